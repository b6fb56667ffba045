"""Queries of text functions, segmentation and identity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import ids as K
from stratalex.functions import matching as M
from stratalex.functions import text as T
from stratalex.functions.text import BLANKS, HAN, SPARSE_NOISE
from stratalex.operators import cleaning as C
from stratalex.operators import intervals as I
from stratalex.operators import joins as J
from stratalex.operators import ranking as R
from stratalex.operators import segments as G
from stratalex.plans.base import ASKED_SQL, BODY_SQL, CIT_SQL, ENT_SQL, HITS_SQL, R_SQL, body, citations, hits, narrow, questions, sq, sql_compact, sql_fold, sql_label, sql_match, sql_strip, sql_tokens
from stratalex.plans.catalog import query
from stratalex.plans.q_aggregates import _CHUNK_SQL
from stratalex.session import table

_TEXT = "coalesce(paragraph_text, '')"


def texts(spark, d):
    return narrow(spark, d, "paragraph_text").select("paragraph_id", F.coalesce("paragraph_text", F.lit("")).alias("t"))


@query(
    "h01_match_forms",
    f"WITH {R_SQL} SELECT paragraph_id, sha256({sql_compact(_TEXT)}) AS compact, sha256({sql_label('paragraph_text')}) AS label, sha256({sql_match(_TEXT)}) AS match, sha256({sql_strip(f'lower({_TEXT})', BLANKS + SPARSE_NOISE)}) AS sparse FROM r",
)
def h01(spark, d):
    forms = {"compact": T.compact("t"), "label": T.label("t"), "match": T.match_form("t"), "sparse": T.sparse_form("t")}
    return texts(spark, d).select("paragraph_id", *[F.sha2(v, 256).alias(k) for k, v in forms.items()])


@query("h02_quote_form", f"WITH {CIT_SQL} SELECT item_id, ord, {sql_match('quote')} AS form FROM cit")
def h02(spark, d):
    return citations(spark, d).select("item_id", "ord", T.match_form("quote").alias("form"))


@query("h03_mojibake_repair", None)
def h03(spark, d):
    n = texts(spark, d)
    return n.select("paragraph_id", M.repair_mojibake(F.col("t")).alias("repaired"), F.col("t")).filter("repaired <> t").drop("t")


@query("h04_digit_folding", f"WITH {R_SQL} SELECT paragraph_id, translate(article, '０１２３４５６７８９', '0123456789') AS folded FROM r WHERE article IS NOT NULL")
def h04(spark, d):
    return narrow(spark, d, "article").filter("article is not null").select("paragraph_id", F.translate("article", "０１２３４５６７８９", "0123456789").alias("folded"))


@query("h05_tokens", f"WITH {R_SQL}, k AS (SELECT paragraph_id, {sql_tokens(_TEXT)} AS k FROM r) SELECT paragraph_id, CAST(len(k) AS INTEGER) AS n, sha256(array_to_string(k, ' ')) AS hash FROM k")
def h05(spark, d):
    k = texts(spark, d).select("paragraph_id", T.tokens("t").alias("k"))
    return k.select("paragraph_id", F.size("k").alias("n"), F.sha2(F.array_join("k", " "), 256).alias("hash"))


_SPARSE = sql_strip(f"lower({ASKED_SQL})", BLANKS + SPARSE_NOISE)


@query(
    "h06_sparse_tokens",
    f"""WITH x AS (SELECT e.item_id, {_SPARSE} AS t FROM eval_items e), k AS (SELECT item_id, list_concat(regexp_extract_all(t, '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(t, '[{HAN}]+'), lambda g: CASE WHEN length(g) <= 2 THEN [g] ELSE list_concat(list_transform(range(1, length(g)), lambda i: substring(g, i, 2)), list_transform(range(1, length(g) - 1), lambda j: substring(g, j, 3))) END))) AS k FROM x)
  SELECT item_id, array_to_string(list_filter(k, lambda v, i: list_position(k, v) = i), ' ') AS tokens FROM k""",
)
def h06(spark, d):
    return questions(spark, d).select("item_id", F.array_join(T.sparse_tokens("asked"), " ").alias("tokens"))


@query("h07_phrases", None)
def h07(spark, d):
    return questions(spark, d).select("item_id", F.array_join(T.phrases("question", ["怎样理解", "的含义", "哪里讨论了", "请给出关于", "的原文和页码", "的论述出自哪一篇"]), "|").alias("phrases"))


@query(
    "h08_han_bigrams",
    f"WITH {R_SQL}, h AS (SELECT paragraph_id, regexp_replace({_TEXT}, '[^{HAN}]+', '', 'g') AS h FROM r) SELECT paragraph_id, CAST(len(list_distinct(list_transform(range(1, length(h)), lambda i: substring(h, i, 2)))) AS INTEGER) AS n FROM h",
)
def h08(spark, d):
    return texts(spark, d).select("paragraph_id", F.size(T.han_bigrams("t")).alias("n"))


@query("h09_lexical_vector", None)
def h09(spark, d):
    k = questions(spark, d).select("item_id", T.sparse_tokens("asked").alias("k"))
    ids = F.transform("k", lambda t: F.xxhash64(t))
    return k.select("item_id", F.to_json(F.map_from_arrays(F.array_distinct(ids), F.transform(F.array_distinct(ids), lambda _: F.lit(1.0)))).alias("vector"))


@query("h10_term_ids", None)
def h10(spark, d):
    t = questions(spark, d).select(F.explode(T.tokens("asked")).alias("term")).distinct()
    return t.select("term", (F.pmod(F.xxhash64("term"), F.lit((1 << 32) - 2)) + 1).alias("term_id"))


@query("h12_fuzzy_windows", None)
def h12(spark, d):
    c = citations(spark, d).select("item_id", T.match_form("quote").alias("q"))
    h = hits(spark, d).select("item_id", "paragraph_id", T.match_form(F.coalesce("paragraph_text", F.lit(""))).alias("t"))
    x = h.join(I.dimension(c), "item_id").withColumn("score", M.fuzzy_score(F.col("q"), F.col("t")))
    return x.groupBy("item_id", "paragraph_id").agg(F.round(F.max("score"), 6).alias("score"), F.max(F.col("score") >= M.FUZZY_LEAST).alias("matched"))


@query("h13_block_coverage", None)
def h13(spark, d):
    c = citations(spark, d).select("item_id", T.match_form("quote").alias("q"))
    h = hits(spark, d).select("item_id", "paragraph_id", T.match_form(F.coalesce("paragraph_text", F.lit(""))).alias("t"))
    x = h.join(I.dimension(c), "item_id").withColumn("cov", M.quote_coverage("q", "t"))
    return x.groupBy("item_id", "paragraph_id").agg(F.max("cov").alias("coverage"))


@query(
    "h14_overlap_score",
    f"""WITH {HITS_SQL}, t AS (SELECT h.item_id, h.paragraph_id, {sql_match('e.question')} AS qn, {sql_match("coalesce(h.paragraph_text, '')")} AS pn FROM hits h JOIN eval_items e USING (item_id)),
  g AS (SELECT item_id, paragraph_id, pn, list_distinct(flatten([list_transform(range(1, length(qn) - 6), lambda i: substring(qn, i, 8)), list_transform(range(1, length(qn) - 4), lambda i: substring(qn, i, 6)), list_transform(range(1, length(qn) - 2), lambda i: substring(qn, i, 4)), list_transform(range(1, length(qn)), lambda i: substring(qn, i, 2))])) AS terms FROM t)
  SELECT item_id, paragraph_id, CAST(coalesce(list_sum(list_transform(list_filter(terms, lambda x: contains(pn, x)), lambda x: length(x) * length(x))), 0) AS BIGINT) AS score FROM g""",
)
def h14(spark, d):
    h = hits(spark, d).join(I.dimension(questions(spark, d).select("item_id", "question")), "item_id")
    return h.select("item_id", "paragraph_id", T.overlap_score(T.match_form("question"), T.match_form(F.coalesce("paragraph_text", F.lit("")))).alias("score"))


@query("h15_snippets", None)
def h15(spark, d):
    c = table(spark, d, "core_classics").select("work_id", F.explode("quotes").alias("q"))
    x = J.containing(narrow(spark, d, "paragraph_text").filter("paragraph_text is not null"), "paragraph_text", c, "q")
    return x.select("paragraph_id", "work_id", M.snippet_around("paragraph_text", "q").alias("snippet"))


@query(
    "h16_previews",
    f"WITH {R_SQL}, k AS (SELECT paragraph_id, trim({sql_strip(_TEXT, BLANKS, ' ')}) AS k FROM r) SELECT paragraph_id, CASE WHEN length(k) > 80 THEN substring(k, 1, 80) || '…' ELSE k END AS preview FROM k",
)
def h16(spark, d):
    return texts(spark, d).select("paragraph_id", T.preview("t", 80).alias("preview"))


@query("h17_compact_lengths", f"WITH {R_SQL} SELECT paragraph_id, CAST(length({sql_compact(_TEXT)}) AS INTEGER) AS n FROM r")
def h17(spark, d):
    return texts(spark, d).select("paragraph_id", F.length(T.compact("t")).alias("n"))


# ---------------------------------------------------------------- segmentation and cleaning


@query("g01_window_chunks", f"WITH {R_SQL}, {BODY_SQL}, {_CHUNK_SQL} SELECT paragraph_id, CAST(child_index AS INTEGER) AS child_index, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", sha256(substring(paragraph_text, s + 1, e - s)) AS chunk_hash FROM ch")
def g01(spark, d):
    c = G.chunked(body(spark, d), "paragraph_id", "paragraph_text")
    return c.select("paragraph_id", "child_index", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.sha2("chunk", 256).alias("chunk_hash"))


@query("g02_recursive_chunks", None)
def g02(spark, d):
    b = body(spark, d).filter(F.length("paragraph_text") > 320)
    return b.select("paragraph_id", F.posexplode(C.recursive_chunks("paragraph_text")).alias("child_index", "c")).select("paragraph_id", "child_index", "c.*")


@query("g03_sentence_packing", None)
def g03(spark, d):
    b = body(spark, d).filter(F.length("paragraph_text") > 320)
    return b.select("paragraph_id", F.posexplode(G.sentence_packed(F.col("paragraph_text"), 320)).alias("part_no", "part"))


@query("g04_page_paragraphs", None)
def g04(spark, d):
    b = body(spark, d).filter(F.contains("paragraph_text", F.lit("\n")))
    return b.select("paragraph_id", F.posexplode(C.page_paragraphs("paragraph_text")).alias("no", "paragraph"))


@query("g05_located_paragraphs", None)
def g05(spark, d):
    b = body(spark, d).filter(F.contains("paragraph_text", F.lit("\n")))
    p = b.select("paragraph_id", "paragraph_text", F.posexplode(C.page_paragraphs("paragraph_text")).alias("no", "paragraph"))
    return p.select("paragraph_id", "no", M.located("paragraph_text", "paragraph").alias("x")).select("paragraph_id", "no", "x.*")


@query(
    "g06_paragraph_records",
    f"WITH {R_SQL} SELECT paragraph_id, source || ' · ' || coalesce(nullif(article, ''), '-') || ' · ' || CASE WHEN pdf_page_end > pdf_page_start THEN pdf_page_start || '-' || pdf_page_end ELSE coalesce(pdf_page_start::VARCHAR, '?') END AS page_range FROM r",
)
def g06(spark, d):
    r = narrow(spark, d, "source", "article", "pdf_page_start", "pdf_page_end")
    pages = F.when(F.col("pdf_page_end") > F.col("pdf_page_start"), F.concat_ws("-", F.col("pdf_page_start").cast("string"), F.col("pdf_page_end").cast("string"))).otherwise(F.coalesce(F.col("pdf_page_start").cast("string"), F.lit("?")))
    return r.select("paragraph_id", F.concat_ws(" · ", "source", F.coalesce(F.nullif("article", F.lit("")), F.lit("-")), pages).alias("page_range"))


@query(
    "g07_page_classifier",
    f"""WITH {R_SQL}, x AS (SELECT paragraph_id, {_TEXT} AS t FROM r), s AS (SELECT paragraph_id, t, len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[0-9]+\\s*$') AND length(l) < 60)) AS numbered, len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '…{{2,}}|\\.{{4,}}'))) AS dotted FROM x)
  SELECT paragraph_id, CASE WHEN trim(t) = '' THEN 'blank' WHEN numbered + 2 * dotted >= 4 THEN 'toc' WHEN length(t) < 30 AND NOT regexp_matches(t, '[。！？.!?]') THEN 'title_page' ELSE 'body' END AS page_class FROM s""",
)
def g07(spark, d):
    return texts(spark, d).select("paragraph_id", C.page_class("t").alias("page_class"))


@query(
    "g08_line_cleaning",
    f"WITH {R_SQL}, l AS (SELECT paragraph_id, unnest(string_split(paragraph_text, chr(10))) AS x, generate_subscripts(string_split(paragraph_text, chr(10)), 1) - 1 AS pos FROM r WHERE page_type = 'toc') SELECT paragraph_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(regexp_replace(x, '[.…·]{{2,}}', ' ', 'g'), '\\s+', ' ', 'g')) AS line FROM l",
)
def g08(spark, d):
    r = narrow(spark, d, "page_type", "paragraph_text").filter("page_type = 'toc'")
    return r.select("paragraph_id", F.posexplode(F.split("paragraph_text", "\n")).alias("pos", "x")).select("paragraph_id", "pos", C.clean_toc_line("x").alias("line"))


@query("g09_margin_regions", None)
def g09(spark, d):
    return C.margin_lines(body(spark, d).filter(F.contains("paragraph_text", F.lit("\n"))), "paragraph_id", "paragraph_text")


@query(
    "g10_page_number_candidates",
    f"""WITH {R_SQL}, l AS (SELECT paragraph_id, pdf_page_start, translate(trim(unnest(string_split(paragraph_text, chr(10)))), '０１２３４５６７８９', '0123456789') AS x, generate_subscripts(string_split(paragraph_text, chr(10)), 1) - 1 AS pos FROM r),
  k AS (SELECT *, CASE WHEN regexp_matches(x, '^[-—·\\[\\s]*[0-9]{{1,4}}[-—·\\]\\s]*$') THEN 'line' WHEN regexp_matches(x, '^[0-9]{{1,4}}[　 ·]') THEN 'left' WHEN regexp_matches(x, '[　 ][0-9]{{1,4}}$') THEN 'right' END AS how FROM l),
  v AS (SELECT paragraph_id, pos, how, pdf_page_start, CAST(CASE how WHEN 'right' THEN regexp_extract(x, '([0-9]{{1,4}})$', 1) ELSE regexp_extract(x, '([0-9]{{1,4}})', 1) END AS INTEGER) AS page FROM k WHERE how IS NOT NULL)
  SELECT paragraph_id, CAST(pos AS INTEGER) AS pos, how, page, pdf_page_start - page BETWEEN -80 AND 220 AS plausible FROM v WHERE page BETWEEN 1 AND 1200""",
)
def g10(spark, d):
    r = narrow(spark, d, "pdf_page_start", "paragraph_text")
    return C.page_candidates(r, "paragraph_id", "paragraph_text", "pdf_page_start")


@query(
    "g11_page_validity",
    f"WITH {R_SQL} SELECT paragraph_id, pdf_page_start - printed_page_start BETWEEN -5 AND 140 AS strict_window, pdf_page_start - printed_page_start BETWEEN -80 AND 220 AS wide_window, printed_page_start - pdf_page_start BETWEEN -60 AND 160 AS catalog_window FROM r WHERE printed_page_start IS NOT NULL AND pdf_page_start IS NOT NULL",
)
def g11(spark, d):
    r = narrow(spark, d, "printed_page_start", "pdf_page_start").filter("printed_page_start is not null and pdf_page_start is not null")
    off = F.col("pdf_page_start") - F.col("printed_page_start")
    return r.select("paragraph_id", off.between(-5, 140).alias("strict_window"), off.between(-80, 220).alias("wide_window"), (-off).between(-60, 160).alias("catalog_window"))


@query(
    "g12_printed_page_inference",
    f"""WITH {R_SQL}, l AS (SELECT paragraph_id, pdf_page_start, translate(trim(unnest(string_split(paragraph_text, chr(10)))), '０１２３４５６７８９', '0123456789') AS x, generate_subscripts(string_split(paragraph_text, chr(10)), 1) - 1 AS pos FROM r),
  k AS (SELECT *, CASE WHEN regexp_matches(x, '^[-—·\\[\\s]*[0-9]{{1,4}}[-—·\\]\\s]*$') THEN 'line' WHEN regexp_matches(x, '^[0-9]{{1,4}}[　 ·]') THEN 'left' WHEN regexp_matches(x, '[　 ][0-9]{{1,4}}$') THEN 'right' END AS how FROM l),
  v AS (SELECT paragraph_id, pos, how, pdf_page_start, CAST(CASE how WHEN 'right' THEN regexp_extract(x, '([0-9]{{1,4}})$', 1) ELSE regexp_extract(x, '([0-9]{{1,4}})', 1) END AS INTEGER) AS page FROM k WHERE how IS NOT NULL)
  SELECT paragraph_id, page FROM v WHERE page BETWEEN 1 AND 1200 AND pdf_page_start - page BETWEEN -80 AND 220 QUALIFY row_number() OVER (PARTITION BY paragraph_id ORDER BY CASE how WHEN 'line' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, pos, page) = 1""",
)
def g12(spark, d):
    c = C.page_candidates(narrow(spark, d, "pdf_page_start", "paragraph_text"), "paragraph_id", "paragraph_text", "pdf_page_start").filter("plausible")
    order = F.when(F.col("how") == "line", 0).when(F.col("how") == "left", 1).otherwise(2)
    return R.first_per(c, ["paragraph_id"], [order.asc(), F.asc("pos"), F.asc("page")]).select("paragraph_id", "page")


@query(
    "g13_toc_entries",
    f"""WITH {R_SQL}, l AS (SELECT paragraph_id, trim(unnest(string_split(paragraph_text, chr(10)))) AS x, generate_subscripts(string_split(paragraph_text, chr(10)), 1) - 1 AS pos FROM r WHERE page_type = 'toc'), e AS (SELECT *, regexp_matches(x, '[0-9]+\\s*$') AS ends FROM l WHERE x <> ''),
  g AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY paragraph_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM e)
  SELECT paragraph_id, CAST(grp AS BIGINT) AS grp, string_agg(x, ' ' ORDER BY pos) AS entry FROM g GROUP BY paragraph_id, grp HAVING bool_or(ends)""",
)
def g13(spark, d):
    return C.toc_entries(narrow(spark, d, "page_type", "paragraph_text").filter("page_type = 'toc'"), "paragraph_id", "paragraph_text")


@query("g14_title_cleaning", f"WITH {R_SQL}, a AS (SELECT DISTINCT article FROM r WHERE article IS NOT NULL) SELECT article, trim(regexp_replace(regexp_replace(article, '[.…·]{{2,}}.*$', ''), '^[\\s●○•\\-*]+', '')) AS title FROM a")
def g14(spark, d):
    a = table(spark, d, "records").select("article").filter("article is not null").distinct()
    return a.select("article", C.clean_title("article").alias("title"))


@query(
    "g15_book_parts",
    "SELECT source, series, volume, regexp_extract(source, '^([a-z]+)', 1) AS family, CAST(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS INTEGER) AS volume_no, CAST(nullif(regexp_extract(volume, '第([0-9]+)卷', 1), '') AS INTEGER) AS named_no FROM editions",
)
def g15(spark, d):
    e = table(spark, d, "editions")
    number = lambda x, p: K.to_int(F.nullif(F.regexp_extract(x, p, 1), F.lit("")))
    return e.select("source", "series", "volume", F.regexp_extract("source", "^([a-z]+)", 1).alias("family"), number("source", "([0-9]+)").alias("volume_no"), number("volume", "第([0-9]+)卷").alias("named_no"))


@query(
    "g16_metadata_normalization",
    f"""WITH {R_SQL} SELECT r.paragraph_id, coalesce(nullif(trim(r.article), ''), a.title, '未知篇名') AS article, coalesce(r.volume, e.volume, '') AS volume, coalesce(r.printed_page_start, r.citation_page_start, r.pdf_page_start) AS page FROM r LEFT JOIN editions e USING (source)
  LEFT JOIN (SELECT source, arg_min(title, entry_no) AS title FROM article_map WHERE entry_level = 1 GROUP BY source) a USING (source)""",
)
def g16(spark, d):
    r = narrow(spark, d, "source", "article", "volume", "printed_page_start", "citation_page_start", "pdf_page_start")
    e = table(spark, d, "editions").select("source", F.col("volume").alias("ev"))
    a = table(spark, d, "article_map").filter("entry_level = 1").groupBy("source").agg(F.min_by("title", "entry_no").alias("title"))
    out = r.join(I.dimension(e), "source", "left").join(I.dimension(a), "source", "left")
    article = F.coalesce(F.nullif(F.trim("article"), F.lit("")), "title", F.lit("未知篇名"))
    return out.select("paragraph_id", article.alias("article"), F.coalesce("volume", "ev", F.lit("")).alias("volume"), F.coalesce("printed_page_start", "citation_page_start", "pdf_page_start").alias("page"))


@query("g17_title_types", "SELECT entry_no, CASE WHEN regexp_matches(title, '^致.*信') THEN 'letter' WHEN regexp_matches(title, '(目录|注释|索引)$') THEN 'non_body' ELSE 'article' END AS kind FROM article_map")
def g17(spark, d):
    return table(spark, d, "article_map").select("entry_no", C.title_kind("title").alias("kind"))


@query(
    "g18_locator_table",
    f"""WITH {R_SQL}, t AS (SELECT source, printed_page_start AS p, min(pdf_page_start) AS pdf FROM r WHERE printed_page_start IS NOT NULL AND pdf_page_start IS NOT NULL GROUP BY ALL), m AS (SELECT *, CASE WHEN regexp_matches(title, '^致.*信') THEN 'letter' WHEN regexp_matches(title, '(目录|注释|索引)$') THEN 'non_body' ELSE 'article' END AS kind FROM article_map WHERE end_printed_page >= start_printed_page)
  SELECT m.entry_no, m.source, m.kind, m.start_printed_page AS s, m.end_printed_page AS e, t.pdf + m.start_printed_page - t.p AS pdf_start FROM m LEFT JOIN t ON t.source = m.source AND abs(t.p - m.start_printed_page) <= 3 QUALIFY row_number() OVER (PARTITION BY m.entry_no ORDER BY abs(t.p - m.start_printed_page), t.p, t.pdf) = 1""",
)
def g18(spark, d):
    from stratalex.operators.joins import nearest

    t = table(spark, d, "records").filter("printed_page_start is not null and pdf_page_start is not null").groupBy("source", F.col("printed_page_start").alias("p")).agg(F.min("pdf_page_start").alias("pdf"))
    m = table(spark, d, "article_map").filter("end_printed_page >= start_printed_page").select("entry_no", "source", C.title_kind("title").alias("kind"), F.col("start_printed_page").alias("s"), F.col("end_printed_page").alias("e"))
    near = nearest(m, t, "entry_no", "source", "s", "p", "pdf", 3).select("entry_no", (F.col("pdf") + F.col("s") - F.col("p")).alias("pdf_start"))
    return m.join(near, "entry_no", "left")


@query("g19_length_buckets", f"WITH {R_SQL} SELECT CASE WHEN length({_TEXT}) < 120 THEN 'short' WHEN length({_TEXT}) <= 600 THEN 'medium' ELSE 'long' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1")
def g19(spark, d):
    return texts(spark, d).groupBy(T.length_bucket("t").alias("bucket")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- identity, hashing, JSON


@query(
    "k01_paragraph_ids",
    f"""WITH {R_SQL} SELECT paragraph_id, 'par_' || substring(sha256('{{' || CASE WHEN pdf_page_end IS NULL THEN '' ELSE '"page_end":' || pdf_page_end || ',' END || CASE WHEN pdf_page_start IS NULL THEN '' ELSE '"page_start":' || pdf_page_start || ',' END || '"segmentation_major":2,"source":"' || source || '","text_sha256":"' || sha256({_TEXT}) || '"}}'), 1, 32) AS stable_id FROM r""",
)
def k01(spark, d):
    r = narrow(spark, d, "source", "paragraph_text", "pdf_page_start", "pdf_page_end")
    return r.select("paragraph_id", K.paragraph_id(F.col("source"), F.col("paragraph_text"), F.col("pdf_page_start"), F.col("pdf_page_end")).alias("stable_id"))


@query(
    "k02_retrieval_ids",
    f"""WITH {R_SQL}, {BODY_SQL}, {_CHUNK_SQL} SELECT paragraph_id, CAST(child_index AS INTEGER) AS child_index, 'ret_' || substring(sha256('{{"indexed_text_sha256":"' || sha256(substring(paragraph_text, s + 1, e - s)) || '","parent_char_end":' || e || ',"parent_char_start":' || s || ',"parent_paragraph_id":"' || paragraph_id || '"}}'), 1, 32) AS retrieval_id FROM ch""",
)
def k02(spark, d):
    c = G.chunked(body(spark, d), "paragraph_id", "paragraph_text")
    return c.select("paragraph_id", "child_index", K.retrieval_id(F.col("paragraph_id"), F.col("start"), F.col("end"), F.col("chunk")).alias("retrieval_id"))


@query("k03_explicit_or_hashed_id", f"WITH {R_SQL} SELECT paragraph_id, coalesce(nullif(trim(parent_paragraph_id), ''), 'mr2_' || substring(sha256(source || '|' || coalesce(pdf_page_start::VARCHAR, '') || '|' || coalesce(paragraph_index::VARCHAR, '')), 1, 32)) AS record_id FROM r")
def k03(spark, d):
    r = narrow(spark, d, "parent_paragraph_id", "source", "pdf_page_start", "paragraph_index")
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    return r.select("paragraph_id", K.explicit_or_hashed(F.col("parent_paragraph_id"), F.concat_ws("|", "source", blank("pdf_page_start"), blank("paragraph_index"))).alias("record_id"))


@query("k04_article_ids", "SELECT entry_no, 'art_' || substring(sha256(source || chr(31) || title || chr(31) || start_printed_page || chr(31) || end_printed_page), 1, 32) AS article_id FROM article_map")
def k04(spark, d):
    return table(spark, d, "article_map").select("entry_no", K.article_id(F.col("source"), F.col("title"), F.col("start_printed_page"), F.col("end_printed_page")).alias("article_id"))


@query("k05_canonical_json", """SELECT source, '{"edition_id":"' || edition_id || '","series":"' || series || '","source":"' || source || '"}' AS json FROM editions""")
def k05(spark, d):
    return table(spark, d, "editions").select("source", K.canonical_json(source=F.col("source"), series=F.col("series"), edition_id=F.col("edition_id")).alias("json"))


@query("k06_safe_casts", "SELECT work_id, TRY_CAST(work_year AS INTEGER) AS year, TRY_CAST(title AS INTEGER) AS none FROM core_classics")
def k06(spark, d):
    return table(spark, d, "core_classics").select("work_id", K.to_int(F.col("work_year")).alias("year"), K.to_int(F.col("title")).alias("none"))


@query("k07_days", "WITH q AS (SELECT DISTINCT * EXCLUDE (received_at) FROM request_metrics) SELECT request_id, CAST(to_timestamp(ts) AS DATE)::VARCHAR AS day FROM q")
def k07(spark, d):
    return table(spark, d, "request_metrics").select("request_id", K.day_of(F.col("ts")).cast("string").alias("day")).distinct()


@query("k08_math", "SELECT entry_no, round(ln(1 + start_printed_page), 6) AS log1p, round(start_printed_page + (end_printed_page - start_printed_page) * 0.25::DOUBLE, 6) AS quarter, round_even(start_printed_page / 2.0::DOUBLE, 0) AS bankers FROM article_map")
def k08(spark, d):
    m, s, e = table(spark, d, "article_map"), F.col("start_printed_page"), F.col("end_printed_page")
    return m.select("entry_no", F.round(F.log1p(s), 6).alias("log1p"), F.round(s + (e - s) * 0.25, 6).alias("quarter"), F.bround(s / 2.0, 0).alias("bankers"))


@query("k09_ordered_union_of_arrays", f"WITH {R_SQL} SELECT paragraph_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS pages FROM (SELECT paragraph_id, list_concat(coalesce(page_span, []), [pdf_page_start, pdf_page_end]) AS v FROM r WHERE pdf_page_start IS NOT NULL AND pdf_page_end IS NOT NULL)")
def k09(spark, d):
    r = narrow(spark, d, "page_span", "pdf_page_start", "pdf_page_end").filter("pdf_page_start is not null and pdf_page_end is not null")
    v = F.array_distinct(F.concat(F.coalesce("page_span", F.array().cast("array<int>")), F.array("pdf_page_start", "pdf_page_end")))
    return r.select("paragraph_id", F.array_join(F.transform(v, lambda x: x.cast("string")), ",").alias("pages"))
