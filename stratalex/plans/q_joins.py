"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import ids as K
from stratalex.functions import text as T
from stratalex.operators import intervals as I
from stratalex.operators import joins as J
from stratalex.operators import ranking as R
from stratalex.plans.base import (
    ASKED_SQL, CHANNELS_SQL, CIT_SQL, ENT_SQL, HITS_SQL, R_SQL, citations, entries, hits, narrow, questions, records, sq, sql_grams, sql_label, sql_match, text_channel,
    title_channel,
)
from stratalex.plans.catalog import query
from stratalex.session import table


def _map(spark, d):
    return table(spark, d, "article_map").select(
        "entry_no", F.col("source").alias("m_source"), "title", F.col("start_printed_page").alias("s"), F.col("end_printed_page").alias("e"), "entry_level", "parent_title"
    )


def _article_map(spark, d):
    return _map(spark, d).withColumnRenamed("m_source", "source")


@query(
    "j01_parent_window",
    f"""WITH {HITS_SQL}, h AS (SELECT DISTINCT paragraph_id AS hit, source, paragraph_index FROM hits WHERE rank = 1)
  SELECT h.hit, CAST(count(*) AS INTEGER) AS n_parts, sha256(string_agg(coalesce(r.paragraph_text, ''), chr(10) || chr(10) ORDER BY r.paragraph_index, r.paragraph_id)) AS window_hash,
  min(r.paragraph_index) AS first_index, max(r.paragraph_index) AS last_index FROM h JOIN r ON r.source = h.source AND r.paragraph_index BETWEEN h.paragraph_index - 2 AND h.paragraph_index + 2 GROUP BY h.hit""",
)
def j01(spark, d):
    h = hits(spark, d).filter("rank = 1").select("paragraph_id", "source", "paragraph_index").distinct()
    p = narrow(spark, d, "source", "paragraph_index", "paragraph_text")
    w = J.neighbour_windows(h, p, "source", "paragraph_index", "paragraph_id", "paragraph_text", 2)
    return w.select("hit", "n_parts", F.sha2("window_text", 256).alias("window_hash"), "first_index", "last_index")


@query(
    "j02_small_to_big",
    f"""WITH {HITS_SQL}, x AS (SELECT h.item_id, h.rank, coalesce(p.paragraph_id, h.paragraph_id) AS unit_id, p.paragraph_id IS NOT NULL AS expanded FROM hits h LEFT JOIN r p ON h.paragraph_id <> p.paragraph_id
  AND p.paragraph_id = (SELECT any_value(c.parent_paragraph_id) FROM r c WHERE c.paragraph_id = h.paragraph_id) AND p.page_type = 'body')
  SELECT item_id, unit_id, rank, expanded FROM x QUALIFY row_number() OVER (PARTITION BY item_id, unit_id ORDER BY rank) = 1""",
)
def j02(spark, d):
    up = narrow(spark, d, "parent_paragraph_id").filter("parent_paragraph_id is not null and parent_paragraph_id <> paragraph_id")
    body = narrow(spark, d, "page_type").filter("page_type = 'body'").select(F.col("paragraph_id").alias("parent_paragraph_id"))
    x = hits(spark, d).select("item_id", "rank", "paragraph_id").join(up.join(body, "parent_paragraph_id"), "paragraph_id", "left")
    x = x.select("item_id", F.coalesce("parent_paragraph_id", "paragraph_id").alias("unit_id"), "rank", F.col("parent_paragraph_id").isNotNull().alias("expanded"))
    return R.first_per(x, ["item_id", "unit_id"], [F.asc("rank")])


_PAGE_SQL = "coalesce(printed_page_start, CASE WHEN citation_page_type = 'printed_page' THEN citation_page_start END)"


def _paged(spark, d, *more):
    r = narrow(spark, d, "source", "article", "page_type", "printed_page_start", "citation_page_type", "citation_page_start", *more)
    page = F.coalesce("printed_page_start", F.when(F.col("citation_page_type") == "printed_page", F.col("citation_page_start")))
    return r.withColumn("page", page)


@query(
    "j03_bibliography_enrichment",
    f"""WITH {R_SQL}, p AS (SELECT paragraph_id, source, article, {_PAGE_SQL} AS page FROM r WHERE page_type = 'body'),
  m AS (SELECT p.paragraph_id, a.entry_no, a.title FROM p JOIN article_map a ON a.source = p.source AND p.page BETWEEN a.start_printed_page AND a.end_printed_page AND {sql_label('a.title')} = {sql_label('p.article')} AND {sql_label('p.article')} <> ''
  QUALIFY row_number() OVER (PARTITION BY p.paragraph_id ORDER BY a.end_printed_page - a.start_printed_page, a.start_printed_page, a.title, a.entry_no) = 1)
  SELECT p.paragraph_id, e.series, e.edition_id, e.publisher, e.publication_year, m.entry_no, CASE WHEN m.entry_no IS NULL THEN 0.0::DOUBLE ELSE 0.95::DOUBLE END AS article_confidence,
  CASE WHEN e.series IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS series_confidence FROM p LEFT JOIN editions e USING (source) LEFT JOIN m USING (paragraph_id)""",
)
def j03(spark, d):
    p = _paged(spark, d).filter("page_type = 'body'").withColumn("_label", T.label("article"))
    titled = p.filter("_label <> ''").select("paragraph_id", "source", "page", "_label")
    # the label is part of the equi-join, so pages meet only intervals of their own title
    m = _article_map(spark, d).withColumn("_label", T.label("title"))
    keyed = lambda df: df.withColumn("_on", F.concat_ws("\u001f", "source", "_label"))
    found = I.interval_join(keyed(titled).drop("source", "_label"), I.dimension(keyed(m).drop("source", "_label")), "_on", F.col("page"), "s", "e")
    best = R.first_per(found, ["paragraph_id"], [(F.col("e") - F.col("s")).asc(), F.asc("s"), F.asc("title"), F.asc("entry_no")]).select("paragraph_id", "entry_no")
    e = I.dimension(table(spark, d, "editions").select("source", "series", "edition_id", "publisher", "publication_year"))
    out = p.join(e, "source", "left").join(best, "paragraph_id", "left")
    return out.select(
        "paragraph_id", "series", "edition_id", "publisher", "publication_year", "entry_no",
        F.when(F.col("entry_no").isNull(), 0.0).otherwise(0.95).alias("article_confidence"), F.when(F.col("series").isNull(), 0.0).otherwise(1.0).alias("series_confidence"),
    )


@query(
    "j04_unique_interval",
    f"""WITH {R_SQL}, {ENT_SQL}, p AS (SELECT paragraph_id, source, {_PAGE_SQL} AS page FROM r)
  SELECT p.paragraph_id, min(e.work_id) AS work_id FROM p JOIN ent e ON e.source = p.source AND p.page BETWEEN e.start_page AND e.end_page GROUP BY p.paragraph_id HAVING count(DISTINCT e.work_id) = 1""",
)
def j04(spark, d):
    p = _paged(spark, d).select("paragraph_id", "source", "page")
    found = I.interval_join(p, I.dimension(entries(spark, d).select("work_id", "source", "start_page", "end_page")), "source", F.col("page"), "start_page", "end_page")
    return J.known_only_once(found, "paragraph_id", "work_id")


@query(
    "j05_interval_stabbing",
    f"""WITH {R_SQL}, p AS (SELECT paragraph_id, source, {_PAGE_SQL} AS page FROM r)
  SELECT p.paragraph_id, a.title, a.entry_no FROM p JOIN article_map a ON a.source = p.source AND p.page BETWEEN a.start_printed_page AND a.end_printed_page
  QUALIFY row_number() OVER (PARTITION BY p.paragraph_id ORDER BY a.end_printed_page - a.start_printed_page, a.start_printed_page, a.entry_level DESC, length(a.title) DESC, a.entry_no) = 1""",
)
def j05(spark, d):
    p = _paged(spark, d).select("paragraph_id", "source", "page")
    tie = [F.desc("entry_level"), F.length("title").desc(), F.asc("entry_no")]
    return J.narrowest_interval(p, _article_map(spark, d), "paragraph_id", "source", F.col("page"), "s", "e", tie, "inner").select("paragraph_id", "title", "entry_no")


@query("j06_edition_lookup", f"WITH {R_SQL} SELECT r.paragraph_id, e.series, e.edition_id, e.volume FROM r LEFT JOIN editions e USING (source)")
def j06(spark, d):
    e = R.first_per(table(spark, d, "editions").select("source", "series", "edition_id", "volume"), ["source"], [F.asc("edition_id")])
    return narrow(spark, d, "source").join(I.dimension(e), "source", "left").select("paragraph_id", "series", "edition_id", "volume")


@query(
    "j07_hybrid_merge",
    f"""WITH {HITS_SQL}, {CHANNELS_SQL} SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.paragraph_id, b.paragraph_id) AS paragraph_id, a.rank AS dense_rank, b.rank AS sparse_rank,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce((CASE WHEN a.rank IS NOT NULL THEN 1.15::DOUBLE ELSE 0.72::DOUBLE END) / (55 + b.rank), 0), 6) AS score,
  CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'fused' WHEN b.rank IS NOT NULL THEN 'sparse' ELSE 'dense' END AS tag
  FROM dense a FULL JOIN sparse b ON a.item_id = b.item_id AND a.paragraph_id = b.paragraph_id""",
)
def j07(spark, d):
    return J.hybrid_merge(title_channel(spark, d), text_channel(spark, d, 8), "item_id", "paragraph_id")


@query(
    "j08_constraint_annotation",
    f"""WITH {HITS_SQL}, {ENT_SQL} SELECT h.item_id, h.paragraph_id, e.work_id, e.ord FROM hits h JOIN ent e ON e.source = h.source AND h.page BETWEEN e.start_page - 2 AND e.end_page + 2
  QUALIFY row_number() OVER (PARTITION BY h.item_id, h.paragraph_id ORDER BY e.priority DESC, e.work_id, e.ord) = 1""",
)
def j08(spark, d):
    e = entries(spark, d).select("work_id", "ord", "source", "priority", (F.col("start_page") - 2).alias("lo"), (F.col("end_page") + 2).alias("hi"))
    h = hits(spark, d).select("item_id", "paragraph_id", "source", "page")
    found = I.interval_join(h, I.dimension(e), "source", F.col("page"), "lo", "hi")
    return R.first_per(found, ["item_id", "paragraph_id"], [F.desc("priority"), F.asc("work_id"), F.asc("ord")]).select("item_id", "paragraph_id", "work_id", "ord")


@query(
    "j09_printed_to_pdf",
    f"WITH {R_SQL}, {CIT_SQL} SELECT c.item_id, c.ord, min(r.pdf_page_start) AS pdf_page FROM cit c JOIN r ON r.source = c.source AND r.printed_page_start = c.citation_page GROUP BY ALL",
)
def j09(spark, d):
    c = citations(spark, d).select("item_id", "ord", "source", F.col("citation_page").alias("printed_page_start"))
    r = narrow(spark, d, "source", "printed_page_start", "pdf_page_start")
    return r.join(I.dimension(c), ["source", "printed_page_start"]).groupBy("item_id", "ord").agg(F.min("pdf_page_start").alias("pdf_page"))


@query(
    "j10_nearest_page",
    f"""WITH {R_SQL}, {CIT_SQL}, t AS (SELECT DISTINCT source, printed_page_start AS p, pdf_page_start AS pdf FROM r WHERE printed_page_start IS NOT NULL AND pdf_page_start IS NOT NULL)
  SELECT c.item_id, c.ord, t.pdf + (c.citation_page - t.p) AS pdf_page, abs(c.citation_page - t.p) AS off FROM cit c JOIN t ON t.source = c.source AND abs(c.citation_page - t.p) <= 3
  QUALIFY row_number() OVER (PARTITION BY c.item_id, c.ord ORDER BY abs(c.citation_page - t.p), t.p, t.pdf) = 1""",
)
def j10(spark, d):
    t = table(spark, d, "records").filter("printed_page_start is not null and pdf_page_start is not null").select("source", F.col("printed_page_start").alias("p"), F.col("pdf_page_start").alias("pdf")).distinct()
    c = citations(spark, d).select(F.struct("item_id", "ord").alias("k"), "source", "citation_page").filter("citation_page is not null")
    best = J.nearest(c, t, "k", "source", "citation_page", "p", "pdf", 3)
    return best.select("k.item_id", "k.ord", (F.col("pdf") + F.col("citation_page") - F.col("p")).alias("pdf_page"), F.abs(F.col("citation_page") - F.col("p")).alias("off"))


@query(
    "j11_title_containment",
    f"""WITH n AS (SELECT work_id, 0 AS stage, {sql_match('title')} AS k, 4 AS least FROM core_classics UNION ALL SELECT work_id, 2, {sql_match('a')}, 3 FROM (SELECT work_id, unnest(aliases) AS a FROM core_classics)
  UNION ALL SELECT work_id, 1, substring({sql_match('qt')}, 1, 12), 12 FROM (SELECT work_id, unnest(quotes) AS qt FROM core_classics))
  SELECT e.item_id, n.work_id, n.stage FROM eval_items e JOIN n ON length(n.k) >= n.least AND contains({sql_match(ASKED_SQL)}, n.k)
  QUALIFY row_number() OVER (PARTITION BY e.item_id ORDER BY n.stage, length(n.k) DESC, n.work_id) = 1""",
)
def j11(spark, d):
    c = table(spark, d, "core_classics")
    title = c.select("work_id", F.lit(0).alias("stage"), T.match_form("title").alias("k"), F.lit(4).alias("least"))
    part = lambda column, stage, key, least: c.select("work_id", F.explode(column).alias("x")).select("work_id", F.lit(stage).alias("stage"), key.alias("k"), F.lit(least).alias("least"))
    quote = part("quotes", 1, F.substring(T.match_form("x"), 1, 12), 12)
    alias = part("aliases", 2, T.match_form("x"), 3)
    keys = title.unionByName(quote).unionByName(alias).filter(F.length("k") >= F.col("least"))
    found = J.containing(questions(spark, d).select("item_id", T.match_form("asked").alias("qn")), "qn", keys, "k")
    return R.first_per(found, ["item_id"], [F.asc("stage"), F.length("k").desc(), F.asc("work_id")]).select("item_id", "work_id", "stage")


@query(
    "j12_concept_score",
    f"""WITH k AS (SELECT work_id, unnest(aliases) AS a, generate_subscripts(aliases, 1) AS i FROM core_classics), m AS (SELECT e.item_id, k.work_id, CASE WHEN k.i = 1 THEN 100 ELSE 10 END AS p FROM eval_items e JOIN k ON length(k.a) >= 2 AND contains({ASKED_SQL}, k.a))
  SELECT item_id, work_id, CAST(max(p) + 2 * count(*) AS BIGINT) AS score FROM m GROUP BY ALL HAVING max(p) + 2 * count(*) >= 22""",
)
def j12(spark, d):
    k = table(spark, d, "core_classics").select("work_id", F.posexplode("aliases").alias("i", "a")).filter(F.length("a") >= 2)
    m = J.containing(questions(spark, d).select("item_id", "asked"), "asked", k, "a")
    return m.groupBy("item_id", "work_id").agg((F.max(F.when(F.col("i") == 0, 100).otherwise(10)) + 2 * F.count("*")).cast("long").alias("score")).filter("score >= 22")


@query(
    "j13_parallel_entries",
    f"""WITH a AS (SELECT entry_no, title, {sql_match('title')} AS k FROM article_map), c AS (SELECT work_id, {sql_match('title')} AS k FROM core_classics)
  SELECT c.work_id, a.entry_no, CASE WHEN a.k = c.k THEN 0 WHEN suffix(a.k, c.k) THEN 1 ELSE 2 END AS preference FROM a JOIN c ON a.k = c.k OR (length(c.k) >= 4 AND contains(a.k, c.k)) OR (length(a.k) >= 6 AND contains(c.k, a.k))""",
)
def j13(spark, d):
    a = table(spark, d, "article_map").select("entry_no", T.match_form("title").alias("ak"))
    c = table(spark, d, "core_classics").select("work_id", T.match_form("title").alias("ck"))
    rank = F.when(F.col("ak") == F.col("ck"), 0).when(F.endswith("ak", "ck"), 1).otherwise(2)
    entry_holds = J.containing(a, "ak", c.filter(F.length("ck") >= 4), "ck").select("entry_no", "ak", "work_id", "ck")
    work_holds = J.containing(c, "ck", a.filter(F.length("ak") >= 6), "ak").select("entry_no", "ak", "work_id", "ck")
    equal = a.join(c, F.col("ak") == F.col("ck")).select("entry_no", "ak", "work_id", "ck")
    return entry_holds.unionByName(work_holds).unionByName(equal).distinct().select("work_id", "entry_no", rank.alias("preference"))


@query(
    "j14_locator_rules",
    f"""WITH rules AS (SELECT entry_no, {sql_label('title')} AS t FROM article_map), m AS (SELECT e.item_id, r.entry_no, length(r.t) AS n FROM eval_items e JOIN rules r ON length(r.t) >= 4 AND contains({sql_label(ASKED_SQL)}, r.t)),
  k AS (SELECT item_id, entry_no, n, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, entry_no) AS rank FROM m) SELECT item_id, entry_no, rank, count(*) OVER (PARTITION BY item_id) > 1 AS ambiguous FROM k WHERE rank <= 8""",
)
def j14(spark, d):
    rules = table(spark, d, "article_map").select("entry_no", T.label("title").alias("t")).filter(F.length("t") >= 4)
    m = J.containing(questions(spark, d).select("item_id", T.label("asked").alias("q")), "q", rules, "t")
    k = R.top_k(m, ["item_id"], [F.length("t").desc(), F.asc("entry_no")], 8)
    return k.select("item_id", "entry_no", "rank", (F.count("*").over(Window.partitionBy("item_id")) > 1).alias("ambiguous"))


@query(
    "j15_quote_containment",
    f"""WITH {CIT_SQL}, n AS (SELECT doc_id, {sql_match('text')} AS t FROM documents) SELECT DISTINCT c.item_id, n.doc_id FROM cit c JOIN n ON length({sql_match('c.quote')}) >= 12 AND contains(n.t, {sql_match('c.quote')})""",
)
def j15(spark, d):
    q = citations(spark, d).select("item_id", T.match_form("quote").alias("qn")).filter(F.length("qn") >= 12).distinct()
    n = table(spark, d, "documents").select("doc_id", T.match_form("text").alias("t")).filter(F.length("t") >= 12)
    return J.containing(n, "t", q, "qn").select("item_id", "doc_id").distinct()


_BIG = "list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)))"


@query(
    "j16_bigram_candidates",
    f"""WITH {R_SQL}, {CIT_SQL}, qs AS (SELECT item_id, ord, regexp_replace(quote, '[^一-鿿]+', '', 'g') AS h FROM cit WHERE quote IS NOT NULL AND item_id % 20 = 0), qg AS (SELECT item_id, ord, unnest({_BIG.format('h')}) AS g FROM qs),
  ps AS (SELECT paragraph_id, regexp_replace(paragraph_text, '[^一-鿿]+', '', 'g') AS h FROM r), pg AS (SELECT paragraph_id, unnest({_BIG.format('h')}) AS g FROM ps),
  n AS (SELECT item_id, ord, paragraph_id, count(*) AS shared FROM qg JOIN pg USING (g) GROUP BY ALL) SELECT item_id, ord, paragraph_id, shared, row_number() OVER (PARTITION BY item_id, ord ORDER BY shared DESC, paragraph_id) AS rank FROM n QUALIFY rank <= 5""",
)
def j16(spark, d):
    q = citations(spark, d).filter("quote is not null and item_id % 20 = 0").select(F.struct("item_id", "ord").alias("q"), "quote")
    p = narrow(spark, d, "paragraph_text")
    return J.gram_candidates(p, "paragraph_id", F.col("paragraph_text"), q, "q", F.col("quote"), 5).select("q.item_id", "q.ord", "paragraph_id", "shared", "rank")


@query(
    "j17_evidence_citation",
    f"""WITH {HITS_SQL}, ev AS (SELECT item_id, paragraph_id, source, article, page, rank FROM hits) SELECT c.item_id, c.ord, ev.paragraph_id FROM cit c JOIN ev ON ev.item_id = c.item_id
  AND ((length({sql_label('c.article')}) >= 2 AND (contains({sql_label('ev.article')}, {sql_label('c.article')}) OR (length({sql_label('ev.article')}) >= 2 AND contains({sql_label('c.article')}, {sql_label('ev.article')})))) OR (ev.page = c.citation_page AND ev.source = c.source))
  QUALIFY row_number() OVER (PARTITION BY c.item_id, c.ord ORDER BY ev.rank) = 1""",
)
def j17(spark, d):
    ev = hits(spark, d).select("item_id", "paragraph_id", F.col("source").alias("es"), T.label("article").alias("ea"), "page", "rank")
    c = citations(spark, d).select("item_id", "ord", "source", "citation_page", T.label("article").alias("ca"))
    title = (F.length("ca") >= 2) & (F.contains("ea", "ca") | ((F.length("ea") >= 2) & F.contains("ca", "ea")))
    m = ev.join(c, "item_id").filter(title | ((F.col("page") == F.col("citation_page")) & (F.col("es") == F.col("source"))))
    return R.first_per(m, ["item_id", "ord"], [F.asc("rank")]).select("item_id", "ord", "paragraph_id")


@query(
    "j18_lineage_check",
    f"""WITH {R_SQL}, s AS (SELECT paragraph_id, parent_paragraph_id, paragraph_text, paragraph_char_count, pdf_page_start, pdf_page_end FROM r)
  SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE parent_paragraph_id IS NOT NULL AND parent_paragraph_id NOT IN (SELECT paragraph_id FROM r)) AS BIGINT) AS orphans,
  CAST(count(*) FILTER (WHERE paragraph_char_count <> length(paragraph_text)) AS BIGINT) AS wrong_counts, CAST(count(*) FILTER (WHERE pdf_page_end < pdf_page_start) AS BIGINT) AS reversed FROM s""",
)
def j18(spark, d):
    r = narrow(spark, d, "parent_paragraph_id", "paragraph_text", "paragraph_char_count", "pdf_page_start", "pdf_page_end")
    known = r.select(F.col("paragraph_id").alias("parent_paragraph_id"), F.lit(1).alias("known"))
    x = r.join(known, "parent_paragraph_id", "left")
    return x.agg(
        F.count("*").alias("n"), F.count_if(F.col("parent_paragraph_id").isNotNull() & F.col("known").isNull()).alias("orphans"),
        F.count_if(F.col("paragraph_char_count") != F.length("paragraph_text")).alias("wrong_counts"), F.count_if(F.col("pdf_page_end") < F.col("pdf_page_start")).alias("reversed"),
    )


@query("j19_held_out_anti_join", f"WITH {R_SQL} SELECT item_id FROM eval_items WHERE question NOT IN (SELECT paragraph_text FROM r WHERE paragraph_text IS NOT NULL)")
def j19(spark, d):
    known = table(spark, d, "records").select(F.col("paragraph_text").alias("question"))
    return questions(spark, d).join(known, "question", "left_anti").select("item_id")


@query(
    "j20_canonical_entry",
    f"""WITH {R_SQL}, {ENT_SQL}, p AS (SELECT paragraph_id, source, article, {_PAGE_SQL} AS page FROM r),
  m AS (SELECT p.paragraph_id, e.work_id, e.article AS classic FROM p JOIN ent e ON e.source = p.source AND p.page BETWEEN e.start_page AND e.end_page QUALIFY row_number() OVER (PARTITION BY p.paragraph_id ORDER BY e.end_page - e.start_page, e.start_page, e.priority DESC, e.work_id, e.ord) = 1)
  SELECT m.paragraph_id, m.work_id, CASE WHEN length(coalesce(p.article, '')) < 3 THEN m.classic ELSE p.article END AS title FROM m JOIN p USING (paragraph_id)""",
)
def j20(spark, d):
    p = _paged(spark, d).select("paragraph_id", "source", "article", "page")
    e = entries(spark, d).select("work_id", "ord", "source", F.col("article").alias("classic"), "start_page", "end_page", "priority")
    m = J.narrowest_interval(p, e, "paragraph_id", "source", F.col("page"), "start_page", "end_page", [F.desc("priority"), F.asc("work_id"), F.asc("ord")], "inner")
    return m.select("paragraph_id", "work_id", F.when(F.length(F.coalesce("article", F.lit(""))) < 3, F.col("classic")).otherwise(F.col("article")).alias("title"))


@query(
    "j21_title_fill",
    f"""WITH {R_SQL}, p AS (SELECT paragraph_id, source, article, {_PAGE_SQL} AS page FROM r), m AS (SELECT p.paragraph_id, a.title FROM p JOIN article_map a ON a.source = p.source AND a.entry_level = 1 AND p.page BETWEEN a.start_printed_page AND a.end_printed_page
  QUALIFY row_number() OVER (PARTITION BY p.paragraph_id ORDER BY a.end_printed_page - a.start_printed_page, a.start_printed_page, a.entry_no) = 1)
  SELECT p.paragraph_id, CASE WHEN trim(coalesce(p.article, '')) = '' THEN m.title ELSE p.article END AS title FROM p LEFT JOIN m USING (paragraph_id)""",
)
def j21(spark, d):
    p = _paged(spark, d).select("paragraph_id", "source", "article", "page")
    m = _article_map(spark, d).filter("entry_level = 1").select("entry_no", "source", "title", "s", "e")
    out = J.narrowest_interval(p, m, "paragraph_id", "source", F.col("page"), "s", "e", [F.asc("entry_no")])
    return out.select("paragraph_id", F.when(F.trim(F.coalesce("article", F.lit(""))) == "", F.col("title")).otherwise(F.col("article")).alias("title"))


_PARENT_SQL = """par AS (SELECT a.entry_no, b.entry_no AS parent FROM article_map a LEFT JOIN article_map b ON a.source = b.source AND b.start_printed_page <= a.start_printed_page AND b.end_printed_page >= a.end_printed_page
  AND b.end_printed_page - b.start_printed_page > a.end_printed_page - a.start_printed_page QUALIFY row_number() OVER (PARTITION BY a.entry_no ORDER BY b.end_printed_page - b.start_printed_page, b.start_printed_page, b.entry_no) = 1)"""


@query(
    "j22_hierarchy_levels",
    f"""WITH RECURSIVE {_PARENT_SQL}, up AS (SELECT entry_no, parent, 1 AS level FROM par UNION ALL SELECT u.entry_no, p.parent, u.level + 1 FROM up u JOIN par p ON u.parent = p.entry_no WHERE u.level <= 4)
  SELECT entry_no, least(max(level), 6) AS level FROM up GROUP BY entry_no""",
)
def j22(spark, d):
    m = _article_map(spark, d).select("entry_no", "source", "s", "e")
    return J.levels(J.enclosing(m, "entry_no", "source", "s", "e"), "entry_no")


@query(
    "j23_expected_hit_rank",
    f"""WITH {HITS_SQL} SELECT h.item_id, min(CASE WHEN c.source = h.source THEN h.rank END) AS source_rank, min(CASE WHEN c.source = h.source AND abs(h.page - c.citation_page) <= 1 THEN h.rank END) AS page_rank,
  min(CASE WHEN length(c.quote) >= 8 AND contains(h.paragraph_text, c.quote) THEN h.rank END) AS quote_rank FROM hits h JOIN cit c USING (item_id) GROUP BY h.item_id""",
)
def j23(spark, d):
    h = hits(spark, d).select("item_id", "rank", "page", "paragraph_text", F.col("source").alias("hs"))
    m = h.join(I.dimension(citations(spark, d)), "item_id")
    same = F.col("source") == F.col("hs")
    return m.groupBy("item_id").agg(
        F.min(F.when(same, F.col("rank"))).alias("source_rank"), F.min(F.when(same & (F.abs(F.col("page") - F.col("citation_page")) <= 1), F.col("rank"))).alias("page_rank"),
        F.min(F.when((F.length("quote") >= 8) & F.contains("paragraph_text", "quote"), F.col("rank"))).alias("quote_rank"),
    )


@query(
    "j24_structural_match",
    f"""WITH {R_SQL}, {CIT_SQL} SELECT c.item_id, c.ord, max(CASE WHEN contains(coalesce(r.paragraph_text, ''), c.quote) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage, CAST(count(*) AS BIGINT) AS n FROM cit c JOIN r ON r.source = c.source AND c.citation_page BETWEEN r.citation_page_start AND r.citation_page_end GROUP BY ALL""",
)
def j24(spark, d):
    c = citations(spark, d).select("item_id", "ord", F.col("source").alias("cs"), "citation_page", "quote")
    r = narrow(spark, d, "source", "citation_page_start", "citation_page_end", "paragraph_text")
    m = r.join(I.dimension(c), (F.col("source") == F.col("cs")) & F.col("citation_page").between(F.col("citation_page_start"), F.col("citation_page_end")))
    cover = F.when(F.contains(F.coalesce("paragraph_text", F.lit("")), "quote"), 1.0).otherwise(0.0)
    return m.groupBy("item_id", "ord").agg(F.max(cover).alias("coverage"), F.count("*").alias("n"))


@query(
    "j25_classic_boost",
    f"""WITH {HITS_SQL}, {ENT_SQL} SELECT h.item_id, h.paragraph_id, CAST(coalesce(sum(CASE WHEN e.source IS NULL THEN 0 ELSE 50 END + CASE WHEN h.page BETWEEN e.start_page AND e.end_page THEN 100 - e.priority ELSE 0 END), 0) AS BIGINT) AS boost FROM hits h LEFT JOIN ent e ON e.source = h.source GROUP BY ALL""",
)
def j25(spark, d):
    e = entries(spark, d).select("source", "start_page", "end_page", "priority")
    h = hits(spark, d).select("item_id", "paragraph_id", "source", "page").join(I.dimension(e), "source", "left")
    gain = F.when(F.col("start_page").isNotNull(), 50 + F.when(F.col("page").between(F.col("start_page"), F.col("end_page")), 100 - F.col("priority")).otherwise(0))
    return h.groupBy("item_id", "paragraph_id").agg(F.coalesce(F.sum(gain), F.lit(0)).cast("long").alias("boost"))


@query(
    "j26_toc_ranges",
    f"""WITH {R_SQL}, l AS (SELECT source, unnest(string_split(paragraph_text, chr(10))) AS line FROM r WHERE page_type = 'toc'), m AS (SELECT source, trim(regexp_extract(line, '^(.*?)[ .…·　]*([0-9]+)\\s*$', 1)) AS title, CAST(regexp_extract(line, '^(.*?)[ .…·　]*([0-9]+)\\s*$', 2) AS INTEGER) AS page
  FROM l WHERE regexp_matches(line, '^(.*?)[ .…·　]*([0-9]{{1,4}})\\s*$')) SELECT source, title, min(page) AS page, CAST(count(*) AS BIGINT) AS n FROM m WHERE title <> '' GROUP BY source, title""",
)
def j26(spark, d):
    p = "^(.*?)[ .…·　]*([0-9]+)\\s*$"
    line = narrow(spark, d, "source", "page_type", "paragraph_text").filter("page_type = 'toc'").select("source", F.explode(F.split("paragraph_text", "\n")).alias("line"))
    m = line.filter(F.col("line").rlike("^(.*?)[ .…·　]*([0-9]{1,4})\\s*$")).select("source", F.trim(F.regexp_extract("line", p, 1)).alias("title"), F.regexp_extract("line", p, 2).cast("int").alias("page"))
    return m.filter("title <> ''").groupBy("source", "title").agg(F.min("page").alias("page"), F.count("*").alias("n"))


@query(
    "j27_asymmetric_coverage",
    f"""WITH {R_SQL}, {ENT_SQL} SELECT r.paragraph_id, e.work_id FROM r JOIN ent e ON e.source = r.source AND r.pdf_page_start BETWEEN e.start_page - 20 AND e.end_page + 80
  QUALIFY row_number() OVER (PARTITION BY r.paragraph_id ORDER BY e.priority DESC, e.work_id, e.ord) = 1""",
)
def j27(spark, d):
    e = entries(spark, d).select("work_id", "ord", "priority", "source", (F.col("start_page") - 20).alias("lo"), (F.col("end_page") + 80).alias("hi"))
    found = I.interval_join(narrow(spark, d, "source", "pdf_page_start"), I.dimension(e), "source", F.col("pdf_page_start"), "lo", "hi")
    return R.first_per(found, ["paragraph_id"], [F.desc("priority"), F.asc("work_id"), F.asc("ord")]).select("paragraph_id", "work_id")


@query(
    "j28_ambiguous_locations",
    f"""WITH {HITS_SQL}, x AS (SELECT c.item_id, c.ord, bool_or(h.page IS NOT NULL AND abs(h.page - c.citation_page) <= 2) AS hit FROM cit c LEFT JOIN hits h ON h.item_id = c.item_id AND h.source = c.source GROUP BY ALL)
  SELECT item_id, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS found, count(*) FILTER (WHERE hit) >= least(2, count(*)) AS passed FROM x GROUP BY item_id""",
)
def j28(spark, d):
    h = hits(spark, d).select("item_id", "source", "page")
    x = citations(spark, d).join(h, ["item_id", "source"], "left").groupBy("item_id", "ord").agg(
        F.coalesce(F.max(F.abs(F.col("page") - F.col("citation_page")) <= 2), F.lit(False)).alias("hit")
    )
    out = x.groupBy("item_id").agg(F.count("*").alias("expected"), F.count_if("hit").alias("found"))
    return out.withColumn("passed", F.col("found") >= F.least(F.lit(2), "expected"))
