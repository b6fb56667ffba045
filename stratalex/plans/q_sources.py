"""Queries of the scans, filters and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import ids as K
from stratalex.functions import text as T
from stratalex.operators import filters, intervals, sources_ops
from stratalex.operators import ranking as R
from stratalex.plans.base import (
    CIT_SQL, ENT_SQL, FRONT, HITS_SQL, MOJIBAKE, POLLUTION, Q_SQL, R_SQL, UNITS, citations, entries, hits, narrow, questions, records, requests, sq, sql_compact,
    sql_label, sql_list, sql_match, sql_strip,
)
from stratalex.plans.catalog import query
from stratalex.session import table

# ---------------------------------------------------------------- scans, sources, sinks


@query(
    "s03_page_gate_title_fill",
    f"""WITH {R_SQL}, w AS (SELECT paragraph_id, page_type, length(trim(coalesce(paragraph_text, ''))) AS n,
  last_value(CASE WHEN page_type = 'title_page' THEN trim(paragraph_text) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY pdf_page_start, paragraph_index, paragraph_id ROWS UNBOUNDED PRECEDING) AS title_context FROM r)
  SELECT paragraph_id, title_context FROM w WHERE page_type NOT IN ('toc', 'title_page') AND n >= 20""",
)
def s03(spark, d):
    r = narrow(spark, d, "source", "page_type", "paragraph_text", "pdf_page_start", "paragraph_index")
    return sources_ops.page_gate(r, "source", ["pdf_page_start", "paragraph_index", "paragraph_id"], "page_type", "paragraph_text").select("paragraph_id", "title_context")


@query("s04_jsonl_round_trip", f"WITH {R_SQL} SELECT paragraph_id, source, article, pdf_page_start, retrievable FROM r")
def s04(spark, d):
    r = narrow(spark, d, "source", "article", "pdf_page_start", "retrievable")
    lines = r.select(F.to_json(F.struct("paragraph_id", "source", "article", "pdf_page_start", "retrievable")).alias("value"))
    return sources_ops.parse_jsonl(lines, "paragraph_id string, source string, article string, pdf_page_start int, retrievable boolean")


@query("s05_rows_per_source", f"WITH {R_SQL} SELECT source, count(*) AS n FROM r GROUP BY source")
def s05(spark, d):
    return narrow(spark, d, "source").groupBy("source").agg(F.count("*").alias("n"))


@query(
    "s06_page_snapshot_hashes",
    f"WITH {R_SQL} SELECT paragraph_id, sha256(coalesce(paragraph_text, '')) AS raw_sha256, sha256({sql_compact('coalesce(paragraph_text, ' + sq('') + ')')}) AS normalized_sha256 FROM r",
)
def s06(spark, d):
    t = F.coalesce("paragraph_text", F.lit(""))
    return narrow(spark, d, "paragraph_text").select("paragraph_id", F.sha2(t, 256).alias("raw_sha256"), F.sha2(T.compact(t), 256).alias("normalized_sha256"))


@query(
    "s08_dataset_manifest",
    f"""WITH {R_SQL} SELECT source, count(*) AS n, CAST(sum(strlen(coalesce(paragraph_text, ''))) AS BIGINT) AS bytes,
  CAST(sum(CAST('0x' || substring(sha256(paragraph_id || '|' || coalesce(paragraph_text, '')), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM r GROUP BY source""",
)
def s08(spark, d):
    return sources_ops.manifest(narrow(spark, d, "source", "paragraph_text"), "source", "paragraph_id", "paragraph_text")


@query(
    "s09_first_wins_map",
    f"""WITH {ENT_SQL}, u AS (SELECT source, title, start_printed_page AS start_page, end_printed_page AS end_page, 0 AS prio FROM article_map
  UNION ALL SELECT source, article, start_page, end_page, 1 FROM ent)
  SELECT source, title, start_page, end_page, prio FROM u QUALIFY prio = min(prio) OVER (PARTITION BY source)""",
)
def s09(spark, d):
    first = table(spark, d, "article_map").select("source", "title", F.col("start_printed_page").alias("start_page"), F.col("end_printed_page").alias("end_page"))
    extra = entries(spark, d).select("source", F.col("article").alias("title"), "start_page", "end_page")
    return sources_ops.first_wins([first, extra], "source")


@query(
    "s10_catalog_dimension",
    f"""WITH {ENT_SQL} SELECT e.work_id, e.source, e.article, e.start_page, e.end_page, e.priority, {sql_label('e.title')} AS title_key,
  array_to_string(list_transform(c.aliases, lambda a: {sql_label('a')}), '|') AS alias_keys
  FROM ent e JOIN core_classics c USING (work_id)
  QUALIFY row_number() OVER (PARTITION BY e.work_id, e.source, e.start_page ORDER BY e.priority DESC, e.ord) = 1""",
)
def s10(spark, d):
    c = table(spark, d, "core_classics").select("work_id", F.array_join(F.transform("aliases", T.label), "|").alias("alias_keys"))
    e = R.first_per(entries(spark, d), ["work_id", "source", "start_page"], [F.desc("priority"), F.asc("ord")])
    return e.join(c, "work_id").select("work_id", "source", "article", "start_page", "end_page", "priority", T.label("title").alias("title_key"), "alias_keys")


@query("s13_link_harvest", None)
def s13(spark, d):
    page = F.concat(F.lit('<p><a href="scans/'), F.col("source"), F.lit('">x</a> <A class="k" HREF="/abs/'), F.col("edition_id"), F.lit('.txt">y</A></p>'))
    return sources_ops.links(table(spark, d, "editions").select("source", page.alias("html")), "html", "https://example.org/base/", ".pdf")


@query("s15_clip_head_tail", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substring(text, 1, 1500) || right(text, 500) ELSE text END AS clipped FROM documents")
def s15(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clip("text", 2000).alias("clipped"))


@query(
    "s17_contract_columns",
    "SELECT column_name AS name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'INTEGER[]' THEN 'array<int>' "
    "WHEN 'VARCHAR[]' THEN 'array<string>' ELSE 'timestamp' END AS type FROM (SELECT * FROM (DESCRIBE records) AS t(column_name, data_type, a, b, c, e))",
)
def s17(spark, d):
    return spark.createDataFrame([(n, t) for n, t in table(spark, d, "records").dtypes], "name string, type string")


@query("s20_event_log_permissive", f"WITH {Q_SQL} SELECT request_id, intent, elapsed_ms FROM q WHERE request_id % 7 <> 0")
def s20(spark, d):
    q = requests(spark, d)
    whole = F.to_json(F.struct("request_id", "intent", "elapsed_ms"))
    lines = q.select(F.when(F.col("request_id") % 7 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("value"))
    return sources_ops.parse_jsonl(lines, "request_id long, intent string, elapsed_ms double")


# ---------------------------------------------------------------- filters and predicates


@query("f01_filter_compiler", f"WITH {R_SQL} SELECT paragraph_id FROM r WHERE page_type = 'body' AND source IN ('qb01.pdf', 'qb02.pdf')")
def f01(spark, d):
    pushed = filters.compiled(table(spark, d, "records"), {"page_type": "body", "source": ["qb01.pdf", "qb02.pdf"], "volume": None, "section": []})
    return pushed.select("paragraph_id").distinct()


_NOISE_SQL = (
    "page_type IN ('toc', 'title_page') OR length(coalesce(paragraph_text, '')) < 24 OR length(coalesce(paragraph_text, '')) - length(regexp_replace(coalesce(paragraph_text, ''), '[—-]', '', 'g')) >= 8 "
    "OR (length(coalesce(paragraph_text, '')) - length(regexp_replace(coalesce(paragraph_text, ''), '[!-/:-@。，、；：？！“”（）…·—]', '', 'g'))) > 0.38 * length(coalesce(paragraph_text, ''))"
)


@query(
    "f02_noise_filter_with_fallback",
    f"WITH {HITS_SQL}, k AS (SELECT item_id, paragraph_id, NOT ({_NOISE_SQL}) AS keep FROM hits) SELECT item_id, paragraph_id FROM k QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY item_id)",
)
def f02(spark, d):
    return filters.kept_or_all(hits(spark, d), ~filters.is_noise("page_type", "paragraph_text"), "item_id").select("item_id", "paragraph_id")


@query(
    "f03_index_like_text",
    f"WITH {R_SQL} SELECT paragraph_id FROM r WHERE page_type IN ('toc', 'title_page') OR (length(paragraph_text) < 600 AND length(paragraph_text) - length(regexp_replace(paragraph_text, '[—-]', '', 'g')) >= 3) "
    "OR (length(paragraph_text) - length(regexp_replace(paragraph_text, '[!-/:-@。，、；：？！“”（）…·—]', '', 'g'))) > 0.42 * length(paragraph_text)",
)
def f03(spark, d):
    return narrow(spark, d, "page_type", "paragraph_text").filter(filters.looks_like_index("page_type", "paragraph_text")).select("paragraph_id")


@query("f04_source_constraint", f"WITH {R_SQL}, {CIT_SQL} SELECT paragraph_id FROM r WHERE source IN (SELECT source FROM cit)")
def f04(spark, d):
    return narrow(spark, d, "source").join(intervals.dimension(citations(spark, d).select("source").distinct()), "source", "left_semi").select("paragraph_id")


@query(
    "f05_page_range_tolerance",
    f"WITH {R_SQL}, {ENT_SQL} SELECT DISTINCT r.paragraph_id FROM r JOIN ent e ON r.source = e.source AND r.printed_page_start BETWEEN e.start_page - 2 AND e.end_page + 2",
)
def f05(spark, d):
    e = entries(spark, d).select("source", (F.col("start_page") - 2).alias("lo"), (F.col("end_page") + 2).alias("hi"))
    r = narrow(spark, d, "source", "printed_page_start")
    return intervals.interval_join(r, intervals.dimension(e), "source", F.col("printed_page_start"), "lo", "hi").select("paragraph_id").distinct()


@query(
    "f06_soft_page_filter",
    f"WITH {HITS_SQL} SELECT item_id, paragraph_id FROM hits QUALIFY distance = 0 OR NOT bool_or(distance = 0) OVER (PARTITION BY item_id)",
)
def f06(spark, d):
    return filters.kept_or_all(hits(spark, d), F.col("distance") == 0, "item_id").select("item_id", "paragraph_id")


@query("f07_narrow_ranges", f"WITH {ENT_SQL} SELECT work_id, bool_and(end_page - start_page <= 3) AS narrow FROM ent GROUP BY work_id")
def f07(spark, d):
    return table(spark, d, "core_classics").filter(F.size("entries") > 0).select("work_id", F.forall("entries", lambda e: e["end_page"] - e["start_page"] <= 3).alias("narrow"))


_FRONT_SQL = "(coalesce(article, '') || ' ' || substring(coalesce(paragraph_text, ''), 1, 260))"


@query("f08_front_matter", f"WITH {R_SQL} SELECT paragraph_id FROM r WHERE regexp_matches({_FRONT_SQL}, '序言|前言|说明|出版|编者|[0-9]{{4}}年.{{0,4}}版') OR page_type IN ('toc', 'title_page')")
def f08(spark, d):
    r = narrow(spark, d, "article", "paragraph_text", "page_type")
    return r.filter(filters.is_front_matter("article", "paragraph_text", "page_type", ["序言", "前言", "说明", "出版", "编者", "[0-9]{4}年.{0,4}版"])).select("paragraph_id")


@query(
    "f09_noisy_title",
    f"""WITH {R_SQL}, a AS (SELECT DISTINCT article FROM r WHERE article IS NOT NULL)
  SELECT article FROM a WHERE trim(article) = '' OR regexp_matches(article, '^[0-9]+$') OR regexp_matches(article, '^[ -~]+$') OR length(article) > 40 OR regexp_matches(article, '^(和|与|及|或|但|而)')
  OR (length(article) - length(replace(article, '（', ''))) <> (length(article) - length(replace(article, '）', '')))
  OR (length(article) - length(replace(article, '《', ''))) <> (length(article) - length(replace(article, '》', '')))
  OR (length(article) - length(regexp_replace(article, '[!-/:-@。，、；：？！“”（）…·—]', '', 'g'))) > 0.25 * length(article)""",
)
def f09(spark, d):
    return table(spark, d, "records").select("article").filter("article is not null").distinct().filter(filters.is_noisy_title("article"))


@query(
    "f10_title_allow_list",
    f"WITH {R_SQL}, t AS (SELECT DISTINCT title FROM core_classics) SELECT DISTINCT r.paragraph_id FROM r JOIN t ON contains(r.article, t.title)",
)
def f10(spark, d):
    t = table(spark, d, "core_classics").select("title").distinct()
    a = table(spark, d, "records").select("article").filter("article is not null").distinct()
    allowed = a.join(intervals.dimension(t), F.contains("article", "title"), "left_semi")
    return narrow(spark, d, "article").join(intervals.dimension(allowed), "article", "left_semi").select("paragraph_id")


@query(
    "f11_collection_priority",
    "SELECT source, CASE WHEN regexp_matches(source, '^qb') THEN 0 WHEN regexp_matches(source, '^xj') THEN 1 WHEN regexp_matches(source, '^(sx|bj)') THEN 2 ELSE 3 END AS priority FROM editions",
)
def f11(spark, d):
    return table(spark, d, "editions").select("source", filters.family_rank("source", ["^qb", "^xj", "^(sx|bj)"]).alias("priority"))


_QUALITY_SQL = (
    "(CASE WHEN page_type IN ('toc', 'title_page') THEN -60 ELSE 0 END + CASE WHEN length(coalesce(paragraph_text, '')) < 40 THEN -30 ELSE 0 END + CASE WHEN coalesce(article, '') = '' THEN -10 ELSE 0 END "
    "+ CASE WHEN regexp_matches(coalesce(paragraph_text, ''), '[!！]{5,}') THEN -25 ELSE 0 END + CASE WHEN contains(coalesce(paragraph_text, ''), '锟斤拷') THEN -45 ELSE 0 END "
    "+ CASE WHEN length(regexp_replace(coalesce(paragraph_text, ''), '[^0-9]', '', 'g')) > 0.3 * length(coalesce(paragraph_text, '')) THEN -35 ELSE 0 END)"
)


@query("f12_quality_score", f"WITH {R_SQL} SELECT paragraph_id, {_QUALITY_SQL} AS quality FROM r")
def f12(spark, d):
    return narrow(spark, d, "page_type", "paragraph_text", "article").select("paragraph_id", filters.quality("page_type", "paragraph_text", "article").alias("quality"))


_POLL_SQL = "CASE " + " ".join(f"WHEN contains({sql_label('article')}, {sq(p)}) THEN {sq(p)}" for p in POLLUTION) + " END"
_MOJI_SQL = "(" + " OR ".join(f"contains(coalesce(paragraph_text, ''), {sq(m)})" for m in MOJIBAKE) + ")"


@query(
    "f13_quarantine_projection",
    f"""WITH {R_SQL}, n AS (SELECT paragraph_id, coalesce(volume, nullif('第' || regexp_extract(book, '第\\s*([0-9]+)\\s*卷', 1) || '卷', '第卷'), '') AS volume, {_POLL_SQL} AS kind, {_MOJI_SQL} AS mojibake, page_type, quality_flags,
  coalesce(pdf_page_end, pdf_page_start) - pdf_page_start + 1 AS pages FROM r)
  SELECT paragraph_id, volume, CASE WHEN page_type = 'body' AND kind IS NOT NULL THEN CASE kind WHEN '注释' THEN 'notes' WHEN '目录' THEN 'toc' ELSE 'subject_index' END ELSE page_type END AS page_type,
  mojibake, page_type = 'body' AND kind IS NULL AND NOT mojibake AND len(coalesce(quality_flags, [])) = 0 AS retrievable, CAST(greatest(coalesce(pages, 0), CASE WHEN pages IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS n_pages FROM n""",
)
def f13(spark, d):
    r = narrow(spark, d, "volume", "book", "article", "paragraph_text", "page_type", "quality_flags", "pdf_page_start", "pdf_page_end")
    return filters.quarantined(r, POLLUTION, MOJIBAKE).select("paragraph_id", "volume", "page_type", "mojibake", "retrievable", F.size("page_span").alias("n_pages"))


@query(
    "f14_metadata_inheritance",
    f"""WITH {R_SQL} SELECT c.paragraph_id, c.parent_paragraph_id, coalesce(c.article, p.article) AS article, coalesce(c.section, p.section) AS section, coalesce(c.volume, p.volume) AS volume
  FROM r c JOIN r p ON c.parent_paragraph_id = p.paragraph_id""",
)
def f14(spark, d):
    r = narrow(spark, d, "parent_paragraph_id", "article", "section", "volume")
    return filters.inherited(r.filter("parent_paragraph_id is not null"), r, "parent_paragraph_id", "paragraph_id", ["article", "section", "volume"])


@query(
    "f15_storage_sentinels",
    f"WITH {R_SQL} SELECT paragraph_id, coalesce(printed_page_start, -1) AS printed_page_start, coalesce(citation_page_start, -1) AS citation_page_start, coalesce(article, '') AS article, "
    "coalesce(to_json(page_span)::VARCHAR, '[]') AS page_span FROM r",
)
def f15(spark, d):
    r = narrow(spark, d, "printed_page_start", "citation_page_start", "article", "page_span")
    return filters.storage_row(r, ["printed_page_start", "citation_page_start"], ["article"], ["page_span"])


@query("f16_index_columns", f"WITH {R_SQL} SELECT paragraph_id, source, book, article, section, page_type FROM r WHERE retrievable")
def f16(spark, d):
    r = table(spark, d, "records").filter("retrievable")
    return r.select(*filters.reconciled(r, ["paragraph_id", "source", "book", "article", "section", "page_type", "no_such_field"])).distinct()


@query("f17_output_fields", f"WITH {Q_SQL} SELECT request_id, intent, topic_id FROM q")
def f17(spark, d):
    q = requests(spark, d)
    return q.select(*filters.reconciled(q, ["request_id", "intent", "topic_id", "crag_score"]))


@query(
    "f18_line_noise",
    f"""WITH {R_SQL}, l AS (SELECT paragraph_id, article, book, unnest(string_split(paragraph_text, chr(10))) AS line FROM r), k AS (SELECT paragraph_id, line, {sql_compact('line')} AS k, {sql_compact("coalesce(article, '')")} AS a, {sql_compact("coalesce(book, '')")} AS b FROM l)
  SELECT paragraph_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE k = '' OR (length(k) <= 2 AND NOT regexp_matches(k, '[一-鿿]')) OR regexp_matches(k, '^[!！.。·•…_-]{{4,}}$') OR regexp_matches(k, '[!！]{{5,}}') OR k = a OR k = b OR regexp_matches(k, '^[-—_·•.。,0-9]+$')) AS BIGINT) AS n_noise FROM k GROUP BY paragraph_id""",
)
def f18(spark, d):
    r = narrow(spark, d, "article", "book", "paragraph_text").select("paragraph_id", "article", "book", F.explode(F.split("paragraph_text", "\n")).alias("line"))
    return r.groupBy("paragraph_id").agg(F.count("*").alias("n_lines"), F.count_if(filters.is_noise_line("line", ["article", "book"])).alias("n_noise"))


@query("f19_index_eligible", f"WITH {R_SQL} SELECT paragraph_id FROM r WHERE coalesce(retrievable, true) AND page_type = 'body' AND trim(coalesce(paragraph_text, '')) <> ''")
def f19(spark, d):
    return table(spark, d, "records").filter("coalesce(retrievable, true) and page_type = 'body' and trim(coalesce(paragraph_text, '')) <> ''").select("paragraph_id").distinct()


@query(
    "f20_marker_groups",
    f"WITH {R_SQL} SELECT paragraph_id FROM r WHERE (contains(paragraph_text, '劳动') OR contains(paragraph_text, '资本')) AND ((contains(paragraph_text, '价值') OR contains(paragraph_text, '价格')) AND contains(paragraph_text, '生产'))",
)
def f20(spark, d):
    return narrow(spark, d, "paragraph_text").filter(filters.markers("paragraph_text", ["劳动", "资本"], [["价值", "价格"], ["生产"]])).select("paragraph_id")


@query(
    "f21_text_overlap_filter",
    f"""WITH {HITS_SQL}, t AS (SELECT h.item_id, h.paragraph_id, h.rank, {sql_match('e.question')} AS qn, {sql_match("coalesce(h.paragraph_text, '')")} AS pn FROM hits h JOIN eval_items e USING (item_id)),
  g AS (SELECT item_id, paragraph_id, rank, pn, list_distinct(flatten([list_transform(range(1, length(qn) - 6), lambda i: substring(qn, i, 8)), list_transform(range(1, length(qn) - 4), lambda i: substring(qn, i, 6)), list_transform(range(1, length(qn) - 2), lambda i: substring(qn, i, 4)), list_transform(range(1, length(qn)), lambda i: substring(qn, i, 2))])) AS terms FROM t),
  s AS (SELECT item_id, paragraph_id, rank, CAST(coalesce(list_sum(list_transform(list_filter(terms, lambda x: contains(pn, x)), lambda x: length(x) * length(x))), 0) AS BIGINT) AS score FROM g)
  SELECT item_id, paragraph_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) <= 5""",
)
def f21(spark, d):
    h = hits(spark, d).join(intervals.dimension(questions(spark, d).select("item_id", "question")), "item_id")
    s = h.withColumn("score", T.overlap_score(T.match_form("question"), T.match_form(F.coalesce("paragraph_text", F.lit(""))))).filter("score > 0")
    return R.top_k(s, ["item_id"], [F.desc("score"), F.asc("rank")], 5, "r").select("item_id", "paragraph_id", "score")


@query("f22_corpus_filter", f"WITH {R_SQL} SELECT paragraph_id FROM r WHERE regexp_matches(source, '^(qb|xj)[0-9]+')")
def f22(spark, d):
    return table(spark, d, "records").filter(F.col("source").rlike("^(qb|xj)[0-9]+")).select("paragraph_id").distinct()


@query("f23_relevance_gate", "SELECT item_id, CASE WHEN regexp_matches(question, '劳动|资本|价值|生产|土地') THEN 'relevant' WHEN regexp_matches(question, '天气|股票|电影') THEN 'irrelevant' ELSE 'pass' END AS gate FROM eval_items")
def f23(spark, d):
    return questions(spark, d).select("item_id", filters.tri_state("question", "劳动|资本|价值|生产|土地", "天气|股票|电影").alias("gate"))


@query(
    "f24_unreadable_text",
    f"WITH {R_SQL} SELECT paragraph_id FROM r WHERE paragraph_text IS NOT NULL AND length(paragraph_text) >= 4 AND length(regexp_replace(paragraph_text, '[^0-9A-Za-zÀ-ÿА-яёЁ一-鿿]', '', 'g')) < 0.4 * length(paragraph_text)",
)
def f24(spark, d):
    return narrow(spark, d, "paragraph_text").filter(filters.unreadable("paragraph_text")).select("paragraph_id")


@query(
    "f25_non_body_and_page",
    f"WITH {R_SQL} SELECT paragraph_id, page_type IN ('toc', 'title_page', 'blank', 'notes') OR regexp_matches({sql_label('article')}, '(目录|注释|索引)$') AS non_body, "
    "coalesce(printed_page_start, CASE WHEN citation_page_type = 'printed_page' THEN citation_page_start END) AS page FROM r",
)
def f25(spark, d):
    r = narrow(spark, d, "page_type", "article", "printed_page_start", "citation_page_type", "citation_page_start")
    return r.select("paragraph_id", filters.non_body("page_type", "article").alias("non_body"), filters.record_page().alias("page"))


@query(
    "f26_pollution_and_orphans",
    f"WITH {R_SQL} SELECT paragraph_id, {_POLL_SQL} AS pollution, length(trim(coalesce(paragraph_text, ''))) <= 400 AND regexp_matches(coalesce(paragraph_text, ''), '^\\s*[\\[［【]\\s*[0-9０-９]{{1,2}}\\s*[\\]］】]') AS orphan FROM r",
)
def f26(spark, d):
    r = narrow(spark, d, "article", "paragraph_text")
    return r.select("paragraph_id", filters.pollution("article", POLLUTION).alias("pollution"), filters.orphan_footnote("paragraph_text").alias("orphan"))


@query(
    "f27_item_validation",
    """SELECT item_id, CASE WHEN difficulty IN ('easy', 'medium', 'hard') THEN difficulty ELSE 'medium' END AS difficulty, len(list_filter(expected_citations, lambda c: coalesce(c.quote, '') <> '')) AS n_quotes,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(source_scope, []), list_transform(expected_citations, lambda c: c.source)))), '|') AS scope FROM eval_items""",
)
def f27(spark, d):
    return filters.validated_items(table(spark, d, "eval_items"))


@query("f28_broad_questions", "SELECT item_id, regexp_matches(question, '哪些|怎样|如何|为什么|比较') AS broad, regexp_matches(question, '哪一卷|第.{1,3}卷|出自|在哪') AS location FROM eval_items")
def f28(spark, d):
    return questions(spark, d).select("item_id", F.col("question").rlike("哪些|怎样|如何|为什么|比较").alias("broad"), F.col("question").rlike("哪一卷|第.{1,3}卷|出自|在哪").alias("location"))
