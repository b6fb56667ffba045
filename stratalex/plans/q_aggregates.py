"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import ids as K
from stratalex.functions import text as T
from stratalex.operators import aggregates as A
from stratalex.operators import filters as P
from stratalex.operators import intervals as I
from stratalex.operators import joins as J
from stratalex.operators import ranking as R
from stratalex.operators import segments as G
from stratalex.plans.base import (
    BODY_SQL, CIT_SQL, ENT_SQL, FRONT, HITS_SQL, MOJIBAKE, POLLUTION, Q_SQL, R_SQL, UNITS, body, citations, entries, hits, narrow, questions, records, requests, sq, sql_compact,
    sql_label, sql_list, sql_tokens,
)
from stratalex.plans.catalog import query
from stratalex.session import table

_POLL_SQL = "CASE " + " ".join(f"WHEN contains({sql_label('article')}, {sq(p)}) THEN {sq(p)}" for p in POLLUTION) + " END"
_MOJI_SQL = "(" + " OR ".join(f"contains(coalesce(paragraph_text, ''), {sq(m)})" for m in MOJIBAKE) + ")"
#: Placeholders for a missing title (fixed values).
UNKNOWN = ["未知", "未知篇名", "未识别", "未识别篇名", "unknown", "n/a", "none"]


@query(
    "a01_corpus_statistics",
    f"WITH {R_SQL}, {BODY_SQL}, t AS (SELECT {sql_tokens('paragraph_text')} AS k FROM b) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(len(k)), 6) AS avgdl FROM t",
)
def a01(spark, d):
    return R.corpus_statistics(body(spark, d), "paragraph_text").select("n", F.round("avgdl", 6).alias("avgdl"))


_DF_SQL = f"{R_SQL}, {BODY_SQL}, t AS (SELECT paragraph_id, list_distinct({sql_tokens('paragraph_text')}) AS k FROM b), e AS (SELECT unnest(k) AS term FROM t), df AS (SELECT term, count(*) AS df FROM e GROUP BY term)"


@query("a02_inverted_index", f"WITH {_DF_SQL} SELECT term, df FROM df WHERE df >= 40")
def a02(spark, d):
    t = body(spark, d).select(T.exploded(F.array_distinct(T.tokens("paragraph_text")), "term")).filter("term is not null")
    return t.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 40")


@query("a03_postings_pruning", f"WITH {_DF_SQL} SELECT CAST(count(*) AS BIGINT) AS terms, CAST(sum(df) AS BIGINT) AS postings FROM df WHERE df >= 5 AND df <= 0.6 * (SELECT count(*) FROM b)")
def a03(spark, d):
    b = body(spark, d)
    df = b.select(T.exploded(F.array_distinct(T.tokens("paragraph_text")), "term")).filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    n = table(spark, d, "records").filter("page_type = 'body' and paragraph_text is not null").select("paragraph_id").distinct().count()
    return df.filter(f"df >= 5 and df <= 0.6D * {n}").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))


_UNIT_SQL = f"lower(trim(coalesce(retrieval_unit, 'paragraph'))) IN {sql_list(UNITS)}"
_CODES = {
    "FRONT_MATTER_LEAK": f"u AND coalesce(retrievable, true) AND page_type IN {sql_list(FRONT)}",
    "EMPTY_RETRIEVAL_TEXT": "u AND k = ''",
    "MOJIBAKE_REMAINS": "moji AND NOT (NOT (u AND coalesce(retrievable, true)) AND coalesce(list_contains(quality_flags, 'mojibake'), false))",
    "ARTICLE_POLLUTION": f"kind IS NOT NULL AND page_type NOT IN {sql_list([*FRONT, 'notes'])}",
    "FOOTNOTE_ORPHAN": "orphan AND NOT (page_type = 'notes' OR coalesce(kind = '注释', false))",
    "ARTICLE_MISSING": "u AND page_type = 'body' AND trim(coalesce(article, '')) = ''",
    "ARTICLE_UNKNOWN": f"u AND page_type = 'body' AND trim(coalesce(article, '')) <> '' AND {sql_label('article')} IN {sql_list(UNKNOWN)}",
    "PAGE_REQUIRED": "u AND (pdf_page_start IS NULL OR pdf_page_end IS NULL)",
    "PAGE_RANGE_REVERSED": "u AND pdf_page_end < pdf_page_start",
}
_AUDIT_SQL = (
    f"{R_SQL}, x AS (SELECT *, {_UNIT_SQL} AS u, {sql_compact('coalesce(paragraph_text, ' + sq('') + ')')} AS k, {_MOJI_SQL} AS moji, {_POLL_SQL} AS kind, "
    "length(trim(coalesce(paragraph_text, ''))) <= 400 AND regexp_matches(coalesce(paragraph_text, ''), '^\\s*[\\[［【]\\s*[0-9０-９]{1,2}\\s*[\\]］】]') AS orphan FROM r), i AS ("
    + " UNION ALL ".join(f"SELECT paragraph_id, {sq(c)} AS code, {sq('warning' if c == 'FOOTNOTE_ORPHAN' else 'error')} AS severity FROM x WHERE {w}" for c, w in _CODES.items())
    + ")"
)


@query("a04_document_audit", f"WITH {_AUDIT_SQL} SELECT code, severity, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY ALL")
def a04(spark, d):
    r = narrow(spark, d, "retrieval_unit", "retrievable", "page_type", "paragraph_text", "quality_flags", "article", "pdf_page_start", "pdf_page_end", "source", "paragraph_index")
    return A.audit(r, POLLUTION, MOJIBAKE, UNITS, FRONT, UNKNOWN).groupBy("code", "severity").agg(F.count("*").alias("n"))


_COV = ["source", "book", "article", "retrieval_unit", "pdf_page_start", "citation_page_start", "citation_page_type", "document_record_version"]


@query(
    "a05_field_coverage",
    f"WITH {R_SQL} " + " UNION ALL ".join(f"SELECT {sq(c)} AS field, CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS BIGINT) AS filled FROM r" for c in _COV),
)
def a05(spark, d):
    return A.coverage(narrow(spark, d, *_COV), _COV)


@query(
    "a06_source_profile",
    f"""WITH {R_SQL}, x AS (SELECT source, coalesce(paragraph_text, '') AS t, printed_page_start AS p FROM r), g AS (SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN trim(t) = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS empty_rate,
  round(avg(length(regexp_replace(t, '[^一-鿿]', '', 'g'))), 6) AS avg_han, round(avg(CASE WHEN p IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS page_rate FROM x GROUP BY source)
  SELECT *, CASE WHEN empty_rate > 0.2 THEN 'C' WHEN page_rate >= 0.95 THEN 'A' WHEN page_rate >= 0.85 THEN 'B' ELSE 'L' END AS tier FROM g""",
)
def a06(spark, d):
    t = F.coalesce("paragraph_text", F.lit(""))
    g = narrow(spark, d, "source", "paragraph_text", "printed_page_start").groupBy("source").agg(
        F.count("*").alias("n"), A.rate(F.trim(t) == "", 6).alias("empty_rate"), F.round(F.avg(F.length(F.regexp_replace(t, "[^一-鿿]", ""))), 6).alias("avg_han"),
        A.rate(F.col("printed_page_start").isNotNull(), 6).alias("page_rate"),
    )
    return g.withColumn("tier", F.when(F.col("empty_rate") > 0.2, "C").when(F.col("page_rate") >= 0.95, "A").when(F.col("page_rate") >= 0.85, "B").otherwise("L"))


@query(
    "a07_repeated_line_ratio",
    f"""WITH {R_SQL}, l AS (SELECT source, trim(unnest(string_split(paragraph_text, chr(10)))) AS x FROM r), n AS (SELECT source, x, count(*) AS n FROM l WHERE length(x) >= 6 GROUP BY ALL)
  SELECT source, CAST(sum(n) AS BIGINT) AS lines, round(sum(CASE WHEN n >= 3 THEN n - 1 ELSE 0 END)::DOUBLE / sum(n), 6) AS ratio FROM n GROUP BY source""",
)
def a07(spark, d):
    return A.repeated_line_ratio(narrow(spark, d, "source", "paragraph_text"), "source", "paragraph_text")


@query(
    "a08_character_ratios",
    f"WITH {R_SQL}, x AS (SELECT paragraph_id, coalesce(paragraph_text, '') AS t FROM r) SELECT paragraph_id, CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[^一-鿿]', '', 'g'))::DOUBLE / length(t), 6) ELSE 0.0::DOUBLE END AS han, "
    "CASE WHEN length(t) > 0 THEN round(length(regexp_replace(t, '[^A-Za-z]', '', 'g'))::DOUBLE / length(t), 6) ELSE 0.0::DOUBLE END AS latin FROM x",
)
def a08(spark, d):
    x = narrow(spark, d, "paragraph_text").select("paragraph_id", F.coalesce("paragraph_text", F.lit("")).alias("t"))
    return x.select("paragraph_id", F.round(T.ratio("t", "一-鿿"), 6).alias("han"), F.round(T.ratio("t", "A-Za-z"), 6).alias("latin"))


@query(
    "a09_dominant_offset",
    f"""WITH {R_SQL}, o AS (SELECT source, pdf_page_start - printed_page_start AS shift FROM r WHERE printed_page_start IS NOT NULL AND pdf_page_start IS NOT NULL), n AS (SELECT source, shift, count(*) AS n FROM o GROUP BY ALL),
  m AS (SELECT source, shift, n FROM n QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, shift) = 1) SELECT m.source, m.shift, m.n, CAST((SELECT sum(n.n) FROM n WHERE n.source = m.source AND n.shift <> m.shift) AS BIGINT) AS outliers FROM m""",
)
def a09(spark, d):
    o = narrow(spark, d, "source", "pdf_page_start", "printed_page_start").select("source", (F.col("pdf_page_start") - F.col("printed_page_start")).alias("shift")).filter("shift is not null")
    total = o.groupBy("source").agg(F.count("*").alias("total"))
    return A.dominant(o, ["source"], "shift").join(total, "source").select("source", "shift", "n", F.nullif(F.col("total") - F.col("n"), F.lit(0)).alias("outliers"))


@query(
    "a10_widest_range",
    "SELECT source, title, end_printed_page - start_printed_page AS width FROM article_map QUALIFY row_number() OVER (PARTITION BY source ORDER BY end_printed_page - start_printed_page DESC, entry_no) = 1",
)
def a10(spark, d):
    m = table(spark, d, "article_map").withColumn("width", F.col("end_printed_page") - F.col("start_printed_page"))
    return R.first_per(m, ["source"], [F.desc("width"), F.asc("entry_no")]).select("source", "title", "width")


_RANKS_SQL = f"""{HITS_SQL}, ranks AS (SELECT e.item_id, e.discipline, e.difficulty, e.question_type, e.evaluation_mode, min(CASE WHEN h.source = c.source AND abs(h.page - c.citation_page) <= 1 THEN h.rank END) AS rank
  FROM eval_items e JOIN cit c USING (item_id) LEFT JOIN hits h ON h.item_id = e.item_id GROUP BY ALL)"""


def ranks(spark, d):
    h = hits(spark, d).select("item_id", "rank", "page", F.col("source").alias("hs"))
    m = questions(spark, d).join(citations(spark, d), "item_id").join(h, "item_id", "left")
    hit = (F.col("hs") == F.col("source")) & (F.abs(F.col("page") - F.col("citation_page")) <= 1)
    return m.groupBy("item_id", "discipline", "difficulty", "question_type", "evaluation_mode").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))


_METRIC_SQL = "CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall_{k}" for k in (1, 5, 8)) + ", round(avg(CASE WHEN rank <= 8 THEN 1.0::DOUBLE / rank ELSE 0.0::DOUBLE END), 6) AS mrr_8"


@query("a11_retrieval_metrics", f"WITH {_RANKS_SQL} SELECT {_METRIC_SQL} FROM ranks")
def a11(spark, d):
    return A.retrieval_metrics(ranks(spark, d), "rank", [])


@query(
    "a12_pass_rate_rollup",
    f"WITH {_RANKS_SQL} SELECT coalesce(question_type, 'all') AS question_type, coalesce(evaluation_mode, 'all') AS evaluation_mode, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE rank <= 3) AS BIGINT) AS passed FROM ranks GROUP BY ROLLUP (question_type, evaluation_mode)",
)
def a12(spark, d):
    g = ranks(spark, d).rollup("question_type", "evaluation_mode").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 3).alias("passed"))
    return g.select(F.coalesce("question_type", F.lit("all")).alias("question_type"), F.coalesce("evaluation_mode", F.lit("all")).alias("evaluation_mode"), "n", "passed")


@query(
    "a13_grouping_sets",
    f"WITH {_RANKS_SQL} SELECT discipline, question_type, difficulty, CAST(grouping(discipline, question_type, difficulty) AS BIGINT) AS level, {_METRIC_SQL} FROM ranks GROUP BY GROUPING SETS ((discipline), (question_type), (difficulty), ())",
)
def a13(spark, d):
    sets = [[F.col("discipline")], [F.col("question_type")], [F.col("difficulty")], []]
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    mrr = F.round(F.avg(F.when(F.col("rank") <= 8, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_8")
    return ranks(spark, d).groupingSets(sets, F.col("discipline"), F.col("question_type"), F.col("difficulty")).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), at(1), at(5), at(8), mrr)


@query(
    "a14_latency_summary",
    f"WITH {Q_SQL} SELECT event_name, CAST(count(*) AS BIGINT) AS n, round(avg(elapsed_ms), 4) AS mean_ms, round(median(elapsed_ms), 4) AS median_ms, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms FROM q WHERE elapsed_ms >= 0 GROUP BY event_name",
)
def a14(spark, d):
    q = requests(spark, d).filter("elapsed_ms >= 0")
    return q.groupBy("event_name").agg(
        F.count("*").alias("n"), F.round(F.avg("elapsed_ms"), 4).alias("mean_ms"), F.round(F.percentile("elapsed_ms", 0.5), 4).alias("median_ms"), F.min("elapsed_ms").alias("min_ms"), F.max("elapsed_ms").alias("max_ms")
    )


@query(
    "a15_request_report",
    f"""WITH {Q_SQL} SELECT CAST(to_timestamp(ts) AS DATE)::VARCHAR AS day, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN evidence_count > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS evidence_pct, round(avg(CASE WHEN fallback_used THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS fallback_pct,
  round(avg(CASE WHEN matched_count > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS matched_pct, round(avg(CASE WHEN elapsed_ms >= 0 THEN elapsed_ms END), 6) AS avg_ms FROM q GROUP BY 1""",
)
def a15(spark, d):
    pct = lambda t: F.round(F.avg(F.when(t, 100.0).otherwise(0.0)), 4)
    return requests(spark, d).groupBy(K.day_of(F.col("ts")).cast("string").alias("day")).agg(
        F.count("*").alias("n"), pct(F.col("evidence_count") > 0).alias("evidence_pct"), pct(F.col("fallback_used")).alias("fallback_pct"), pct(F.col("matched_count") > 0).alias("matched_pct"),
        F.round(F.avg(F.when(F.col("elapsed_ms") >= 0, F.col("elapsed_ms"))), 6).alias("avg_ms"),
    )


@query("a15_top_intents", f"WITH {Q_SQL} SELECT coalesce(intent, 'unknown') AS intent, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1 ORDER BY n DESC, intent LIMIT 5")
def a15b(spark, d):
    return requests(spark, d).groupBy(F.coalesce("intent", F.lit("unknown")).alias("intent")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "intent").limit(5)


_MISS_SQL = "CASE WHEN fallback_used THEN 'fallback' WHEN evidence_count = 0 THEN 'no_evidence' WHEN NOT audit_ok THEN 'audit_failed' WHEN matched_count = 0 THEN 'no_match' ELSE 'ok' END"


@query("a16_miss_report", f"WITH {Q_SQL} SELECT {_MISS_SQL} AS kind, coalesce(intent, 'unknown') AS intent, CAST(count(*) AS BIGINT) AS n, max(ts) AS last_ts FROM q GROUP BY 1, 2")
def a16(spark, d):
    rules = [("fallback", F.col("fallback_used")), ("no_evidence", F.col("evidence_count") == 0), ("audit_failed", ~F.col("audit_ok")), ("no_match", F.col("matched_count") == 0)]
    return requests(spark, d).groupBy(A.first_code(rules, "ok").alias("kind"), F.coalesce("intent", F.lit("unknown")).alias("intent")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


_CHUNK_SQL = """ch AS (SELECT paragraph_id, length(paragraph_text) AS n, i AS child_index, i * 256 AS s, least(i * 256 + 320, length(paragraph_text)) AS e, paragraph_text
  FROM (SELECT paragraph_id, paragraph_text, unnest(range(CAST(greatest(1, ceil((length(paragraph_text) - 64) / 256.0)) AS BIGINT))) AS i FROM b WHERE length(paragraph_text) > 0))"""


@query(
    "a17_chunk_layout",
    f"""WITH {R_SQL}, {BODY_SQL}, {_CHUNK_SQL}, o AS (SELECT *, coalesce(max(e) OVER (PARTITION BY paragraph_id ORDER BY child_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM ch),
  p AS (SELECT paragraph_id, count(*) AS k, sum(e - s) AS stored, sum(greatest(0, e - greatest(s, pre))) AS covered, sum(greatest(0, s - pre)) AS gaps FROM o GROUP BY 1),
  x AS (SELECT length(b.paragraph_text) AS n, coalesce(k, 0) AS k, coalesce(stored, 0) AS stored, coalesce(covered, 0) AS covered, coalesce(gaps, 0) AS gaps FROM b LEFT JOIN p USING (paragraph_id) WHERE length(b.paragraph_text) > 0)
  SELECT CAST(sum(k) AS BIGINT) AS chunks, round(sum(covered)::DOUBLE / sum(n), 6) AS coverage, CAST(sum(stored) - sum(covered) AS BIGINT) AS duplicated, round(sum(stored)::DOUBLE / sum(n), 6) AS multiplier,
    CAST(sum(n) - sum(covered) AS BIGINT) AS orphans, CAST(count(*) FILTER (WHERE covered < n OR gaps > 0) AS BIGINT) AS texts_with_orphans FROM x""",
)
def a17(spark, d):
    c = G.chunked(body(spark, d), "paragraph_id", "paragraph_text")
    # what a chunk covers beyond all chunks before it; what it leaves out before its start is an orphan
    before = F.coalesce(F.max("end").over(Window.partitionBy("paragraph_id").orderBy("child_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.select("paragraph_id", "start", "end", F.greatest(F.lit(0), F.col("end") - F.greatest("start", before)).alias("fresh"), F.greatest(F.lit(0), F.col("start") - before).alias("gap"))
    p = c.groupBy("paragraph_id").agg(F.count("*").alias("k"), F.sum(F.col("end") - F.col("start")).alias("stored"), F.sum("fresh").alias("covered"), F.sum("gap").alias("gaps"))
    n = body(spark, d).select("paragraph_id", F.length("paragraph_text").alias("n")).filter("n > 0")
    p = n.join(p, "paragraph_id", "left").na.fill(0, ["k", "stored", "covered", "gaps"])
    whole = F.sum("n")
    return p.agg(
        F.sum("k").alias("chunks"), F.round(F.sum("covered") / whole, 6).alias("coverage"), (F.sum("stored") - F.sum("covered")).alias("duplicated"), F.round(F.sum("stored") / whole, 6).alias("multiplier"),
        (whole - F.sum("covered")).alias("orphans"), F.count_if((F.col("covered") < F.col("n")) | (F.col("gaps") > 0)).alias("texts_with_orphans"),
    )


@query(
    "a18_quote_containment",
    f"""WITH {CIT_SQL}, c AS (SELECT item_id, ord, quote FROM cit WHERE length(quote) >= 16), p AS (SELECT item_id, ord, quote, i, substring(quote, i, 16) AS s FROM (SELECT item_id, ord, quote, unnest(range(1, length(quote) - 14, 8)) AS i FROM c)),
  d AS (SELECT text FROM documents WHERE text IS NOT NULL), f AS (SELECT p.item_id, p.ord, d.text, count(*)::DOUBLE / max(1 + (length(p.quote) - 16) // 8) AS part, bool_or(contains(d.text, p.quote)) AS exact FROM p JOIN d ON contains(d.text, p.s) GROUP BY p.item_id, p.ord, d.text),
  m AS (SELECT item_id, ord, max(part) AS part, bool_or(exact) AS exact FROM f GROUP BY ALL), x AS (SELECT c.item_id, c.ord, coalesce(m.part, 0) AS part, coalesce(m.exact, false) AS exact FROM c LEFT JOIN m USING (item_id, ord))
  SELECT CAST(count(*) AS BIGINT) AS evaluable, round(avg(CASE WHEN exact THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS exact_rate, round(avg(part), 6) AS mean_coverage, CAST(count(*) FILTER (WHERE part > 0 AND NOT exact) AS BIGINT) AS partly FROM x""",
)
def a18(spark, d):
    """A quote is cut into pieces of 16 code points at every eighth; the part of them that one text holds is its coverage."""
    c = citations(spark, d).filter(F.length("quote") >= 16).select("item_id", "ord", "quote")
    at = F.sequence(F.lit(1), F.length("quote") - 15, F.lit(8))
    pieces = c.select("item_id", "ord", "quote", F.size(at).alias("pieces"), F.explode(at).alias("i")).withColumn("s", F.substring("quote", F.col("i"), F.lit(16)))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    found = J.containing(docs, "text", pieces, "s").groupBy("doc_id", "item_id", "ord").agg(
        (F.count_distinct("i") / F.max("pieces")).alias("part"), F.max(F.contains("text", "quote")).alias("exact")
    )
    m = found.groupBy("item_id", "ord").agg(F.max("part").alias("part"), F.max("exact").alias("exact"))
    x = c.select("item_id", "ord").join(m, ["item_id", "ord"], "left").select(F.coalesce("part", F.lit(0.0)).alias("part"), F.coalesce("exact", F.lit(False)).alias("exact"))
    return x.agg(
        F.count("*").alias("evaluable"), A.rate(F.col("exact")).alias("exact_rate"), F.round(F.avg("part"), 6).alias("mean_coverage"), F.count_if((F.col("part") > 0) & ~F.col("exact")).alias("partly")
    )


@query(
    "a19_answer_metrics",
    f"""WITH {HITS_SQL}, x AS (SELECT h.item_id, bool_or(contains(coalesce(h.paragraph_text, ''), t.tag)) AS in_context, avg(length(coalesce(h.paragraph_text, ''))) AS n FROM hits h JOIN (SELECT item_id, unnest(tags) AS tag FROM eval_items) t USING (item_id) GROUP BY h.item_id)
  SELECT CAST(count(*) AS BIGINT) AS items, round(avg(CASE WHEN in_context THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS term_rate, round(avg(n), 4) AS avg_length FROM x""",
)
def a19(spark, d):
    tags = table(spark, d, "eval_items").select("item_id", F.explode("tags").alias("tag"))
    t = F.coalesce("paragraph_text", F.lit(""))
    x = hits(spark, d).select("item_id", "paragraph_text").join(I.dimension(tags), "item_id").groupBy("item_id").agg(F.max(F.contains(t, F.col("tag"))).alias("in_context"), F.avg(F.length(t)).alias("n"))
    return x.agg(F.count("*").alias("items"), A.rate(F.col("in_context")).alias("term_rate"), F.round(F.avg("n"), 4).alias("avg_length"))


@query(
    "a20_ambiguous_titles",
    f"""WITH {ENT_SQL}, u AS (SELECT title, source, start_printed_page AS s, end_printed_page AS e FROM article_map UNION ALL SELECT article, source, start_page, end_page FROM ent),
  x AS (SELECT {sql_label('title')} AS k, * FROM u) SELECT k, CAST(count(DISTINCT (source, s, e)) AS BIGINT) AS locations, arg_min(title, (length(title), title)) AS representative FROM x GROUP BY k HAVING count(DISTINCT (source, s, e)) >= 2""",
)
def a20(spark, d):
    m = table(spark, d, "article_map").select("title", "source", F.col("start_printed_page").alias("s"), F.col("end_printed_page").alias("e"))
    u = m.unionByName(entries(spark, d).select(F.col("article").alias("title"), "source", F.col("start_page").alias("s"), F.col("end_page").alias("e"))).withColumn("k", T.label("title"))
    g = u.groupBy("k").agg(F.count_distinct(F.struct("source", "s", "e")).alias("locations"), F.min_by("title", F.struct(F.length("title"), "title")).alias("representative"))
    return g.filter("locations >= 2")


@query(
    "a21_paragraph_audit",
    f"""WITH {R_SQL}, x AS (SELECT source, length(coalesce(paragraph_text, '')) AS n, cross_page FROM r), h AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM x)
  SELECT x.source, CAST(count(*) AS BIGINT) AS rows, min(n) AS min_len, (SELECT h.n FROM h WHERE h.source = x.source AND h.i = h.c // 2) AS p50_len, max(n) AS max_len, CAST(count(*) FILTER (WHERE n < 20) AS BIGINT) AS short, CAST(count(*) FILTER (WHERE cross_page) AS BIGINT) AS crossing FROM x GROUP BY x.source""",
)
def a21(spark, d):
    n = F.length(F.coalesce("paragraph_text", F.lit("")))
    x = narrow(spark, d, "source", "paragraph_text", "cross_page").select("source", n.alias("n"), "cross_page")
    # the discrete median from counts of lengths: no list of all rows of a source
    counts = x.groupBy("source", "n").agg(F.count("*").alias("k"))
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("n")
    c = counts.withColumn("upto", F.sum("k").over(w)).withColumn("total", F.sum("k").over(Window.partitionBy("source")))
    median = c.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("source").agg(F.min("n").alias("p50_len"))
    g = x.groupBy("source").agg(F.count("*").alias("rows"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.count_if(F.col("n") < 20).alias("short"), F.count_if("cross_page").alias("crossing"))
    return g.join(median, "source")


@query(
    "a22_channel_comparison",
    f"""WITH {HITS_SQL}, a AS (SELECT c.item_id, bool_or(h.rank <= 3 AND h.distance = 0) AS x FROM cit c LEFT JOIN hits h USING (item_id) GROUP BY 1), b AS (SELECT c.item_id, bool_or(h.rank <= 8 AND h.distance <= 1) AS x FROM cit c LEFT JOIN hits h USING (item_id) GROUP BY 1)
  SELECT CASE WHEN coalesce(a.x, false) = coalesce(b.x, false) THEN 'same' WHEN coalesce(b.x, false) THEN 'improved' ELSE 'regressed' END AS change, CAST(count(*) AS BIGINT) AS n FROM a JOIN b USING (item_id) GROUP BY 1""",
)
def a22(spark, d):
    h = hits(spark, d).select("item_id", "rank", "distance")
    m = citations(spark, d).select("item_id").distinct().join(h, "item_id", "left")
    one = m.groupBy("item_id").agg(
        F.coalesce(F.max((F.col("rank") <= 3) & (F.col("distance") == 0)), F.lit(False)).alias("a"), F.coalesce(F.max((F.col("rank") <= 8) & (F.col("distance") <= 1)), F.lit(False)).alias("b")
    )
    return one.groupBy(F.when(F.col("a") == F.col("b"), "same").when(F.col("b"), "improved").otherwise("regressed").alias("change")).agg(F.count("*").alias("n"))


@query("a23_most_frequent_article", f"WITH {HITS_SQL} SELECT item_id, article, count(*) AS n FROM hits WHERE coalesce(article, '') <> '' GROUP BY item_id, article QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, article) = 1")
def a23(spark, d):
    return A.dominant(hits(spark, d).filter("coalesce(article, '') <> ''"), ["item_id"], "article")


@query(
    "a24_quality_score",
    f"""WITH {HITS_SQL}, g AS (SELECT item_id, count(*) AS docs, count(*) FILTER (WHERE page_type = 'body') AS evid, count(*) FILTER (WHERE distance = 0) AS anchored FROM hits GROUP BY 1)
  SELECT item_id, CAST(least(docs, 5) * 10 + least(evid, 4) * 8 + least(anchored, 4) * 7 AS BIGINT) AS score, least(docs, 5) * 10 + least(evid, 4) * 8 + least(anchored, 4) * 7 >= 52 AS passed, array_to_string(list_filter([CASE WHEN docs < 3 THEN 'few_docs' END, CASE WHEN evid = 0 THEN 'no_evidence' END, CASE WHEN anchored = 0 THEN 'no_anchor' END], lambda x: x IS NOT NULL), ',') AS issues FROM g""",
)
def a24(spark, d):
    g = hits(spark, d).groupBy("item_id").agg(F.count("*").alias("docs"), F.count_if(F.col("page_type") == "body").alias("evid"), F.count_if(F.col("distance") == 0).alias("anchored"))
    score = F.least("docs", F.lit(5)) * 10 + F.least("evid", F.lit(4)) * 8 + F.least("anchored", F.lit(4)) * 7
    issues = A.flags([("few_docs", F.col("docs") < 3), ("no_evidence", F.col("evid") == 0), ("no_anchor", F.col("anchored") == 0)])
    return g.select("item_id", score.cast("long").alias("score"), (score >= 52).alias("passed"), F.array_join(issues, ",").alias("issues"))


@query(
    "a25_intent_distribution",
    f"""WITH {Q_SQL}, n AS (SELECT coalesce(topic_id, 'none') AS topic, coalesce(intent, 'unknown') AS intent, count(*) AS n FROM q GROUP BY 1, 2), p AS (SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY topic), 6) AS p FROM n)
  SELECT topic, intent AS top_intent, p, p - coalesce(lead(p) OVER (PARTITION BY topic ORDER BY p DESC, intent), 0) < 0.15 AS ambiguous FROM p QUALIFY row_number() OVER (PARTITION BY topic ORDER BY p DESC, intent) = 1""",
)
def a25(spark, d):
    from pyspark.sql import Window

    n = requests(spark, d).groupBy(F.coalesce("topic_id", F.lit("none")).alias("topic"), F.coalesce("intent", F.lit("unknown")).alias("intent")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("topic").orderBy(F.desc("p"), F.asc("intent"))
    p = n.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("topic")), 6))
    p = p.withColumn("next", F.coalesce(F.lead("p").over(w), F.lit(0.0))).withColumn("i", F.row_number().over(w)).filter("i = 1")
    return p.select("topic", F.col("intent").alias("top_intent"), "p", (F.col("p") - F.col("next") < 0.15).alias("ambiguous"))


@query("a26_dataset_histogram", "SELECT discipline, CAST(count(*) FILTER (WHERE difficulty = 'easy') AS BIGINT) AS easy, CAST(count(*) FILTER (WHERE difficulty = 'medium') AS BIGINT) AS medium, CAST(count(*) FILTER (WHERE difficulty = 'hard') AS BIGINT) AS hard FROM eval_items GROUP BY 1")
def a26(spark, d):
    return questions(spark, d).groupBy("discipline").pivot("difficulty", ["easy", "medium", "hard"]).count().na.fill(0)


@query(
    "a27_session_flags",
    f"""WITH {Q_SQL}, f AS (SELECT CAST(to_timestamp(ts) AS DATE)::VARCHAR AS day, list_filter([CASE WHEN elapsed_ms > 5000 THEN 'slow' END, CASE WHEN evidence_count = 0 THEN 'no_evidence' END, CASE WHEN coalesce(audit_issue_count, 0) > 0 THEN 'audit' END], lambda x: x IS NOT NULL) AS flags FROM q), e AS (SELECT day, unnest(flags) AS flag FROM f)
  SELECT day, flag, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL""",
)
def a27(spark, d):
    flags = A.flags([("slow", F.col("elapsed_ms") > 5000), ("no_evidence", F.col("evidence_count") == 0), ("audit", F.coalesce("audit_issue_count", F.lit(0)) > 0)])
    return requests(spark, d).select(K.day_of(F.col("ts")).cast("string").alias("day"), F.explode(flags).alias("flag")).groupBy("day", "flag").agg(F.count("*").alias("n"))


@query(
    "a28_gate",
    f"""WITH {_RANKS_SQL}, m AS (SELECT {_METRIC_SQL} FROM ranks), c AS (SELECT 'recall_8' AS name, recall_8 AS value, 0.4::DOUBLE AS least FROM m UNION ALL SELECT 'mrr_8', mrr_8, 0.2::DOUBLE FROM m UNION ALL SELECT 'cases', n::DOUBLE, 100.0::DOUBLE FROM m) SELECT name, value, value >= least AS passed, bool_and(value >= least) OVER () AS gate FROM c""",
)
def a28(spark, d):
    m = A.retrieval_metrics(ranks(spark, d), "rank", [])
    checks = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.lit(t).alias("least")) for n, c, t in (("recall_8", "recall_8", 0.4), ("mrr_8", "mrr_8", 0.2), ("cases", "n", 100.0))])
    c = m.select(F.explode(checks).alias("c"), F.forall(checks, lambda x: x["value"] >= x["least"]).alias("gate"))
    return c.select("c.name", "c.value", (F.col("c.value") >= F.col("c.least")).alias("passed"), "gate")


@query("a29_page_map_coverage", f"WITH {R_SQL} SELECT source, CAST(count(DISTINCT pdf_page_start) AS BIGINT) AS pages, CAST(count(DISTINCT CASE WHEN printed_page_start IS NOT NULL THEN pdf_page_start END) AS BIGINT) AS mapped FROM r GROUP BY source")
def a29(spark, d):
    p = table(spark, d, "records").groupBy("source", "pdf_page_start").agg(F.max(F.col("printed_page_start").isNotNull()).alias("mapped"))
    return p.filter("pdf_page_start is not null").groupBy("source").agg(F.count("*").alias("pages"), F.count_if("mapped").alias("mapped")).join(table(spark, d, "records").select("source").distinct(), "source", "right").na.fill(0)


@query(
    "a30_entry_attribution",
    f"""WITH {R_SQL}, {ENT_SQL}, x AS (SELECT e.work_id, e.ord, r.paragraph_id, (CASE WHEN contains({sql_label('r.article')}, {sql_label('e.article')}) THEN 1 ELSE 0 END) AS hit FROM ent e JOIN r ON r.source = e.source AND r.printed_page_start IN (e.start_page, (e.start_page + e.end_page) // 2, e.end_page))
  SELECT work_id, ord, CAST(count(*) AS BIGINT) AS n, round(avg(hit), 6) AS score FROM x GROUP BY ALL""",
)
def a30(spark, d):
    e = entries(spark, d).select("work_id", "ord", "source", T.label("article").alias("want"), F.array_distinct(F.array("start_page", F.floor((F.col("start_page") + F.col("end_page")) / 2).cast("int"), "end_page")).alias("ps"))
    e = e.select("work_id", "ord", "source", "want", F.explode("ps").alias("printed_page_start"))
    r = narrow(spark, d, "source", "printed_page_start", "article")
    x = r.join(I.dimension(e), ["source", "printed_page_start"])
    return x.groupBy("work_id", "ord").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.contains(T.label("article"), "want"), 1.0).otherwise(0.0)), 6).alias("score"))


@query(
    "a31_bigram_index",
    f"WITH {R_SQL}, h AS (SELECT source, paragraph_id, regexp_replace(paragraph_text, '[^一-鿿]+', '', 'g') AS h FROM r WHERE page_type = 'notes'), g AS (SELECT DISTINCT paragraph_id, unnest(list_transform(range(1, length(h)), lambda i: substring(h, i, 2))) AS g FROM h) SELECT g, CAST(count(*) AS BIGINT) AS pages, min(paragraph_id) AS first_page FROM g GROUP BY g",
)
def a31(spark, d):
    r = table(spark, d, "records").filter("page_type = 'notes'").select("paragraph_id", "paragraph_text").distinct()
    return r.select("paragraph_id", T.exploded(T.han_bigrams("paragraph_text"), "g")).filter("g is not null").groupBy("g").agg(F.count("*").alias("pages"), F.min("paragraph_id").alias("first_page"))


@query(
    "a32_metadata_accuracy",
    f"""WITH {HITS_SQL}, x AS (SELECT e.item_id, e.discipline, bool_or({sql_label('h.article')} = {sql_label('e.expected_work')}) AS hit, count(h.paragraph_id) AS n FROM eval_items e LEFT JOIN hits h USING (item_id) GROUP BY ALL)
  SELECT discipline, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS covered, round(count(*) FILTER (WHERE hit)::DOUBLE / nullif(count(*) FILTER (WHERE n > 0), 0), 6) AS precision FROM x GROUP BY discipline""",
)
def a32(spark, d):
    e = table(spark, d, "eval_items").select("item_id", "discipline", T.label("expected_work").alias("want"))
    x = e.join(hits(spark, d).select("item_id", T.label("article").alias("have"), "paragraph_id"), "item_id", "left").groupBy("item_id", "discipline").agg(F.max(F.col("have") == F.col("want")).alias("hit"), F.count("paragraph_id").alias("n"))
    return x.groupBy("discipline").agg(F.count("*").alias("items"), F.count_if(F.col("n") > 0).alias("covered"), F.round(F.try_divide(F.count_if("hit").cast("double"), F.count_if(F.col("n") > 0)), 6).alias("precision"))


@query(
    "a33_conversation_regression",
    f"WITH {Q_SQL} SELECT CASE WHEN answer_len = 0 THEN 'empty_answer' WHEN fallback_used THEN 'fallback' WHEN topic_id IS NULL AND memory_turns > 0 THEN 'missing_topic' ELSE 'ok' END AS reason, CAST(count(*) AS BIGINT) AS n, CAST(sum(memory_turns) AS BIGINT) AS turns FROM q GROUP BY 1",
)
def a33(spark, d):
    rules = [("empty_answer", F.col("answer_len") == 0), ("fallback", F.col("fallback_used")), ("missing_topic", F.col("topic_id").isNull() & (F.col("memory_turns") > 0))]
    return requests(spark, d).groupBy(A.first_code(rules, "ok").alias("reason")).agg(F.count("*").alias("n"), F.sum("memory_turns").alias("turns"))
