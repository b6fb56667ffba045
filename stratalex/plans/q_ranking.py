"""Queries of ranking, top-k, fusion and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.operators import aggregates as A
from stratalex.operators import filters as P
from stratalex.operators import intervals as I
from stratalex.operators import joins as J
from stratalex.operators import ranking as R
from stratalex.plans.base import (
    BODY_SQL, CHANNELS_SQL, CIT_SQL, ENT_SQL, HITS_SQL, R_SQL, bm25_sql, body, citations, entries, hits, narrow, questions, sql_label, sql_match, text_channel, title_channel,
)
from stratalex.plans.catalog import query
from stratalex.plans.q_aggregates import _METRIC_SQL, _RANKS_SQL, ranks
from stratalex.session import table

_HAY_SQL = sql_match("coalesce(h.book, '') || ' ' || coalesce(h.article, '') || ' ' || substring(coalesce(h.paragraph_text, ''), 1, 600)")
_PARTS_SQL = f"""{HITS_SQL}, s AS (SELECT h.item_id, h.paragraph_id, h.rank, CASE WHEN list_contains(e.source_scope, h.source) THEN 100 ELSE 0 END AS source_part, CASE WHEN h.distance <= 1 THEN 40 ELSE 0 END AS page_part,
  CASE WHEN e.expected_work IS NULL THEN 0 ELSE CASE WHEN contains({sql_label('h.article')}, {sql_label('e.expected_work')}) THEN 35 ELSE 0 END + CASE WHEN contains({_HAY_SQL}, {sql_match('e.expected_work')}) THEN 25 ELSE 0 END END AS article_part,
  CASE WHEN {sql_match('e.question')} <> '' AND contains({_HAY_SQL}, {sql_match('e.question')}) THEN 10 ELSE 0 END AS query_part,
  CAST(least(coalesce(list_sum(list_transform(e.tags, lambda t: CASE WHEN contains({sql_label('h.article')}, {sql_label('t')}) THEN 28 ELSE 0 END + CASE WHEN contains(substring(coalesce(h.paragraph_text, ''), 1, 400), t) THEN 24 WHEN contains(coalesce(h.paragraph_text, ''), t) THEN 10 ELSE 0 END)), 0), 120) AS INTEGER) AS topic_part,
  CASE WHEN h.page_type IN ('toc', 'title_page') THEN -60 ELSE 0 END + CASE WHEN length(coalesce(h.paragraph_text, '')) < 40 THEN -30 ELSE 0 END AS quality_part
  FROM hits h JOIN eval_items e USING (item_id))"""


def parts(spark, d):
    e = table(spark, d, "eval_items").select("item_id", "question", "expected_work", "source_scope", "tags")
    h = hits(spark, d).join(I.dimension(e), "item_id")
    text, article = F.coalesce("paragraph_text", F.lit("")), F.coalesce("article", F.lit(""))
    h = h.withColumn("hay", T.match_form(F.concat_ws(" ", F.coalesce("book", F.lit("")), article, F.substring(text, 1, 600)))).withColumn("label", T.label("article"))
    title = F.when(F.col("expected_work").isNull(), 0).otherwise(
        F.when(F.contains("label", T.label("expected_work")), 35).otherwise(0) + F.when(F.contains("hay", T.match_form("expected_work")), 25).otherwise(0)
    )
    lead = F.substring(text, 1, 400)
    topic = F.aggregate(
        F.coalesce("tags", F.array().cast("array<string>")), F.lit(0),
        lambda s, t: s + F.when(F.contains(F.col("label"), T.label(t)), 28).otherwise(0) + F.when(F.contains(lead, t), 24).when(F.contains(text, t), 10).otherwise(0),
    )
    asked = T.match_form("question")
    return h.select(
        "item_id", "paragraph_id", "rank", F.when(F.array_contains("source_scope", F.col("source")), 100).otherwise(0).alias("source_part"), F.when(F.col("distance") <= 1, 40).otherwise(0).alias("page_part"),
        title.alias("article_part"), F.when((asked != "") & F.contains("hay", asked), 10).otherwise(0).alias("query_part"), F.least(topic, F.lit(120)).alias("topic_part"),
        (F.when(F.col("page_type").isin("toc", "title_page"), -60).otherwise(0) + F.when(F.length(text) < 40, -30).otherwise(0)).alias("quality_part"),
    )


_NAMES = ["source_part", "page_part", "article_part", "query_part", "topic_part", "quality_part"]
_SUM_SQL = " + ".join(_NAMES)


def total():
    return sum((F.col(n) for n in _NAMES[1:]), F.col(_NAMES[0]))


@query(
    "t01_rule_rerank",
    f"WITH {_PARTS_SQL} SELECT item_id, paragraph_id, CAST({_SUM_SQL} AS BIGINT) AS score, row_number() OVER (PARTITION BY item_id ORDER BY {_SUM_SQL} DESC, rank) AS position FROM s",
)
def t01(spark, d):
    s = parts(spark, d).withColumn("score", total().cast("long"))
    return R.ranked(s, ["item_id"], [F.desc("score"), F.asc("rank")], "position").select("item_id", "paragraph_id", "score", "position")


@query("t02_score_parts", f"WITH {_PARTS_SQL} SELECT item_id, paragraph_id, source_part, page_part, article_part, query_part FROM s")
def t02(spark, d):
    return parts(spark, d).select("item_id", "paragraph_id", "source_part", "page_part", "article_part", "query_part")


@query("t03_topic_parts", f"WITH {_PARTS_SQL} SELECT item_id, paragraph_id, topic_part FROM s WHERE topic_part > 0")
def t03(spark, d):
    return parts(spark, d).filter("topic_part > 0").select("item_id", "paragraph_id", "topic_part")


_MERGED_SQL = f"""{HITS_SQL}, {CHANNELS_SQL},
  m AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.paragraph_id, b.paragraph_id) AS paragraph_id, a.rank AS dr, b.rank AS sr, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce((CASE WHEN a.rank IS NOT NULL THEN 1.15::DOUBLE ELSE 0.72::DOUBLE END) / (55 + b.rank), 0), 6) AS rrf
  FROM dense a FULL JOIN sparse b ON a.item_id = b.item_id AND a.paragraph_id = b.paragraph_id)"""


def merged(spark, d):
    return J.hybrid_merge(title_channel(spark, d), text_channel(spark, d, 8), "item_id", "paragraph_id")


@query(
    "t04_hybrid_signal",
    f"WITH {_MERGED_SQL} SELECT item_id, paragraph_id, CAST(CASE WHEN dr IS NOT NULL AND sr IS NOT NULL THEN 10 WHEN sr IS NOT NULL THEN 1 ELSE 0 END + least(CAST(floor(rrf * 320) AS INTEGER), 9) + CASE WHEN sr IS NOT NULL THEN least(CAST(floor(ln(1 + 20.0::DOUBLE / sr) * (CASE WHEN dr IS NOT NULL THEN 1.7::DOUBLE ELSE 1.0::DOUBLE END)) AS INTEGER), CASE WHEN dr IS NOT NULL THEN 6 ELSE 4 END) ELSE 0 END - CASE WHEN sr IS NOT NULL AND dr IS NULL THEN 6 ELSE 0 END AS INTEGER) AS signal FROM m",
)
def t04(spark, d):
    dr, sr = F.col("dense_rank"), F.col("sparse_rank")
    base = F.when(dr.isNotNull() & sr.isNotNull(), 10).when(sr.isNotNull(), 1).otherwise(0)
    fused = F.least(F.floor(F.col("score") * 320).cast("int"), F.lit(9))
    lexical = F.when(sr.isNotNull(), F.least(F.floor(F.log(1 + 20.0 / sr) * F.when(dr.isNotNull(), 1.7).otherwise(1.0)).cast("int"), F.when(dr.isNotNull(), 6).otherwise(4))).otherwise(0)
    return merged(spark, d).select("item_id", "paragraph_id", (base + fused + lexical - F.when(sr.isNotNull() & dr.isNull(), 6).otherwise(0)).cast("int").alias("signal"))


@query(
    "t05_concept_focus",
    f"""WITH {HITS_SQL}, x AS (SELECT h.item_id, h.paragraph_id, instr(coalesce(h.paragraph_text, ''), t.tag) AS p FROM hits h JOIN (SELECT item_id, unnest(tags) AS tag FROM eval_items) t USING (item_id))
  SELECT item_id, paragraph_id, CAST(sum(CASE WHEN p = 0 THEN 0 WHEN p <= 120 THEN 95 WHEN p <= 260 THEN 72 ELSE 30 END) AS BIGINT) AS focus FROM x GROUP BY ALL""",
)
def t05(spark, d):
    tags = table(spark, d, "eval_items").select("item_id", F.explode("tags").alias("tag"))
    p = F.instr(F.coalesce("paragraph_text", F.lit("")), F.col("tag"))
    x = hits(spark, d).join(I.dimension(tags), "item_id").select("item_id", "paragraph_id", p.alias("p"))
    return x.groupBy("item_id", "paragraph_id").agg(F.sum(F.when(F.col("p") == 0, 0).when(F.col("p") <= 120, 95).when(F.col("p") <= 260, 72).otherwise(30)).alias("focus"))


@query("t06_diversify", None)
def t06(spark, d):
    h = hits(spark, d).select("item_id", "paragraph_id", "rank", "source", T.label("article").alias("article"))
    return R.diversify(h, "item_id", "rank", "source", "article", 6)


@query("t07_topic_tiers", None)
def t07(spark, d):
    p = parts(spark, d).withColumn("tier", F.when(F.col("topic_part") >= 24, 0).when(F.col("topic_part") > 0, 1).otherwise(2))
    s = hits(spark, d).select("item_id", "paragraph_id", "source", T.label("article").alias("article"))
    ranked = R.ranked(p.select("item_id", "paragraph_id", "tier", "rank"), ["item_id"], [F.asc("tier"), F.asc("rank")], "order")
    return R.diversify(ranked.join(s, ["item_id", "paragraph_id"]), "item_id", "order", "source", "article", 6, 3, 2)


@query(
    "t08_edition_preference",
    f"WITH {_MERGED_SQL}, k AS (SELECT m.*, CASE WHEN regexp_matches(r.source, '^qb') THEN 0 WHEN regexp_matches(r.source, '^xj') THEN 1 ELSE 2 END AS prio FROM m JOIN r USING (paragraph_id)) SELECT item_id, paragraph_id, row_number() OVER (PARTITION BY item_id ORDER BY prio, coalesce(dr, 9999), coalesce(sr, 9999), paragraph_id) AS position FROM k",
)
def t08(spark, d):
    m = merged(spark, d).join(narrow(spark, d, "source"), "paragraph_id").withColumn("prio", P.family_rank("source", ["^qb", "^xj"]))
    order = [F.asc("prio"), F.coalesce("dense_rank", F.lit(9999)).asc(), F.coalesce("sparse_rank", F.lit(9999)).asc(), F.asc("paragraph_id")]
    return R.ranked(m, ["item_id"], order, "position").select("item_id", "paragraph_id", "position")


@query(
    "t09_exact_neighbours",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
)
def t09(spark, d):
    e = table(spark, d, "embeddings")
    return R.exact_neighbours(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), 10)


@query("t09_neighbours_by_cells", None)
def t09b(spark, d):
    e = table(spark, d, "embeddings")
    return R.cell_neighbours(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), 10)


_LISTS_SQL = f"{HITS_SQL}, {CHANNELS_SQL}, l AS (SELECT item_id, paragraph_id, rank, 'dense' AS channel FROM dense UNION ALL SELECT item_id, paragraph_id, rank, 'sparse' FROM sparse)"


def lists(spark, d):
    one = title_channel(spark, d).select("item_id", "paragraph_id", "rank", F.lit("dense").alias("channel"))
    return one.unionByName(text_channel(spark, d, 8).select("item_id", "paragraph_id", "rank", F.lit("sparse").alias("channel")))


@query("t10_server_hybrid", f"WITH {_LISTS_SQL} SELECT item_id, paragraph_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, CAST(count(DISTINCT channel) AS BIGINT) AS lists FROM l GROUP BY ALL")
def t10(spark, d):
    return R.rrf(lists(spark, d), "item_id", "paragraph_id").select("item_id", "paragraph_id", "score", "lists")


@query(
    "t11_multi_list_rrf",
    f"WITH {_LISTS_SQL}, f AS (SELECT item_id, paragraph_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min((channel, rank)) AS best FROM l GROUP BY ALL) SELECT item_id, paragraph_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, best) AS position FROM f QUALIFY position <= 12",
)
def t11(spark, d):
    return R.top_k(R.rrf(lists(spark, d), "item_id", "paragraph_id"), ["item_id"], [F.desc("score"), F.asc("best")], 12, "position").select("item_id", "paragraph_id", "score", "position")


_BM25_SQL = f"{R_SQL}, {BODY_SQL}, {bm25_sql('', 'b', 'paragraph_text')}"


@query("t12_bm25_topk", f"WITH {_BM25_SQL} SELECT item_id, paragraph_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paragraph_id) AS rank FROM sc QUALIFY rank <= 8")
def t12(spark, d):
    return R.bm25_topk(body(spark, d), "paragraph_id", "paragraph_text", questions(spark, d), "item_id", "asked")


@query(
    "t13_bm25_phrase_rerank",
    f"""WITH {_BM25_SQL}, p AS (SELECT item_id, paragraph_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paragraph_id) AS rank FROM sc QUALIFY rank <= 50),
  x AS (SELECT p.item_id, p.paragraph_id, round(p.score + CASE WHEN e.expected_work IS NOT NULL AND contains({sql_label('r.article')}, {sql_label('e.expected_work')}) THEN 6.0::DOUBLE ELSE 0.0::DOUBLE END + 0.6::DOUBLE * len(list_filter(e.tags, lambda t: contains(substring(r.paragraph_text, 1, 300), t))), 6) AS score FROM p JOIN r USING (paragraph_id) JOIN eval_items e USING (item_id))
  SELECT item_id, paragraph_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paragraph_id) AS rank FROM x QUALIFY rank <= 8""",
)
def t13(spark, d):
    p = R.bm25_topk(body(spark, d), "paragraph_id", "paragraph_text", questions(spark, d), "item_id", "asked", k=50).drop("rank")
    e = table(spark, d, "eval_items").select("item_id", "expected_work", "tags")
    x = p.join(narrow(spark, d, "article", "paragraph_text"), "paragraph_id").join(I.dimension(e), "item_id")
    title = F.when(F.col("expected_work").isNotNull() & F.contains(T.label("article"), T.label("expected_work")), 6.0).otherwise(0.0)
    lead = 0.6 * F.size(F.filter("tags", lambda t: F.contains(F.substring("paragraph_text", 1, 300), t)))
    x = x.select("item_id", "paragraph_id", F.round(F.col("score") + title + lead, 6).alias("score"))
    return R.top_k(x, ["item_id"], [F.desc("score"), F.asc("paragraph_id")], 8)


@query(
    "t14_quote_index_topk",
    f"""WITH {R_SQL}, {CIT_SQL}, qs AS (SELECT item_id, regexp_replace(quote, '[^一-鿿]+', '', 'g') AS h FROM cit WHERE quote IS NOT NULL AND item_id % 20 = 0), qg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(h)), lambda i: substring(h, i, 2))) AS g FROM qs),
  ps AS (SELECT paragraph_id, regexp_replace(paragraph_text, '[^一-鿿]+', '', 'g') AS h FROM r), pg AS (SELECT DISTINCT paragraph_id, unnest(list_transform(range(1, length(h)), lambda i: substring(h, i, 2))) AS g FROM ps), n AS (SELECT item_id, paragraph_id, count(*) AS shared FROM qg JOIN pg USING (g) GROUP BY ALL)
  SELECT item_id, paragraph_id, shared, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, paragraph_id) AS rank FROM n QUALIFY rank <= 60""",
)
def t14(spark, d):
    q = citations(spark, d).filter("ord = 0 and item_id % 20 = 0").select("item_id", "quote")
    return J.gram_candidates(narrow(spark, d, "paragraph_text"), "paragraph_id", F.col("paragraph_text"), q, "item_id", F.col("quote"), 60)


@query(
    "t15_hit_quality",
    f"""WITH {R_SQL}, x AS (SELECT r.paragraph_id, c.work_id, r.page_type, length(r.paragraph_text) AS n, instr(r.paragraph_text, c.k) AS p FROM r JOIN (SELECT work_id, unnest(quotes) AS k FROM core_classics) c ON contains(r.paragraph_text, c.k))
  SELECT DISTINCT paragraph_id, work_id, CASE WHEN page_type IN ('toc', 'title_page') THEN 4 WHEN page_type <> 'body' THEN 3 WHEN n < 80 THEN 2 WHEN p::DOUBLE / n < 0.15 THEN 1 ELSE 0 END AS quality FROM x""",
)
def t15(spark, d):
    c = table(spark, d, "core_classics").select("work_id", F.explode("quotes").alias("k"))
    x = J.containing(narrow(spark, d, "page_type", "paragraph_text").filter("paragraph_text is not null"), "paragraph_text", c, "k")
    n, p = F.length("paragraph_text"), F.instr(F.col("paragraph_text"), F.col("k"))
    rank = F.when(F.col("page_type").isin("toc", "title_page"), 4).when(F.col("page_type") != "body", 3).when(n < 80, 2).when(p / n < 0.15, 1).otherwise(0)
    return x.select("paragraph_id", "work_id", rank.alias("quality")).distinct()


@query(
    "t16_backstop_quota",
    f"""WITH {HITS_SQL}, {ENT_SQL}, n AS (SELECT item_id, count(*) AS have FROM hits WHERE rank <= 3 GROUP BY 1), bs AS (SELECT c.item_id, e.work_id, e.ord, row_number() OVER (PARTITION BY c.item_id ORDER BY e.priority DESC, e.work_id, e.ord) AS r FROM (SELECT DISTINCT item_id, source FROM cit) c JOIN ent e USING (source))
  SELECT bs.item_id, bs.work_id, bs.ord, bs.r FROM bs LEFT JOIN n USING (item_id) WHERE bs.r <= 3 - coalesce(n.have, 0)""",
)
def t16(spark, d):
    have = hits(spark, d).filter("rank <= 3").groupBy("item_id").agg(F.count("*").alias("have"))
    bs = citations(spark, d).select("item_id", "source").distinct().join(I.dimension(entries(spark, d)), "source")
    bs = R.top_k(bs.select("item_id", "work_id", "ord", "priority"), ["item_id"], [F.desc("priority"), F.asc("work_id"), F.asc("ord")], 3, "r")
    return bs.join(have, "item_id", "left").filter(F.col("r") <= 3 - F.coalesce("have", F.lit(0))).select("item_id", "work_id", "ord", "r")


@query("t17_dimension_sample", None)
def t17(spark, d):
    r = narrow(spark, d, "source", "page_type", "text_source").withColumn("stratum", F.concat_ws("/", "page_type", "text_source"))
    return R.hash_sample(r, ["stratum", "source"], F.col("paragraph_id"), 1, "probe").select("paragraph_id", "stratum", "source")


@query(
    "t18_stratified_sample",
    "SELECT item_id, discipline FROM eval_items QUALIFY row_number() OVER (PARTITION BY discipline ORDER BY sha256('s1|' || item_id)) <= 5",
)
def t18(spark, d):
    return R.hash_sample(questions(spark, d), ["discipline"], F.col("item_id"), 5, "s1").select("item_id", "discipline")


@query(
    "t19_filtered_sample",
    f"WITH {R_SQL}, k AS (SELECT *, sha256('s2|' || paragraph_id) AS o FROM r WHERE page_type = 'body' AND printed_page_start IS NOT NULL AND length(paragraph_text) >= 100) SELECT paragraph_id, source FROM k QUALIFY row_number() OVER (ORDER BY o) <= 100",
)
def t19(spark, d):
    r = table(spark, d, "records").filter("page_type = 'body' and printed_page_start is not null and length(paragraph_text) >= 100").select("paragraph_id", "source").distinct()
    return r.orderBy(F.sha2(F.concat_ws("|", F.lit("s2"), "paragraph_id"), 256)).limit(100)


@query(
    "t20_best_configuration",
    f"WITH {_RANKS_SQL}, m AS (SELECT evaluation_mode, {_METRIC_SQL} FROM ranks GROUP BY evaluation_mode) SELECT evaluation_mode, recall_8, mrr_8 FROM m ORDER BY recall_8 DESC, mrr_8 DESC, recall_1 DESC, evaluation_mode LIMIT 1",
)
def t20(spark, d):
    m = A.retrieval_metrics(ranks(spark, d), "rank", ["evaluation_mode"])
    return m.orderBy(F.desc("recall_8"), F.desc("mrr_8"), F.desc("recall_1"), "evaluation_mode").limit(1).select("evaluation_mode", "recall_8", "mrr_8")


@query(
    "t21_budgeted_prefix",
    f"WITH {HITS_SQL}, c AS (SELECT item_id, paragraph_id, rank, sum(length(coalesce(paragraph_text, '')) + 2) OVER (PARTITION BY item_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM hits) SELECT item_id, paragraph_id, CAST(least(used, 1500) AS BIGINT) AS used FROM c WHERE used <= 1500 OR rank = 1",
)
def t21(spark, d):
    w = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length(F.coalesce("paragraph_text", F.lit(""))) + 2).over(w)
    c = hits(spark, d).withColumn("used", used).filter((F.col("used") <= 1500) | (F.col("rank") == 1))
    return c.select("item_id", "paragraph_id", F.least("used", F.lit(1500)).cast("long").alias("used"))


@query(
    "t22_evidence_ranking",
    f"""WITH {HITS_SQL}, x AS (SELECT h.item_id, h.paragraph_id, h.rank, CAST(sum((CASE WHEN contains(coalesce(h.paragraph_text, ''), t.tag) THEN 3 ELSE 0 END) + (CASE WHEN contains({sql_label('h.article')}, {sql_label('t.tag')}) THEN 5 ELSE 0 END)) AS BIGINT) AS score FROM hits h JOIN (SELECT item_id, unnest(tags) AS tag FROM eval_items) t USING (item_id) GROUP BY ALL)
  SELECT item_id, paragraph_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS position FROM x WHERE score > 0 QUALIFY position <= 8""",
)
def t22(spark, d):
    tags = table(spark, d, "eval_items").select("item_id", F.explode("tags").alias("tag"))
    x = hits(spark, d).join(I.dimension(tags), "item_id").groupBy("item_id", "paragraph_id", "rank").agg(
        F.sum(F.when(F.contains(F.coalesce("paragraph_text", F.lit("")), F.col("tag")), 3).otherwise(0) + F.when(F.contains(T.label("article"), T.label("tag")), 5).otherwise(0)).alias("score")
    )
    return R.top_k(x.filter("score > 0"), ["item_id"], [F.desc("score"), F.asc("rank")], 8, "position").drop("rank")


@query(
    "t23_best_clause",
    f"""WITH {HITS_SQL}, c AS (SELECT h.item_id, h.paragraph_id, unnest(string_split_regex(coalesce(h.paragraph_text, ''), '[。；！？]')) AS clause, generate_subscripts(string_split_regex(coalesce(h.paragraph_text, ''), '[。；！？]'), 1) - 1 AS pos FROM hits h WHERE h.rank = 1),
  s AS (SELECT c.item_id, c.paragraph_id, c.pos, c.clause, len(list_filter(e.tags, lambda t: contains(c.clause, t))) - CASE WHEN length(c.clause) < 12 THEN 1 ELSE 0 END AS score FROM c JOIN eval_items e USING (item_id)) SELECT item_id, paragraph_id, pos, clause FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) = 1""",
)
def t23(spark, d):
    e = table(spark, d, "eval_items").select("item_id", "tags")
    c = hits(spark, d).filter("rank = 1").select("item_id", "paragraph_id", F.posexplode(F.split(F.coalesce("paragraph_text", F.lit("")), "[。；！？]")).alias("pos", "clause")).join(I.dimension(e), "item_id")
    score = F.size(F.filter("tags", lambda t: F.contains(F.col("clause"), t))) - F.when(F.length("clause") < 12, 1).otherwise(0)
    return R.first_per(c.withColumn("score", score), ["item_id"], [F.desc("score"), F.asc("pos")]).select("item_id", "paragraph_id", "pos", "clause")


@query(
    "t24_page_refinement",
    f"""WITH {HITS_SQL}, x AS (SELECT h.item_id, h.page, sum(CASE WHEN contains(coalesce(h.paragraph_text, ''), substring(c.quote, 1, 4)) THEN 2 ELSE 0 END + CASE WHEN h.distance = 0 THEN 1 ELSE 0 END) AS score, bool_or(h.printed_page_start IS NOT NULL) AS printed FROM hits h JOIN cit c USING (item_id) GROUP BY ALL)
  SELECT item_id, page, CAST(score AS BIGINT) AS score FROM x QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, printed DESC, page DESC) = 1""",
)
def t24(spark, d):
    c = citations(spark, d).select("item_id", "quote")
    h = hits(spark, d).select("item_id", "page", "paragraph_text", "distance", "printed_page_start").join(I.dimension(c), "item_id")
    gain = F.when(F.contains(F.coalesce("paragraph_text", F.lit("")), F.substring("quote", 1, 4)), 2).otherwise(0) + F.when(F.col("distance") == 0, 1).otherwise(0)
    x = h.groupBy("item_id", "page").agg(F.sum(gain).alias("score"), F.max(F.col("printed_page_start").isNotNull()).alias("printed"))
    return R.first_per(x, ["item_id"], [F.desc("score"), F.desc("printed"), F.desc("page")]).select("item_id", "page", "score")


@query(
    "t25_one_per_source_then_fill",
    f"""WITH {R_SQL}, k AS (SELECT paragraph_id, source, sha256('s3|' || paragraph_id) AS o FROM r WHERE page_type = 'body'), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o) AS i FROM k) SELECT paragraph_id, source FROM s QUALIFY row_number() OVER (ORDER BY CASE WHEN i = 1 THEN 0 ELSE 1 END, o) <= 60""",
)
def t25(spark, d):
    k = table(spark, d, "records").filter("page_type = 'body'").select("paragraph_id", "source").distinct().withColumn("o", F.sha2(F.concat_ws("|", F.lit("s3"), "paragraph_id"), 256))
    # 60 rows can only come from the first 60 of each source
    s = R.top_k(k, ["source"], [F.asc("o")], 60, "i")
    return s.orderBy(F.when(F.col("i") == 1, 0).otherwise(1), "o").limit(60).select("paragraph_id", "source")


@query("t26_band_numbers", None)
def t26(spark, d):
    r = narrow(spark, d, "page_type", "paragraph_text").filter("page_type = 'toc'")
    spans = r.select("paragraph_id", F.posexplode(F.split("paragraph_text", "\n")).alias("y", "line")).select("paragraph_id", "y", F.posexplode(F.regexp_extract_all("line", F.lit("[0-9]+"), F.lit(0))).alias("x", "digits"))
    bands = spans.groupBy("paragraph_id", F.floor(F.col("y") / 2).alias("band")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "digits"))), lambda s: s["digits"]), " ").alias("number"))
    return R.first_per(bands, ["paragraph_id"], [F.asc("band")])
