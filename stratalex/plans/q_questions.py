"""Queries of question understanding, citations and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.operators import aggregates as A
from stratalex.operators import citing as C
from stratalex.operators import filters as P
from stratalex.operators import intervals as I
from stratalex.operators import models as M
from stratalex.operators import ranking as R
from stratalex.operators import validation as V
from stratalex.plans.base import ASKED_SQL, CIT_SQL, ENT_SQL, HITS_SQL, R_SQL, citations, entries, hits, narrow, questions, sq, sql_label, sql_match
from stratalex.plans.catalog import query
from stratalex.session import table

KINDS = {"meaning": ["怎样理解", "含义"], "place": ["哪里讨论", "出自哪一篇", "出自"], "quote": ["原文", "原文和页码"]}


@query(
    "q01_structure_features",
    """SELECT item_id, CASE WHEN contains(question, '原文和页码') THEN 'quote' WHEN contains(question, '出自哪一篇') THEN 'place' WHEN contains(question, '怎样理解') THEN 'meaning' WHEN contains(question, '哪里讨论') THEN 'place' WHEN contains(question, '含义') THEN 'meaning' WHEN contains(question, '出自') THEN 'place' WHEN contains(question, '原文') THEN 'quote' ELSE 'other' END AS kind,
  contains(question, '“') AS quoted, regexp_matches(question, '[0-9０-９]') AS digits, regexp_matches(question, '[？?]$') AS asks, CAST(length(question) AS INTEGER) AS n FROM eval_items""",
)
def q01(spark, d):
    q = F.col("question")
    return questions(spark, d).select(
        "item_id", C.question_kind(q, KINDS, "other").alias("kind"), F.contains(q, F.lit("“")).alias("quoted"), q.rlike("[0-9０-９]").alias("digits"), q.rlike("[？?]$").alias("asks"), F.length(q).alias("n")
    )


RULES = {"meaning": [("怎样理解", 0.6), ("含义", 0.4)], "place": [("哪里|哪一篇", 0.7), ("讨论|论述", 0.3)], "quote": [("原文", 0.6), ("页码", 0.3), ("“", 0.2)]}


@query(
    "q02_intent_scores",
    "SELECT item_id, "
    + ", ".join(
        "round(greatest(" + ("0.15" if k == "meaning" else "0.0") + "::DOUBLE, least(1.0::DOUBLE, " + " + ".join(f"CASE WHEN regexp_matches(question, {sq(p)}) THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w in rs) + f")), 6) AS {k}"
        for k, rs in RULES.items()
    )
    + " FROM eval_items",
)
def q02(spark, d):
    q = F.col("question")
    return questions(spark, d).select("item_id", *[F.round(C.additive_score(q, rs, 0.15 if k == "meaning" else 0.0), 6).alias(k) for k, rs in RULES.items()])


@query(
    "q03_router",
    """WITH s AS (SELECT item_id, question, expected_work FROM eval_items) SELECT item_id, CASE WHEN length(question) < 4 THEN 'unreadable' WHEN contains(question, '“') THEN 'quote' WHEN regexp_matches(question, '原文|页码') THEN 'quote' WHEN regexp_matches(question, '哪里|哪一篇') THEN 'place' WHEN EXISTS (SELECT 1 FROM core_classics c WHERE c.title = s.expected_work) THEN 'work' ELSE 'meaning' END AS route FROM s""",
)
def q03(spark, d):
    known = table(spark, d, "core_classics").select(F.col("title").alias("expected_work"), F.lit(True).alias("known")).distinct()
    s = table(spark, d, "eval_items").select("item_id", "question", "expected_work").join(I.dimension(known), "expected_work", "left")
    q = F.col("question")
    rules = [("unreadable", F.length(q) < 4), ("quote", F.contains(q, F.lit("“"))), ("quote", q.rlike("原文|页码")), ("place", q.rlike("哪里|哪一篇")), ("work", F.col("known").isNotNull())]
    return s.select("item_id", A.first_code(rules, "meaning").alias("route"))


@query("q04_boolean_classifiers", "SELECT item_id, regexp_matches(question, '原文|页码|“') AS wants_quote, regexp_matches(question, '哪一卷|哪一篇|出自') AS bibliographic, regexp_matches(question, '比较|区别|关系') AS compares FROM eval_items")
def q04(spark, d):
    q = F.col("question")
    return questions(spark, d).select("item_id", q.rlike("原文|页码|“").alias("wants_quote"), q.rlike("哪一卷|哪一篇|出自").alias("bibliographic"), q.rlike("比较|区别|关系").alias("compares"))


@query("q05_title_extraction", "SELECT item_id, coalesce(nullif(regexp_extract(question, '《([^》]+)》', 1), ''), nullif(regexp_extract(question, '“([^”]+)”', 1), ''), nullif(regexp_extract(question, '关于(.+?)的', 1), ''), expected_work) AS title FROM eval_items")
def q05(spark, d):
    pick = lambda p: F.nullif(F.regexp_extract("question", p, 1), F.lit(""))
    return table(spark, d, "eval_items").select("item_id", F.coalesce(pick("《([^》]+)》"), pick("“([^”]+)”"), pick("关于(.+?)的"), "expected_work").alias("title"))


@query(
    "q06_query_plan",
    """WITH v AS (SELECT item_id, list_filter([question, CASE WHEN len(tags) > 0 THEN tags[1] || ' 论述' END, expected_work, CASE WHEN len(tags) > 1 THEN tags[1] || '与' || tags[2] END], lambda x: coalesce(x, '') <> '') AS v FROM eval_items)
  SELECT item_id, i AS variant_no, v[i] AS variant FROM (SELECT item_id, v, unnest(range(1, len(v) + 1)) AS i FROM v)""",
)
def q06(spark, d):
    t = F.col("tags")
    v = F.array(F.col("question"), F.when(F.size(t) > 0, F.concat(F.get(t, 0), F.lit(" 论述"))), F.col("expected_work"), F.when(F.size(t) > 1, F.concat(F.get(t, 0), F.lit("与"), F.get(t, 1))))
    kept = F.filter(F.array_compact(v), lambda x: x != "")
    return table(spark, d, "eval_items").select("item_id", F.posexplode(kept).alias("p", "variant")).select("item_id", (F.col("p") + 1).cast("long").alias("variant_no"), "variant")


@query(
    "q08_constraint_cascade",
    f"""WITH {ENT_SQL}, a AS (SELECT e.item_id, 0 AS stage, m.source, m.start_printed_page AS s, m.end_printed_page AS t FROM eval_items e JOIN article_map m ON m.title = e.expected_work UNION ALL
  SELECT e.item_id, 1, x.source, x.start_page, x.end_page FROM eval_items e JOIN ent x ON x.article = e.expected_work UNION ALL SELECT item_id, 2, unnest(source_scope), NULL, NULL FROM eval_items) SELECT item_id, stage, source, s, t FROM a QUALIFY stage = min(stage) OVER (PARTITION BY item_id)""",
)
def q08(spark, d):
    e = table(spark, d, "eval_items").select("item_id", "expected_work", "source_scope")
    m = table(spark, d, "article_map").select(F.col("title").alias("expected_work"), "source", F.col("start_printed_page").alias("s"), F.col("end_printed_page").alias("t"))
    x = entries(spark, d).select(F.col("article").alias("expected_work"), "source", F.col("start_page").alias("s"), F.col("end_page").alias("t"))
    stage = lambda df, i: df.select("item_id", F.lit(i).alias("stage"), "source", "s", "t")
    scope = e.select("item_id", F.explode("source_scope").alias("source"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("t"))
    every = stage(e.join(I.dimension(m), "expected_work"), 0).unionByName(stage(e.join(I.dimension(x), "expected_work"), 1)).unionByName(stage(scope, 2))
    return every.withColumn("_m", F.min("stage").over(Window.partitionBy("item_id"))).filter("stage = _m").drop("_m")


@query("q09_model_blend", None)
def q09(spark, d):
    e = table(spark, d, "embeddings")
    train, test = M.split_by_hash(e, "vec_id", 0.2, "q09")
    p = M.predicted(M.fitted(train, "embedding", "label"), test, "embedding")
    rules = F.when(F.col("label") == 0, 1.0).otherwise(0.0)
    return p.select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"), F.round(M.blended(F.col("probability")[0], rules), 4).alias("blend_0"))


@query("q10_model_report", None)
def q10(spark, d):
    e = table(spark, d, "embeddings")
    train, test = M.split_by_hash(e, "vec_id", 0.2, "q10")
    return M.f1_report(M.predicted(M.fitted(train, "embedding", "label"), test, "embedding"), "label", "prediction")


@query(
    "q11_template_dataset",
    """WITH t AS (SELECT * FROM (VALUES (0, '怎样理解', '？'), (1, '哪里讨论了', '？'), (2, '请给出关于', '的原文。')) AS t(template, a, b)), x AS (SELECT t.template, c.work_id, t.a || c.title || t.b AS query FROM t, core_classics c)
  SELECT template, work_id, query FROM x QUALIFY row_number() OVER (PARTITION BY template ORDER BY sha256('q11|' || query), work_id) <= 20""",
)
def q11(spark, d):
    t = spark.createDataFrame([(0, "怎样理解", "？"), (1, "哪里讨论了", "？"), (2, "请给出关于", "的原文。")], "template int, a string, b string")
    # a fixed set of templates beside a fixed catalog: each title is filled into each template
    each = F.explode(F.array(*[F.struct(F.lit(r["template"]).alias("template"), F.lit(r["a"]).alias("a"), F.lit(r["b"]).alias("b")) for r in t.collect()]))
    x = table(spark, d, "core_classics").select("work_id", "title", each.alias("t")).select("t.template", "work_id", F.concat("t.a", "title", "t.b").alias("query"))
    return R.top_k(x, ["template"], [F.sha2(F.concat_ws("|", F.lit("q11"), "query"), 256).asc(), F.asc("work_id")], 20, "_i").drop("_i")


# ---------------------------------------------------------------- citations


_CITE_SQL = """concat_ws('，', '《' || book || '》', nullif(trim(article), ''), CASE WHEN printed_page_start IS NOT NULL THEN '第' || printed_page_start || '页' WHEN citation_page_start IS NOT NULL THEN '第' || citation_page_start || '页' WHEN pdf_page_start IS NOT NULL THEN 'PDF第' || pdf_page_start || '页' END)"""


@query("c01_citation_format", f"WITH {R_SQL} SELECT paragraph_id, {_CITE_SQL} AS citation FROM r")
def c01(spark, d):
    r = narrow(spark, d, "book", "article", "printed_page_start", "citation_page_start", "pdf_page_start")
    return r.select("paragraph_id", C.rendered(F.col("book"), F.col("article"), F.col("printed_page_start"), F.col("citation_page_start"), F.col("pdf_page_start")).alias("citation"))


_CARDS_SQL = f"""{HITS_SQL}, one AS (SELECT *, substring(coalesce(paragraph_text, ''), 1, 80) AS excerpt FROM hits QUALIFY row_number() OVER (PARTITION BY item_id, source, page, article, substring(coalesce(paragraph_text, ''), 1, 80) ORDER BY rank) = 1),
  cards AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS card_no FROM one QUALIFY card_no <= 12)"""


def cards(spark, d):
    return C.evidence_cards(hits(spark, d), "item_id", "rank", "paragraph_text", ["source", "page", "article"])


@query("c02_evidence_cards", f"WITH {_CARDS_SQL} SELECT item_id, paragraph_id, card_no, excerpt FROM cards")
def c02(spark, d):
    return cards(spark, d).select("item_id", "paragraph_id", "card_no", "excerpt")


_ANS_SQL = f"{_CARDS_SQL}, ans AS (SELECT item_id, string_agg('见第' || (page + CASE WHEN card_no = 3 THEN 900 ELSE 0 END) || '页[E' || (card_no + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END) || ']', '；' ORDER BY card_no) || CASE WHEN item_id % 5 = 0 THEN '[来源1]' ELSE '' END AS answer, max(card_no) AS n, list(page) AS pages FROM cards GROUP BY item_id)"


def answers(spark, d):
    e = cards(spark, d).select("item_id", "card_no", "page", "source")
    part = F.concat(
        F.lit("见第"), (F.col("page") + F.when(F.col("card_no") == 3, 900).otherwise(0)).cast("string"), F.lit("页[E"), (F.col("card_no") + F.when(F.col("item_id") % 3 == 0, 1).otherwise(0)).cast("string"), F.lit("]")
    )
    a = e.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("card_no", part.alias("p")))), lambda x: x["p"]), "；").alias("a"))
    return a.select("item_id", F.concat("a", F.when(F.col("item_id") % 5 == 0, "[来源1]").otherwise("")).alias("answer")), e


@query("c03_citation_extraction", f"WITH {_ANS_SQL} SELECT item_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS pages FROM (SELECT item_id, regexp_extract_all(answer, '第([0-9]+)页', 1) AS p FROM ans)")
def c03(spark, d):
    a, _ = answers(spark, d)
    return a.select("item_id", F.array_join(F.transform(C.cited_pages(F.col("answer")), lambda x: x.cast("string")), ",").alias("pages"))


@query(
    "c04_citation_audit",
    f"""WITH {_ANS_SQL} SELECT item_id, array_to_string(list_filter([CASE WHEN len(list_filter(regexp_extract_all(answer, '\\[E([0-9]+)\\]', 1), lambda x: CAST(x AS INTEGER) > n)) > 0 THEN 'ref_out_of_range' END,
  CASE WHEN len(list_filter(regexp_extract_all(answer, '第([0-9]+)页', 1), lambda x: NOT list_contains(pages, CAST(x AS INTEGER)))) > 0 THEN 'page_not_in_evidence' END, CASE WHEN regexp_matches(answer, '\\[(来源|source)[^\\]]*\\]') THEN 'forbidden_mark' END], lambda x: x IS NOT NULL), ',') AS issues FROM ans""",
)
def c04(spark, d):
    a, e = answers(spark, d)
    return C.audited(a, "item_id", "answer", e, "page", "card_no")


@query("c05_citation_repair", None)
def c05(spark, d):
    a, e = answers(spark, d)
    name = F.concat_ws("，", "source", F.concat(F.lit("第"), F.col("page").cast("string"), F.lit("页")))
    k = e.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("card_no", name.alias("c")))), lambda x: x["c"]).alias("cards"))
    return a.join(k, "item_id").select("item_id", C.repaired("answer", "cards").alias("answer"))


@query("c06_history_follow_up", f"WITH {_CARDS_SQL} SELECT item_id, paragraph_id, page FROM cards WHERE card_no = 2 OR card_no = 1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY page, card_no) = 1")
def c06(spark, d):
    return R.first_per(cards(spark, d).filter("card_no <= 2"), ["item_id"], [F.asc("page"), F.asc("card_no")]).select("item_id", "paragraph_id", "page")


@query("c07_excerpt_cleanup", f"WITH {_CARDS_SQL} SELECT item_id, card_no, trim(regexp_replace(regexp_replace(excerpt, '\\[[0-9]+\\]', '', 'g'), '[\\s　]+', ' ', 'g')) AS excerpt FROM cards")
def c07(spark, d):
    return cards(spark, d).select("item_id", "card_no", F.trim(F.regexp_replace(F.regexp_replace("excerpt", "\\[[0-9]+\\]", ""), "[\\s　]+", " ")).alias("excerpt"))


@query(
    "c08_ibid_fill",
    f"""WITH {R_SQL}, n AS (SELECT paragraph_id, source, paragraph_index, trim(paragraph_text) AS t, regexp_matches(trim(paragraph_text), '^(同上|ibid\\.?|注：同上。?)$') AS ibid FROM r WHERE page_type IN ('notes', 'body') AND paragraph_text IS NOT NULL)
  SELECT paragraph_id, sha256(CASE WHEN ibid THEN coalesce(last_value(CASE WHEN NOT ibid THEN t END IGNORE NULLS) OVER (PARTITION BY source ORDER BY paragraph_index, paragraph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t) ELSE t END) AS hash FROM n""",
)
def c08(spark, d):
    n = narrow(spark, d, "source", "page_type", "paragraph_index", "paragraph_text").filter("page_type in ('notes', 'body') and paragraph_text is not null")
    x = n.select("paragraph_id", "source", F.struct("paragraph_index", "paragraph_id").alias("pos"), F.trim("paragraph_text").alias("t"))
    return C.ibid_resolved(x, "source", "pos", "t").select("paragraph_id", F.sha2("t", 256).alias("hash"))


@query("c09_fallback_stages", f"WITH {HITS_SQL}, s AS (SELECT item_id, paragraph_id, rank, CASE WHEN distance = 0 THEN 0 WHEN distance = 1 THEN 1 ELSE 2 END AS stage FROM hits) SELECT item_id, paragraph_id, stage FROM s QUALIFY stage = min(stage) OVER (PARTITION BY item_id)")
def c09(spark, d):
    s = hits(spark, d).select("item_id", "paragraph_id", F.when(F.col("distance") == 0, 0).when(F.col("distance") == 1, 1).otherwise(2).alias("stage"))
    return s.withColumn("_m", F.min("stage").over(Window.partitionBy("item_id"))).filter("stage = _m").drop("_m")


@query(
    "c10_list_answers",
    f"""WITH {HITS_SQL}, k AS (SELECT item_id, rank, trim(regexp_replace(coalesce(paragraph_text, ''), '[\\s   -   　]+', ' ', 'g')) AS k FROM hits WHERE rank <= 8) SELECT item_id, string_agg(rank || '. ' || CASE WHEN length(k) > 60 THEN substring(k, 1, 60) || '…' ELSE k END, chr(10) ORDER BY rank) AS answer FROM k GROUP BY item_id HAVING count(*) >= 2""",
)
def c10(spark, d):
    h = hits(spark, d).select("item_id", "rank", F.coalesce("paragraph_text", F.lit("")).alias("t"))
    return C.numbered_lines(h, "item_id", "rank", "t")


# ---------------------------------------------------------------- validation


@query("v01_schema_contract", "SELECT 'crag_score' AS field, 'missing' AS gap UNION ALL SELECT 'ts', 'type'")
def v01(spark, d):
    from pyspark.sql.types import _parse_datatype_string

    wanted = _parse_datatype_string("request_id bigint, intent string, ts string, crag_score double")
    return spark.createDataFrame(V.schema_gaps(table(spark, d, "request_metrics"), wanted), "field string, gap string")


@query(
    "v02_map_rules",
    "SELECT entry_no, rule FROM (SELECT entry_no, unnest(list_filter([CASE WHEN NOT coalesce(start_printed_page >= 1, false) THEN 'start' END, CASE WHEN NOT coalesce(end_printed_page >= start_printed_page, false) THEN 'order' END, CASE WHEN NOT coalesce(length(title) BETWEEN 1 AND 25, false) THEN 'title' END, CASE WHEN NOT coalesce(entry_level = 1 OR parent_title IS NOT NULL, false) THEN 'parent' END], lambda x: x IS NOT NULL)) AS rule FROM article_map)",
)
def v02(spark, d):
    rules = {
        "start": F.col("start_printed_page") >= 1, "order": F.col("end_printed_page") >= F.col("start_printed_page"), "title": F.length("title").between(1, 25),
        "parent": (F.col("entry_level") == 1) | F.col("parent_title").isNotNull(),
    }
    return V.rule_failures(table(spark, d, "article_map"), "entry_no", rules)


@query(
    "v04_top1_flags",
    f"WITH {HITS_SQL} SELECT item_id, array_to_string(list_filter([CASE WHEN page_type <> 'body' THEN 'non_body' END, CASE WHEN coalesce(trim(article), '') = '' THEN 'no_article' END, CASE WHEN printed_page_start IS NULL THEN 'no_page' END, CASE WHEN length(coalesce(paragraph_text, '')) < 24 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS flags FROM hits WHERE rank = 1",
)
def v04(spark, d):
    f = A.flags([
        ("non_body", F.col("page_type") != "body"), ("no_article", F.coalesce(F.trim("article"), F.lit("")) == ""), ("no_page", F.col("printed_page_start").isNull()),
        ("short", F.length(F.coalesce("paragraph_text", F.lit(""))) < 24),
    ])
    return hits(spark, d).filter("rank = 1").select("item_id", F.array_join(f, ",").alias("flags"))


@query(
    "v05_case_evaluation",
    f"""WITH {HITS_SQL} SELECT e.item_id, coalesce(bool_or(h.rank <= 5 AND list_contains(e.source_scope, h.source)), false) AS source_ok, coalesce(bool_or(h.rank <= 5 AND {sql_label('h.article')} = {sql_label('e.expected_work')}), false) AS title_ok, coalesce(bool_or(len(e.tags) > 0 AND len(list_filter(e.tags, lambda t: NOT contains(coalesce(h.paragraph_text, ''), t))) = 0), false) AS tokens_ok FROM eval_items e LEFT JOIN hits h USING (item_id) GROUP BY e.item_id""",
)
def v05(spark, d):
    e = table(spark, d, "eval_items").select("item_id", "source_scope", "expected_work", "tags")
    h = hits(spark, d).select("item_id", "rank", "source", "article", F.coalesce("paragraph_text", F.lit("")).alias("t"))
    x = e.join(h, "item_id", "left")
    top = F.col("rank") <= 5
    tokens = (F.size("tags") > 0) & F.col("t").isNotNull() & F.forall("tags", lambda t: F.contains(F.col("t"), t))
    ok = lambda test: F.coalesce(F.max(test), F.lit(False))
    return x.groupBy("item_id").agg(
        ok(top & F.array_contains("source_scope", F.col("source"))).alias("source_ok"), ok(top & (T.label("article") == T.label("expected_work"))).alias("title_ok"), ok(tokens).alias("tokens_ok")
    )


@query("v07_channel_probe", f"WITH {HITS_SQL} SELECT 'dense' AS channel, CAST(count(*) FILTER (WHERE rank <= 12) AS BIGINT) AS hits, count(*) FILTER (WHERE rank <= 12) > 0 AS ok FROM hits UNION ALL SELECT 'exact', CAST(count(*) FILTER (WHERE distance = 0) AS BIGINT), count(*) FILTER (WHERE distance = 0) > 0 FROM hits")
def v07(spark, d):
    one = hits(spark, d).agg(F.count_if(F.col("rank") <= 12).alias("dense"), F.count_if(F.col("distance") == 0).alias("exact"))
    c = one.select(F.explode(F.array(F.struct(F.lit("dense").alias("channel"), F.col("dense").alias("hits")), F.struct(F.lit("exact").alias("channel"), F.col("exact").alias("hits")))).alias("c"))
    return c.select("c.channel", "c.hits", (F.col("c.hits") > 0).alias("ok"))
