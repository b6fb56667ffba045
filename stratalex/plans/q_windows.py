"""Queries of the window and ordered-state operators, sets and de-duplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.operators import aggregates as A
from stratalex.operators import intervals as I
from stratalex.operators import ordered as O
from stratalex.operators import ranking as R
from stratalex.operators import segments as G
from stratalex.plans.base import ASKED_SQL, CIT_SQL, ENT_SQL, HITS_SQL, Q_SQL, R_SQL, citations, entries, hits, narrow, questions, requests, sq, sql_compact, sql_label, sql_match
from stratalex.plans.catalog import query
from stratalex.session import table

_PAGES_SQL = f"{R_SQL}, pg AS (SELECT source, pdf_page_start AS pdf, min(printed_page_start) AS printed FROM r WHERE pdf_page_start IS NOT NULL GROUP BY ALL)"


def pages(spark, d):
    return table(spark, d, "records").filter("pdf_page_start is not null").groupBy("source", F.col("pdf_page_start").alias("pdf")).agg(F.min("printed_page_start").alias("printed"))


@query("w01_page_fill_fold", None)
def w01(spark, d):
    p = pages(spark, d).withColumn("trusted", F.col("pdf") % 5 != 0)
    return G.filled_pages(p, "source", "pdf", "printed", "trusted")


@query(
    "w01_page_fill_simple",
    f"""WITH {_PAGES_SQL}, f AS (SELECT *, last_value(CASE WHEN printed IS NOT NULL THEN pdf END IGNORE NULLS) OVER w AS lp, last_value(printed IGNORE NULLS) OVER w AS lv FROM pg WINDOW w AS (PARTITION BY source ORDER BY pdf ROWS UNBOUNDED PRECEDING))
  SELECT source, pdf, coalesce(printed, CASE WHEN pdf - lp <= 3 THEN lv + pdf - lp END) AS page FROM f""",
)
def w01b(spark, d):
    return O.forward_filled(pages(spark, d), "source", "pdf", "printed", 3).select("source", "pdf", "page")


_BODY_SQL = "b AS (SELECT paragraph_id, source, pdf_page_start AS pdf, paragraph_index, paragraph_text AS t FROM r WHERE page_type = 'body' AND trim(coalesce(paragraph_text, '')) <> '' AND pdf_page_start IS NOT NULL)"


@query(
    "w02_cross_page_merge",
    f"""WITH {R_SQL}, {_BODY_SQL}, l AS (SELECT *, lag(t) OVER w AS pt, lag(pdf) OVER w AS pp FROM b WINDOW w AS (PARTITION BY source ORDER BY pdf, paragraph_index, paragraph_id)),
  s AS (SELECT *, CASE WHEN pt IS NOT NULL AND pdf = pp + 1 AND NOT regexp_matches(pt, '[。！？!?.…”」』）)]\\s*$') THEN 0 ELSE 1 END AS start FROM l), g AS (SELECT *, sum(start) OVER (PARTITION BY source ORDER BY pdf, paragraph_index, paragraph_id ROWS UNBOUNDED PRECEDING) AS grp FROM s)
  SELECT source, CAST(grp AS BIGINT) AS grp, CAST(count(*) AS BIGINT) AS parts, min(pdf) AS first_page, max(pdf) AS last_page, CAST(sum(length(t)) AS BIGINT) AS chars FROM g GROUP BY ALL HAVING count(*) > 1""",
)
def w02(spark, d):
    b = narrow(spark, d, "source", "page_type", "pdf_page_start", "paragraph_index", "paragraph_text").filter("page_type = 'body' and trim(coalesce(paragraph_text, '')) <> '' and pdf_page_start is not null")
    g = O.merged_over_pages(b, "source", "pdf_page_start", ["pdf_page_start", "paragraph_index", "paragraph_id"], "paragraph_text")
    return g.groupBy("source", "grp").agg(
        F.count("*").alias("parts"), F.min("pdf_page_start").alias("first_page"), F.max("pdf_page_start").alias("last_page"), F.sum(F.length("paragraph_text")).alias("chars")
    ).filter("parts > 1")


@query(
    "w03_sequence_breaks",
    f"""WITH {_PAGES_SQL}, k AS (SELECT *, lag(pdf) OVER w AS pp, lag(printed) OVER w AS pv FROM pg WHERE printed IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY pdf))
  SELECT source, pdf, printed, CASE WHEN pdf - printed < -60 OR pdf - printed > 140 THEN 'offset' WHEN printed - pv < -3 THEN 'reversal' WHEN printed - pv > pdf - pp + 8 THEN 'jump' END AS issue FROM k
  WHERE pdf - printed < -60 OR pdf - printed > 140 OR printed - pv < -3 OR printed - pv > pdf - pp + 8""",
)
def w03(spark, d):
    return O.sequence_breaks(pages(spark, d), "source", "pdf", "printed").select("source", "pdf", "printed", "issue")


@query("w04_fixpoint_outliers", None)
def w04(spark, d):
    return O.fixpoint_outliers(pages(spark, d).filter("printed is not null"), "source", "pdf", "printed")


@query(
    "w05_longest_offset_run",
    f"""WITH {_PAGES_SQL}, o AS (SELECT source, pdf, pdf - printed AS shift FROM pg WHERE printed IS NOT NULL), i AS (SELECT *, pdf - row_number() OVER (PARTITION BY source, shift ORDER BY pdf) AS island FROM o),
  g AS (SELECT source, shift, island, min(pdf) AS first_pdf, max(pdf) AS last_pdf, count(*) AS n FROM i GROUP BY ALL) SELECT source, shift, first_pdf, last_pdf, n FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first_pdf, shift) = 1""",
)
def w05(spark, d):
    o = pages(spark, d).filter("printed is not null").withColumn("shift", F.col("pdf") - F.col("printed"))
    return O.longest_runs(o, "source", "shift", "pdf")


@query("w06_anchor_segments", None)
def w06(spark, d):
    return O.anchor_segments(pages(spark, d).filter("printed is not null"), "source", "pdf", "printed")


@query("w07_chain_selection", None)
def w07(spark, d):
    c = narrow(spark, d, "source", "pdf_page_start", "printed_page_start", "citation_page_start").filter("pdf_page_start is not null")
    cand = c.select("source", F.col("pdf_page_start").alias("pdf"), F.explode(F.array("printed_page_start", "citation_page_start")).alias("value")).filter("value is not null").distinct()
    return O.viterbi_chain(cand, "source", "pdf", "value")


@query(
    "w08_gap_interpolation",
    f"""WITH {_PAGES_SQL}, f AS (SELECT *, last_value(CASE WHEN printed IS NOT NULL THEN pdf END IGNORE NULLS) OVER a AS l, last_value(printed IGNORE NULLS) OVER a AS lv, first_value(CASE WHEN printed IS NOT NULL THEN pdf END IGNORE NULLS) OVER b AS r, first_value(printed IGNORE NULLS) OVER b AS rv FROM pg
  WINDOW a AS (PARTITION BY source ORDER BY pdf ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY source ORDER BY pdf ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), x AS (SELECT source, pdf, lv + (rv - lv) * (pdf - l)::DOUBLE / (r - l) AS v FROM f WHERE printed IS NULL AND r > l)
  SELECT source, pdf, CAST(round(v) AS INTEGER) AS page FROM x WHERE abs(v - round(v)) <= 0.45""",
)
def w08(spark, d):
    return O.interpolated(pages(spark, d), "source", "pdf", "printed")


@query(
    "w09_single_outliers",
    f"""WITH {_PAGES_SQL}, k AS (SELECT *, lag(printed) OVER w AS a, lead(printed) OVER w AS b FROM pg WHERE printed IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY pdf)) SELECT source, pdf, printed, a + 1 AS repaired FROM k WHERE b = a + 2 AND printed NOT IN (a + 1, a + 2)""",
)
def w09(spark, d):
    return O.single_outliers(pages(spark, d).filter("printed is not null"), "source", "pdf", "printed")


@query(
    "w10_range_ends",
    """WITH k AS (SELECT entry_no, source, start_printed_page AS s, greatest(start_printed_page, end_printed_page) AS e, lead(start_printed_page) OVER (PARTITION BY source ORDER BY start_printed_page, end_printed_page, title) AS nx FROM article_map)
  SELECT entry_no, s, CASE WHEN e = s AND nx > s THEN nx - 1 ELSE e END AS e FROM k""",
)
def w10(spark, d):
    m = table(spark, d, "article_map").select("entry_no", "source", F.col("start_printed_page").alias("s"), F.col("end_printed_page").alias("e"), "title")
    return O.closed_ranges(m, "source", "s", "e", "title").select("entry_no", "s", "e")


@query("w11_parent_packing", None)
def w11(spark, d):
    r = narrow(spark, d, "source", "section", "page_type", "pdf_page_start", "paragraph_index", "paragraph_text").filter("page_type = 'body' and paragraph_text is not null")
    p = G.packed_parents(r, ["source", "section"], "pdf_page_start", ["pdf_page_start", "paragraph_index", "paragraph_id"], "paragraph_text", 1200)
    return p.groupBy("source", "section", "island", "parent_no").agg(F.count("*").alias("n"), F.sum(F.length("paragraph_text")).alias("chars"))


@query("w12_channel_ranks", f"WITH {HITS_SQL} SELECT item_id, paragraph_id, row_number() OVER (PARTITION BY item_id ORDER BY distance DESC, paragraph_id DESC) AS sparse_rank FROM hits")
def w12(spark, d):
    return R.top_k(hits(spark, d).select("item_id", "paragraph_id", "distance"), ["item_id"], [F.desc("distance"), F.desc("paragraph_id")], 1 << 30, "sparse_rank").drop("distance")


@query(
    "w13_monotonicity_breaks",
    f"WITH {_PAGES_SQL}, k AS (SELECT source, printed, lag(printed) OVER (PARTITION BY source ORDER BY pdf) AS p FROM pg WHERE printed IS NOT NULL) SELECT source, CAST(count(*) FILTER (WHERE printed <= p) AS BIGINT) AS breaks FROM k GROUP BY source",
)
def w13(spark, d):
    w = Window.partitionBy("source").orderBy("pdf")
    k = pages(spark, d).filter("printed is not null").withColumn("p", F.lag("printed").over(w))
    return k.groupBy("source").agg(F.count_if(F.col("printed") <= F.col("p")).alias("breaks"))


_TURN = "PARTITION BY coalesce(topic_id, 'none') ORDER BY ts, request_id"


@query(
    "w14_last_good_turn",
    f"WITH {Q_SQL} SELECT request_id, last_value(CASE WHEN audit_ok AND evidence_count > 0 THEN request_id END IGNORE NULLS) OVER ({_TURN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_good FROM q",
)
def w14(spark, d):
    w = Window.partitionBy(F.coalesce("topic_id", F.lit("none"))).orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("audit_ok") & (F.col("evidence_count") > 0), F.col("request_id"))
    return requests(spark, d).select("request_id", F.last(good, ignorenulls=True).over(w).alias("last_good"))


@query(
    "w15_rolling_history",
    f"WITH {Q_SQL} SELECT request_id, CAST(count(*) OVER w AS BIGINT) AS turns, CAST(coalesce(sum(least(answer_len, 300)) OVER w, 0) AS BIGINT) AS history_chars FROM q WINDOW w AS ({_TURN} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)",
)
def w15(spark, d):
    w = Window.partitionBy(F.coalesce("topic_id", F.lit("none"))).orderBy("ts", "request_id").rowsBetween(-6, -1)
    return requests(spark, d).select("request_id", F.count("*").over(w).alias("turns"), F.coalesce(F.sum(F.least("answer_len", F.lit(300))).over(w), F.lit(0)).cast("long").alias("history_chars"))


@query(
    "w16_follow_up_inherits",
    f"WITH {Q_SQL} SELECT request_id, CASE WHEN query_len < 12 THEN coalesce(last_value(CASE WHEN query_len >= 12 THEN request_id END IGNORE NULLS) OVER ({_TURN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), request_id) ELSE request_id END AS asks_as FROM q",
)
def w16(spark, d):
    w = Window.partitionBy(F.coalesce("topic_id", F.lit("none"))).orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("query_len") >= 12, F.col("request_id")), ignorenulls=True).over(w)
    return requests(spark, d).select("request_id", F.when(F.col("query_len") < 12, F.coalesce(before, "request_id")).otherwise(F.col("request_id")).alias("asks_as"))


@query(
    "w17_parent_range_extension",
    """WITH k AS (SELECT *, sum(CASE WHEN entry_level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY start_printed_page, entry_no ROWS UNBOUNDED PRECEDING) AS grp FROM article_map)
  SELECT source, CAST(grp AS BIGINT) AS grp, min(entry_no) AS entry_no, min(start_printed_page) AS s, max(end_printed_page) AS e, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY source, grp""",
)
def w17(spark, d):
    w = Window.partitionBy("source").orderBy("start_printed_page", "entry_no").rowsBetween(Window.unboundedPreceding, 0)
    k = table(spark, d, "article_map").withColumn("grp", F.sum(F.when(F.col("entry_level") == 1, 1).otherwise(0)).over(w))
    return k.groupBy("source", "grp").agg(F.min("entry_no").alias("entry_no"), F.min("start_printed_page").alias("s"), F.max("end_printed_page").alias("e"), F.count("*").alias("n"))


@query(
    "w18_child_ordinals",
    f"WITH {R_SQL} SELECT paragraph_id, row_number() OVER (PARTITION BY source, pdf_page_start ORDER BY paragraph_index, paragraph_id) - 1 AS child_index, count(*) OVER (PARTITION BY source, pdf_page_start) AS child_total FROM r",
)
def w18(spark, d):
    p = Window.partitionBy("source", "pdf_page_start")
    r = narrow(spark, d, "source", "pdf_page_start", "paragraph_index")
    return r.select("paragraph_id", (F.row_number().over(p.orderBy("paragraph_index", "paragraph_id")) - 1).alias("child_index"), F.count("*").over(p).alias("child_total"))


# ---------------------------------------------------------------- sets and de-duplication


@query(
    "d01_key_dedupe",
    f"WITH {HITS_SQL} SELECT item_id, min_by(paragraph_id, rank) AS paragraph_id, min(rank) AS rank FROM hits GROUP BY item_id, source, page, coalesce(article, ''), substring(coalesce(paragraph_text, ''), 1, 120)",
)
def d01(spark, d):
    h = hits(spark, d).withColumn("a", F.coalesce("article", F.lit(""))).withColumn("x", F.substring(F.coalesce("paragraph_text", F.lit("")), 1, 120))
    return R.first_per(h, ["item_id", "source", "page", "a", "x"], [F.asc("rank")]).select("item_id", "paragraph_id", "rank")


@query(
    "d02_signature_collapse",
    f"""WITH {HITS_SQL}, s AS (SELECT *, substring({sql_match("coalesce(paragraph_text, '')")}, 1, 96) AS g FROM hits) SELECT item_id, arg_max(paragraph_id, (CASE WHEN page_type = 'body' THEN 1 ELSE 0 END, length(coalesce(paragraph_text, '')), -rank)) AS paragraph_id, min(rank) AS first_rank, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY item_id, CASE WHEN g = '' THEN paragraph_id ELSE g END""",
)
def d02(spark, d):
    g = F.substring(T.match_form(F.coalesce("paragraph_text", F.lit(""))), 1, 96)
    h = hits(spark, d).withColumn("g", g)
    prefer = F.struct(F.when(F.col("page_type") == "body", 1).otherwise(0), F.length(F.coalesce("paragraph_text", F.lit(""))), -F.col("rank"))
    key = F.when(F.col("g") == "", F.col("paragraph_id")).otherwise(F.col("g")).alias("k")
    return h.groupBy("item_id", key).agg(F.max_by("paragraph_id", prefer).alias("paragraph_id"), F.min("rank").alias("first_rank"), F.count("*").alias("n")).drop("k")


_TWO_SQL = "one AS (SELECT item_id, paragraph_id, rank FROM hits WHERE distance = 0), two AS (SELECT item_id, paragraph_id, rank FROM hits WHERE rank <= 6)"


@query(
    "d03_preferred_union",
    f"WITH {HITS_SQL}, {_TWO_SQL}, u AS (SELECT *, 0 AS list FROM one UNION ALL SELECT *, 1 FROM two), f AS (SELECT item_id, paragraph_id, min((list, rank)) AS o FROM u GROUP BY ALL), k AS (SELECT item_id, paragraph_id, row_number() OVER (PARTITION BY item_id ORDER BY o) AS position FROM f) SELECT * FROM k WHERE position <= 8",
)
def d03(spark, d):
    h = hits(spark, d).select("item_id", "paragraph_id", "rank", "distance")
    u = h.filter("distance = 0").withColumn("list", F.lit(0)).unionByName(h.filter("rank <= 6").withColumn("list", F.lit(1)))
    f = R.first_per(u, ["item_id", "paragraph_id"], [F.asc("list"), F.asc("rank")])
    return R.top_k(f, ["item_id"], [F.asc("list"), F.asc("rank")], 8, "position").select("item_id", "paragraph_id", "position")


@query(
    "d04_seed_union",
    f"WITH {HITS_SQL}, s AS (SELECT item_id, source, paragraph_id, row_number() OVER (PARTITION BY item_id, source ORDER BY distance, paragraph_id) AS r FROM hits) SELECT DISTINCT item_id, paragraph_id FROM s WHERE r <= 4",
)
def d04(spark, d):
    h = hits(spark, d).select("item_id", "source", "paragraph_id", "distance")
    return R.top_k(h, ["item_id", "source"], [F.asc("distance"), F.asc("paragraph_id")], 4, "r").select("item_id", "paragraph_id").distinct()


@query("d05_duplicate_ids", "SELECT paragraph_id, CAST(count(*) AS BIGINT) AS n FROM records GROUP BY paragraph_id HAVING count(*) > 1")
def d05(spark, d):
    return table(spark, d, "records").groupBy("paragraph_id").agg(F.count("*").alias("n")).filter("n > 1")


@query(
    "d06_duplicate_text",
    f"""WITH {R_SQL}, x AS (SELECT paragraph_id, source, paragraph_index, pdf_page_start AS a, pdf_page_end AS b, {sql_compact("coalesce(paragraph_text, '')")} AS k FROM r), f AS (SELECT *, first_value(a) OVER w AS fa, first_value(b) OVER w AS fb, row_number() OVER w AS i FROM x WHERE length(k) >= 12 WINDOW w AS (PARTITION BY source, k ORDER BY paragraph_index, paragraph_id))
  SELECT paragraph_id, CASE WHEN a IS NOT DISTINCT FROM fa AND b IS NOT DISTINCT FROM fb THEN 'DUPLICATE_TEXT' ELSE 'DUPLICATE_PAGE_TEXT' END AS code FROM f WHERE i > 1""",
)
def d06(spark, d):
    r = narrow(spark, d, "source", "paragraph_index", "pdf_page_start", "pdf_page_end", "paragraph_text")
    return O.repeated_text(r, "source", "paragraph_text", ["paragraph_index", "paragraph_id"], ["pdf_page_start", "pdf_page_end"]).select("paragraph_id", "code")


@query("d07_set_difference", f"WITH {CIT_SQL} SELECT source FROM editions EXCEPT SELECT source FROM cit")
def d07(spark, d):
    return table(spark, d, "editions").select("source").exceptAll(citations(spark, d).select("source").distinct())


@query(
    "d08_known_answers",
    f"""WITH {CIT_SQL}, k AS (SELECT work_id, {sql_match('qt')} AS k FROM (SELECT work_id, unnest(quotes) AS qt FROM core_classics)), n AS (SELECT item_id, {sql_match('quote')} AS n FROM cit) SELECT DISTINCT n.item_id, k.work_id FROM n JOIN k ON (length(k.k) >= 10 AND contains(n.n, k.k)) OR (length(n.n) >= 10 AND contains(k.k, n.n))""",
)
def d08(spark, d):
    k = table(spark, d, "core_classics").select("work_id", F.explode("quotes").alias("x")).select("work_id", T.match_form("x").alias("k"))
    n = citations(spark, d).select("item_id", T.match_form("quote").alias("n"))
    held = ((F.length("k") >= 10) & F.contains("n", "k")) | ((F.length("n") >= 10) & F.contains("k", "n"))
    return n.join(I.dimension(k), held).select("item_id", "work_id").distinct()


@query(
    "d09_query_variants",
    """WITH v AS (SELECT item_id, [question, trim(question), question || '？', coalesce(expected_work, ''), lower(question)] AS v FROM eval_items), k AS (SELECT item_id, v, list_transform(v, lambda x: lower(regexp_replace(x, '[？?。 ]', '', 'g'))) AS k FROM v),
  f AS (SELECT item_id, list_filter(range(1, 6), lambda i: list_position(k, k[i]) = i AND k[i] <> '') AS i, v FROM k) SELECT item_id, array_to_string(list_transform(i[1:4], lambda j: v[j]), '|') AS variants FROM f""",
)
def d09(spark, d):
    q = table(spark, d, "eval_items").select("item_id", "question", F.coalesce("expected_work", F.lit("")).alias("w"))
    v = F.array("question", F.trim("question"), F.concat("question", F.lit("？")), "w", F.lower("question"))
    key = lambda x: F.lower(F.regexp_replace(x, "[？?。 ]", ""))
    return q.select("item_id", F.array_join(T.ordered_distinct(F.filter(v, lambda x: key(x) != ""), key, 4), "|").alias("variants"))


@query("d10_train_overlap", f"WITH {R_SQL} SELECT article FROM r WHERE page_type = 'body' AND article IS NOT NULL INTERSECT SELECT article FROM r WHERE page_type = 'notes' AND article IS NOT NULL")
def d10(spark, d):
    r = table(spark, d, "records").filter("article is not null")
    return r.filter("page_type = 'body'").select("article").intersect(r.filter("page_type = 'notes'").select("article"))
