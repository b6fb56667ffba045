"""Operators on small literal tables: ties, nulls, empty input, and the folds that SQL cannot express."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalex.functions import ids as K
from stratalex.functions import matching as M
from stratalex.functions import text as T
from stratalex.operators import aggregates as A
from stratalex.operators import cleaning as C
from stratalex.operators import citing, filters, intervals, joins, ordered, sources_ops, validation
from stratalex.operators import models as Mo
from stratalex.operators import ranking as R
from stratalex.operators import segments as G
from stratalex.session import cut


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("剩余价值 Theory２", ["theory2", "剩余", "余价", "价值", "剩余价", "余价值"]), ("资本", ["资本"]), ("", []), ("ＡＢ c9 劳", ["ab", "c9", "劳"]),
        ("价值价值", ["价值", "值价", "价值", "价值价", "值价值"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens) == want


def test_sparse_tokens_and_phrases(spark):
    assert one(spark, "《资本》 ab-cd 资本", T.sparse_tokens)[:2] == ["abcd", "资本资本"] or one(spark, "《资本》x资本", T.sparse_tokens) == ["x", "资本"]
    assert one(spark, "请谈“商品 拜物教”与abc", lambda x: T.phrases(x, ["请谈"])) == ["商品拜物教与", "商品拜物教", "abc"]


def test_clip_preview_ratio(spark):
    assert one(spark, "a" * 75 + "b" * 50, lambda x: T.clip(x, 100)) == "a" * 75 + "b" * 25
    assert one(spark, " a \n b ", lambda x: T.preview(x, 10)) == "a b"
    assert one(spark, "", lambda x: T.ratio(x, "a")) == 0.0
    assert one(spark, None, T.label) == ""


def test_golden_windows(spark):
    df = spark.createDataFrame([("p", "0123456789abcdef"), ("e", ""), ("n", None), ("s", "ab")], "id string, t string")
    got = [(r["id"], r["start"], r["end"], r["child_total"]) for r in G.chunked(df, "id", "t", 6, 2).orderBy("id", "start").collect()]
    assert got == [("p", 0, 6, 4), ("p", 4, 10, 4), ("p", 8, 14, 4), ("p", 12, 16, 4), ("s", 0, 2, 1)]
    with pytest.raises(ValueError):
        G.chunked(df, "id", "t", 6, 6)


def test_packed_parents(spark):
    rows = [("s", 1, 1, "a" * 5), ("s", 1, 2, "b" * 5), ("s", 2, 3, "c" * 5), ("s", 5, 4, "d"), ("s", 5, 5, None), ("t", 1, 1, "e" * 30), ("t", 1, 2, "f")]
    df = spark.createDataFrame(rows, "src string, page int, i int, t string")
    got = {(r["src"], r["i"]): (r["island"], r["parent_no"]) for r in G.packed_parents(df, ["src"], "page", ["page", "i"], "t", 10).collect()}
    assert got == {("s", 1): (0, 0), ("s", 2): (0, 0), ("s", 3): (0, 1), ("s", 4): (1, 0), ("s", 5): (1, 0), ("t", 1): (0, 0), ("t", 2): (0, 1)}


def test_page_fold(spark):
    rows = [(1, 10, True), (2, None, True), (3, 12, True), (4, 13, True), (5, 99, False), (6, 15, True), (20, None, True), (21, 40, True)]
    df = spark.createDataFrame([("s", *r) for r in rows], "src string, pdf int, printed int, sure boolean")
    got = {r["pdf"]: (r["page"], r["how"]) for r in G.filled_pages(df, "src", "pdf", "printed", "sure").collect()}
    assert got[2] == (11, "filled") and got[5] == (14, "corrected") and got[20] == (None, "unknown") and got[21] == (40, "read")


def test_sentence_packed(spark):
    assert one(spark, "甲乙。丙丁。戊己庚辛壬癸。", lambda x: G.sentence_packed(x, 6)) == ["甲乙。丙丁。", "戊己庚辛壬癸", "。"]
    assert one(spark, "", lambda x: G.sentence_packed(x, 6)) == []


def test_ordered_operators(spark):
    rows = [("s", p, v) for p, v in [(1, 1), (2, 2), (3, 30), (4, 4), (5, 5), (6, None), (7, None), (8, 8), (9, 3), (10, 10)]]
    df = spark.createDataFrame(rows, "src string, pdf int, v int")
    breaks = {(r["pdf"], r["issue"]) for r in ordered.sequence_breaks(df, "src", "pdf", "v").collect()}
    assert breaks == {(3, "jump"), (4, "reversal"), (9, "reversal")}
    gone = {r["pdf"] for r in ordered.fixpoint_outliers(df.filter("v is not null"), "src", "pdf", "v").collect()}
    assert {3, 4, 9} <= gone
    assert {(r["pdf"], r["page"]) for r in ordered.interpolated(df, "src", "pdf", "v").collect()} == {(6, 6), (7, 7)}
    assert [(r["pdf"], r["repaired"]) for r in ordered.single_outliers(df.filter("v is not null and pdf in (2, 3, 4)"), "src", "pdf", "v").collect()] == [(3, 3)]
    run = ordered.longest_runs(df.filter("v is not null").withColumn("shift", F.col("pdf") - F.col("v")), "src", "shift", "pdf").first()
    assert (run["shift"], run["first_pdf"], run["n"]) == (0, 1, 2)
    assert ordered.anchor_segments(df.filter("v is not null and pdf not in (3, 9)"), "src", "pdf", "v").first()["n"] >= 4
    chain = ordered.viterbi_chain(df.filter("v is not null").select("src", "pdf", F.col("v").alias("value")), "src", "pdf", "value").collect()
    assert {(r["pdf"], r["value"]) for r in chain} >= {(1, 1), (2, 2), (4, 4), (5, 5), (8, 8), (10, 10)} and (9, 3) not in {(r["pdf"], r["value"]) for r in chain}
    filled = {r["pdf"]: r["page"] for r in ordered.forward_filled(df, "src", "pdf", "v", 1).collect()}
    assert filled[6] == 6 and filled[7] is None
    empty = df.limit(0)
    assert ordered.fixpoint_outliers(empty, "src", "pdf", "v").count() == 0 and ordered.interpolated(empty, "src", "pdf", "v").count() == 0


def test_interval_join_equals_nested_loop(spark):
    rng = random.Random(1)
    points = [(i, rng.choice("ab"), rng.randint(0, 500)) for i in range(300)] + [(999, "a", None)]
    spans = [(i, rng.choice("ab"), s, s + rng.randint(-3, 200)) for i in range(60) for s in [rng.randint(0, 450)]]
    p = spark.createDataFrame(points, "pid int, src string, at int")
    i = spark.createDataFrame(spans, "iid int, src string, s int, e int")
    got = {(r["pid"], r["iid"]) for r in intervals.interval_join(p, i, "src", F.col("at"), "s", "e", width=16).collect()}
    assert got == {(a, b) for a, x, v in points for b, y, s, e in spans if v is not None and x == y and s <= v <= e}


def test_nearest_and_hierarchy(spark):
    t = spark.createDataFrame([("s", 10, 100), ("s", 12, 102), ("s", 30, 130)], "src string, p int, pdf int")
    c = spark.createDataFrame([(1, "s", 11), (2, "s", 33), (3, "s", 34), (4, "x", 10)], "k int, src string, v int")
    got = {r["k"]: (r["p"], r["pdf"]) for r in joins.nearest(c, t, "k", "src", "v", "p", "pdf").collect()}
    assert got == {1: (10, 100), 2: (30, 130)}
    e = spark.createDataFrame([(1, "s", 1, 100), (2, "s", 1, 50), (3, "s", 10, 20), (4, "s", 10, 20), (5, "t", 1, 2)], "k int, src string, s int, e int")
    parents = joins.enclosing(e, "k", "src", "s", "e")
    assert {r["k"]: r["parent"] for r in parents.collect()} == {1: None, 2: 1, 3: 2, 4: 2, 5: None}
    assert {r["k"]: r["level"] for r in joins.levels(parents, "k").collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 1}


def test_bm25_by_hand(spark):
    docs = {"a": "cat dog dog", "b": "cat bird", "c": "fish", "d": None}
    df = spark.createDataFrame(list(docs.items()), "id string, t string")
    q = spark.createDataFrame([(1, "dog dog cat"), (2, "none")], "q int, x string")
    got = {(r["q"], r["id"]): r["score"] for r in R.bm25_topk(df, "id", "t", q, "q", "x").collect()}
    toks = {k: (v or "").split() for k, v in docs.items()}
    n, avg = 4, sum(map(len, toks.values())) / 4
    idf = lambda t: math.log1p((n - sum(t in x for x in toks.values()) + 0.5) / (sum(t in x for x in toks.values()) + 0.5))
    for k, x in toks.items():
        want = sum(idf(t) ** 2 * (1 + math.log(c)) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / avg)) for t, c in (("dog", 2), ("cat", 1)) if t in x)
        assert (want == 0 and (1, k) not in got) or abs(got[(1, k)] - want) < 1e-5


def test_plain_tokens_are_those_of_the_jvm(spark):
    texts = ["资本论 Das KAPITAL ２０２６ Ａb", "一", "一二三，四五x六", "İK ﬁ é ß", "", "。"]
    got = {r["t"]: list(r["k"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.tokens("t").alias("k")).collect()}
    assert got == {t: T.plain_tokens(t) for t in texts}


def test_bm25_keeps_only_numbers_of_question_terms(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(R, "cut", lambda df: kept.append(df) or cut(df))
    docs = [("a", "猫猫狗 cat"), ("a", "猫猫狗 cat"), ("a", "dog cat"), ("b", "cat"), ("c", None), ("d", "cat")]
    df = spark.createDataFrame(docs, "id string, t string")
    q = spark.createDataFrame([(1, "cat 猫狗"), (2, "fish"), (3, "dog dog")], "q int, x string")
    got = R.bm25_topk(df, "id", "t", q, "q", "x", k=2).collect()
    assert all(t != "string" for x in kept for n, t in x.dtypes if n != "id")
    # five texts; b and d tie and the lesser key stays, the two texts of a add up
    assert [(r["q"], r["id"], r["rank"]) for r in sorted(got)] == [(1, "a", 1), (1, "b", 2), (3, "a", 1)]
    assert sorted(got) == sorted(R.bm25_topk(df.distinct().repartition(3), "id", "t", q, "q", "x", k=2).collect())
    monkeypatch.setattr(R, "PAIRS_AT_ONCE", 1)
    assert sorted(got) == sorted(R.bm25_topk(df, "id", "t", q, "q", "x", k=2).collect())


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(8, 16))
    v = np.concatenate([c + 0.3 * rng.normal(size=(60, 16)) for c in centres]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in enumerate(v)], "id long, v array<float>, similarity int").repartition(5)
    q = df.filter("id % 20 = 0")
    exact = {(r["query_id"], r["rank"]): r["id"] for r in R.exact_neighbours(df, "id", "v", q, 5).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(0, len(v), 20):
        assert {exact[(i, k)] for k in range(1, 6)} == set(np.argsort(-s[i])[:5].tolist())
    near = {(r["query_id"], r["id"]) for r in R.cell_neighbours(df, "id", "v", q, 5, cells=8, probe=3).collect()}
    assert len(near & {(a, b) for (a, _), b in exact.items()}) >= 0.9 * len(exact)


def test_index_recall_on_test_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.filter("vec_id % 20 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in R.exact_neighbours(e, "vec_id", "embedding", q, 10).collect()}
    near = {(r["query_id"], r["vec_id"]) for r in R.cell_neighbours(e, "vec_id", "embedding", q, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_diversify_greedy(spark):
    rows = [(1, i, s, a) for i, (s, a) in enumerate([("x", "t"), ("x", "t"), ("x", "u"), ("x", "w"), ("y", ""), ("y", ""), ("y", "")], 1)]
    df = spark.createDataFrame(rows, "q int, rank int, src string, art string")
    got = [r["rank"] for r in R.diversify(df, "q", "rank", "src", "art", 5).orderBy("position").collect()]
    assert got == [1, 3, 5, 6, 2]
    assert R.diversify(df.limit(0), "q", "rank", "src", "art", 5).count() == 0


def test_fusion_ties(spark):
    df = spark.createDataFrame([(1, "a", 1, "d"), (1, "b", 1, "s"), (1, "a", 2, "s")], "q int, doc string, rank int, channel string")
    got = {r["doc"]: (r["score"], r["lists"]) for r in R.rrf(df, "q", "doc").collect()}
    assert got == {"a": (round(1 / 61 + 1 / 62, 6), 2), "b": (round(1 / 61, 6), 1)}


def test_filters(spark):
    df = spark.createDataFrame([(1, "x", True), (1, "y", False), (2, "z", False), (2, None, None)], "q int, s string, ok boolean")
    assert {r["s"] for r in filters.kept_or_all(df, F.col("ok"), "q").collect()} == {"x", "z", None}
    assert filters.compiled(df, {"s": ["x", "z"], "q": None}).count() == 2 and filters.compiled(df, {}).count() == 4
    assert filters.compiled(df, {"s": "it's"}).count() == 0
    assert filters.reconciled(df, ["s", "none", "q"]) == ["s", "q"]


def test_audit_codes(spark):
    cols = "paragraph_id string, retrieval_unit string, retrievable boolean, page_type string, paragraph_text string, quality_flags array<string>, article string, pdf_page_start int, pdf_page_end int"
    rows = [
        ("ok", "paragraph", None, "body", "正文。", [], "甲", 1, 1), ("toc", "paragraph", None, "toc", "x", [], "", 1, 1), ("rev", "PARAGRAPH ", None, "body", "y", [], "甲", 5, 3),
        ("none", None, None, "body", None, None, None, None, None), ("moji", "paragraph", False, "body", "锟斤拷", ["mojibake"], "甲", 1, 1), ("foot", "paragraph", True, "body", "［3］注文", [], "甲", 1, 1),
        ("note", "paragraph", True, "notes", "［3］注文", [], "注释", 1, 1), ("unk", "paragraph", True, "body", "z", [], "未知", 1, 1),
    ]
    df = spark.createDataFrame(rows, cols)
    got = {(r["paragraph_id"], r["code"]) for r in A.audit(df, ["目录", "注释"], ["锟斤拷"], ["paragraph"], ["toc"], ["未知"]).collect()}
    assert got == {("toc", "FRONT_MATTER_LEAK"), ("rev", "PAGE_RANGE_REVERSED"), ("none", "EMPTY_RETRIEVAL_TEXT"), ("none", "ARTICLE_MISSING"), ("none", "PAGE_REQUIRED"), ("foot", "FOOTNOTE_ORPHAN"), ("unk", "ARTICLE_UNKNOWN")}


def test_matching_functions(spark):
    assert M.repaired("MÃ¼hle und â€žGeldâ€œ") == "Mühle und „Geld“" and M.repaired("naïve") == "naïve"
    assert M.block_coverage("abcdef", "xxabcyy") == 0.5 and M.block_coverage("ab", "cab") == 1.0 and M.block_coverage("", "x") == 0.0
    assert M.window_ratio("abcdef", "zzzabcdefzzz") >= 0.9 and M.window_ratio("abc", "") == 0.0
    assert M.snippet("a b\nc d e", "bc", 2) == "a b c d" or "b c" in M.snippet("a b\nc d e", "bc", 2)
    df = spark.createDataFrame([("甲 乙\n丙丁", "乙丙"), ("甲", "x"), (None, "x")], "a string, b string")
    got = [tuple(r["p"]) if r["p"] else None for r in df.select(M.located("a", "b").alias("p")).collect()]
    assert got[0] == (2, 5, 1, 2) and got[1][0] is None
    assert one(spark, "MÃ¼hle", M.repair_mojibake) == "Mühle"


def test_cleaning(spark):
    text = "第一章 总论\n" + "这是一个很长的段落" * 5 + "。\n下一段开始" + "了" * 40 + "！\n● 条目"
    assert len(C.lines_to_paragraphs(text)) == 3 or C.lines_to_paragraphs(text)[-1] == "●条目"
    spans = C.chunk_spans("甲乙丙。" * 50, 40, 8)
    assert spans[0][0] == 0 and spans[-1][1] == 200 and all(b - a <= 40 for a, b in spans) and all(x[1] >= y[0] for x, y in zip(spans, spans[1:]))
    assert C.chunk_spans("", 40, 8) == []
    df = spark.createDataFrame([("a", "1 甲"), ("b", None), ("c", ""), ("d", "甲 … 12\n乙…… 3\n丙 5\n丁 7")], "id string, t string")
    got = {r["id"]: r["k"] for r in df.select("id", C.page_class("t").alias("k")).collect()}
    assert got["c"] == "blank" and got["d"] == "toc"


def test_citing(spark):
    cards = ["甲，第3页", "乙，第9页"]
    df = spark.createDataFrame([("见[E1]和[E5][来源2]。", cards), (None, cards), ("无", None)], "a string, c array<string>")
    got = [r["x"] for r in df.select(citing.repaired(F.col("a"), F.col("c")).alias("x")).collect()]
    assert got == ["见（甲，第3页）和。\n\n1. 甲，第3页", None, "无"]
    lines = spark.createDataFrame([(1, 1, "甲，第3页"), (1, 2, "同上"), (1, 3, "乙"), (1, 4, "ibid."), (2, 1, "同上")], "q int, p int, l string")
    assert [r["l"] for r in citing.ibid_resolved(lines, "q", "p", "l").orderBy("q", "p").collect()] == ["甲，第3页", "甲，第3页", "乙", "乙", "同上"]


def test_sources_and_validation(spark):
    html = spark.createDataFrame([(1, '<a href="a.pdf">x</a><A HREF="/b.PDF">y</A><a href="http://h/c.pdf">z</a><a href="d.txt">t</a>'), (2, None), (3, "")], "id int, html string")
    got = {r["url"] for r in sources_ops.links(html, "html", "https://e.org/dir/", ".pdf").collect()}
    assert got == {"https://e.org/dir/a.pdf", "https://e.org/b.PDF", "http://h/c.pdf"}
    lines = spark.createDataFrame([('{"a": 1}',), ("",), ("{broken",)], "value string")
    assert [r["a"] for r in sources_ops.parse_jsonl(lines, "a int").collect()] == [1]
    with pytest.raises(Exception):
        sources_ops.parse_jsonl(lines, "a int", strict=True).collect()
    m = [spark.createDataFrame([("s", "a")], "k string, v string"), spark.createDataFrame([("s", "b"), ("t", "c")], "k string, v string")]
    assert {(r["k"], r["v"]) for r in sources_ops.first_wins(m, "k").collect()} == {("s", "a"), ("t", "c")}
    assert validation.rule_failures(html, "id", {"html": F.col("html").isNotNull()}).count() == 1


def test_model_learns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4) + 3 * (i % 2)], i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    train, test = Mo.split_by_hash(df, "id", 0.3, "s")
    assert train.count() + test.count() == 300
    report = Mo.f1_report(Mo.predicted(Mo.fitted(train, "v", "label"), test, "v"), "label", "prediction").collect()
    assert all(r["f1"] > 0.9 for r in report)


def test_ids(spark):
    df = spark.createDataFrame([("s", "t", 1, None), ("s", None, 1, 2)], "s string, t string, a int, b int")
    got = [r["i"] for r in df.select(K.paragraph_id(F.col("s"), F.col("t"), F.col("a"), F.col("b")).alias("i")).collect()]
    assert len(set(got)) == 2 and all(x.startswith("par_") and len(x) == 36 for x in got)
    assert one(spark, " 12 ", lambda x: K.to_int(x)) == 12 and one(spark, "x", lambda x: K.to_int(x)) is None
