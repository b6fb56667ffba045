import random

from hypothesis import given, settings
from hypothesis import strategies as st

from stratalex.llm import splitting


@given(st.text(alphabet="ab。，. \n中文é́", max_size=900), st.integers(20, 120), st.integers(0, 10))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    spans = splitting.pieces(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    assert all(spans[i + 1][0] == spans[i][1] - overlap for i in range(len(spans) - 1))
    rebuilt = text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:])
    assert rebuilt == text


def test_strong_boundaries_stay():
    text = "甲" * 30 + "。" + "乙" * 30 + "，" + "丙" * 30 + "\n\n" + "丁" * 40 + "。"
    cuts = splitting.cut_points(text, 100, 0)
    assert text.index("丁") in cuts


def test_one_kind_of_boundary_fills_the_pieces():
    sizes = [b - a for a, b in splitting.pieces("word " * 200, 320)]
    assert sizes == [320, 319, 319, 234] and len(sizes) == -(-(1000 - 64) // (320 - 64))


def test_different_texts_under_one_id(spark):
    one, two = "甲，" * 200, "乙。" * 300
    df = spark.createDataFrame([("a", one, "semantic_child"), ("a", two, "semantic_child"), ("a", one, "semantic_child")], "id string, t string, u string")
    got = splitting.split_oversized(df, "id", "t", "u").collect()
    by = {}
    for r in sorted(got, key=lambda r: r["piece_no"]):
        by.setdefault(r["text_hash"], []).append(r)
    whole = lambda rows: rows[0]["piece_text"] + "".join(r["piece_text"][splitting.OVERLAP :] for r in rows[1:])
    assert sorted(map(whole, by.values())) == sorted([one, two])


def test_operator_on_odd_rows(spark):
    long = "词，" * 400
    rows = [
        ("a", long, " Semantic_Child "), ("a", long, " Semantic_Child "), ("b", long, "paragraph"), ("c", None, "paragraph"), ("d", "", "paragraph"),
        ("e", "x" * 900, "PARAGRAPH"), ("f", long, None), ("g", long, "unknown"), ("h", "é" * 320, "semantic_child"), ("i", "é" * 321, "semantic_child"),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, t string, u string, piece_no string, k int")
    got = splitting.split_oversized(df, "id", "t", "u").collect()
    assert {r["id"] for r in got} == {"a", "e", "i"}
    assert sum(r["id"] == "a" for r in got) == len(splitting.pieces(long, 320))
    assert all(len(r["piece_text"]) <= 800 for r in got)
    assert splitting.split_oversized(df.limit(0), "id", "t", "u").count() == 0


def test_very_long_text_is_fast():
    rng = random.Random(1)
    text = "".join(rng.choice("甲乙丙丁，。 ") for _ in range(200_000))
    assert len(splitting.pieces(text, 320)) >= 200_000 // 320
