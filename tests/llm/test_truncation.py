import math
import random

from stratalex.llm import truncation as m


def test_ends(spark):
    open_ = ["Er ging in die", "甲乙丙，就会", "He saw the mar...", "甲乙…", "甲乙 [...]", "甲乙�", "see cf. p.", "with Mr.", "甲（乙）", "a,", "line。\n新的行还没有"]
    whole = [
        "Er ging.", "甲乙。", "甲乙！”", "“甲”。", "So it was (he said).", "Fin ! »", "甲……", "甲。\n[完]", "甲。\n（未完待续）", "甲。\nM. Olden", "甲。\n第3卷第12页",
        "甲。\n附录 水车表", "甲。\n——1816年9月于Javburg", "甲。\n- 水车\n- 新近的港口", "甲。\n水车\t12.5", "甲。\n旧式的科学……", "x etc.", "", "  ", None,
    ]
    rows = [(i, t) for i, t in enumerate(open_ + whole)]
    df = spark.createDataFrame([(i, t, None, 0) for i, t in rows], "id long, t string, s string, cut int")
    got = {r["id"]: r["cut"] for r in m.truncated(df, "id", "t", "s").collect()}
    assert {t for i, t in rows if got[i]} == set(open_)
    assert len(got) == len(rows)


def test_limits_are_found(spark):
    rng = random.Random(1)
    body = lambda n: "".join(rng.choice("甲乙丙丁戊，。") for _ in range(n))
    rows = [(i, body(rng.randint(50, 400)) + "。", "a") for i in range(300)]
    rows += [(1000 + i, body(199) + "甲", "a") for i in range(20)] + [(2000 + i, body(330)[:332] + "甲" + "b" * (i % 3), "b") for i in range(12)]
    rows += [(3000, (body(170) + "。\n- 水车一二三四五六七八九十" + "甲" * 40)[:200], "a")]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    out = m.truncated(df, "id", "t", "s")
    got = {r["id"]: r["cut_kind"] for r in out.collect() if r["cut"]}
    assert all(got.get(1000 + i) == "char_limit" for i in range(20)) and got[3000] == "char_limit"
    share = {r["source"]: (r["n_documents"], r["n_cut"]) for r in m.share_by_source(out).collect()}
    assert share["a"][0] == 321 and share["a"][1] >= 21
    assert m.share_by_source(m.truncated(df.limit(0), "id", "t", "s")).count() == 0


def test_signs_are_counted_at_every_place(spark):
    texts = ["甲" * 50 + "乙" + "丙" * 49, "丙" * 9 + "乙", "乙丙", "丙", "", None, "  "]
    got = {r["sign"]: r["sign_score"] for r in m.sign_evidence(spark.createDataFrame([(t,) for t in texts], "t string")).collect()}
    places = 100 + 10 + 2 + 1 + 2 - 4
    want = {sign: math.log((inside + 1) / (places + 1)) - math.log((ends + 1) / (len(texts) + 1)) for sign, inside, ends in (("乙", 2, 1), ("丙", 48 + 9, 3))}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(max(-m.SIGN_MOST, min(m.SIGN_MOST, v)), 9) for k, v in want.items()}
