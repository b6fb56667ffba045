import unicodedata

from stratalex.llm import lookalikes as m


def rows(spark, values):
    return spark.createDataFrame([(str(i), v, "s") for i, v in enumerate(values)], "id string, t string, mapped string")


def test_texts_that_look_the_same(spark):
    values = [
        "Die alte M\u00fchle", "Die alte Mu\u0308hle", "D\u0456e \u0430lte M\u00fchle", "\uff24\uff49\uff45 alte M\u00fchle", "Die\u00a0alte M\u00fchle", "Die al\u200bte M\u00fchle",
        "Die\u3000alte\u2005M\u00fchle", "die alte M\u00fchle", "Die alte Muhle", "Die  alte M\u00fchle", "Die alte M\u00fchle.", "Die alte M\u00fchle!",
        "\u5de5\u5382", "\u2f2f\u5382", "\u304c\u3093", "\u304b\u3099\u3093", "\u30ab", "\u30f5", "\u0401\u043b\u043a\u0430", "\u0415\u0308\u043b\u043a\u0430", "", " ", "\u3000", None,
    ]
    got = {int(r["id"]): r["canonical"] for r in m.lookalike_texts(rows(spark, values), "id", "t").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 6, 12, 13, 14, 15, 18, 19, 21, 22}
    assert {got[i] for i in range(7)} == {"Die alte M\u00fchle"}
    assert got[13] == "\u5de5\u5382" and got[22] == " "


def test_scripts_and_signs(spark):
    values = [
        "\uac00\ub098 \ud55c\uae00", "\u1100\u1161\u1102\u1161 \u1112\u1161\u11ab\u1100\u1173\u11af", "\u30ac\u30c9", "\uff76\uff9e\uff84\uff9e", "\u30ab\u3099\u30c8\u3099",
        "Band IV, office", "Band \u2163, o\ufb03ce", "\U0001d401and IV, office", "Band IV, office\u0001", "\u0251lpha", "alpha", "\u2460", "1", "x\u00b2", "x2", "\u212bngstrom", "\u00c5ngstrom",
        "\u1f48d\u1f79s", "O\u0313d\u03cc\u0073", "\u0928\u093c", "\u0929", "\u0e19\u0e33", "\u0e19\u0e4d\u0e32",
    ]
    got = {int(r["id"]): r["canonical"] for r in m.lookalike_texts(rows(spark, values), "id", "t").collect()}
    assert set(got) == {*range(11), *range(15, 23)}
    assert got[0] == got[1] and got[2] == got[3] == got[4] and got[5] == got[6] == got[7] == got[8] and got[9] == got[10] == "alpha"
    assert got[15] == got[16] and got[17] == got[18] and got[19] == got[20] and got[21] == got[22]


def test_the_coarse_form_keeps_what_the_shape_makes_equal():
    a, b = m.coarse_map()
    one = {x: b[i] if i < len(b) else "" for i, x in enumerate(a)}
    coarse = lambda s: "".join(one.get(x, x) for x in s)
    assert coarse("hamo\u4e00") == "hamo\u4e00"
    for cp in m._code_points():
        ch = chr(cp)
        assert coarse(unicodedata.normalize("NFD", ch)) == coarse(unicodedata.normalize("NFC", ch)) == coarse(m.shape(ch)) == coarse(ch), hex(cp)


def test_no_plan_sends_texts_to_all_tasks(spark):
    df = m.lookalike_texts(rows(spark, ["abc", "\u0430bc", "x"] * 3), "id", "t")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan and df.count() == 6
    for side in plan.split("rightHint=(strategy=broadcast)")[1:]:
        assert "canonical" not in side.split("LogicalRDD")[-1].split("]")[0]


def test_titles(spark):
    titles = spark.createDataFrame([("s", "论水车（一）"), ("r", "别的")], "source string, title string")
    df = spark.createDataFrame([("1", "论水车(一)", "s"), ("2", "论水车（一）", "s"), ("3", "论水车(一)", "r"), ("4", None, "s"), ("5", "论水车(二)", "s")], "id string, a string, source string")
    got = m.lookalike_titles(df, "id", "a", "source", titles).collect()
    assert [(r["id"], r["canonical"]) for r in got] == [("1", "论水车（一）")]


def test_empty(spark):
    assert m.lookalike_texts(spark.createDataFrame([], "id string, t string"), "id", "t").count() == 0


def test_many_copies_are_one_member(spark):
    df = spark.createDataFrame([(str(i), "abc" if i % 3 else "\u0430bc") for i in range(300)], "id string, t string")
    assert m.lookalike_texts(df, "id", "t").count() == 300
    same = spark.createDataFrame([(str(i), "abc") for i in range(300)], "id string, t string")
    assert m.lookalike_texts(same, "id", "t").count() == 0
