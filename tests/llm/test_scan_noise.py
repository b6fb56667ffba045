from stratalex.llm import scan_noise as m

FILL = ["the market of the town governs the old trade and the annual fair of the river", "资本和农业之间的生产决定着劳动的价值，社会的制度改变了货币"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id string, source string, book string, t string, line_no string")


def test_noise_kinds(spark):
    rows = [(f"f{i}", "s", "砚山全编 第3卷", FILL[i % 2] + "\n" + FILL[i % 2]) for i in range(60)]
    rows += [
        ("a", "s", None, "the annual fair of the\n— 12 —\nold town gov-\nerns the trade\n砚 山 全 编 第 3 卷\nof the markct."),
        ("b", "s", None, "资木和农业之间\n207·砚山全编 第3卷\n的价值，到18O9年，社会\n19\n的制度。"),
        ("c", "s", None, "die Boden-\nund Steuerlast of the r1ver\nxvii\nend."),
        ("d", "s", None, None), ("e", "s", None, ""), ("g", None, None, "\n\n"), ("h", None, None, "第9页"),
        ("a", "s", None, "the annual fair of the\n— 12 —\nold town gov-\nerns the trade\n砚 山 全 编 第 3 卷\nof the markct."),
    ]
    got = {(r["id"], r["line_no"], r["noise_kind"]) for r in m.marked(frame(spark, rows), "id", "t", "source", ["book"]).collect()}
    want = {
        ("a", 2, "page_number"), ("a", 3, "hyphen_break"), ("a", 5, "running_head"), ("a", 6, "misread"),
        ("b", 1, "misread"), ("b", 2, "running_head"), ("b", 3, "misread"), ("b", 4, "page_number"), ("c", 2, "misread"), ("c", 3, "page_number"),
    }
    assert got == want
    lines = m.marked(frame(spark, rows), "id", "t", "source", ["book"], lines=True)
    text = {r["id"]: r["paragraph"] for r in m.paragraphs(lines, "id").collect()}
    assert text["a"] == "the annual fair of the old town governs the trade of the market."
    assert text["b"] == "资本和农业之间的价值，到1809年，社会的制度。"


def test_a_bounded_lexicon_in_parts_gives_the_same(spark):
    rows = [(f"f{i}", "s", None, FILL[0]) for i in range(40)] + [("a", "s", None, "the markct of\nthe towu and thc fair"), ("b", "s", None, "old tradc\n资木和")]
    rows += [(f"g{i}", "s", None, FILL[1]) for i in range(40)]
    df = frame(spark, rows)
    one = {tuple(r) for r in m.marked(df, "id", "t", "source", ["book"]).collect()}
    parts = {tuple(r) for r in m.marked(df, "id", "t", "source", ["book"], lexicon_rows=1).collect()}
    assert one == parts and ("a", 1, "misread") in one and ("b", 2, "misread") in one


def test_empty(spark):
    df = frame(spark, []) if False else spark.createDataFrame([], "id string, source string, book string, t string")
    assert m.marked(df, "id", "t", "source", ["book"]).count() == 0


def test_copies_and_opening_lines_do_not_hide_a_head(spark):
    pages = [(f"p{i}", "s", None, f"{FILL[0]} {w}\n砚山余编卷\nold {w} trade.") for i, w in enumerate(("north", "south", "west", "east"))]
    copies = [("c%d" % i, "s", None, pages[0][3]) for i in range(30)] + [pages[1]] * 5
    opening = [(f"o{i}", "s", None, f"砚山余编卷\nthe fair of {w}.") for i, w in enumerate("abcdefgh")]
    # a line of text in a copied text stays a line of text
    text = [(f"t{i}", "s", None, "the river in the town\nthe market and the fair\nend.") for i in range(30)]
    heads = lambda rows: {(r["id"], r["line_no"]) for r in m.marked(frame(spark, rows), "id", "t", "source", ["book"]).collect() if r["noise_kind"] == "running_head"}
    want = {(r[0], 2) for r in pages}
    assert heads(pages + text) == want
    assert heads(pages + text + copies) == want | {(r[0], 2) for r in copies}
    assert heads(pages + text + opening) == want | {(r[0], 1) for r in opening}


def test_lines_are_repaired_by_all_parts_of_the_lexicon(spark):
    rows = [(f"f{i}", "s", None, FILL[0]) for i in range(100)] + [(f"g{i}", "s", None, FILL[1]) for i in range(100)]
    rows += [("a", "s", None, "the markct of the town and the\nfair in 18O9\nold tradc"), ("b", "s", None, "资木和农业之间，markct and tradc\nend")]
    rows += [rows[-1]]
    df = frame(spark, rows)
    lines = lambda n: {tuple(map(str, r)) for r in m.marked(df, "id", "t", "source", ["book"], lines=True, lexicon_rows=n).select("id", "line_no", "line", "repaired", "noise", "spaced").collect()}
    text = lambda n: {tuple(r) for r in m.paragraphs(m.marked(df, "id", "t", "source", ["book"], lines=True, lexicon_rows=n), "id").collect()}
    assert lines(1) == lines(m.LEXICON_ROWS)
    assert text(1) == text(m.LEXICON_ROWS)
    assert ("a", 0, "the market of the town and the fair in 1809 old trade") in text(1)
