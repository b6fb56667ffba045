import random

from stratalex.llm import leakage as m


def brute(docs, items, run=40):
    grams = {}
    for i, q in items:
        n = m.normalized(q) if q else ""
        for s in range(len(n) - run + 1):
            grams.setdefault(n[s : s + run], set()).add(i)
    out = set()
    for d, t in docs:
        n = m.normalized(t) if t else ""
        for s in range(len(n) - run + 1):
            out |= {(d, i) for i in grams.get(n[s : s + run], ())}
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda k: "".join(rng.choice("甲乙丙丁戊己庚ＡbＣ１２。， -") for _ in range(k))
    items = [(i // 2, word(rng.randint(20, 160))) for i in range(40)] + [(99, None), (98, "short"), (0, "x" * 200)]
    docs = []
    for d in range(200):
        t = word(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            q = rng.choice(items[:40])[1]
            a = rng.randrange(len(q))
            t = t[:50] + q[a : a + rng.choice([30, 40, 45, 60, 200])].upper() + t[50:]
        docs.append((d, t))
    docs += [(1000, None), (1001, ""), (1002, "x" * 39), (1003, "X" * 5000), (1004, docs[5][1])]
    df = spark.createDataFrame([(*x, 0) for x in docs], "id long, t string, item_id int")
    want = brute(docs, items)
    assert len(want) > 20
    assert {(r["id"], r["item_id"]) for r in m.leaked(df, "id", "t", items).collect()} == want
    assert {(r["id"], r["item_id"]) for r in m.leaked(df, "id", "t", items, max_patterns=10).collect()} == want
    assert m.leaked(df, "id", "t", []).count() == 0 and m.leaked(df.limit(0), "id", "t", items).count() == 0


def test_rows_do_not_depend_on_the_groups(spark):
    items = [(1, "a" * 30 + "b" * 30), (1, "c" * 90), (2, "c" * 50)]
    docs = [(1, "x" + "a" * 30 + "b" * 20), (1, "c" * 200), (1, "c" * 200), (2, "C" * 60), (2, "C" * 60)]
    df = spark.createDataFrame(docs, "id long, t string")
    rows = lambda n: sorted(tuple(r) for r in m.leaked(df, "id", "t", items, max_patterns=n).collect())
    assert rows(1) == rows(m.MAX_PATTERNS) == [(1, 1, 90, 90, True), (1, 2, 50, 50, True), (2, 1, 60, 90, False), (2, 2, 50, 50, True)]


def test_too_many_quotes_are_refused(spark):
    items = spark.createDataFrame([(i, [("s", 1, f"quote {i}", "a")]) for i in range(3)], "item_id int, expected_citations array<struct<source string, citation_page int, quote string, article string>>")
    assert len(m.item_quotes(items)) == 3
    try:
        m.item_quotes(items, 2)
    except ValueError:
        return
    raise AssertionError


def test_search_finds_every_occurrence():
    rng = random.Random(4)
    for _ in range(50):
        pats = list({"".join(rng.choice("ab") for _ in range(8)) for _ in range(5)})
        text = "".join(rng.choice("ab") for _ in range(300))
        got = set(m.WuManber(pats, 3).find(text))
        assert got == {(p, i) for p in pats for i in range(len(text) - 7) if text.startswith(p, i)}
