import random

import numpy as np

from stratalex.llm import shared_spans as m


def brute(texts, least):
    """text -> set of positions that lie in a run of `least` which another text has."""
    where = {}
    for k, t in texts.items():
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], set()).add(k)
    out = {}
    for k, t in texts.items():
        hit = {p for i in range(len(t) - least + 1) if where[t[i : i + least]] - {k} for p in range(i, i + least)}
        if hit:
            out[k] = len(hit)
    return out


def made(rng, n, alphabet="abcdefgh"):
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(100, 300))) for _ in range(5)]
    texts = {}
    for k in range(n):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))
        for _ in range(rng.randint(0, 2)):
            b = rng.choice(base)
            i, size = rng.randrange(len(b)), rng.choice([40, 63, 64, 65, 100])
            j = rng.randint(0, len(t))
            t = t[:j] + b[i : i + size] + t[j:]
        texts[f"p{k}"] = t
    return texts


def test_against_brute_force(spark):
    rng = random.Random(7)
    texts = made(rng, 150)
    texts["same1"] = texts["same2"] = "".join(rng.choice("xyz") for _ in range(90))
    texts["loop"] = "ab" * 100  # repeats itself only
    quote = texts["p3"][:80].ljust(80, "q")
    rows = [(k, t) for k, t in texts.items()] + [("p1", texts["p1"]), ("none", None), ("empty", "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id string, t string, tid int")
    quotes = spark.createDataFrame([(quote,), (None,)], "q string")
    got = {r["id"]: r["shared_chars"] for r in m.shared_text(df, "id", "t", quotes, "q").collect()}
    want = brute({**texts, "quote": quote}, 64)
    want.pop("quote", None)
    assert got == want


def test_small_alphabet_and_divided_shards(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD", 2)
    rng = random.Random(3)
    core = "".join(rng.choice("ab") for _ in range(70))
    texts = {f"p{k}": "".join(rng.choice("cd") for _ in range(30)) + core[: 60 + k % 11] + "".join(rng.choice("ef") for _ in range(30)) for k in range(40)}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    got = {r["id"]: r["shared_chars"] for r in m.shared_text(df, "id", "t", spark.createDataFrame([], "q string"), "q").collect()}
    assert got == brute(texts, 64)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, t string")
    assert m.shared_text(df, "id", "t", spark.createDataFrame([], "q string"), "q").count() == 0


def test_automaton_finds_all_maximal_matches():
    rng = random.Random(5)
    for _ in range(100):
        refs = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(4)]
        sam = m.SuffixAutomaton()
        for k, r in enumerate(refs):
            sam.add(r, k)
        t = "".join(rng.choice("ab") for _ in range(40))
        for a, b, owner, end in sam.match(t, 3):
            assert refs[owner][end - (b - a) : end] == t[a:b]
        covered = {p for a, b, _, _ in sam.match(t, 3) for p in range(a, b)}
        want = {p for i in range(len(t) - 2) if any(t[i : i + 3] in r for r in refs) for p in range(i, i + 3)}
        assert covered == want


def test_every_run_has_a_common_anchor():
    rng = np.random.default_rng(1)
    run = "".join(chr(97 + x) for x in rng.integers(0, 26, 64))
    a, b = "x" * 50 + run + "y" * 50, "z" * 7 + run + "w" * 9
    ha, hb = (set(m.anchors([t])[2].tolist()) for t in (a, b))
    assert ha & hb


def test_spans_are_removed_but_for_one_copy(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    texts = made(rng, 120)
    texts["same1"] = texts["same2"] = "".join(rng.choice("xyz") for _ in range(90))
    rows = [*texts.items(), ("p1", texts["p1"]), ("none", None), ("empty", "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id string, t string, tid int")
    got = {r["id"]: (r["removed_chars"], r["cleaned"]) for r in m.without_shared(df, "id", "t").collect()}
    tid = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("t").alias("h")).collect()}
    where = {}
    for k, t in texts.items():
        for i in range(len(t) - 63):
            where.setdefault(t[i : i + 64], set()).add(tid[k])
    want = {}
    for k, t in texts.items():
        hit = {p for i in range(len(t) - 63) if min(where[t[i : i + 64]]) < tid[k] for p in range(i, i + 64)}
        if hit:
            pieces = "".join("\n" if p in hit else t[p] for p in range(len(t))).split("\n")
            want[k] = (len(hit), "\n".join(x for x in pieces if x))
    want["same2"] = (90, "")
    assert got == want
    assert m.without_shared(df.limit(0), "id", "t").count() == 0


def test_lengths_beyond_the_packed_reach_are_refused(spark):
    try:
        m.spans(spark.createDataFrame([], "tid long, t string"), 1500)
    except ValueError:
        return
    raise AssertionError
