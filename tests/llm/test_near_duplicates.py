import random

import numpy as np

from stratalex.llm import near_duplicates as m


def shingles(t):
    s = m.squeezed(t)
    return {s[i : i + 5] for i in range(len(s) - 4)}


def brute(rows, threshold=0.7):
    sets = {k: shingles(t) for k, t in rows.items() if t is not None and len(m.squeezed(t)) >= 60}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def made(n, seed=1, edits=12):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(70, 300))) for _ in range(n // 6)]
    rows = {}
    for k in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(len(t))] = rng.choice("qrs ")
        rows[f"p{k:03d}"] = "".join(t)
    return rows


def check(spark, rows):
    extra = [("p000", rows["p000"]), ("none", None), ("short", "abc"), ("blank", " " * 80)]
    df = spark.createDataFrame([(*r, 1) for r in [*rows.items(), *extra]], "id string, t string, tid int")
    got = {(r["id_a"], r["id_b"]) for r in m.similar_pairs(df, "id", "t").collect()}
    assert got == brute(rows)
    return df


def test_pairs_against_brute_force(spark):
    rows = made(240)
    rows["w1"], rows["w2"] = rows["p001"], " 　".join(rows["p001"])  # equal but for white space
    df = check(spark, rows)
    pairs = brute(rows)
    parent = {k: k for k in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        parent[root(a)] = root(b)
    got = {r["id"]: r["group_id"] for r in m.groups(df, "id", "t").collect()}
    assert len({(root(k), got[k]) for k in got}) == len({root(k) for k in got}) == len(set(got.values()))


def test_hot_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT", 16)
    monkeypatch.setattr(m, "TILE", 4)
    check(spark, made(200, seed=2, edits=4) | {f"q{i:03d}": "x" * 50 + f"{i:03d}" + "common ending of a very hot passage that a third of all rows have" * 2 for i in range(90)})


def test_empty(spark):
    assert m.similar_pairs(spark.createDataFrame([], "id string, t string"), "id", "t").count() == 0


def test_tiles_equal_all_pairs():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63 - 1, 1500)
    b = a.copy()
    for _ in range(10):
        b ^= np.int64(1) << rng.integers(0, 62, 1500)
    both = np.concatenate([a, b])
    x, y = m.close_pairs(both, radius=12)
    d = np.bitwise_count(both.view(np.uint64)[:, None] ^ both.view(np.uint64)[None, :]) <= 12
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} == {(i, j) for i, j in zip(*np.nonzero(np.triu(d, 1)))}
