import random
from collections import defaultdict

import numpy as np
import pytest

from stratalex.llm import packing as m


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_keeps_every_capacity(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.integers(1, 100, 500))[::-1]
    cap, docs, cost = 100, int(rng.integers(2, 20)), float(rng.choice([3_000.0, 6_000.0, 9_000.0]))
    where = m.best_fit(sizes, cap, docs, cost)
    for b in np.unique(where):
        x = sizes[where == b].astype(float)
        assert x.sum() <= cap and len(x) <= docs and (len(x) == 1 or (x * x).sum() <= cost)


def test_every_capacity_refuses_items():
    """Documents and attention cost each change the packing at the defaults and leave containers shut by them alone."""
    rng = np.random.default_rng(3)
    cap, cost = m.CAPACITY, m.MAX_COST_PART * m.CAPACITY**2
    sizes = np.sort(np.concatenate([rng.integers(1, 60, 3000), rng.integers(1900, 2000, 200)]))[::-1]
    free = len(set(m.best_fit(sizes, cap, 10**9, 1e18)))
    few = m.best_fit(sizes, cap, m.MAX_DOCUMENTS, 1e18)
    cheap = m.best_fit(sizes, cap, 10**9, cost)
    assert len(set(few)) > free and max(np.bincount(few)) == m.MAX_DOCUMENTS
    alone = [b for b in set(cheap) if (cheap == b).sum() == 1 and sizes[cheap == b][0] ** 2 > cost]
    assert alone and len(set(cheap)) >= free
    assert all((cheap == cheap[i]).sum() == 1 for i in np.flatnonzero(sizes.astype(float) ** 2 > cost))


def fewest(sizes, cap, docs, cost):
    """The least number of containers, by trying all ways."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        s = sizes[i]
        for k, (t, d, c) in enumerate(bins):
            if t + s <= cap and d < docs and c + s * s <= cost:
                bins[k] = (t + s, d + 1, c + s * s)
                go(i + 1, bins)
                bins[k] = (t, d, c)
        bins.append((s, 1, s * s))
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@pytest.mark.parametrize("docs,cost", [(9, 1e9), (3, 1e9), (9, 3500.0), (3, 4000.0)])
def test_against_the_least_number_of_containers(docs, cost):
    rng = np.random.default_rng(docs)
    more = 0
    for _ in range(30):
        sizes = np.sort(rng.integers(5, 70, 9))[::-1]
        got, want = len(set(m.best_fit(sizes, 100, docs, cost))), fewest(sizes.tolist(), 100, docs, cost)
        assert want <= got <= want + 1
        more += got - want
    assert more <= 10


def test_fill_of_each_capacity(spark):
    rows = [(1, 0, 0, 2000, "a"), (2, 0, 0, 48, "b"), *[(10 + i, 0, 0, 10, "c") for i in range(m.MAX_DOCUMENTS)], (99, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "id long, part_no int, token_start int, n_tokens int, container_id string")
    r = m.fill(df).collect()[0]
    assert (r["containers"], r["documents"], r["full_by_documents"]) == (3, 2 + m.MAX_DOCUMENTS, 1) and abs(r["token_fill"] - (2000 + 48 + 10 * m.MAX_DOCUMENTS) / 2048 / 3) < 1e-9
    assert m.fill(df.limit(0)).collect()[0]["containers"] == 0


def test_fill_is_near_the_best(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([5, 30, 100, 400])))) for i in range(800)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 5000), (1003, "word " * 5000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, t string, part_no int")
    got = m.packed(df, "id", "t").collect()
    assert {r["id"] for r in got} == {r[0] for r in rows}
    by, whole = defaultdict(int), defaultdict(int)
    for r in got:
        whole[r["id"]] += r["n_tokens"]
        if r["container_id"] is None:
            assert r["n_tokens"] == 0
        else:
            by[r["container_id"]] += r["n_tokens"]
    assert max(by.values()) <= 2048
    enc = m.encoding(*m.tokenizer_file(m.TOKENIZER))
    assert all(whole[i] == (len(enc.encode_ordinary(t)) if t else 0) for i, t in rows)
    parts = [r for r in got if r["id"] == 1002]
    assert sorted(r["part_no"] for r in parts) == list(range(len(parts))) and len(parts) == -(-whole[1002] // 2048)
    assert all(sum(x["id"] == r["id"] for x in got) == 1 for r in got if whole[r["id"]] <= 2048)
    assert sum(by.values()) / (2048 * len(by)) > 0.97


def test_empty(spark):
    assert m.packed(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0
