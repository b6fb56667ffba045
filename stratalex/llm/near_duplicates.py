"""Near-duplicate texts by exact comparison in tiles.

Texts are compared by the Jaccard similarity of their sets of 5-character substrings, white space removed. Equal
texts are one text from here on, told apart again at the end.

1. Each text gets minimum hashes, which are joined to bands and also give a sketch of one bit each. Texts that share
   a band stand in one block. A task sends an equal text only once.
2. Blocks stream, sorted, through numpy tiles: sketches ordered by population count, tile pairs whose counts differ
   beyond the radius skipped, the rest compared by exclusive-or and bit count. A block beyond HOT rows is not held by one
   task: its rows go on as pairs of tiles, spread over all tasks.
3. Pairs within the radius are held against each other by all their minimum hashes, one byte each, before any text is moved;
   pairs of like texts of one language, which are many, end here.
4. The rest is compared exactly: bitmaps of the substrings first, by exclusive-or and bit count against
   the greatest symmetric difference that the threshold allows, then the sets themselves.

With BANDS bands of ROWS hashes a pair at similarity 0.7 shares a band with probability 0.9998 (0.8: 0.999999); at 0.8
or more the loss is below one in a million. Of the pairs at 0.7 that share a band, 0.9999 lie within the radius of the
sketch (five deviations are less than that) and 0.9999999 agree in MATCHES of the bytes (six deviations).

Defined cases: null texts and texts of fewer than `least` characters are in no pair; equal texts have similarity 1;
repeated rows of a key count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import batches_by_chars, code_points, cut

SHINGLE = 5
THRESHOLD = 0.7
LEAST = 60
BANDS, ROWS = 20, 3
#: Bits in which the sketches of a pair may differ; at similarity 0.7 the mean is 8.6, the deviation 2.7.
RADIUS = 20
#: Minimum hashes that must agree in one byte; at similarity 0.7 the mean is 42, the deviation 3.5.
MATCHES = 21
TILE = 512
HOT = 8192
BITS = 1024
BROADCAST_ROWS = 1_000_000

_MULTIPLIERS = np.random.default_rng(20240131).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def squeezed(text: str) -> str:
    """The text without white space; invisible signs stay."""
    return "".join(text.split())


def shingle_hashes(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the SHINGLE code points from each position on (the last ones reach over the end)."""
    p = points.astype(np.uint64)
    n = len(p) - SHINGLE + 1
    h = p[:n].copy()
    for i in range(1, SHINGLE):
        h *= _P1
        h += p[i : i + n]
    h ^= h >> np.uint64(29)
    h *= _P2
    h ^= h >> np.uint64(32)
    return h.astype(np.uint32)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bands, sketch, bytes) of texts of at least SHINGLE characters: int64 of shape (texts, BANDS), int64, and uint8 of
    shape (texts, BANDS * ROWS)."""
    points, offsets = code_points(texts)
    h = shingle_hashes(points)
    start, stop = offsets[:-1], offsets[1:] - SHINGLE + 1
    cuts = np.ravel(np.column_stack([start, stop]))
    h = np.append(h, np.full(SHINGLE, 0xFFFFFFFF, np.uint32))
    mins = np.empty((BANDS * ROWS, len(texts)), np.uint32)
    buffer = np.empty_like(h)
    for i, a in enumerate(_MULTIPLIERS):
        np.multiply(h, a, out=buffer)
        mins[i] = np.minimum.reduceat(buffer, cuts)[::2]
    m = mins.astype(np.uint64)
    bands = np.zeros((len(texts), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(texts), b + 1, np.uint64)
        for r in range(ROWS):
            x = (x ^ m[b * ROWS + r]) * _P2
            x ^= x >> np.uint64(31)
        bands[:, b] = x * _P3
    sketch = np.zeros(len(texts), np.uint64)
    for i in range(BANDS * ROWS):
        sketch |= ((m[i] >> np.uint64(6)) & np.uint64(1)) << np.uint64(i)
    return bands.view(np.int64), sketch.view(np.int64), np.ascontiguousarray(((mins >> np.uint32(6)) & np.uint32(255)).astype(np.uint8).T)


def close_pairs(sketch_a: np.ndarray, sketch_b: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sketches differ in at most radius bits, in tiles ordered by population count.

    Without sketch_b the pairs within sketch_a, each once.
    """
    own = sketch_b is None
    a = sketch_a.view(np.uint64)
    b = a if own else sketch_b.view(np.uint64)
    ca, cb = np.bitwise_count(a), np.bitwise_count(b)
    oa = np.argsort(ca, kind="stable")
    ob = oa if own else np.argsort(cb, kind="stable")
    left, right = [], []
    for i in range(0, len(oa), TILE):
        x = oa[i : i + TILE]
        low, high = int(ca[x[0]]), int(ca[x[-1]])
        for j in range(i if own else 0, len(ob), TILE):
            y = ob[j : j + TILE]
            if int(cb[y[0]]) - high > radius:
                break
            if low - int(cb[y[-1]]) > radius:
                continue
            near = np.bitwise_count(a[x][:, None] ^ b[y][None, :]) <= radius
            if own and i == j:
                near = np.triu(near, 1)
            r, c = np.nonzero(near)
            left.append(x[r])
            right.append(y[c])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def signed(texts: DataFrame) -> DataFrame:
    """(tid, sketch, signature, bands) of the texts (tid, t); a task gives an equal text once."""
    n = BANDS * ROWS
    schema = pa.schema([("tid", pa.int64()), ("sketch", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, kept = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i in seen:
                    continue
                seen.add(i)
                s = squeezed(t)
                if len(s) >= LEAST:
                    ids.append(i)
                    kept.append(s)
            for a, b in batches_by_chars(kept):
                bands, sketch, sig = signatures(kept[a:b])
                raw = sig.tobytes()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array(sketch), pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary()), lists], schema=schema
                )

    return texts.mapInArrow(run, "tid long, sketch long, signature binary, bands array<long>")


def agreeing(pairs: DataFrame, signatures_: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least MATCHES bytes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    n = BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, n) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= MATCHES)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    one = signatures_.select(F.col("tid").alias("a"), F.col("signature").alias("sa"))
    two = signatures_.select(F.col("tid").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def blocked(bands: DataFrame) -> DataFrame:
    """Stream the sorted blocks: (a, b) pairs within the radius; rows of hot blocks go on as (a, null, band, sketch, idx)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("band", pa.int64()), ("sketch", pa.int64()), ("idx", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_over = [np.zeros(0, np.int64)] * 3
        hot_band, hot_rows = None, 0

        def hot(band: np.ndarray, tid: np.ndarray, sketch: np.ndarray, first: int) -> pa.RecordBatch:
            n = len(tid)
            return pa.RecordBatch.from_arrays([pa.array(tid), pa.nulls(n, pa.int64()), pa.array(band), pa.array(sketch), pa.array(np.arange(first, first + n))], schema=schema)

        def pairs(band: np.ndarray, tid: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal hot_band, hot_rows
            if not len(band):
                return
            edges = np.flatnonzero(np.diff(band)) + 1
            starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(band)]])
            size = stops - starts
            lefts, rights = [], []
            two = starts[size == 2]
            if len(two):
                near = np.bitwise_count(sketch[two].view(np.uint64) ^ sketch[two + 1].view(np.uint64)) <= RADIUS
                lefts.append(tid[two[near]])
                rights.append(tid[two[near] + 1])
            for s, e in zip(starts[size > 2].tolist(), stops[size > 2].tolist()):
                if e - s > HOT or (hot_band is not None and band[s] == hot_band):
                    if band[s] != hot_band:
                        hot_band, hot_rows = band[s], 0
                    yield hot(band[s:e], tid[s:e], sketch[s:e], hot_rows)
                    hot_rows += e - s
                    continue
                x, y = close_pairs(sketch[s:e])
                lefts.append(tid[s:e][x])
                rights.append(tid[s:e][y])
            if lefts:
                x, y = np.concatenate(lefts), np.concatenate(rights)
                x, y = np.minimum(x, y), np.maximum(x, y)
                keep = x != y
                if keep.any():
                    both = np.unique(np.column_stack([x[keep], y[keep]]), axis=0)
                    n = pa.nulls(len(both), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), n, n, n], schema=schema)

        for batch in batches:
            now = [np.concatenate([o, batch.column(i).to_numpy()]) for i, o in enumerate(left_over)]
            if not len(now[0]):
                continue
            last = now[0][-1]
            split = int(np.searchsorted(now[0], last))  # the last block may go on in the next batch
            if len(now[0]) - split > HOT or (hot_band is not None and last == hot_band):
                yield from pairs(*[x[:split] for x in now])
                tail = [x[split:] for x in now]
                if last != hot_band:
                    hot_band, hot_rows = last, 0
                yield hot(*tail, hot_rows)
                hot_rows += len(tail[0])
                left_over = [x[:0] for x in now]
            else:
                yield from pairs(*[x[:split] for x in now])
                left_over = [x[split:] for x in now]
        if len(left_over[0]) > 1:
            yield from pairs(*left_over)

    return bands.repartition("band").sortWithinPartitions("band").mapInArrow(run, "a long, b long, band long, sketch long, idx long")


def hot_pairs(hot: DataFrame) -> DataFrame:
    """(a, b) within hot blocks: each pair of tiles of a block is a group of its own."""
    tiles = hot.groupBy("band").agg((F.floor(F.max("idx") / HOT) + 1).cast("int").alias("tiles"))
    rows = hot.join(tiles, "band").withColumn("tile", F.floor(F.col("idx") / HOT).cast("int"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "band", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), (F.col("tile") > F.col("other")).alias("second"), "a", "sketch"
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["x"].iloc[0] == pdf["y"].iloc[0]:
            t = pdf["a"].to_numpy()
            x, y = close_pairs(pdf["sketch"].to_numpy())
            x, y = t[x], t[y]
        else:
            one, two = pdf[~pdf["second"]], pdf[pdf["second"]]
            x, y = close_pairs(one["sketch"].to_numpy(), two["sketch"].to_numpy())
            x, y = one["a"].to_numpy()[x], two["a"].to_numpy()[y]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).query("a != b")

    return spread.groupBy("band", "x", "y").applyInPandas(compare, "a long, b long")


def _bitmap(text: str) -> tuple[np.ndarray, int]:
    h = shingle_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)) % BITS
    bits = np.zeros(BITS, bool)
    bits[h] = True
    return np.packbits(bits).view(np.uint64), len(h)


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, ta, b, tb) whose similarity reaches the threshold, compared exactly."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, ta, b, tb = (batch.column(i).to_pylist() for i in range(4))
            texts: dict[int, str] = {}
            for i, t in zip(a + b, ta + tb):
                if i not in texts:
                    texts[i] = squeezed(t)
            order = {i: k for k, i in enumerate(texts)}
            maps = [_bitmap(t) for t in texts.values()]
            bits, sizes = np.array([m for m, _ in maps]), np.array([n for _, n in maps], np.int64)
            ia, ib = np.array([order[i] for i in a]), np.array([order[i] for i in b])
            # the sets have at most these sizes, and differ at least in the bits that differ
            apart = np.bitwise_count(bits[ia] ^ bits[ib]).sum(axis=1)
            near = apart <= (1 - threshold) / (1 + threshold) * (sizes[ia] + sizes[ib]) + 1e-9
            sets: dict[int, set[str]] = {}
            out: list[tuple[int, int, float]] = []
            for k in np.flatnonzero(near).tolist():
                x, y = a[k], b[k]
                for i in (x, y):
                    if i not in sets:
                        t = texts[i]
                        sets[i] = {t[j : j + SHINGLE] for j in range(len(t) - SHINGLE + 1)}
                shared = len(sets[x] & sets[y])
                total = len(sets[x]) + len(sets[y]) - shared
                if shared >= threshold * total - 1e-9:
                    out.append((x, y, shared / total))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], schema.field(i).type) for i in range(3)], schema=schema)

    return pairs.mapInArrow(run, "a long, b long, similarity double")


def similar_texts(df: DataFrame, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) of different texts, by the 64-bit hash of each stored text (xxhash64), a < b."""
    texts = df.select(F.xxhash64(text).alias("tid"), F.col(text).alias("t")).filter(F.length("t") >= LEAST)
    made = cut(signed(texts))
    found = cut(blocked(made.select(F.explode("bands").alias("band"), "tid", "sketch")))
    near = found.filter(F.col("b").isNotNull()).select("a", "b").unionByName(hot_pairs(found.filter(F.col("b").isNull()).select("a", "band", "sketch", "idx"))).distinct()
    pairs = cut(agreeing(near, made.select("tid", "signature").dropDuplicates(["tid"])))
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct())
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    few = texts.join(wanted, "tid", "left_semi").groupBy("tid").agg(F.min("t").alias("t"))
    one, two = few.select(F.col("tid").alias("a"), F.col("t").alias("ta")), few.select(F.col("tid").alias("b"), F.col("t").alias("tb"))
    return verified(pairs.join(one, "a").join(two, "b").select("a", "ta", "b", "tb"), threshold)


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, tid) of the rows with a text long enough to be compared, repeated rows once."""
    rows = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("tid"), F.length(F.regexp_replace(text, "(?U)[\\s\\x{1c}-\\x{1f}]+", "")).alias("n"))
    return rows.filter(F.col("n") >= LEAST).select("k", "tid").distinct()


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key_a, key_b, similarity) of all pairs of rows, key_a < key_b as strings; equal texts count."""
    m = members(df, key, text)
    found = similar_texts(df, text, threshold)
    a = m.select(F.col("k").alias("ka"), F.col("tid").alias("a"))
    b = m.select(F.col("k").alias("kb"), F.col("tid").alias("b"))
    different = found.join(a, "a").join(b, "b").select("ka", "kb", "similarity")
    equal = a.join(b, F.col("a") == F.col("b")).select("ka", "kb", F.lit(1.0).alias("similarity"))
    both = different.unionByName(equal).filter(F.col("ka") != F.col("kb"))
    return both.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"), "similarity").distinct()


def groups(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, group_id, group_size, n_links): one row per row; n_links counts the links of its text to different texts.

    Groups are the connected components of the links between different texts; copies are not expanded into pairs. The
    label of a group is its least text hash, found by alternating label and pointer steps, each one cut by a checkpoint.
    """
    m = cut(members(df, key, text))
    links = cut(similar_texts(df, text, threshold).select("a", "b"))
    both = cut(links.union(links.select("b", "a")))
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("other"))
        stepped = label.join(near, "a", "left").select("a", F.least("label", F.coalesce("other", "label")).alias("step"), F.col("label").alias("old"))
        stepped = cut(stepped)
        jumped = stepped.join(stepped.select(F.col("a").alias("x"), F.col("step").alias("further")), F.col("step") == F.col("x"), "left")
        fresh = cut(jumped.select("a", F.least("step", F.coalesce("further", "step")).alias("label"), "old"))
        changed = fresh.filter("label <> old").limit(1).count()
        label = fresh.select("a", "label")
        if not changed:
            break
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    known = label.join(degree, "a").select(F.col("a").alias("tid"), "label", "n")
    out = m.join(known, "tid", "left").select("k", F.coalesce("label", "tid").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
    size = out.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return out.join(size, "group_id").select(F.col("k").alias(key), "group_id", "group_size", "n_links")
