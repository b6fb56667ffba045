"""Long spans that stand verbatim in more than one record.

Every run of `least` code points contains WINDOW consecutive GRAM-code-point substrings, so two texts with a common run
choose the same least hash in it: an anchor. Texts meet only where they share an anchor, in a shard of the reference.

1. A numpy pass gives the anchors of each text, each with the hash of its surroundings, i.e. of all runs of `least` that
   contain it. Partial sums keep the anchors that stand in more than one text. Where the surroundings are
   equal as well, they are shared whole, and no text need be looked at.
2. Only different surroundings of one anchor remain. Each anchor is a shard: its distinct surroundings are put into a
   suffix automaton, one text after the other, and each is streamed through it first for its matching statistics; maximal
   matches of at least `least` are shared spans, on both sides. Anchors with more than SHARD different surroundings are not
   held by one task: their runs are compared by hash, spread over all tasks.
3. The quotes, a fixed table, are texts like the others; spans are merged per text, and equal texts are told apart again.

The automata are held by the tasks to which their shard is routed, not broadcast: together they would be as large as
the shared part of the corpus.

without_shared() removes the spans: every code point of a text that stands in a span which a text of a lesser id also
holds. The text of the least id loses nothing, so one copy of every span is kept.

Defined cases: null texts and texts shorter than `least` share nothing; a text that repeats itself shares nothing with
itself; records of equal text share it whole; repeated rows of a key count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalex.llm.common import batches_by_chars, code_points, cut

LEAST = 64
GRAM = 24
SHARD = 512
BROADCAST_ROWS = 1_000_000

_B = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k code points from each position on, by doubling."""
    have, size = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D), 1
    out, done = None, 0
    rest = k
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, done = have, size
                else:
                    n = len(points) - done - size + 1
                    out = have[:n] * np.uint64(pow(_B, done, 1 << 64)) + out[size : size + n]
                    done += size
            rest >>= 1
            if rest:
                n = len(have) - size
                have = have[:n] * np.uint64(pow(_B, size, 1 << 64)) + have[size : size + n]
                size *= 2
    return out


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w values."""
    have, size = x, 1
    while size * 2 <= w:
        have = f(have[:-size], have[size:])
        size *= 2
    return f(have[: len(x) - w + 1], have[w - size : w - size + len(x) - w + 1]) if size < w else have


def anchors(texts: list[str], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash, hash of the surroundings, packed reach) of the anchors of texts of at least `least`.

    The surroundings of an anchor at p are the code points from p - before to p + after, where before and after reach as
    far as runs of `least` that contain the anchor do inside the text; the reach packs both numbers.
    """
    window = least - gram + 1
    points, offsets = code_points(texts, gap=1)
    h = _mix(gram_hashes(points, gram))
    n = len(points)
    start_of = np.repeat(offsets[:-1], np.diff(offsets))
    end_of = np.repeat(offsets[1:] - 1, np.diff(offsets))
    if n < least:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    least_in = _slide(h, window, np.minimum)
    at = np.arange(len(least_in))
    least_in = np.where(at + least <= end_of[: len(least_in)], least_in, np.uint64(0))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least_in, np.zeros(window - 1, np.uint64)])
    top = _slide(padded, window, np.maximum)[: len(h)]
    p = np.flatnonzero((h == top) & (top > 0))
    before = np.minimum(p - start_of[p], least - gram)
    after = np.minimum(end_of[p] - p, least)
    # hash of the surroundings: two parts of at most `least`, each from grams of powers of two
    left = _span_hash(points, p - before, before)
    right = _span_hash(points, p, after)
    reach = before * 1024 + after
    around = _mix(left * np.uint64(3) + right * np.uint64(0xC2B2AE3D27D4EB4F) + reach.astype(np.uint64))
    return np.searchsorted(offsets, p, side="right") - 1, p - start_of[p], h[p].view(np.int64), around.view(np.int64), reach


def _span_hash(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Polynomial hash of points[start : start + length] for many spans at once, by the binary digits of the length."""
    out = np.zeros(len(start), np.uint64)
    at, rest = start.copy(), length.copy()
    have, size = points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D), 1
    with np.errstate(over="ignore"):
        while True:
            use = (rest & 1).astype(bool)
            if use.any():
                out[use] = out[use] * np.uint64(pow(_B, size, 1 << 64)) + have[at[use]]
                at[use] += size
            rest >>= 1
            if not rest.any():
                return out
            n = len(have) - size
            have = have[:n] * np.uint64(pow(_B, size, 1 << 64)) + have[size : size + n]
            size *= 2


class SuffixAutomaton:
    """A generalized suffix automaton: add() puts in a text, match() gives the maximal matches of another."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [(-1, -1)]  # (text, end) of one occurrence of the strings of a state

    def add(self, text: str, owner: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for i, ch in enumerate(text):
            q = nxt[last].get(ch)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                link.append(link[q])
                length.append(length[last] + 1)
                first.append(first[q])
                link[q] = clone
                p = last
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = clone
                    p = link[p]
                last = clone
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append((owner, i))
            link.append(0)
            p = last
            while p >= 0 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][ch]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
            last = cur

    def match(self, text: str, least: int) -> list[tuple[int, int, int, int]]:
        """(start, end, owner, owner's end) of the maximal matches of at least `least`."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out: list[tuple[int, int, int, int]] = []
        v = l = 0  # noqa: E741
        for i, ch in enumerate(text):
            n = nxt[v].get(ch)
            if n is None:
                if l >= least:
                    out.append((i - l, i, first[v][0], first[v][1] + 1))
                while v > 0 and ch not in nxt[v]:
                    v = link[v]
                    l = length[v]  # noqa: E741
                n = nxt[v].get(ch)
                if n is None:
                    v = l = 0  # noqa: E741
                    continue
            v = n
            l += 1  # noqa: E741
        if l >= least:
            out.append((len(text) - l, len(text), first[v][0], first[v][1] + 1))
        return out


def shard_matches(rows: list[tuple[tuple[int, int], int, str]], least: int = LEAST) -> Iterator[tuple[int, int, int, bool]]:
    """(text id, from, to, whether a text of a lesser id has it) of what the surroundings in one shard share across texts.

    rows: ((text id, number), offset of the surroundings in the text, surroundings); different numbers make different
    texts of one id. Texts are streamed in the order of their ids; the surroundings of one text join the automaton only
    after all of them went through it.
    """
    if len(rows) < 2:
        return
    sam, held = SuffixAutomaton(), []
    rows = sorted(rows)
    i = 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        for (tid, _), at, s in rows[i:j]:
            for a, b, owner, end in sam.match(s, least):
                (tid2, _), at2, _ = held[owner]
                yield tid, at + a, at + b, tid2 < tid
                yield tid2, at2 + end - (b - a), at2 + end, False
        if j < len(rows):
            for r in rows[i:j]:
                sam.add(r[2], len(held))
                held.append(r)
        i = j


def spans(texts: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(tid, a, b, later): spans of the texts (tid, t) that stand in another text, overlapping ones not merged.

    later: a text of a lesser id has the span as well.
    """
    if not gram < least <= 1000:
        raise ValueError("spans of more than the gram and at most 1000 code points can be found")
    schema = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("tid", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, kept = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i not in seen and len(t) >= least:
                    ids.append(i)
                    kept.append(t)
                seen.add(i)
            for a, b in batches_by_chars(kept):
                text, pos, h, s, reach = anchors(kept[a:b], least, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(s), pa.array(np.array(ids[a:b], np.int64)[text]), pa.array((pos << 20) | reach)], schema=schema
                )

    found = texts.mapInArrow(run, "h long, s long, tid long, at long")
    # anchors of more than one text: counted with partial sums, then the anchors are read again with that at hand
    several = found.groupBy("h").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).filter("lo <> hi").select("h")
    pos, before, after = F.shiftright("at", 20), F.shiftright("at", 10).bitwiseAND(F.lit(1023)), F.col("at").bitwiseAND(F.lit(1023))
    seen = cut(found.join(_small(several), "h", "left_semi").select("h", "s", "tid", (pos - before).cast("int").alias("a"), (pos + after).cast("int").alias("b")))
    classes = cut(seen.groupBy("h", "s").agg(F.min(F.struct("tid", "a", "b")).alias("one"), F.max("tid").alias("hi")).select("h", "s", "one.*", (F.col("one.tid") != F.col("hi")).alias("equal")))
    whole = seen.join(_small(classes.filter("equal").select("h", "s", F.col("tid").alias("first"))), ["h", "s"]).select("tid", "a", "b", (F.col("tid") != F.col("first")).alias("later"))
    # one text stands for equal surroundings; it counts as a text of its own, since others have them as well
    sizes = classes.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    apart = cut(classes.join(_small(sizes), "h").select("h", "tid", "equal", "a", "b", "n"))
    few = texts.join(_small(apart.select("tid").distinct()), "tid", "left_semi").groupBy("tid").agg(F.min("t").alias("t"))
    cutouts = apart.join(few, "tid").select("h", "n", "tid", "equal", "a", F.substring("t", F.col("a") + 1, F.col("b") - F.col("a")).alias("x"))
    cutouts = cut(cutouts)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[int, int], int, str]] = []
        last = None

        def made(rows: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["tid", "a", "b", "later"])

        def close() -> list[tuple[int, int, int, bool]]:
            out = list(shard_matches(held, least))
            held.clear()
            return out

        for batch in batches:
            out: list[tuple[int, int, int, bool]] = []
            for h, t, equal, a, x in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last:
                    out.extend(close())
                    last = h
                held.append(((t, len(held) + 1 if equal else 0), a, x))
            yield made(out)
        yield made(close())

    shards = cutouts.filter(F.col("n") <= SHARD).select("h", "tid", "equal", "a", "x")
    matched = shards.repartition("h").sortWithinPartitions("h").mapInArrow(go, "tid long, a int, b int, later boolean")
    return whole.unionByName(matched).unionByName(_hot_runs(cutouts.filter(F.col("n") > SHARD), least))


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed side, broadcast if its counted rows allow it; else the join shuffles, and AQE splits skewed keys."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hot_runs(cutouts: DataFrame, least: int) -> DataFrame:
    """(tid, a, b, later) of the runs that the surroundings of an anchor with very many of them share.

    Each run of `least` around the anchor is a row with its hash; runs of several texts are found by partial sums, so
    neither an automaton nor a group of rows grows with the anchor. At most least - GRAM + 1 runs hold an anchor.
    """
    runs = cutouts.filter(F.length("x") >= least).select(
        "h", F.when(F.col("equal"), F.struct(F.col("tid"), F.col("a"))).otherwise(F.struct(F.col("tid"), F.lit(-1).alias("a"))).alias("who"), "tid", "a", "x",
        F.explode(F.sequence(F.lit(0), F.length("x") - least)).alias("i"),
    )
    keyed = runs.select("h", F.xxhash64(F.substring("x", F.col("i") + 1, F.lit(least))).alias("run"), "who", "tid", (F.col("a") + F.col("i")).alias("a"))
    shared = keyed.groupBy("h", "run").agg(F.min("who").alias("lo"), F.max("who").alias("hi")).filter("lo <> hi").select("h", "run", "lo")
    later = (F.col("tid") != F.col("lo.tid")).alias("later")
    return keyed.join(shared, ["h", "run"]).select("tid", "a", (F.col("a") + least).cast("int").alias("b"), later)


def islands(found: DataFrame) -> DataFrame:
    """(tid, a, b): the union of the spans of each text, by SQL windows."""
    order = Window.partitionBy("tid").orderBy("a", F.desc("b"))
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    s = found.select("tid", "a", "b").distinct().withColumn("reach", reach).withColumn("new", F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), 1).otherwise(0))
    s = s.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("tid", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("tid", "a", "b")


def merged(found: DataFrame) -> DataFrame:
    """(tid, shared_chars, longest_span, n_spans) of the spans of each text."""
    one = islands(found).select("tid", (F.col("b") - F.col("a")).alias("size"))
    return one.groupBy("tid").agg(F.sum("size").alias("shared_chars"), F.max("size").alias("longest_span"), F.count("*").alias("n_spans"))


def _texts(df: DataFrame, key: str, text: str, quotes: DataFrame | None, quote: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(k, t, tid) of the rows, and (tid, t) of them and the quotes."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("tid")).filter(F.length("t") >= least)
    if quotes is None:
        return rows, rows.select("tid", "t")
    # a quote has an id of its own, also where a record has the same text
    q = quotes.select(F.xxhash64(F.lit("quote"), F.col(quote)).alias("tid"), F.col(quote).alias("t")).filter(F.length("t") >= least).distinct()
    return rows, rows.select("tid", "t").unionByName(q)


def without_shared(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """(key, n_chars, removed_chars, cleaned) of every row that loses something: its text without the spans of which
    another text keeps the copy, the rest joined by line feeds; of equal texts the row of the least key keeps it whole.

    Rows that are not listed stay as they are.
    """
    rows, texts = _texts(df, key, text, None, "", least)
    held = islands(spans(texts, least).filter("later")).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("holes"))
    first = rows.groupBy("tid").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    lost = first.join(held, "tid", "left").filter("holes is not null or first <> last")
    each = rows.join(_small(lost), "tid").groupBy("k", "tid").agg(F.min("t").alias("t"), F.first("first").alias("first"), F.first("holes").alias("holes"))
    n = F.size("holes")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("holes", i)["b"])
    stop = lambda i: F.when(i == n, F.length("t")).otherwise(F.element_at("holes", i + 1)["a"])
    piece = lambda i: F.col("t").substr(start(i) + 1, stop(i) - start(i))
    kept = F.array_join(F.array_remove(F.transform(F.sequence(F.lit(0), n), piece), ""), "\n")
    removed = F.aggregate("holes", F.lit(0), lambda s, h: s + h["b"] - h["a"])
    copy = F.col("k") != F.col("first")
    out = each.select("k", F.length("t").alias("n_chars"), F.when(copy, F.length("t")).otherwise(removed).alias("removed_chars"), F.when(copy, F.lit("")).otherwise(kept).alias("cleaned"))
    return out.filter("removed_chars > 0").select(F.col("k").alias(key), "n_chars", "removed_chars", "cleaned")


def shared_text(df: DataFrame, key: str, text: str, quotes: DataFrame, quote: str, least: int = LEAST) -> DataFrame:
    """(key, n_chars, shared_chars, longest_span, shared_part) of every row whose text shares a span."""
    rows, texts = _texts(df, key, text, quotes, quote, least)
    part = merged(spans(texts, least))
    keys = rows.select("k", "tid", F.length("t").alias("n_chars")).distinct()
    copies = keys.groupBy("tid").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).filter("lo <> hi").select("tid", F.lit(True).alias("copied"))
    out = keys.join(part, "tid", "left").join(copies, "tid", "left").filter("copied or shared_chars is not null")
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("shared_chars"))
    longest = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("longest_span"))
    return out.select(F.col("k").alias(key), "n_chars", shared.alias("shared_chars"), longest.alias("longest_span"), (shared / F.col("n_chars")).alias("shared_part"))
