"""Splitting oversized texts at natural boundaries with an overlap.

Agglomerative merging: a text is cut into atomic segments at every natural boundary; all adjacent pairs stand in a
heap by the strength of the boundary between them, and the weakest boundary is merged first while the joined
segment and the overlap fit the limit (the first piece has no overlap before it). What is left between segments are the
strongest boundaries. Of equally strong boundaries the first in the text is merged first, so that pieces are filled one
after the other and a text with one kind of boundary only wastes no room.

Only texts beyond their limit leave the JVM, and each is handled on its own, so the work is in proportion to the
oversized text and needs no shuffle but for the repeats of a key.

Defined cases: a null or unknown unit has no limit; null, empty and short texts give no piece; a text without any
natural boundary is cut at whole code points, before no combining sign where that can be helped; rows equal in id, text
and unit give their pieces once, and different texts under one id each give theirs, told apart by text_hash; the overlap is exact and may therefore begin with a combining sign; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import arrow_map

#: Code points that a piece of a unit may have.
LIMITS = {"semantic_child": 320, "paragraph_child": 320, "paragraph": 800, "semantic_parent": 1200, "milvus_passage": 2000}
OVERLAP = 64

#: A boundary lies after the match; group number = strength, the strongest last.
_BOUNDARY = re.compile(
    r"(?P<b1>[ \t　 ]+)"
    r"|(?P<b2>[，、,:：—–]+[”’»\"』」）)]*[ \t　]*)"
    r"|(?P<b3>[；;]+[”’»\"』」）)]*[ \t　]*)"
    r"|(?P<b4>(?:[。！？!?｡।…]+|\.(?=[\s”“’»\"』」）)]|$))[”“’»\"』」）)]*[ \t　]*)"
    r"|(?P<b5>\r?\n)"
    r"|(?P<b6>(?:\r?\n[ \t　]*){2,})"
)
_STRENGTH = {f"b{i}": i for i in range(1, 7)}
_BREAKS = re.compile(r"(?:\r?\n[ \t　]*){2,}")


def boundaries(text: str) -> list[tuple[int, int]]:
    """(position, strength) of the natural boundaries inside a text, in order; the larger strength wins a position."""
    found: dict[int, int] = {}
    for m in _BOUNDARY.finditer(text):
        found[m.end()] = max(found.get(m.end(), 0), _STRENGTH[m.lastgroup])
    for m in _BREAKS.finditer(text):
        found[m.end()] = 6
    found.pop(0, None)
    found.pop(len(text), None)
    return sorted(found.items())


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Starts and the end of the cores of the pieces; a core and the overlap before it fit the limit."""
    room = limit - overlap
    if room < 1:
        raise ValueError("the overlap must be smaller than the limit")
    cuts, strength = [0], []
    for at, s in [*boundaries(text), (len(text), 0)]:
        while at - cuts[-1] > (room if cuts[-1] else limit):  # no natural boundary within reach
            p = cuts[-1] + (room if cuts[-1] else limit)
            q = p
            while q > p - 16 and q > cuts[-1] + 1 and (unicodedata.combining(text[q]) or text[q] in "\u200d\ufe0f"):
                q -= 1
            cuts.append(q if q > cuts[-1] else p)
            strength.append(0.5)
        cuts.append(at)
        strength.append(s)
    strength.pop()
    n = len(cuts) - 1
    start, end = cuts[:-1], cuts[1:]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive, version = [True] * n, [0] * n
    heap = [(strength[i], i, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, i, vi, vj = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or version[i] != vi or version[j] != vj:
            continue
        if end[j] - start[i] > (room if i else limit):
            continue  # sizes only grow: this boundary stays
        end[i] = end[j]
        alive[j] = False
        right[i] = right[j]
        version[i] += 1
        if right[i] < n:
            left[right[i]] = i
            strength[i] = strength[j]
            heapq.heappush(heap, (strength[i], i, version[i], version[right[i]]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (strength[k], k, version[k], version[i]))
    return [start[i] for i in range(n) if alive[i]] + [len(text)]


def pieces(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces; each but the first begins `overlap` code points before the end of the last one."""
    if len(text) <= limit:
        return [(0, len(text))]
    cuts = cut_points(text, limit, overlap)
    return [(max(0, a - overlap), b) for a, b in zip(cuts, cuts[1:])]


def limit_of(unit: Column, limits: dict[str, int]) -> Column:
    """The limit of a unit, its name compared without letter case and outer blanks; null where there is none."""
    name = F.lower(F.regexp_replace(unit, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    pairs = [x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[name]


def split_oversized(
    df: DataFrame, key: str, text: str, unit: str, limits: dict[str, int] = LIMITS, overlap: int = OVERLAP
) -> DataFrame:
    """The pieces of every oversized text: (key, text_hash, piece_no, piece_count, piece_start, piece_end, piece_text).

    text_hash (xxhash64) tells different texts under one key apart.
    """
    kind = dict(df.dtypes)[key]
    long = (
        df.select(F.col(key).alias("k"), F.col(text).alias("t"), limit_of(F.col(unit), limits).alias("m"))
        .filter(F.length("t") > F.col("m"))
        .groupBy("k", "m", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g"))
        .agg(F.min("t").alias("t"))
    )

    def run(c: dict[str, list]):
        out = {n: [] for n in (key, "text_hash", "piece_no", "piece_count", "piece_start", "piece_end", "piece_text")}
        for k, h, t, m in zip(c["k"], c["h"], c["t"], c["m"]):
            spans = pieces(t, m, overlap)
            for i, (a, b) in enumerate(spans):
                for n, v in zip(out, (k, h, i, len(spans), a, b, t[a:b])):
                    out[n].append(v)
        yield out

    return arrow_map(
        long, run, f"`{key}` {kind}, text_hash long, piece_no int, piece_count int, piece_start int, piece_end int, piece_text string"
    )
