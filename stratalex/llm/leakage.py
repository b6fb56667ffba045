"""Evaluation texts inside training text: Wu-Manber search for many patterns at once.

Two texts leak if, after NFKC, lower case and dropping all but letters and digits, a quote and a document share a run of
at least `run` characters. Every run of that length in a quote covers a whole block of `run // 2` characters from the
blocks that begin at multiples of `run // 2 + 1`; these blocks are the patterns. The shift table over the last BLOCK
characters skips positions where no pattern can end, a suffix bucket chooses the few patterns left, and direct
comparison confirms one. A confirmed block is extended to both sides in the quote and in the document, so a result is
exact: no run is missed and none is invented.

The documents stream through map tasks, unsplit and unshuffled; only the patterns are broadcast. Their size is
checked: beyond MAX_PATTERNS they are handled in several groups of bounded size, one pass each. The rows found, a few
numbers for each leak, are merged by (document, item) in any case, so that their number does not depend on the groups.

Only letters and digits (categories L and N) are compared, as the problem defines it: vowel signs of Indic scripts and
Thai (category M) fall out on both sides.

Defined cases: null texts, quotes and citation lists match nothing; quotes shorter than `run` cannot leak; rows of one
document key are one document and give one row with the longest run found in any of them; an item with several quotes
gives one row with its longest run.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import arrow_map

RUN = 40
BLOCK = 4
MAX_PATTERNS = 500_000
#: Quotes of a held-out set that may be collected to the driver.
MAX_ITEM_QUOTES = 1_000_000
_DROP = regex.compile(r"[^\p{L}\p{N}]+")


def normalized(text: str) -> str:
    """NFKC, then lower case, then letters and digits only."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower())


class WuManber:
    """The tables of a set of equally long patterns; find() gives (pattern, position) of each occurrence."""

    def __init__(self, patterns: list[str], block: int = BLOCK):
        m = len(patterns[0])
        self.m, self.block, self.most = m, block, m - block + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[str, list[str]]] = {}
        for p in patterns:
            for i in range(block, m + 1):
                b, s = p[i - block : i], m - i
                if s < self.shift.get(b, self.most):
                    self.shift[b] = s
            by_prefix = self.bucket.setdefault(p[m - block :], defaultdict(list))
            by_prefix[p[:2]].append(p)

    def find(self, text: str):
        m, block, most, get, bucket = self.m, self.block, self.most, self.shift.get, self.bucket
        pos, n = m, len(text)
        while pos <= n:
            b = text[pos - block : pos]
            s = get(b, most)
            if s:
                pos += s
                continue
            start = pos - m
            for p in bucket[b].get(text[start : start + 2], ()):
                if text.startswith(p, start):
                    yield p, start
            pos += 1


class Quotes:
    """The quotes of the items as patterns, with what is needed to extend an occurrence to the whole shared run."""

    def __init__(self, rows: list[tuple[int, str]], run: int = RUN):
        self.run, self.size = run, run // 2
        self.quotes = [(item, q) for item, q in rows if len(q) >= run]
        self.at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, q) in enumerate(self.quotes):
            for s in range(0, len(q) - self.size + 1, self.size + 1):
                self.at[q[s : s + self.size]].append((k, s))
        self.search = WuManber(list(self.at)) if self.at else None

    def leaks(self, text: str) -> dict[int, tuple[int, int]]:
        """item -> (longest shared run, length of the quote it is in), for runs of at least `run`."""
        best: dict[int, tuple[int, int]] = {}
        if self.search is None or len(text) < self.run:
            return best
        seen: dict[tuple[int, int], int] = {}  # (quote, offset between the two) -> end of the run already measured
        for p, start in self.search.find(text):
            for k, s in self.at[p]:
                item, q = self.quotes[k]
                if seen.get((k, start - s), -1) > start:
                    continue
                a, b = s, s + self.size
                i, j = start, start + self.size
                while a and i and q[a - 1] == text[i - 1]:
                    a, i = a - 1, i - 1
                while b < len(q) and j < len(text) and q[b] == text[j]:
                    b, j = b + 1, j + 1
                seen[(k, start - s)] = j
                if b - a >= self.run and (item not in best or best[item] < (b - a, len(q))):
                    best[item] = (b - a, len(q))
        return best


def leaked(
    docs: DataFrame, key: str, text: str, items: list[tuple[int, str]], run: int = RUN, max_patterns: int = MAX_PATTERNS
) -> DataFrame:
    """(key, item_id, shared_run, quote_length, whole) for each document and each item of which it holds a run.

    items: (item id, quote) pairs. They come from a fixed held-out set; groups of them with at most max_patterns
    patterns each are searched for one after the other, so that no task holds more.
    """
    clean = sorted({(i, n) for i, q in items if i is not None and q for n in [normalized(q)] if len(n) >= run})
    groups, size = [[]], 0
    for i, q in clean:
        n = len(q) // (run // 2 + 1) + 1
        if size + n > max_patterns and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append((i, q))
        size += n
    kind = dict(docs.dtypes)[key]
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") >= run // 4)
    found = None
    for group in groups:
        sent = docs.sparkSession.sparkContext.broadcast(group)

        def go(c: dict[str, list], sent=sent, run=run, held={}):  # noqa: B006
            if "q" not in held:
                held["q"] = Quotes(sent.value, run)
            quotes = held["q"]
            out: dict[str, list] = {n: [] for n in (key, "item_id", "shared_run", "quote_length", "whole")}
            for k, t in zip(c["k"], c["t"]):
                for item, (got, whole) in quotes.leaks(normalized(t)).items():
                    for n, v in zip(out, (k, item, got, whole, got == whole)):
                        out[n].append(v)
            yield out

        rows = arrow_map(source, go, f"`{key}` {kind}, item_id int, shared_run int, quote_length int, whole boolean")
        found = rows if found is None else found.unionByName(rows)
    best = F.max_by("quote_length", F.struct("shared_run", "quote_length"))
    return found.groupBy(key, "item_id").agg(F.max("shared_run").alias("shared_run"), best.alias("quote_length"), F.max("whole").alias("whole"))


def item_quotes(items: DataFrame, most: int = MAX_ITEM_QUOTES) -> list[tuple[int, str]]:
    """(item_id, quote) of a held-out set. It is counted first: a set of more than `most` quotes is refused, since the
    search holds its patterns on the driver and in each task."""
    rows = items.select("item_id", F.explode("expected_citations").alias("c")).select("item_id", "c.quote").filter(F.length("quote") > 0).distinct()
    n = rows.count()
    if n > most:
        raise ValueError(f"{n} quotes; call leaked() for parts of at most {most}")
    return [(r["item_id"], r["quote"]) for r in rows.collect()]
