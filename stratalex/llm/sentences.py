"""Sentence boundaries in any language or script by semi-Markov dynamic programming.

A text is divided at blank lines; in each part, every run of closing marks is a possible end. The dynamic program chooses
the sequence of whole spans of highest score. A span is scored jointly by

- its closing: the kind of mark, and for a single point the word before it. Words are classed by counts over all rows
  (Words): how often a word stands before a point, how often such a point ends a part, how often a small letter follows.
  A naive Bayes model of four classes (ordinary word, abbreviation that never ends, abbreviation before small letters,
  abbreviation that may end) gives the weight. The lists below are its prior and decide only where counts are few;
- its opening: what follows the end (capital, digit, numeral of a list, quotation mark, small letter, continuing particle)
  and, where the closing leaves it open, whether the word opens sentences more often than it stands inside them;
- its length: a log-normal prior per kind of script, its mean and deviation taken from all rows; a span that is nothing
  but a numeral is worth less than nothing, so a numeral that opens a sentence stays with it;
- its quotations: an end inside a matched pair of quotation marks or brackets would leave two spans unbalanced and is
  no candidate; one at the closing sign counts only if the enclosing sentence does not go on.

Texts of an unspaced script without any sentence mark are divided at their blanks.

A span looks back to the last certain end, but over no more than REACH code points and LOOK_BACK candidates, so time is
in proportion to the text; a longer span is formed only where no candidate stands inside. Texts are handled on their own
in Arrow batches: no shuffle but for the counts and the repeats of a key. Words are kept that hold at least SHARE of all
points (or openings), so at most 1 / SHARE of each are broadcast, whatever the corpus.

Defined cases: null and blank texts have no sentence; a text without any end is one sentence; offsets are code points of
the stored text, after the last character, closing signs included and following blanks excluded; invisible signs never
make or hide an end; an empty table has no counts, and the prior alone decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import arrow_map, cut
from stratalex.llm.lookalikes import CYRILLIC, CYRILLIC_AS, GREEK, GREEK_AS

#: Words are compared by the shape of their letters, so that a look-alike letter hides no abbreviation.
_SHAPE = str.maketrans((CYRILLIC + GREEK).lower() + CYRILLIC + GREEK, (CYRILLIC_AS + GREEK_AS).lower() + CYRILLIC_AS + GREEK_AS)

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿‪-‮]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {c: 0x20 for c in (0xA0, 0x1680, 0x202F, 0x205F, 0x3000, 0x09, 0x0D, *range(0x2000, 0x200B))}
_WIDE_SIGN = re.compile("[" + "".join(map(chr, _WIDE)) + "]")


def _narrow(text: str) -> str:
    """Wide signs and blanks in their ordinary form; length and offsets stay."""
    return _WIDE_SIGN.sub(lambda m: chr(_WIDE[ord(m.group())]), text)


_PAIRS = {"“": "”", "„": "“”", "‘": "’", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "〔": "〕", "‹": "›"}
_CLOSERS = set("”’»」』)]】》〉〕›")
_ROUND = set("([【〔")
_EVENT = re.compile(r'[“”„‘’«»「」『』()\[\]【】《》〈〉〔〕‹›"]|[.!?。।॥｡…‽]+')
_MARKS = set(".!?。।॥｡…‽")
_STRONG = re.compile(r"[!?。।॥｡‽]")
_PART = re.compile(r"\n(?: *\n)+")
_TOKEN = re.compile(r"[^\W_]+(?:[-’'][^\W_]+)*$")
_NUMERAL = re.compile(r"^[(\[]?(?:\d{1,3}|[IVXLC]{1,5}|[a-zA-Z])[.)]?$")
_UNSPACED = re.compile("[฀-໿က-႟ក-៿々぀-ヿ㐀-鿿豈-﫿]")
_LETTER = re.compile(r"[^\W\d_]")

#: Prior: abbreviations whose points end no sentence (about 100 words of six languages).
NEVER = frozenset(
    w.translate(_SHAPE)
    for w in "mr mrs ms dr prof st hr hrn fr frl mme mlle mm messrs rev gen col capt sgt jr hon vol vols p pp cf vgl bd bde nr no nos fig figs ch chap "
    "s t z d v u i e art tab taf kap abb abt hrsg ca bzw sog geb gest ed eds op cit ibid ders dies al v viz vs approx "
    "см стр гл рис табл им напр т с ср тов гос акад проф св ул пр м mgr sr sra dott".split()
)
#: Prior: abbreviations whose points end a sentence if what follows opens one.
MAYBE = frozenset(w.translate(_SHAPE) for w in "etc usw ff f cent env д п др г гг в вв руб коп тыс млн млрд h p.m a.m inc ltd co corp u.s sq jan feb mar apr jun jul aug sept oct nov dec".split())
#: Words after an ordinal point.
ORDINAL_NEXT = frozenset(
    "januar februar märz april mai juni juli august september oktober november dezember jänner jahrhundert jahrhunderts jh jahrtausend kapitel "
    "band auflage teil abschnitt jahrgang heft klasse tag woche monat mal".split()
)
#: Prior: words that open sentences.
OPENERS = frozenset(
    w.translate(_SHAPE) for w in "the a an it he she we they this that these those in but and der die das es er sie wir dies in le la les il elle ils ce cette un une он она оно они это эта в на но".split()
)
#: A word is kept if it stands at so large a part of all points or openings.
SHARE = 1e-5
#: Code points and candidates over which a span looks back.
REACH, LOOK_BACK = 2000, 48
#: Counts of a word beyond which more of the same proves no more.
ENOUGH = 60
#: Mean and deviation of the logarithm of the length of a sentence, before any count: (spaced, unspaced script).
LENGTHS = ((4.3, 0.9), (3.4, 0.9))
LENGTH_WEIGHT = 0.5

#: Particles with which the enclosing sentence goes on after a quotation.
_GOES_ON = re.compile("^(?:的|と|という|って|との|に|を|は|が|も|で|な|之|这[一种个句样]|那[一种个句]|一[词语句说文]|等|及|和|与|或|地|得|是|也|都|就)")


def _candidates(p: str, words: Words) -> list[tuple[int, float]]:
    """(end, score) of the possible ends in one part of a text (already cleaned)."""
    events = [(m.start(), m.end(), m.group()) for m in _EVENT.finditer(p)]
    matched: dict[int, int] = {}
    stack: list[int] = []
    for s, _, g in events:
        if g[0] in _MARKS:
            continue
        if g == '"':
            if stack and p[stack[-1]] == '"':
                matched[stack.pop()] = s
            else:
                stack.append(s)
            continue
        k = len(stack) - 1
        if g in _CLOSERS or g == "“":
            low = max(-1, k - 64)
            while k > low and not (p[stack[k]] in _PAIRS and g in _PAIRS[p[stack[k]]]):
                k -= 1
            if k > low and (g != "“" or k == len(stack) - 1):
                matched[stack[k]] = s
                del stack[k:]
                continue
        if g in _PAIRS:
            stack.append(s)
    closes = {b: a for a, b in matched.items()}

    out: list[tuple[int, float]] = []
    depth: list[int] = []
    n, i, last_end = len(p), 0, 0
    while i < len(events):
        s, e, g = events[i]
        i += 1
        if g[0] not in _MARKS:
            if s in matched:
                depth.append(s)
            elif s in closes and depth:
                while depth and depth[-1] >= closes[s]:
                    depth.pop()
            continue
        # take in the closing signs and further marks that follow at once
        opened, marks, end = (depth[0] if depth else -1), g, e
        while True:
            q = end
            if p[q : q + 1] == " " and p[q + 1 : q + 2] in ("»", "›") and q + 1 in closes:
                q += 1
            ch = p[q : q + 1]
            if ch and (q in closes or (ch in _CLOSERS and q not in matched)):
                if q in closes:
                    while depth and depth[-1] >= closes[q]:
                        depth.pop()
                end = q + 1
            elif ch and ch in _MARKS and end > e:
                k = q
                while k < n and p[k] in _MARKS:
                    k += 1
                marks += p[q:k]
                end = k
            else:
                break
        while i < len(events) and events[i][0] < end:
            i += 1
        if depth:
            continue
        score = _score(p, s, marks, end, opened, last_end, words)
        if score > -6:
            out.append((end, score))
            if score > 0:
                last_end = end
    return out


def _score(p: str, s: int, marks: str, end: int, opened: int, last_end: int, words: Words) -> float:
    """How well a span may close at `end`: its mark starts at s; opened: where the quotation or bracket it closes began."""
    n = len(p)
    k = end
    while k < n and p[k] in " \n":
        k += 1
    if k >= n:
        return 9.0
    nxt, gap = p[k], k > end
    strong = bool(_STRONG.search(marks))
    if not strong and (len(marks) > 1 or marks == "…"):
        return -9.0  # an ellipsis alone
    if nxt in ",，、;；:：)）]】—–-" and not (nxt in "—–-" and gap):
        return -9.0
    han = bool(_UNSPACED.match(nxt))
    if opened >= 0:
        k0 = opened - 1
        while k0 >= 0 and p[k0].isspace():
            k0 -= 1
        at_start = k0 < last_end
        before = p[k0] if k0 >= 0 else ""
        if p[opened] in _ROUND:
            if not at_start:
                return -9.0
        elif nxt.islower():
            return -9.0
        elif han and not gap:
            if _GOES_ON.match(p[k : k + 3]):
                return -8.0
            if not at_start and before not in ":：道曰说,，":
                return -7.0
        elif not at_start and before not in ":：,，" and not nxt.isupper() and not nxt.isdigit() and nxt not in _PAIRS:
            return -7.0
    if nxt.islower():
        return -9.0
    if strong:
        return 8.0 if gap or han or nxt in _PAIRS or not (nxt.isalnum()) or _UNSPACED.match(p[s - 1 : s] or " ") else -7.0
    # a single point
    if not gap and nxt.isalnum() and not han:
        return -9.0
    acronym = _ACRONYM.search(p, max(0, s - 16), s)
    m = _TOKEN.search(p, max(0, s - 40), s)
    word = m.group() if m else ""
    if not word:
        return 4.0 if opened >= 0 or s != end - 1 or not gap else 2.0
    if word.isdigit():
        if not gap and han:
            return -9.0
        follow = re.match(r"[^\W\d_]+", p[k : k + 24])
        if follow and follow.group().lower() in ORDINAL_NEXT:
            return -9.0
        return 3.0
    after = _OPENING.match(p, k)
    begin = words.opening(after.group() if after else nxt)
    if acronym and opened < 0:
        low = acronym.group().lower().translate(_SHAPE)
        return -9.0 if low in _NEVER_ACRONYM else 1.0 + begin if begin > 0 else -7.0
    if len(word) == 1 and word.isupper():
        return -9.0 if opened < 0 else 1.0
    if not gap and han and opened < 0 and words.closing(word) > 0:
        return -3.0
    if opened >= 0:
        return max(1.0, words.closing(word))
    closing = words.closing(word)
    if closing <= -6.0:
        return -9.0
    return closing + (min(begin, 0.0) if closing > 4.0 else max(-2.5, min(2.5, begin)))


_ACRONYM = re.compile(r"(?<![^\W_])(?:[^\W\d_]\.){1,5}[^\W\d_]$")
_NEVER_ACRONYM = frozenset("i.e e.g z.b d.h u.a z.t v.h т.е т.н н.э".translate(_SHAPE).split())
_OPENING = re.compile(r"\d+[.)]|\d+|[^\W\d_]+")
#: Classes of words before a point: (value as a closing, part of final points, part of points before small letters).
_CLASSES = ((6.0, None, 0.002), (-9.0, 0.002, 0.002), (-9.0, 0.002, 0.5), (3.0, 0.5, 0.3))


class Words:
    """The weights of closings, openings and lengths, from a prior and from counts over all rows."""

    def __init__(self, points: dict[str, tuple[int, int, int]] | None = None, openings: dict[str, tuple[int, int]] | None = None, lengths=LENGTHS, final: float = 0.25):
        self.points, self.openings, self.lengths, self.final = points or {}, openings or {}, lengths, min(0.9, max(0.02, final))
        self._closing: dict[str, float] = {}
        self._opening: dict[str, float] = {}

    def closing(self, word: str) -> float:
        """How well a point after a word ends a sentence: from 6 (ordinary word) to -9 (abbreviation)."""
        w = word.lower().translate(_SHAPE)
        v = self._closing.get(w)
        if v is None:
            v = self._closing[w] = self._class_value(w)
        return v

    def _class_value(self, w: str) -> float:
        if w in MAYBE:
            prior = (0.02, 0.01, 0.01, 0.96)
        elif w in NEVER:
            prior = (0.001, 0.5, 0.498, 0.001)
        elif len(w) <= 4:
            prior = (0.98, 0.0001, 0.01, 0.01)
        else:
            prior = (0.9989, 1e-9, 0.001, 0.0001)
        n, last, small = self.points.get(w, (0, 0, 0))
        part = min(1.0, ENOUGH / n) if n else 0.0
        logs = []
        for p, (_, f, s) in zip(prior, _CLASSES):
            f = self.final if f is None else self.final * 0.5 if f == 0.5 else f
            logs.append(math.log(p) + part * (last * math.log(f) + small * math.log(s) + (n - last - small) * math.log(max(0.01, 1 - f - s))))
        top = max(logs)
        odds = [math.exp(x - top) for x in logs]
        return sum(o * c[0] for o, c in zip(odds, _CLASSES)) / sum(odds)

    def opening(self, word: str) -> float:
        """How well a word opens a sentence after a point that leaves it open: positive where it does so often."""
        if word[:1].isdigit():
            return 0.0 if word[-1] in ".)" else -5.0
        w = word.lower().translate(_SHAPE)
        v = self._opening.get(w)
        if v is None:
            at_start, inside = self.openings.get(w, (0, 0))
            a, b = (4.0, 0.4) if w in OPENERS else (1.0, 1.0)
            v = self._opening[w] = math.log((at_start + a) / (inside + b))
        return v

    def span(self, text: str, start: int, end: int) -> float:
        """The score of a span by its length."""
        n = end - start
        if n < 12:
            t = text[start:end].strip()
            if _NUMERAL.match(t):
                return -12.0
            if len(t) < 3 and not _UNSPACED.search(t):
                return -4.0
        mean, deviation = self.lengths[1 if _UNSPACED.match(text, end - 2) or _UNSPACED.match(text, start) else 0]
        z = (math.log(max(1, n)) - mean) / deviation
        return -LENGTH_WEIGHT * min(8.0, 0.5 * z * z)


PRIOR = Words()


def _choose(p: str, cand: list[tuple[int, float]], words: Words) -> list[int]:
    """The ends of the best sequence of spans; the last candidate is the end of the part and always taken."""
    ends = [0, *(e for e, _ in cand)]
    best, back, most = [0.0], [0], [0.0]  # most: the greatest of best up to here; spans score 0 at most
    floor = 0  # no span begins before the last certain end
    for j in range(1, len(ends)):
        e, c = cand[j - 1]
        top, arg = -math.inf, j - 1
        for i in range(j - 1, max(floor, j - LOOK_BACK) - 1, -1):
            if i < j - 1 and (most[i] <= top or e - ends[i] > REACH):
                break
            v = best[i] + words.span(p, ends[i], e)
            if v > top:
                top, arg = v, i
        best.append(top + c)
        back.append(arg)
        most.append(max(most[-1], top + c))
        if c >= 8 and e - ends[j - 1] > 6:
            floor = j
    path, j = [], len(ends) - 1
    while j > 0:
        path.append(ends[j])
        j = back[j]
    return path[::-1]


_POINT = re.compile(r"(?<![^\W_])([^\W_]+(?:[-’'][^\W_]+)*)\.(?![.\w])(?=([”’»\"')\]]*)[ \n]*(\S?))")
_START = re.compile(r"(?:^|[!?]\s+|\n *\n *)([^\W\d_]+)")
_INSIDE = re.compile(r"(?<=[^\W\d_,] )([A-ZÀ-ÞΑ-ΩЀ-Я][^\W\d_]*)")
_CERTAIN = re.compile(r"[!?。！？]+[”’»」』）)]*\s*|\n *\n *|(?<=\w\w\w\w)\.[”’»\"')\]]*\s+(?=[A-ZÀ-ÞЀ-Я„“«])")


def counted(texts: list[str]) -> Counter[tuple[str, str, str]]:
    """(kind, word, case) -> n: points after words, openings, capital words inside, and squared lengths by script."""
    out: Counter[tuple[str, str, str]] = Counter()
    for raw in texts:
        t = _INVISIBLE.sub("", raw)
        if "." in t or "．" in t:
            t = _narrow(t)
            for m in _POINT.finditer(t):
                nxt = m.group(3)
                case = "final" if not nxt else "small" if nxt.islower() or nxt in ",;:" else "other"
                word = m.group(1)
                if len(word) <= 20 and not word.isdigit():
                    out["point", word, case] += 1
            out.update(("opening", w, "start") for w in _START.findall(t) if len(w) <= 20)
            out.update(("opening", w, "inside") for w in _INSIDE.findall(t) if len(w) <= 20)
        a = 0
        for m in _CERTAIN.finditer(t):
            n = m.start() - a
            if n > 1:
                out["length", "1" if _UNSPACED.match(t, m.start() - 1) else "0", str(round(4 * math.log(n)))] += 1
            a = m.end()
    return out


def corpus_words(rows: DataFrame, text: str) -> Words:
    """The weights from all texts: counts are summed in the tasks, then by (kind, word, case); a bounded part is collected."""
    schema = pa.schema([("kind", pa.string()), ("word", pa.string()), ("case", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, str]] = Counter()

        def flush() -> pa.RecordBatch:
            keys = [(kind, word.lower().translate(_SHAPE), case) for kind, word, case in seen]
            made = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array(list(seen.values()), pa.int64())], schema=schema)
            seen.clear()
            return made

        for batch in batches:
            seen.update(counted(batch.column(0).to_pylist()))
            if len(seen) > 500_000:
                yield flush()
        yield flush()

    source = rows.select(F.col(text).alias("t")).filter(F.length(F.trim("t")) > 0)
    counts = cut(source.mapInArrow(run, "kind string, word string, case string, n long").groupBy("kind", "word", "case").agg(F.sum("n").alias("n")))
    total = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    each = counts.groupBy("kind", "word").agg(
        *[F.sum(F.when(F.col("case") == c, F.col("n")).otherwise(0)).alias(c) for c in ("final", "small", "start", "inside")], F.sum("n").alias("n")
    )
    least = F.when(F.col("kind") == "point", SHARE * total.get("point", 0)).otherwise(SHARE * total.get("opening", 0))
    points: dict[str, tuple[int, int, int]] = {}
    openings: dict[str, tuple[int, int]] = {}
    # at most 1 / SHARE words of each kind can hold SHARE of all
    for r in each.filter((F.col("kind") != "length") & (F.col("n") >= least)).collect():
        if r["kind"] == "point":
            points[r["word"]] = (r["n"], r["final"], r["small"])
        else:
            openings[r["word"]] = (r["start"], r["inside"])
    moments = counts.filter("kind = 'length'").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("case").cast("double") / 4).alias("s"), F.sum(F.col("n") * F.pow(F.col("case").cast("double") / 4, 2)).alias("q")
    )
    lengths = list(LENGTHS)
    for r in moments.collect():
        i, weight = int(r["word"]), 100.0  # the prior counts as so many sentences
        m0, d0 = LENGTHS[i]
        n = r["n"] + weight
        mean = (r["s"] + weight * m0) / n
        spread = (r["q"] + weight * (d0 * d0 + m0 * m0)) / n - mean * mean
        lengths[i] = (mean, max(0.5, math.sqrt(max(0.0, spread))))
    last = sum(r["n"] for r in counts.filter("kind = 'point' and case = 'final'").groupBy().agg(F.sum("n").alias("n")).collect() if r["n"])
    return Words(points, openings, tuple(lengths), (last + 25) / (total.get("point", 0) + 100))


def sentence_ends(text: str, words: Words = PRIOR) -> list[int]:
    """The offsets after the last character of each sentence of a text."""
    if _INVISIBLE.search(text):
        keep = [i for i, ch in enumerate(text) if not _INVISIBLE.match(ch)]
        clean = "".join([text[i] for i in keep])
    else:
        keep, clean = None, text
    clean = _narrow(clean)
    ends: list[int] = []
    parts: list[tuple[int, int]] = []
    a = 0
    for m in _PART.finditer(clean):
        parts.append((a, m.start()))
        a = m.end()
    parts.append((a, len(clean)))
    marked = False
    for a, b in parts:
        while b > a and clean[b - 1] in " \n":
            b -= 1
        while a < b and clean[a] in " \n":
            a += 1
        if a >= b:
            continue
        p = clean[a:b]
        cand = _candidates(p, words)
        marked = marked or bool(cand)
        if not cand or cand[-1][0] != len(p):
            cand.append((len(p), 9.0))
        ends.extend(a + e for e in _choose(p, cand, words))
    if not marked and len(ends) and " " in clean and not _STRONG.search(clean):
        letters = len(_LETTER.findall(clean))
        if letters and 2 * len(_UNSPACED.findall(clean)) > letters:
            more = [m.start() for m in re.finditer(r"(?<=\S) +(?=\S)", clean) if _UNSPACED.match(clean[m.start() - 1]) and _UNSPACED.match(clean[m.end()])]
            ends = sorted({*ends, *more})
    if keep is not None:
        return [keep[e - 1] + 1 for e in ends]
    return ends


def sentences(df: DataFrame, key: str, text: str, words: Words | None = None) -> DataFrame:
    """One row per sentence: (key, sentence_no, start_pos, end_pos, sentence).

    words: the weights; by default they are counted over all rows of df first.
    """
    kind = dict(df.dtypes)[key]
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    sent = df.sparkSession.sparkContext.broadcast(corpus_words(df, text) if words is None else words)

    def run(c: dict[str, list]):
        model = sent.value
        out: dict[str, list] = {n: [] for n in (key, "sentence_no", "start_pos", "end_pos", "sentence")}
        ks, nos, starts, stops, texts = out.values()
        for k, t in zip(c["k"], c["t"]):
            a = 0
            for i, e in enumerate(sentence_ends(t, model)):
                while a < e and t[a].isspace():
                    a += 1
                ks.append(k)
                nos.append(i)
                starts.append(a)
                stops.append(e)
                texts.append(t[a:e])
                a = e
        yield out

    return arrow_map(source, run, f"`{key}` {kind}, sentence_no int, start_pos int, end_pos int, sentence string")
