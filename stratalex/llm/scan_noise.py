"""Repair of text from scanned pages: running heads, page numbers, divided words and misread characters.

Two passes over the texts and small tables between them:

1. Counts over all rows: words, contexts of Han characters that have a look-alike, and lines with their digits masked.
   Each task sums its own counts before anything is shuffled. Masked lines are counted over distinct texts, so that
   copies of a text and repeated rows say nothing about its heads.
2. Lexicon, in SQL over the counts: words are grouped by their confusable-glyph skeleton; in each group the frequent form
   is the reading of rare ones. A Han character is misread where its look-alike is many times as frequent
   beside the same neighbours. Lines that stand masked and alone in different surroundings of one source are heads,
   as are the titles that the rows themselves name.
3. Marks: each text is read again with the lexicon at hand, and every noisy line is marked and repaired.
4. Reflow, with SQL windows over the marked lines: noise lines fall out, divided words are closed, lines become
   paragraphs at blank lines.

The lexicon is bounded: its rows are counted first, and beyond LEXICON_ROWS the marking runs once for each part of it.
Each part finds the misreadings that its own words and contexts show; the changes of all parts are put together for each
line before the line is repaired.

Defined cases: null, empty and blank texts have no lines; a record without line feeds has one line; repeated rows of a
key count once; a word without a frequent form of the same skeleton is left as it is.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalex.llm.common import arrow_map, cut

#: Han characters that scanners take for one another, by groups.
HAN_GROUPS = (
    "产户 本木 史吏 动勋 社杜 币巾 农衣 制刷 品晶 价介 业亚 论沦 货贷 劳芳 度庋 理埋 半羊 己已巳 未末 土士 日曰 人入八 大太犬 千干于 天夭 "
    "戊戌戍 候侯 拔拨 折拆析 今令 午牛 由甲申 贝见 免兔 乌鸟 晴睛 微徽 历厉 自白 住往佳 若苦 刀力 王玉 间问 风凤 西酉 特待 料科 环坏 壮状 民氏 "
    "部郡 卖买 名各 代伐 哀衷 密蜜 辨辩 籍藉 杨扬 治冶 洒酒 侍待 诧 延廷 技枝 抱 撤撒 汩汨 沉沈 淮准 清请 刺剌 幻幼 竟竞 逐遂 赢羸 崇祟 "
    "炙灸 肓盲 商 生主 目且 权杈 资贫 会合 方万 工I 因困 国囯 关夫 在仕 地他 级极 约纳 设没 该刻 活话 供洪 银根 铁 运达 进近 收牧 政玫"
)
#: Readings of Latin and Cyrillic letters by scanners: the first is printed, the second is read.
LETTERS = (
    ("m", "rn"), ("d", "cl"), ("u", "ii"), ("w", "vv"), ("e", "c"), ("t", "f"), ("h", "b"), ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("н", "п"),
    ("и", "н"), ("ш", "щ"), ("п", "л"), ("з", "3"), ("о", "0"), ("б", "6"), ("g", "9"), ("b", "6"), ("z", "2"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "1"), ("l", "I"),
)
#: A frequent form must be so many times as frequent as a rare one, and have so many occurrences.
RATIO, SUPPORT = 20, 5
#: The natural logarithm of the odds beyond which a Han character is misread.
ODDS = 4.0
#: A masked line is a head if it stands after so many different lines of one source, and mostly after different ones:
#: a line of text that was copied follows the same line each time. Equal texts count once; where a line opens a text,
#: nothing stands before it, and this does not speak against it.
HEAD_TIMES, HEAD_PART = 3, 0.7
LEXICON_ROWS = 2_000_000

_BREAK = "-‐¬­"
_WORD = re.compile(r"[^\W\d_]+")
_ALPHA = re.compile("[A-Za-zÀ-ɏЀ-ӿ]+")
_DEHYPHEN = re.compile(f"(?<=[^\\W\\d_])[{_BREAK}] *\n(?=[^\\W\\d_])")
_HAN = re.compile("[㐀-鿿]")
_MIXED = re.compile("(?<![\\w])(?=[\\w]*[A-Za-zÀ-ɏЀ-ӿ])(?=[\\w]*\\d)[A-Za-zÀ-ɏЀ-ӿ0-9]+(?![A-Za-zÀ-ɏЀ-ӿ0-9])")
_YEAR = re.compile(r"(?<![A-Za-z0-9А-яЁё])(?=[0-9]*[A-Za-zА-я])[1lI|][0-9lIOoBSZzQОоЗз]{3}(?![A-Za-z0-9А-яЁё])")
_YEAR_DIGITS = str.maketrans("lI|OoBSZzQОоЗз", "11100852200033")
_NUMBER = re.compile(
    r"^[\s\-–—―~·•\[\](){}【】〔〕|*]*(?:第\s*)?(?:\d(?:\s*[\dlOoI]){0,3}|[ivxlc]{1,7}|[IVXLC]{1,7})\s*(?:[页頁])?[\s\-–—―~·•\[\](){}【】〔〕|*]*$"
)
_PIECE = re.compile(r"^(?:[\-–—―·•\[\]【】〔〕|]{1,2}|第|[页頁])$")
#: A page number at an edge of a head; after a plain blank or a dash it must not run on into another number.
_EDGE_NUMBER = re.compile(r"^(?:\d{1,4}|[ivxlc]{1,7})(?:\s*[·•　|]\s*|[\s\-–—]+(?=\D))|(?:\s*[·•　|]\s*|(?<=\D)[\s\-–—]+)(?:\d{1,4}|[ivxlc]{1,7})$")
_HANGING = frozenset("und oder sowie bis noch bzw and or et ou и или у y e".split())
_FOLD_HAN = {ord(c): g[0] for g in HAN_GROUPS.split() for c in g[1:] if len(g) > 1}


def han_alternatives() -> dict[str, str]:
    """character -> the others of its groups."""
    out: dict[str, str] = {}
    for g in HAN_GROUPS.split():
        for c in g:
            if len(g) > 1 and "㐀" <= c <= "鿿":
                out[c] = "".join(dict.fromkeys(out.get(c, "") + "".join(x for x in g if x != c and "㐀" <= x <= "鿿")))
    return out


def skeleton(word: str) -> str:
    """A word with all readings that scanners confuse folded into one."""
    w = word.replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w")
    return w.translate(_SKELETON)


#: Letter -> representative of the letters that it is confused with.
_SKELETON = str.maketrans(
    {"c": "e", "f": "t", "b": "h", "п": "н", "и": "н", "л": "н", "щ": "ш", "0": "o", "1": "l", "i": "l", "I": "l", "5": "s", "S": "s", "3": "з", "6": "h", "2": "z", "8": "B", "9": "g"}
)


def readings(word: str) -> Iterator[str]:
    """The words that one misreading turns into this one."""
    for right, read in LETTERS:
        i = word.find(read)
        while i >= 0:
            yield word[:i] + right + word[i + len(read) :]
            i = word.find(read, i + 1)


def _narrow(line: str) -> str:
    """NFKC but for the wide blank, which divides the parts of a head."""
    return "　".join(unicodedata.normalize("NFKC", x) for x in line.split("　")).strip()


def head_key(line: str) -> str:
    """A line as a head: page number at an edge off, blanks off, digits masked, look-alikes folded; '' if too short."""
    s = _EDGE_NUMBER.sub("", _narrow(line))
    s = "".join(ch for ch in s if not ch.isspace() and unicodedata.category(ch) != "Cf")
    s = skeleton(re.sub(r"\d", "9", s.translate(_FOLD_HAN)))
    return s if sum(ch.isalpha() for ch in s) >= 2 else ""


def is_page_number(line: str) -> bool:
    s = unicodedata.normalize("NFKC", line).strip()
    return bool(s) and (bool(_NUMBER.match(s)) or bool(_PIECE.match(s)))


def _codes(points: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, packed context) of the characters with a look-alike that have two neighbours."""
    at = np.flatnonzero(special[np.minimum(points[1:-1], 0xFFFF)]) + 1
    p = points.astype(np.int64)
    return at, (p[at - 1] << 42) | (p[at] << 21) | p[at + 1]


def _special() -> np.ndarray:
    flags = np.zeros(0x10000, bool)
    flags[[ord(c) for c in han_alternatives()]] = True
    return flags


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _head_lines(lines: list[str]) -> Iterator[tuple[str, int]]:
    """(key, hash of the line of text before) of the lines that could be heads by their own look."""
    last = ""
    for x in lines:
        s = x.strip()
        if not s:
            continue
        before, last = last, last if is_page_number(s) else s
        if 2 <= len(s) <= 48 and s[-1] not in "。！？!?，,；;：:、”“»」.-‐¬­" and not is_page_number(s):
            k = head_key(s)
            if len(k) >= 3:
                yield k, _hash(before)


def count(rows: DataFrame) -> DataFrame:
    """Counts of words (kind 0), Han contexts (1) and masked lines (2): (kind, word, source, code, n, before, doc).

    doc: hash of the text in which a masked line stands.

    rows: (k, source, t, scanned)
    """
    target = pa.schema([("kind", pa.int32()), ("word", pa.string()), ("source", pa.string()), ("code", pa.int64()), ("n", pa.int64()), ("before", pa.int64()), ("doc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        lines: Counter[tuple[str | None, int, int, int]] = Counter()
        contexts: list[tuple[np.ndarray, np.ndarray]] = []
        special = _special()

        def flush() -> Iterator[pa.RecordBatch]:
            if contexts:
                codes, inverse = np.unique(np.concatenate([c for c, _ in contexts]), return_inverse=True)
                n = np.bincount(inverse, weights=np.concatenate([n for _, n in contexts]), minlength=len(codes)).astype(np.int64)
            else:
                codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            w, l, c = len(words), len(lines), len(codes)
            none = lambda m: [None] * m
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([0, 1, 2], np.int32), [w, c, l])),
                    pa.array([*words, *none(c + l)], pa.string()),
                    pa.array([*none(w + c), *(x[0] for x in lines)], pa.string()),
                    pa.array([*none(w), *codes.tolist(), *(x[1] for x in lines)], pa.int64()),
                    pa.array([*words.values(), *n.tolist(), *lines.values()], pa.int64()),
                    pa.array([*none(w + c), *(x[2] for x in lines)], pa.int64()),
                    pa.array([*none(w + c), *(x[3] for x in lines)], pa.int64()),
                ],
                schema=target,
            )
            words.clear()
            lines.clear()
            contexts.clear()

        for batch in batches:
            texts, sources, scanned = (batch.column(i).to_pylist() for i in (2, 1, 3))
            flat = []
            for t, s, scan in zip(texts, sources, scanned):
                if scan and "\n" in t:
                    doc = _hash(t)
                    lines.update((s, _hash(k), h, doc) for k, h in _head_lines(t.split("\n")))
                    t = _DEHYPHEN.sub("", t)
                flat.append(t)
            joined = "\n\n".join(flat)
            words.update(_ALPHA.findall(joined))
            at, codes = _codes(_points(joined.replace("\n", "")), special)
            contexts.append(np.unique(codes, return_counts=True))
            if len(words) + len(lines) > 500_000 or sum(len(c) for c, _ in contexts) > 4_000_000:
                yield from flush()
        yield from flush()

    raw = rows.mapInArrow(run, "kind int, word string, source string, code long, n long, before long, doc long")
    return raw.groupBy("kind", "word", "source", "code", "before", "doc").agg(F.sum("n").alias("n"))


def word_lexicon(counts: DataFrame) -> DataFrame:
    """(word, right): rare words whose skeleton has one frequent form that a single misreading turns into them."""
    target = "word string, right string, n long"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple[str, str, int]] = []
            for w, k in zip(words, n):
                out.extend((w, r, k) for r in dict.fromkeys(readings(w)) if r != w and skeleton(r) == skeleton(w))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], names=["word", "right", "n"])

    words = counts.filter("kind = 0").select("word", "n").filter(F.length("word") >= 3)
    rare = words.mapInArrow(pairs, target)
    form = words.select(F.col("word").alias("right"), F.col("n").alias("m"))
    ok = rare.join(form, "right").filter((F.col("m") >= SUPPORT) & (F.col("m") >= RATIO * F.col("n")))
    return ok.groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def han_lexicon(counts: DataFrame) -> DataFrame:
    """(code, right): contexts in which a Han character is a misreading of a look-alike."""
    ctx = counts.filter("kind = 1").select("code", "n")
    mask = (1 << 21) - 1
    c = ctx.select(
        "code", "n", F.shiftright("code", 42).alias("p"), F.shiftright("code", 21).bitwiseAND(F.lit(mask)).alias("c"), F.col("code").bitwiseAND(F.lit(mask)).alias("x")
    )
    left = c.groupBy("p", "c").agg(F.sum("n").alias("l"))
    right = c.groupBy("c", "x").agg(F.sum("n").alias("r"))
    alt = han_alternatives()
    table = F.create_map(*[v for k, a in alt.items() for v in (F.lit(ord(k)).cast("long"), F.array(*[F.lit(ord(x)).cast("long") for x in a]))])
    t = (
        c.join(left, ["p", "c"])
        .join(right, ["c", "x"])
        .withColumn("d", F.explode(table[F.col("c")]))
        .join(left.select("p", F.col("c").alias("d"), F.col("l").alias("l2")), ["p", "d"], "left")
        .join(right.select(F.col("c").alias("d"), "x", F.col("r").alias("r2")), ["d", "x"], "left")
    )
    odds = F.log((F.coalesce("l2", F.lit(0)) + 0.5) / (F.col("l") + 0.5)) + F.log((F.coalesce("r2", F.lit(0)) + 0.5) / (F.col("r") + 0.5))
    return t.withColumn("odds", odds).filter(F.col("odds") > ODDS).groupBy("code").agg(F.max_by("d", F.struct("odds", "d")).alias("right"))


def line_heads(counts: DataFrame) -> DataFrame:
    """(source, code): masked lines that stand after different lines in the distinct texts of a source."""
    lines = counts.filter("kind = 2").groupBy("source", "code", "before").agg(F.count("*").alias("texts"))
    after = F.col("before") != F.lit(_hash(""))
    often = lines.groupBy("source", "code").agg(F.count("*").alias("places"), F.count_if(after).alias("different"), F.sum(F.when(after, F.col("texts"))).alias("n"))
    return often.filter((F.col("places") >= HEAD_TIMES) & (F.col("different") >= HEAD_PART * F.col("n"))).select("source", "code")


def title_heads(rows: DataFrame, titles: list[str]) -> DataFrame:
    """(source, title) that the rows themselves name; distinct before they leave the JVM."""
    every = F.explode(F.array(*[F.col(c).cast("string") for c in titles]))
    return rows.select("source", every.alias("title")).filter(F.length("title") >= 4).distinct()


#: (order, offset in the line, misread, repaired); the offset is negative where a word begins on the line before.
Change = tuple[int, int, str, str]


def part_of(word: str, parts: int) -> int:
    """The part of the lexicon that decides on a word, as SQL computes it from crc32."""
    return zlib.crc32(word.encode()) % parts


def repaired(line: str, changes: list[Change]) -> str:
    """A line after its changes, in their order."""
    for _, start, w, right in changes:
        end = start + len(w)
        if start >= 0 and line[start:end] == w and len(right) == len(w):
            line = line[:start] + right + line[end:]
        elif start >= 0 and w in line:
            line = line.replace(w, right, 1)
    return line


class Reader:
    """The lexicon in the form in which texts are read with it."""

    def __init__(self, words: dict[str, str], codes: np.ndarray, rights: np.ndarray, heads: dict[str | None, tuple[set[int], set[str], set[str]]], part: int = 0, parts: int = 1):
        self.words, self.heads, self.part, self.parts = words, heads, part, parts
        order = np.argsort(codes)
        self.codes, self.rights = codes[order], rights[order]
        self.special = _special()

    def is_head(self, source: str | None, line: str) -> bool:
        """Whether a line is a known head, a title or the beginning of one, or several of these side by side."""
        k = head_key(line)
        if len(k) < 2:
            return False
        hashes, titles, starts = self.heads.get(source, ((), (), ()))
        if (len(k) >= 3 and _hash(k) in hashes) or k in titles or (len(k) >= 7 and k in starts):
            return True
        parts = [head_key(x) for x in _EDGE_NUMBER.sub("", _narrow(line)).split("　")]
        return len(parts) > 1 and parts[0] in titles and all(not x or x in titles or x in starts for x in parts[1:])

    def read(self, source: str | None, text: str) -> tuple[list[str], list[set[str]], list[list[Change]], bool]:
        """(lines, kinds of noise of each, changes of each, whether lines are joined by a blank)."""
        lines = text.split("\n")
        kinds: list[set[str]] = [set() for _ in lines]
        if len(lines) > 1:
            for i, x in enumerate(lines):
                if not x or x.isspace():
                    continue
                if len(x) <= 24 and is_page_number(x):
                    kinds[i].add("page_number")
                elif len(x) <= 120 and self.is_head(source, x):
                    kinds[i].add("running_head")
        body = [i for i, x in enumerate(lines) if not kinds[i] and x and not x.isspace()]
        spaced = 4 * len(_HAN.findall(text)) < len(text) and not re.search("[぀-ヿ฀-๿]", text)
        edits: list[list[Change]] = [[] for _ in lines]
        # the text that flows through the lines, and the line and column of each of its characters
        flow: list[str] = []
        spans: list[tuple[int, int]] = []  # (line, offset in the flow)
        size = 0
        for a, i in enumerate(body):
            x = lines[i]
            nxt = lines[body[a + 1]].lstrip() if a + 1 < len(body) else ""
            bare = x.rstrip()
            divided = False
            if bare and bare[-1] in _BREAK and len(bare) > 1 and bare[-2].isalpha() and nxt and nxt[0].islower() and body[a + 1] - i < 6:
                word = _WORD.match(nxt)
                if bare[-1] != "-" or not (word and word.group().lower() in _HANGING):
                    divided = True
                    kinds[i].add("hyphen_break")
            spans.append((i, size))
            if divided:
                part = bare[:-1]
            elif spaced:
                part = x + " "
            else:
                part = x
            flow.append(part)
            size += len(part)
        joined = "".join(flow)
        offsets = [o for _, o in spans]
        changes: list[tuple[int, int, str, int]] = []  # (from, to, repaired, order) in the flow
        if self.words or _MIXED.search(joined):
            for m in _ALPHA.finditer(joined):
                right = self.words.get(m.group())
                if right is not None:
                    changes.append((m.start(), m.end(), right, 0))
            for m in _MIXED.finditer(joined):
                w = m.group()
                letters = sum(ch.isalpha() for ch in w)
                if letters >= 2 and letters > len(w) - letters and re.search("[A-Za-zÀ-ɏЀ-ӿ][0-9]|[0-9][a-zß-ÿа-я]", w) and not re.fullmatch(r"\d+(?:st|nd|rd|th|er|e|ème|го|й|х)", w):
                    r = w
                    for _ in range(4):
                        hit = next((y for y in readings(r) if sum(c.isdigit() for c in y) < sum(c.isdigit() for c in r)), None)
                        if hit is None:
                            break
                        r = hit
                    if part_of(r, self.parts) == self.part:
                        changes.append((m.start(), m.end(), self.words.get(r, r), 1))
            for m in _YEAR.finditer(joined) if self.part == 0 else ():
                if sum(ch.isdigit() for ch in m.group()) >= 2:
                    changes.append((m.start(), m.end(), m.group().translate(_YEAR_DIGITS), 2))
        if len(self.codes) and len(joined) > 2 and _HAN.search(joined):
            at, codes = _codes(_points(joined), self.special)
            if len(at):
                k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
                hit = self.codes[k] == codes
                for p, r in zip(at[hit].tolist(), self.rights[k[hit]].tolist()):
                    changes.append((p, p + 1, chr(r), 3))
        if changes:
            import bisect

            for a, b, right, order in changes:
                w = joined[a:b]
                d = next((i for i in range(min(len(w), len(right))) if w[i] != right[i]), 0)
                j = bisect.bisect_right(offsets, a + d) - 1
                line = spans[j][0]
                kinds[line].add("misread")
                edits[line].append((order, a - offsets[j], w, right))
        return lines, kinds, edits, spaced


def marked(
    df: DataFrame, key: str, text: str, source: str, titles: list[str], scanned: str | None = None, lines: bool = False, lexicon_rows: int = LEXICON_ROWS
) -> DataFrame:
    """The noise in the lines of scanned texts.

    lines=False: (key, line_no, noise_kind), one row for each kind of noise in a line. lines=True: all lines, (key,
    line_no, line, repaired, noise, spaced). titles: columns that name what may stand as a head. scanned: a boolean
    column; rows where it is false are counted but not marked.
    """
    kind = dict(df.dtypes)[key]
    scan = F.col(scanned) if scanned else F.lit(True)
    rows = df.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t"), scan.alias("scanned")).filter(F.length(F.trim("t")) > 0)
    counts = cut(count(rows))
    words, codes = cut(word_lexicon(counts)), cut(han_lexicon(counts))
    often = line_heads(counts)
    named = title_heads(df.select(F.col(source).alias("source"), *titles), titles)
    heads = cut(often.select("source", "code", F.lit(None).cast("string").alias("title")).unionByName(named.select("source", F.lit(None).cast("long").alias("code"), "title")))
    parts = max(1, -(-max(words.count(), codes.count()) // lexicon_rows))
    head_parts = max(1, -(-heads.count() // lexicon_rows))
    sc = df.sparkSession.sparkContext
    results = []
    for part, head_part in [(p, q) for p in range(parts) for q in range(head_parts)]:
        mine = lambda d, c, of, i: d if of == 1 else d.filter(F.pmod(F.xxhash64(c), F.lit(of)) == i)
        w = {r["word"]: r["right"] for r in (words if parts == 1 else words.filter(F.crc32("word") % parts == part)).toLocalIterator()}
        c = [(r["code"], r["right"]) for r in mine(codes, "code", parts, part).toLocalIterator()]
        h: dict[str | None, tuple[set[int], set[str], set[str]]] = {}
        # the rows of a source need its own heads only, and these whole: they decide which lines are text at all
        for r in mine(heads, "source", head_parts, head_part).toLocalIterator():
            hashes, exact, starts = h.setdefault(r["source"], (set(), set(), set()))
            if r["code"] is not None:
                hashes.add(r["code"])
            else:
                k = head_key(r["title"])
                if len(k) >= 3:
                    exact.add(k)
                    starts.update(k[:n] for n in range(3, len(k)))
        sent = sc.broadcast((w, np.array([x for x, _ in c], np.int64), np.array([y for _, y in c], np.int64), h, part, parts))
        held: dict[str, Reader] = {}
        if lines:
            schema = f"`{key}` {kind}, line_no int, line string, {'changes ' + _CHANGES if parts > 1 else 'repaired string'}, noise array<string>, spaced boolean"
        else:
            schema = f"`{key}` {kind}, line_no int, noise_kind string"

        def run(batch: dict[str, list], sent=sent, held=held):
            if "r" not in held:
                held["r"] = Reader(*sent.value)
            reader = held["r"]
            names = (key, "line_no", "line", "changes" if parts > 1 else "repaired", "noise", "spaced") if lines else (key, "line_no", "noise_kind")
            out: dict[str, list] = {n: [] for n in names}
            for k, s, t in zip(batch["k"], batch["source"], batch["t"]):
                all_lines, noise, edits, spaced = reader.read(s, t)
                for i, found in enumerate(noise):
                    if lines:
                        change = [dict(zip(("ord", "start", "wrong", "right"), x)) for x in edits[i]] if parts > 1 else repaired(all_lines[i], edits[i])
                        for n, v in zip(names, (k, i + 1, all_lines[i], change, sorted(found), spaced)):
                            out[n].append(v)
                    else:
                        for x in found:
                            out[key].append(k)
                            out["line_no"].append(i + 1)
                            out["noise_kind"].append(x)
            yield out

        results.append(arrow_map(mine(rows.filter("scanned"), "source", head_parts, head_part).select("k", "source", "t"), run, schema))
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return merged(found, key, kind) if lines and parts > 1 else found


_CHANGES = "array<struct<ord: int, start: int, wrong: string, right: string>>"


def merged(found: DataFrame, key: str, kind: str) -> DataFrame:
    """Each line once, repaired by the changes that all parts of the lexicon found in it."""
    each = found.groupBy(key, "line_no", "line", "spaced").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("changes")))).alias("changes"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("noise")))).alias("noise")
    )

    def run(batch: dict[str, list]):
        fixed = [repaired(x, [(c["ord"], c["start"], c["wrong"], c["right"]) for c in cs]) for x, cs in zip(batch["line"], batch["changes"])]
        yield {**batch, "repaired": fixed}

    return arrow_map(each, run, f"`{key}` {kind}, line_no int, line string, repaired string, noise array<string>, spaced boolean")


def paragraphs(marked_lines: DataFrame, key: str) -> DataFrame:
    """(key, paragraph_no, paragraph): the lines of marked(..., lines=True) as continuous paragraphs."""
    one = marked_lines.dropDuplicates([key, "line_no"])
    in_text = Window.partitionBy(key).orderBy("line_no")
    noise = F.array_contains("noise", "running_head") | F.array_contains("noise", "page_number")
    kept = one.filter(~noise)
    blank = F.length(F.trim("line")) == 0
    numbered = kept.withColumn("paragraph_no", F.sum(F.when(blank, 1).otherwise(0)).over(in_text)).filter(~blank)
    divided = F.array_contains("noise", "hyphen_break")
    piece = F.when(divided, F.regexp_replace("repaired", f"[{_BREAK}]\\s*$", "")).when(F.col("spaced"), F.concat(F.rtrim("repaired"), F.lit(" "))).otherwise(F.col("repaired"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))), lambda x: x["piece"]), "")
    return numbered.groupBy(key, "paragraph_no").agg(F.trim(joined).alias("paragraph"))
