"""Texts that look the same although their characters differ, brought to one consistent form.

A value is mapped by the shapes of its signs: wide, narrow and radical forms to the ordinary ones, every kind of blank to
a space, letters of other alphabets with the same shape to one letter, Roman numeral signs, ligatures and letters of
mathematical fonts to plain letters, invisible signs to nothing. The mapped values are grouped under the accent-sensitive
Unicode collation, which also makes composed and combined accents equal, and one member of each class is the canonical
form, joined back to the values.

Grouping whole texts under a collation is costly, so it is done only where it can matter: a first pass hashes a coarser
form and keeps the hashes under which at least two different values stand. The coarser form maps every sign to the first
shape of its canonical decomposition and drops all marks, the vowels and finals of Hangul and all signs that the collation
ignores, so values equal under the collation are equal in the coarser form, in every script; a test goes through all
code points. That aggregation moves two numbers per distinct text and merges copies before the shuffle. From there on
values are known by two 64-bit hashes: classes are joined to the rows by numbers, and texts move once, to their class.

Covered of the look-alikes that Unicode knows: width, canonical composition, spaces, format and control signs, variation
selectors, Latin, Cyrillic and Greek letters of one shape, dashes, dots, bars and apostrophes, Kangxi radicals and
compatibility ideographs, Katakana like ideographs, Roman numeral signs, Latin ligatures and digraphs, mathematical
alphanumerics, Hangul compatibility letters, the Latin alpha and script g. Not covered, since they differ to the eye:
circled and bracketed signs, superscripts, fractions, squared units, long s; nor the contextual Arabic forms.

Defined cases: null values belong to no class; equal values are one member; values that differ in case, wording,
punctuation, accents or in the number of visible blanks stay apart; ties for the canonical form go to the least value.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import arrow_map, cut

#: Letters that have the shape of a Latin letter, and that letter, in the same order.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеоѕіјрсухԁһӏԛԝѵ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaeosijpcyxdhlqwv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικϳ"
GREEK_AS = "ABEZHIKMNOPTYXovikj"
#: Signs that have the shape of another sign, and that sign.
SIGNS = "‐‑−⁃―∶‚⁄∕∣‧∙⋅・•᛫〜˗ʼʹ"
SIGNS_AS = "--–-—:,//|······~-'′"
#: Katakana that have the shape of an ideograph, and that ideograph.
KANA = "カニエロタトハヘミ"
KANA_AS = "力二工口夕卜八へ三"

#: Letters of phonetic alphabets with the shape of a Latin letter.
PHONETIC = "ɑɡ"
PHONETIC_AS = "ag"

#: Rows of numbers up to which a side is sent to all executors (some 40 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def _code_points():
    """Every code point that may stand in a text, but for the private and the unassigned ones."""
    yield from range(0x80, 0xD800)
    yield from range(0xF900, 0x20000)
    yield from range(0x2F800, 0x2FA20)
    yield from range(0xE0000, 0xE01F0)


def _letters(text: str) -> bool:
    return all(unicodedata.category(x)[0] in "LM" for x in text)


@cache
def shapes() -> dict[str, str]:
    """Sign -> its shape, one or several signs or none, for signs that have no canonical decomposition."""
    plain: dict[str, str] = {}
    for cp in _code_points():
        ch = chr(cp)
        kind = unicodedata.category(ch)
        d = unicodedata.decomposition(ch)
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp:
            plain[ch] = ""
        elif kind == "Zs":
            plain[ch] = " "
        elif d.startswith("<"):
            to = unicodedata.normalize("NFKC", ch)
            one = d.startswith(("<wide>", "<narrow>", "<font>")) or 0x2E80 <= cp <= 0x2FD5 or 0x3131 <= cp <= 0x318E
            # Roman numerals, ligatures and digraphs
            many = d.startswith("<compat>") and (kind == "Nl" or (kind[0] == "L" and len(to) > 1 and cp < 0xFB50 and ch != "ẚ")) and _letters(to)
            if (one and len(to) == 1) or many:
                plain[ch] = to
    plain["\t"] = " "
    plain.update(zip(CYRILLIC + GREEK + SIGNS + KANA + PHONETIC, CYRILLIC_AS + GREEK_AS + SIGNS_AS + KANA_AS + PHONETIC_AS))
    return {ch: "".join(plain.get(x, x) for x in unicodedata.normalize("NFD", to)) for ch, to in plain.items()}


def shape(text: str) -> str:
    """A text with every sign in its shape, composed."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_table()))


@cache
def _table() -> dict[int, str]:
    return {ord(a): b for a, b in shapes().items()}


def _jamo(ch: str) -> bool:
    """A vowel or final of Hangul, which stands in a syllable with its first letter."""
    return "\u1160" <= ch <= "\u11ff" or "\ud7b0" <= ch <= "\ud7ff"


@cache
def coarse_map() -> tuple[str, str]:
    """(from, to): the coarse form for translate(); signs beyond the length of `to` are dropped.

    Dropped are marks, vowels and finals of Hangul, invisible and control signs, and, since translate() gives one sign
    for one, the signs whose shape has several signs (ligatures and digraphs), with all signs of their shapes.
    """
    plain: dict[str, str] = {}
    drop = dict.fromkeys(chr(c) for c in (*range(0x09), *range(0x0E, 0x20), *range(0x7F, 0xA0)) if c != 0x85)
    forms: dict[str, str] = {}
    for cp in (*range(0x20, 0x7F), 0x09, *_code_points()):
        ch = chr(cp)
        to = unicodedata.normalize("NFD", unicodedata.normalize("NFD", ch).translate(_table()))
        forms[ch] = "".join(x for x in to if unicodedata.category(x)[0] != "M" and unicodedata.category(x) not in ("Cf", "Cc") and not _jamo(x))
    parts = {x for to in forms.values() if len(to) > 1 for x in to}
    for ch, to in forms.items():
        if ch in drop or (to == ch and ch not in parts):
            continue
        if len(to) == 1 and to not in parts:
            plain[ch] = to
        else:
            drop[ch] = None
    return "".join(plain) + "".join(drop), "".join(plain.values())


def _coarse(value: Column) -> Column:
    a, b = coarse_map()
    return F.translate(value, a, b)


def _near(df: DataFrame) -> DataFrame:
    """A checkpointed side of numbers, broadcast if its counted rows allow it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _named(values: DataFrame, scope: str, value: str) -> DataFrame:
    """The rows with the hashes by which scope (s) and value (h, g) are known."""
    return values.withColumns({"s": F.xxhash64(F.lit("scope"), scope), "h": F.xxhash64(value), "g": F.xxhash64(F.lit("value"), value)})


def classes(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of values that look the same: (s, h, g, ch, cg, has_reference) and (s, ch, cg, canonical).

    values: (scope, value, reference boolean), repeats allowed; only values of one scope are compared. s, h and g are the
    hashes of scope and value, ch and cg those of the canonical form: a reference value if the class has one, else the
    member that its own mapping changes least, then the shortest, then the least.
    """
    v = _named(values.filter(F.col("value").isNotNull()), "scope", "value")
    hashed = cut(v.select("s", F.xxhash64(_coarse(F.col("value"))).alias("c"), "h").distinct())
    shared = hashed.groupBy("s", "c").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("s", "c")
    wanted = _near(hashed.join(shared, ["s", "c"], "left_semi").select("s", "h").distinct())
    few = v.join(wanted, ["s", "h"], "left_semi").groupBy("s", "h", "g").agg(F.max("reference").alias("reference"), F.min("value").alias("value"))

    def run(c: dict[str, list]):
        table = _table()
        mapped = [shape(x) for x in c["value"]]
        changed = [sum(ord(x) in table for x in v) for v in c["value"]]
        yield {**c, "mapped": mapped, "changed": changed}

    formed = arrow_map(few, run, "s long, h long, g long, reference boolean, value string, mapped string, changed int")
    formed = cut(formed.withColumn("form", F.collate("mapped", "UNICODE")).select("s", "h", "g", "reference", "value", "changed", "form"))
    order = F.struct((~F.col("reference")).alias("a"), F.col("changed").alias("b"), F.length("value").alias("c"), F.col("value").alias("d"))
    best = (
        formed.groupBy("s", "form")
        .agg(F.min_by("value", order).alias("canonical"), F.count("*").alias("members"), F.max("reference").alias("has_reference"))
        .filter("members > 1")
        .withColumns({"ch": F.xxhash64("canonical"), "cg": F.xxhash64(F.lit("value"), "canonical")})
    )
    known = formed.join(best.select("s", "form", "ch", "cg", "has_reference"), ["s", "form"]).select("s", "h", "g", "ch", "cg", "has_reference")
    return known, best.select("s", "ch", "cg", "canonical")


def lookalike_texts(records: DataFrame, key: str, text: str, canonical: bool = True) -> DataFrame:
    """(key, canonical) of every record whose text looks like that of another record but is stored otherwise.

    canonical=False: the keys alone, with no text moved to them.
    """
    v = records.select(F.col(key).alias("k"), F.lit("").alias("scope"), F.col(text).alias("value"))
    known, forms = classes(v.select("scope", "value", F.lit(False).alias("reference")))
    return _joined(v, known, forms, key, canonical)


def lookalike_titles(records: DataFrame, key: str, title: str, source: str, titles: DataFrame, canonical: bool = True) -> DataFrame:
    """(key, canonical) of every record whose title looks like a reference title (source, title) but is stored otherwise."""
    v = records.select(F.col(key).alias("k"), F.col(source).alias("scope"), F.col(title).alias("value"))
    both = v.select("scope", "value", F.lit(False).alias("reference")).distinct().unionByName(
        titles.select(F.col("source").alias("scope"), F.col("title").alias("value"), F.lit(True).alias("reference"))
    )
    known, forms = classes(both)
    return _joined(v, known.filter("has_reference and not (h = ch and g = cg)"), forms, key, canonical)


def _joined(v: DataFrame, known: DataFrame, forms: DataFrame, key: str, canonical: bool) -> DataFrame:
    found = _named(v.filter(F.col("value").isNotNull()), "scope", "value").join(_near(known), ["s", "h", "g"])
    found = found.select(F.col("k").alias(key), "s", "ch", "cg").distinct()
    if not canonical:
        return found.select(key).distinct()
    return found.join(forms, ["s", "ch", "cg"]).select(key, "canonical").distinct()
