"""Scalar text functions as Catalyst expressions: normalizers, tokens, n-grams, clips and character ratios.

All but plain_tokens stays in the JVM. Patterns use explicit classes, so that they mean the same in any engine.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all kinds, for use inside a character class.
BLANKS = "\\s\u00a0\u2000-\u200a\u202f\u205f\u3000"
HAN = "\u4e00-\u9fff"
#: Full-width forms of ASCII and the ASCII characters, in the same order.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
NARROW_LETTERS = "".join(ch for ch in NARROW if ch.isalnum())
WIDE_LETTERS = "".join(chr(ord(ch) + 0xFEE0) for ch in NARROW_LETTERS)
#: Signs that say nothing about a label (a fixed value of the record contract).
LABEL_NOISE = "·•.。…,:：;；—_\\-"
#: Signs dropped before local retrieval (a fixed value of the tokenizer).
SPARSE_NOISE = "《》“”\"'（）()、，。；：！？\\-.·"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold_width(x: Column | str) -> Column:
    """Full-width ASCII forms to ASCII; the wide blank to a space."""
    return F.translate(c(x), WIDE + "\u3000", NARROW + " ")


def fold_letters(x: Column | str) -> Column:
    """Full-width letters and digits to ASCII; texts without any are passed through, since translate() walks every character."""
    wide = WIDE_LETTERS
    return F.when(c(x).rlike(f"[{wide[0]}-{wide[9]}{wide[10]}-{wide[35]}{wide[36]}-{wide[61]}]"), F.translate(c(x), wide, NARROW_LETTERS)).otherwise(c(x))


def compact(x: Column | str) -> Column:
    """The text without any white space."""
    return F.regexp_replace(c(x), f"[{BLANKS}]+", "")


def collapse(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c(x), f"[{BLANKS}]+", " "))


def label(x: Column | str) -> Column:
    """A label for comparison: no blanks, no joining punctuation, lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(c(x), F.lit("")), f"[{BLANKS}{LABEL_NOISE}]+", ""))


def match_form(x: Column | str) -> Column:
    """Letters, digits and Han only, lower case: for containment tests."""
    return F.lower(F.regexp_replace(fold_letters(x), f"[^0-9A-Za-z{HAN}]+", ""))


def sparse_form(x: Column | str) -> Column:
    """Lower case without blanks and the signs of SPARSE_NOISE."""
    return F.regexp_replace(F.lower(c(x)), f"[{BLANKS}{SPARSE_NOISE}]+", "")


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once: inside a lambda an expression would be evaluated for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _grams(x: Column, n: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))
    return F.when(F.length(x) >= n, made).otherwise(F.array().cast("array<string>"))


def grams(x: Column, n: int) -> Column:
    """All substrings of n code points, in order."""
    return bound(x, lambda s: _grams(s, n))


def _run_grams(run: Column) -> Column:
    return F.when(F.length(run) <= 2, F.array(run)).otherwise(F.concat(_grams(run, 2), _grams(run, 3)))


def tokens(x: Column | str) -> Column:
    """Words of ASCII letters and digits, then overlapping 2- and 3-grams of each Han run (runs of at most 2 stay whole)."""

    def made(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))
        runs = F.regexp_extract_all(t, F.lit(f"[{HAN}]+"), F.lit(0))
        return F.concat(words, F.flatten(F.transform(runs, _run_grams)))

    return bound(F.lower(fold_letters(x)), made)


_FOLDED = str.maketrans(WIDE_LETTERS, NARROW_LETTERS)
_WORDS, _HAN_RUNS = re.compile("[a-z0-9]+"), re.compile(f"[{HAN}]+")


def plain_tokens(text: str) -> list[str]:
    """tokens() of a string, for Arrow functions."""
    t = text.translate(_FOLDED).lower()
    out = _WORDS.findall(t)
    for r in _HAN_RUNS.findall(t):
        n = len(r)
        if n <= 2:
            out.append(r)
        else:
            out += [r[i : i + 2] for i in range(n - 1)]
            out += [r[i : i + 3] for i in range(n - 2)]
    return out


def token_count(x: Column | str) -> Column:
    """The number of tokens(x), from the lengths of the runs alone."""

    def counted(t: Column) -> Column:
        words = F.size(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)))
        runs = F.regexp_extract_all(t, F.lit(f"[{HAN}]+"), F.lit(0))
        return words + F.aggregate(runs, F.lit(0), lambda s, r: s + F.when(F.length(r) <= 2, 1).otherwise(2 * F.length(r) - 3))

    return bound(F.lower(fold_letters(x)), counted)


def sparse_tokens(x: Column | str) -> Column:
    """Distinct tokens of the sparse form, in order of first appearance."""
    t = sparse_form(x)
    words = F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(t, F.lit(f"[{HAN}]+"), F.lit(0))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, _run_grams))))


def phrases(x: Column | str, stop: list[str], most: int = 12) -> Column:
    """Quoted spans and, stop phrases taken out, runs of 2-16 Han or of at least 3 ASCII; longest first, ties by appearance."""
    raw, t = c(x), sparse_form(x)
    quoted = F.filter(F.transform(F.regexp_extract_all(raw, F.lit('[“"]([^”"]+)[”"]'), F.lit(1)), sparse_form), lambda p: F.length(p) >= 2)
    for s in stop:
        t = F.replace(t, F.lit(s), F.lit(" "))
    runs = F.regexp_extract_all(t, F.lit(f"[{HAN}]{{2,16}}|[a-z0-9]{{3,}}"), F.lit(0))
    every = F.array_distinct(F.concat(quoted, runs))
    keyed = F.transform(every, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["p"]), 1, most)


def exploded(array: Column, name: str):
    """The elements of a costly array as rows; filter out nulls after it.

    explode() lets the optimizer infer a filter on the array's size, which would be computed a second time at the scan,
    where a file may be read by few tasks; explode_outer() does not.
    """
    return F.explode_outer(array).alias(name)


def han_bigrams(x: Column | str) -> Column:
    """Distinct pairs of adjacent Han, all else taken out first."""
    return F.array_distinct(grams(F.regexp_replace(c(x), f"[^{HAN}]+", ""), 2))


def ratio(x: Column | str, char_class: str) -> Column:
    """Part of the characters that belong to a class; 0 for an empty text."""
    n = F.length(c(x))
    return F.when(n > 0, (n - F.length(F.regexp_replace(c(x), f"[{char_class}]", ""))) / n).otherwise(0.0)


def clip(x: Column | str, limit: int, head: float = 0.75) -> Column:
    """A text over the limit as its head and tail, together of the limit; else unchanged."""
    a = int(limit * head)
    return F.when(F.length(c(x)) > limit, F.concat(F.substring(c(x), 1, a), F.right(c(x), F.lit(limit - a)))).otherwise(c(x))


def preview(x: Column | str, limit: int) -> Column:
    """White space collapsed, cut at the limit with an ellipsis."""
    t = collapse(x)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("…"))).otherwise(t)


def overlap_score(query: Column, page: Column, sizes: tuple[int, ...] = (8, 6, 4, 2)) -> Column:
    """Sum of the squared lengths of the distinct substrings of the query, of the sizes, that the page contains."""
    def score(pair: Column) -> Column:
        terms = F.array_distinct(F.flatten(F.array(*[_grams(pair["q"], n) for n in sizes])))
        held = F.filter(terms, lambda t: F.contains(pair["p"], t))
        return F.aggregate(held, F.lit(0).cast("long"), lambda s, t: s + (F.length(t) * F.length(t)).cast("long"))

    return bound(F.struct(query.alias("q"), page.alias("p")), score)


def ordered_distinct(values: Column, key=None, most: int | None = None) -> Column:
    """The first value of each key, in order; at most `most`."""
    if key is None:
        out = F.array_distinct(values)
    else:
        keys = F.transform(values, key)
        out = F.filter(values, lambda v, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)
    return F.slice(out, 1, most) if most else out


def length_bucket(x: Column | str) -> Column:
    """short below 120, medium to 600, else long."""
    n = F.length(c(x))
    return F.when(n < 120, "short").when(n <= 600, "medium").otherwise("long")
