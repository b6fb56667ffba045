"""Texts that were cut off, and how often each source cuts.

Evidence is summed for each document; it is cut where the sum is above zero.

1. Spikes. Per source, the lengths of all values are counted in characters and in bytes, with how many of them end
   without terminal punctuation. A length limit shows as a spike: far more values at one length (bytes: within the three
   lengths that a last incomplete sign can give) than the lengths around it hold, and most of them open, against the part
   of open ends in the source as a whole (a likelihood ratio). A value at a spike without terminal punctuation is cut
   at that limit.
2. The ending. A text that stops without terminal punctuation speaks for a cut unless its last line is one of the forms
   in which whole texts end (_WHOLE_LINE); a form that looks the same when cut (_OPEN_LINE) speaks against one, and is
   overruled by a spike.
3. The corpus. Values cut in transfer have no common length. Their last sign and last word are held against all
   documents: how often the sign ends texts and how often it stands at any other place of them, and how often the word
   stands as a whole word and how often it only begins longer ones.

All of it is column expressions, partial aggregations on (source, length), sign and word, and joins back; only the signs
of the texts are counted in Python. The signs and words of the corpus are counted with map-side sums; only documents with
an open end are joined to the words.

Defined cases: null, empty and blank texts are never cut; a null source is a source of its own; repeated documents count
each; extra columns are ignored; a last line longer than END_REACH is no form of an ending.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalex.llm.common import arrow_map, cut

#: A length is a spike at so many values, and at so many times the mean of the lengths around it.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_REACH = 5, 5.0, 25
#: The part of open ends at a limit, and the most that is taken for the usual part of a source.
OPEN_AT_LIMIT, OPEN_USUAL = 0.9, 0.5
#: Evidence of: an open end, a last line that may be whole, a closed end, a spike; and bounds of that of sign and word.
OPEN, DOUBTFUL, CLOSED, SPIKE, SIGN_MOST, WORD_MOST = 3.0, -3.0, -20.0, 6.0, 2.0, 3.0
#: Code points at the end of a text in which every form of an ending lies.
END_REACH = 400

_CLOSE = "[\"'”“’»›」』】\\)\\]）］〉》]"
#: What may have been put after a cut.
_MARK = "(?U)(?:\\s*(?:\\[(?:\\.{3}|…+)\\]|\\((?:\\.{3}|…+)\\)|（(?:\\.{3}|…+)）|\\[(?:truncated|cut|gekürzt|abgeschnitten|tronqué|обрезано|截断|略)\\]|(?<![…])…|(?<!\\.)\\.{3}|\\uFFFD+|(?:read more|weiterlesen|lire la suite|阅读全文|查看更多|続きを読む)(?:\\.{3}|…)?))+\\s*$"
_END = f"(?:[。！？!?｡।॥．‽⁇⁈⁉]|……|(?<!\\.)\\.(?!\\.)|\\.{{4,}})(?:\\s?{_CLOSE})*[。．]?\\s*$"
#: Points after these end no sentence.
_ABBREVIATED = (
    "(?:^|[\\s(（“\"„«])(?:[A-ZÀ-ÞА-Я]|z|u|d|i|e|cf|vgl|vol|Bd|Nr|S|pp?|t|ff|Mr|Mrs|Ms|Dr|Prof|St|Hr|Fr|bzw|ca|Kap|Abb|No|Fig|ch|см|стр|гл|рис|напр|т|М|г-н)\\.\\s*$"
)
#: Last lines with which whole texts end, complete in themselves.
_WHOLE_LINE = (
    "^\\s*(?:"
    "[\\[（(【](?:完|终|全文完|未完待续|待续|完结|end|fin|ende|конец|終|to be continued|fortsetzung folgt|à suivre)[\\]）)】]"
    "|[A-ZÀ-ÞА-Я]\\.(?:\\s?[A-ZÀ-ÞА-Я]\\.)*\\s?[A-ZÀ-ÞА-Я][\\p{L}’'-]+"  # a signature
    "|第\\s*\\d+\\s*卷第\\s*\\d+\\s*[页頁]"
    "|(?:附录|附錄|付録|附表|Appendix|Anhang|Annexe|Приложение)\\s.*"
    "|\\d{4}年(?:\\d{1,2}月(?:\\d{1,2}日)?)?"
    "|(?:vol|Bd|t|т)\\. ?\\d+, ?(?:pp?|S|с|стр)\\. ?\\d+(?:[-–]\\d+)?"
    ")\\s*$"
)
#: Last lines that may be whole but look the same when cut: not trusted at a length where the source cuts.
_OPEN_LINE = (
    "^\\s*(?:"
    "[—–-]{2}.*\\d.*"  # a date or place after a dash
    "|[-–•*·]\\s+\\S.*"  # an item of a list
    "|\\d+[.)、]\\s*\\S{1,30}"
    "|[^\\t]+\\t.*\\S"  # a row of a table
    "|\\|.*\\|"
    "|.{1,24}……"
    ")\\s*$"
)


def _spikes(lengths: DataFrame, width: int) -> DataFrame:
    """(source, length) that belong to a spike; width: so many neighbouring lengths form one limit.

    lengths: (source, length, n, n_open).
    """
    near = Window.partitionBy("source").orderBy("length")
    band = near.rangeBetween(-(width - 1), 0)
    around = near.rangeBetween(-SPIKE_REACH - width, SPIKE_REACH)
    whole = Window.partitionBy("source")
    seen = lengths.withColumns(
        {
            "here": F.sum("n").over(band),
            "open": F.sum("n_open").over(band),
            "all": F.sum("n").over(around),
            "base": F.least(F.lit(OPEN_USUAL), (F.sum("n_open").over(whole) + 0.5) / (F.sum("n").over(whole) + 1.0)),
        }
    )
    usual = (F.col("all") - F.col("here")) * width / (2.0 * SPIKE_REACH)
    often = (F.col("here") >= SPIKE_LEAST) & (F.col("here") >= SPIKE_TIMES * (usual + 0.2))
    ratio = F.col("open") * F.log(OPEN_AT_LIMIT / F.col("base")) + (F.col("here") - F.col("open")) * F.log((1 - OPEN_AT_LIMIT) / (1 - F.col("base")))
    top = seen.filter(often & (ratio > 0))
    return top.select("source", F.explode(F.sequence(F.col("length") - (width - 1), F.col("length"))).alias("length")).distinct()


def _tail(text: Column) -> Column:
    """The last END_REACH code points before trailing blanks."""
    return F.right(F.rtrim(text, F.lit(" \n\r\t\u00a0\u3000")), F.lit(END_REACH))


def ending(text: Column) -> tuple[Column, Column, Column]:
    """(no closing punctuation and no whole last line, the same but with a last line that may be whole, bare tail).

    What was put after a cut is not looked at.
    """
    tail = _tail(text)
    bare = F.regexp_replace(F.regexp_replace(tail, _MARK, ""), "(?U)\\s+$", "")
    marked = F.length(bare) < F.length(F.regexp_replace(tail, "(?U)\\s+$", ""))
    last = F.substring_index(bare, "\n", -1)
    seen_whole = (F.length(last) < F.length(bare)) | (F.length(text) <= END_REACH)
    closed = bare.rlike(_END) & ~bare.rlike(_ABBREVIATED)
    whole = ~marked & seen_whole & last.rlike("(?iU)" + _WHOLE_LINE)
    maybe = ~marked & seen_whole & last.rlike("(?iU)" + _OPEN_LINE)
    unclosed = (F.length(bare) > 0) & ~closed & ~whole
    return unclosed & ~maybe, unclosed & maybe, bare


def sign_evidence(t: DataFrame) -> DataFrame:
    """(sign, sign_score): how much a last sign speaks for a cut, from its counts at the end and at all other places of all
    texts. There are at most as many rows as code points."""

    def counted(columns):
        # the texts of a batch one by one, so that none of them is copied
        n: Counter = Counter()
        for x in columns["t"]:
            n.update(x)
        yield {"sign": list(n), "n": list(n.values())}

    whole = Window.partitionBy()
    last = t.select(F.right(_tail(F.col("t")), F.lit(1)).alias("sign")).groupBy("sign").agg(F.count("*").alias("at_end"))
    last = last.withColumn("ends", F.sum("at_end").over(whole)).filter(F.length("sign") > 0)
    every = arrow_map(t.filter(F.length("t") > 0).select("t"), counted, "sign string, n long").groupBy("sign").agg(F.sum("n").alias("n"))
    both = last.join(every.withColumn("all", F.sum("n").over(whole)), "sign")
    # each end is one place of its sign
    inside, places = F.col("n") - F.col("at_end"), F.col("all") - F.sum("at_end").over(whole)
    score = F.log((inside + 1.0) / (places + 1.0)) - F.log((F.col("at_end") + 1.0) / (F.col("ends") + 1.0))
    return both.select("sign", F.greatest(F.lit(-SIGN_MOST), F.least(F.lit(SIGN_MOST), score)).alias("sign_score"))


def word_evidence(t: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, word_score): how much a last word speaks for a cut inside it: it begins longer words of the corpus more often
    than it is one. wanted: (word) at the ends; each of these ends counts against its own word once."""
    words = t.select(F.explode(F.expr(f"regexp_extract_all(t, '{_WORD}', 0)")).alias("w")).select(F.lower("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    ends = wanted.groupBy("word").agg(F.count("*").alias("own"))
    starts = words.select("w", "n", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("k")).select(F.substring("w", F.lit(1), F.col("k")).alias("word"), "n", (F.col("k") == F.length("w")).alias("whole"))
    counts = starts.groupBy("word").agg(F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("as_word"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("n"))).alias("longer"))
    score = F.log((F.coalesce("longer", F.lit(0)) + 0.5) / (F.greatest(F.lit(0), F.coalesce("as_word", F.lit(0)) - F.col("own")) + 0.5))
    return ends.join(counts, "word", "left").select("word", F.greatest(F.lit(0.0), F.least(F.lit(WORD_MOST), score)).alias("word_score"))


#: Words of scripts with spaces; Han, kana, Thai and the like have none.
_WORD = "[\\\\p{Lu}\\\\p{Ll}]{2,}"


def truncated(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One row per document: (key, source, n_chars, n_bytes, cut, cut_kind char_limit | byte_limit | transfer, inside_word)."""
    t = df.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(text).alias("t"))
    certain, doubtful, bare = ending(F.col("t"))
    seen = t.select(
        "k",
        "source",
        F.length("t").alias("n_chars"),
        F.octet_length("t").alias("n_bytes"),
        F.when(certain, 2).when(doubtful, 1).otherwise(0).alias("open"),
        F.right(_tail(F.col("t")), F.lit(1)).alias("sign"),
        F.when(certain | doubtful, F.lower(F.regexp_extract(bare, "([\\p{Lu}\\p{Ll}]{2,})$", 1))).alias("word"),
    )
    seen = cut(seen)  # small columns, so that texts are read for the endings once
    opened = F.sum((F.col("open") > 0).cast("int")).alias("n_open")
    lengths = seen.groupBy("source", "n_chars", "n_bytes").agg(F.count("*").alias("n"), opened)
    sums = (F.sum("n").alias("n"), F.sum("n_open").alias("n_open"))
    in_chars = _spikes(lengths.filter("n_chars > 0").groupBy("source", F.col("n_chars").alias("length")).agg(*sums), 1)
    in_bytes = _spikes(lengths.filter("n_bytes > 0").groupBy("source", F.col("n_bytes").alias("length")).agg(*sums), 3)
    by_chars = in_chars.select(F.col("source").alias("s1"), F.col("length").alias("l1"))
    by_bytes = in_bytes.select(F.col("source").alias("s2"), F.col("length").alias("l2"))
    out = seen.join(by_chars, F.col("source").eqNullSafe(F.col("s1")) & (F.col("n_chars") == F.col("l1")), "left").join(
        by_bytes, F.col("source").eqNullSafe(F.col("s2")) & (F.col("n_bytes") == F.col("l2")), "left"
    )
    words = word_evidence(t, seen.filter("word <> ''").select("word"))
    # rows without a word spread over many keys that no word has
    none = F.concat(F.lit("0"), F.pmod(F.xxhash64("k"), F.lit(1024)))
    out = out.join(F.broadcast(sign_evidence(t)), "sign", "left")
    out = out.withColumn("word", F.when(F.col("word") != "", F.col("word")).otherwise(none)).join(words, "word", "left")
    kind = F.when(F.col("l1").isNotNull(), "char_limit").when(F.col("l2").isNotNull(), "byte_limit").otherwise("transfer")
    form = F.when(F.col("open") == 2, OPEN).when(F.col("open") == 1, DOUBTFUL).otherwise(CLOSED)
    total = form + F.when(kind == "transfer", 0.0).otherwise(SPIKE) + F.coalesce("sign_score", F.lit(0.0)) + F.coalesce("word_score", F.lit(0.0))
    out = out.withColumn("kind", kind).withColumn("cut", total > 0)
    inside = F.coalesce(F.col("cut") & (F.col("word_score") >= 1), F.lit(False))
    return out.select(F.col("k").alias(key), "source", "n_chars", "n_bytes", "cut", F.when(F.col("cut"), F.col("kind")).alias("cut_kind"), inside.alias("inside_word"))


def share_by_source(found: DataFrame) -> DataFrame:
    """How many documents each source has, how many are cut, by kind, and their share."""
    kinds = [F.sum(F.when(F.col("cut_kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("char_limit", "byte_limit", "transfer")]
    return found.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum(F.col("cut").cast("long")).alias("n_cut"), *kinds, F.avg(F.col("cut").cast("double")).alias("cut_share")
    )
