"""Operators over ordered rows: fills, breaks, runs, islands, interpolation, and the folds that windows cannot express."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.operators import ranking as R
from stratalex.session import cut

#: An end of a sentence, closing signs included.
ENDED = "[。！？!?.…”」』）)]\\s*$"


def forward_filled(df: DataFrame, source: str, at: str, value: str, gap: int) -> DataFrame:
    """`page`: the value, or the last known one counted on over at most `gap` pages."""
    w = Window.partitionBy(source).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    last_at = F.last(F.when(F.col(value).isNotNull(), F.col(at)), ignorenulls=True).over(w)
    step = F.col(at) - F.col("_la")
    f = df.withColumn("_la", last_at).withColumn("_lv", F.last(value, ignorenulls=True).over(w))
    return f.withColumn("page", F.coalesce(value, F.when(step <= gap, F.col("_lv") + step))).drop("_la", "_lv")


def merged_over_pages(df: DataFrame, source: str, page: str, order: list[str], text: str) -> DataFrame:
    """`grp`: rows of one paragraph that runs over page ends; a skipped page or a closed sentence starts a new one."""
    w = Window.partitionBy(source).orderBy(*order)
    goes_on = F.lag(text).over(w).isNotNull() & (F.col(page) == F.lag(page).over(w) + 1) & ~F.lag(text).over(w).rlike(ENDED)
    return df.withColumn("_s", F.when(goes_on, 0).otherwise(1)).withColumn("grp", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def sequence_breaks(df: DataFrame, source: str, at: str, value: str, low: int = -60, high: int = 140, back: int = -3, jump: int = 8) -> DataFrame:
    """Rows whose number goes back, jumps, or lies outside the offset window; rows without a number are passed over."""
    w = Window.partitionBy(source).orderBy(at)
    k = df.filter(F.col(value).isNotNull()).withColumn("_pp", F.lag(at).over(w)).withColumn("_pv", F.lag(value).over(w))
    shift, delta = F.col(at) - F.col(value), F.col(value) - F.col("_pv")
    issue = F.when((shift < low) | (shift > high), "offset").when(delta < back, "reversal").when(delta > F.col(at) - F.col("_pp") + jump, "jump")
    return k.withColumn("issue", issue).filter("issue is not null").drop("_pp", "_pv")


def fixpoint_outliers(df: DataFrame, source: str, at: str, value: str, most: int = 12) -> DataFrame:
    """(source, at, value, round): breaks found again and again without those found before, until none is left.

    Each round is cut by a checkpoint; `most` bounds the rounds, and a round that finds nothing ends them.
    """
    left, found = cut(df.select(source, at, value)), None
    for i in range(1, most + 1):
        bad = cut(sequence_breaks(left, source, at, value).select(source, at, value))
        if bad.isEmpty():
            break
        marked = bad.withColumn("round", F.lit(i))
        found = marked if found is None else found.unionByName(marked)
        left = cut(left.join(bad.select(source, at), [source, at], "left_anti"))
    return found if found is not None else df.select(source, at, value, F.lit(0).alias("round")).limit(0)


def longest_runs(df: DataFrame, source: str, value: str, at: str) -> DataFrame:
    """(source, value, first_pdf, last_pdf, n): the longest island of consecutive positions with one value, ties to the first."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(source, value).orderBy(at))
    g = df.withColumn("_i", island).groupBy(source, value, "_i").agg(F.min(at).alias("first_pdf"), F.max(at).alias("last_pdf"), F.count("*").alias("n"))
    return R.first_per(g, [source], [F.desc("n"), F.asc("first_pdf"), F.asc(value)]).drop("_i")


def interpolated(df: DataFrame, source: str, at: str, value: str, off: float = 0.45) -> DataFrame:
    """(source, at, page): numbers between two known ones on the line through them, if near a whole number."""
    before = Window.partitionBy(source).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(source).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    f = df.select(
        source, at, value, F.last(known, ignorenulls=True).over(before).alias("l"), F.last(value, ignorenulls=True).over(before).alias("lv"),
        F.first(known, ignorenulls=True).over(after).alias("r"), F.first(value, ignorenulls=True).over(after).alias("rv"),
    )
    v = F.col("lv") + (F.col("rv") - F.col("lv")) * (F.col(at) - F.col("l")) / (F.col("r") - F.col("l"))
    x = f.filter(F.col(value).isNull() & (F.col("r") > F.col("l"))).select(source, at, v.alias("v"))
    return x.filter(F.abs(F.col("v") - F.round("v")) <= off).select(source, at, F.round("v").cast("int").alias("page"))


def single_outliers(df: DataFrame, source: str, at: str, value: str) -> DataFrame:
    """(source, at, value, repaired): a number between neighbours two apart that is neither of the two that fit."""
    w = Window.partitionBy(source).orderBy(at)
    k = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    odd = (F.col("_b") == F.col("_a") + 2) & (F.col(value) != F.col("_a") + 1) & (F.col(value) != F.col("_a") + 2)
    return k.filter(odd).select(source, at, value, (F.col("_a") + 1).alias("repaired"))


def closed_ranges(df: DataFrame, source: str, start: str, end: str, title: str) -> DataFrame:
    """Ranges put right: a reversed end becomes the start, and a range of one page runs to before the next start."""
    nxt = F.lead(start).over(Window.partitionBy(source).orderBy(start, end, title))
    fixed = df.withColumn("_n", nxt).withColumn(end, F.greatest(start, end))
    return fixed.withColumn(end, F.when((F.col(end) == F.col(start)) & (F.col("_n") > F.col(start)), F.col("_n") - 1).otherwise(F.col(end))).drop("_n")


def anchor_segments(df: DataFrame, source: str, at: str, value: str, least: int = 3) -> DataFrame:
    """(source, first_at, last_at, n): runs in which the number moves with the page (0 or 1 off), of at least `least` rows."""
    w = Window.partitionBy(source).orderBy(at)
    drift = (F.col(value) - F.lag(value).over(w)) - (F.col(at) - F.lag(at).over(w))
    k = df.withColumn("_s", F.when(drift.between(-1, 0), 0).otherwise(1)).withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy(source, "_g").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_g")


def viterbi_chain(candidates: DataFrame, source: str, at: str, value: str, back: int = 3) -> DataFrame:
    """(source, at, value): one candidate number per page, the chain of least total departure, looking back `back` pages.

    The best way to each candidate depends on those before it: a fold over the pages of one source.
    """
    schema = f"`{source}` string, `{at}` int, `{value}` int"

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pages = [(p, sorted(set(g[value].astype(int)))) for p, g in pdf.groupby(at)]
        score: list[dict[int, float]] = []
        came: list[dict[int, tuple[int, int] | None]] = []
        for i, (p, values) in enumerate(pages):
            s: dict[int, float] = {}
            c: dict[int, tuple[int, int] | None] = {}
            for v in values:
                top, arg = 0.0, None
                for j in range(max(0, i - back), i):
                    for u, su in score[j].items():
                        gain = su - min(4.0, abs((v - u) - (p - pages[j][0]))) - 0.5 * (i - j - 1)
                        if gain > top:
                            top, arg = gain, (j, u)
                s[v], c[v] = top + 2.0, arg
            score.append(s)
            came.append(c)
        out = []
        if score:
            i, v = max(((i, v) for i, s in enumerate(score) for v in s), key=lambda x: (score[x[0]][x[1]], -x[0], -x[1]))
            at_: tuple[int, int] | None = (i, v)
            while at_ is not None:
                out.append((pdf[source].iloc[0], int(pages[at_[0]][0]), int(at_[1])))
                at_ = came[at_[0]][at_[1]]
        return pd.DataFrame(out, columns=[source, at, value])

    return candidates.groupBy(source).applyInPandas(best, schema)


def repeated_text(df: DataFrame, source: str, text: str, order: list[str], pages: list[str], least: int = 12) -> DataFrame:
    """Rows that repeat an earlier text of their source, against its first occurrence: on the same pages or on others."""
    w = Window.partitionBy(source, "_k").orderBy(*order)
    k = df.withColumn("_k", T.compact(F.coalesce(text, F.lit("")))).filter(F.length("_k") >= least)
    same: Column = F.lit(True)
    for p in pages:
        k = k.withColumn(f"_f_{p}", F.first(p).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        same = same & F.col(p).eqNullSafe(F.col(f"_f_{p}"))
    k = k.withColumn("_i", F.row_number().over(w)).filter("_i > 1")
    return k.withColumn("code", F.when(same, "DUPLICATE_TEXT").otherwise("DUPLICATE_PAGE_TEXT")).drop("_k", "_i", *[f"_f_{p}" for p in pages])
