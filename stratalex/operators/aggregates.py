"""Aggregations: corpus statistics, audits, profiles, evaluation metrics and grouped reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalex.functions import text as T
from stratalex.operators import filters as P
from stratalex.operators import ranking as R


def rate(test: Column, places: int = 4) -> Column:
    """The part of rows that pass, nulls counted as failures."""
    return F.round(F.avg(F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)), places)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled): rows with a value that is neither null nor empty, in one pass over the table."""
    one = df.agg(*[F.count_if(F.col(x).isNotNull() & (F.col(x).cast("string") != "")).alias(x) for x in columns])
    pairs = F.map_from_arrays(F.array(*[F.lit(x) for x in columns]), F.array(*[F.col(x) for x in columns]))
    return one.select(F.explode(pairs).alias("field", "filled"))


def audit(df: DataFrame, terms: list[str], marks: list[str], units: list[str], front: list[str], unknown: list[str]) -> DataFrame:
    """(paragraph_id, code, severity): one row per issue of a record, by the record contract."""
    unit = F.lower(F.trim(F.coalesce("retrieval_unit", F.lit("paragraph")))).isin(units)
    eligible = unit & F.coalesce("retrievable", F.lit(True))
    empty = ~F.coalesce("paragraph_text", F.lit("")).rlike(f"[^{T.BLANKS}]")
    kind = P.pollution("article", terms)
    title = F.trim(F.coalesce("article", F.lit("")))
    body = F.col("page_type") == "body"
    rules = [
        ("FRONT_MATTER_LEAK", "error", eligible & F.col("page_type").isin(front)),
        ("EMPTY_RETRIEVAL_TEXT", "error", unit & empty),
        ("MOJIBAKE_REMAINS", "error", P.mojibake("paragraph_text", marks) & ~(~eligible & F.coalesce(F.array_contains("quality_flags", "mojibake"), F.lit(False)))),
        ("ARTICLE_POLLUTION", "error", kind.isNotNull() & ~F.col("page_type").isin([*front, "notes"])),
        ("FOOTNOTE_ORPHAN", "warning", P.orphan_footnote("paragraph_text") & ~((F.col("page_type") == "notes") | F.coalesce(kind == "注释", F.lit(False)))),
        ("ARTICLE_MISSING", "error", unit & body & (title == "")),
        ("ARTICLE_UNKNOWN", "error", unit & body & (title != "") & T.label("article").isin(unknown)),
        ("PAGE_REQUIRED", "error", unit & (F.col("pdf_page_start").isNull() | F.col("pdf_page_end").isNull())),
        ("PAGE_RANGE_REVERSED", "error", unit & (F.col("pdf_page_end") < F.col("pdf_page_start"))),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, test in rules]))
    return df.select("paragraph_id", F.explode(found).alias("i")).select("paragraph_id", "i.code", "i.severity")


def repeated_line_ratio(df: DataFrame, key: str, text: str, least: int = 6, times: int = 3) -> DataFrame:
    """(key, lines, ratio): lines of at least `least` characters; repeats count from `times` on."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("x")).select(key, F.trim("x").alias("x")).filter(F.length("x") >= least)
    n = lines.groupBy(key, "x").agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.sum("n").alias("lines"), F.round(F.sum(F.when(F.col("n") >= times, F.col("n") - 1).otherwise(0)) / F.sum("n"), 6).alias("ratio"))


def discrete_median(values: Column) -> Column:
    """Element n // 2 of the sorted values: not interpolated. percentile_disc counts from the other side, hence the shift."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def dominant(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group, ties to the smaller one; counted before it is ranked."""
    n = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return R.first_per(n, group, [F.desc("n"), F.asc(value)])


def retrieval_metrics(ranks: DataFrame, rank: str, by: list[str]) -> DataFrame:
    """Recall at 1, 5 and 8 and the mean reciprocal rank at 8; a null rank is a miss."""
    at = lambda k: F.round(F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}")
    mrr = F.round(F.avg(F.when(F.col(rank) <= 8, 1.0 / F.col(rank)).otherwise(0.0)), 6).alias("mrr_8")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), at(1), at(5), at(8), mrr)


def first_code(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The code of the first rule that holds."""
    return reduce(lambda acc, r: acc.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise(otherwise)


def flags(rules: list[tuple[str, Column]]) -> Column:
    """The codes of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in rules]))
