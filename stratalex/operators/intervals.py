"""Interval, nearest and containment joins without nested loops over the large side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension is broadcast; its count is checked first.
DIMENSION_ROWS = 200_000


def dimension(df: DataFrame) -> DataFrame:
    """A dimension table with a broadcast hint if its counted rows are few, else unchanged.

    The count stops one row after the bound, so that a large table is not read for it.
    """
    return F.broadcast(df) if df.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else df


def interval_join(points: DataFrame, intervals: DataFrame, on: str, point: Column, start: str, end: str, width: int = 64, how: str = "inner") -> DataFrame:
    """Join points to the intervals [start, end] of the same key that hold them.

    Intervals are spread over page buckets of `width`, so that the join is an equi-join on (key, bucket) at any size.
    Intervals whose end lies before their start hold nothing. The interval columns must not clash with those of the points.
    """
    spread = (
        intervals.filter(F.col(start) <= F.col(end))
        .withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
        .withColumnRenamed(on, "_key")
    )
    at = points.withColumn("_at", point).withColumn("_b", F.floor(F.col("_at") / width))
    inside = (F.col(on) == F.col("_key")) & (F.col("_b") == F.col("_bucket")) & F.col("_at").between(F.col(start), F.col(end))
    return at.join(spread, inside, how).drop("_at", "_b", "_bucket", "_key")


def nearest_within(points: DataFrame, targets: DataFrame, on: str, value: str, target: str, reach: int) -> DataFrame:
    """For each point the rows of the same key whose target lies within reach: an equi-join on (key, value).

    Each target answers for the 2 * reach + 1 values around it, so no range condition is left.
    """
    spread = targets.withColumn(value, F.explode(F.sequence(F.col(target) - reach, F.col(target) + reach)))
    return points.join(spread, [on, value])
