"""Contract checks: schemas, map rules and case evaluators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def schema_gaps(df: DataFrame, wanted: StructType) -> list[tuple[str, str]]:
    """(field, missing | type) for the required fields that a table lacks or has in another type; more fields are allowed."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    out = [(f.name, "missing") for f in wanted if f.name not in have]
    return out + [(f.name, "type") for f in wanted if f.name in have and have[f.name] != f.dataType.simpleString()]


def rule_failures(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule): the rules that a row breaks; a rule that gives null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))
