"""The staged corpus build: preflight, pages, paragraphs, audit, enrichment, chunks, index; each stage a versioned table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.operators import aggregates as A
from stratalex.operators import filters as P
from stratalex.operators import joins as J
from stratalex.operators import segments as G
from stratalex.plans import base
from stratalex.plans.q_aggregates import UNKNOWN
from stratalex.sources import writers as W


def preflight(inputs: list[str], outputs: list[str]) -> list[str]:
    """What stands in the way of a build: inputs that are missing and outputs that exist. Local paths only."""
    return [f"missing input: {p}" for p in inputs if not os.path.exists(p)] + [f"existing output: {p}" for p in outputs if os.path.exists(p)]


def build(spark: SparkSession, records: DataFrame, target: str, size: int = 320, overlap: int = 64, strict: bool = False) -> dict[str, int]:
    """Run the stages over a record table and return the rows of each. A blocking audit issue stops a strict build."""
    out: dict[str, int] = {}

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{target}/{name}")
        back = spark.read.parquet(f"{target}/{name}")
        out[name] = back.count()
        return back

    one = stage("records", P.quarantined(J.once(records.drop("ingested_at", "volume_", "retrievable", "page_span"), "paragraph_id"), base.POLLUTION, base.MOJIBAKE))
    issues = stage("issues", A.audit(one, base.POLLUTION, base.MOJIBAKE, base.UNITS, base.FRONT, UNKNOWN))
    if strict and not issues.filter("severity = 'error'").isEmpty():
        raise ValueError("the audit found blocking issues")
    kept = one.filter("retrievable and length(coalesce(paragraph_text, '')) > 0")
    chunks = stage("chunks", G.chunked(kept, "paragraph_id", "paragraph_text", size, overlap).withColumn("chunk_id", F.concat_ws("#", "paragraph_id", F.col("child_index").cast("string"))))
    W.write_index(chunks, "chunk_id", "chunk", f"{target}/index")
    out["terms"] = spark.read.parquet(f"{target}/index/terms").count()
    return out
