"""Structured Streaming: incremental index loads that resume, windowed log reports, and per-session state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalex.operators import segments as G


def load_chunks(spark: SparkSession, source_dir: str, schema: str, target: str, checkpoint: str, signature: dict, size: int = 320, overlap: int = 64) -> int:
    """Load the chunks of all files not loaded yet into target; a second run adds nothing. Returns the rows of the target.

    The load is bound to a signature (input, model, sizes), kept beside the target: another signature is refused.
    Each micro-batch is written under its batch id, so that a batch that is run again replaces itself.
    """
    want = json.dumps(signature | {"size": size, "overlap": overlap}, sort_keys=True)
    meta = f"{target}/_signature"
    try:
        have = spark.read.text(meta).first()["value"]
    except Exception:
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(meta)
        have = want
    if have != want:
        raise ValueError("the target was built with another signature")

    def write(batch: DataFrame, batch_id: int) -> None:
        c = G.chunked(batch, "paragraph_id", "paragraph_text", size, overlap)
        c.write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")

    q = spark.readStream.schema(schema).parquet(source_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(f"{target}/rows").count()


def windowed_requests(events: DataFrame, at: str = "received_at", every: str = "1 hour", late: str | None = "2 days") -> DataFrame:
    """Requests, fallbacks and latency per window and event name, late rows within the watermark counted, repeats once.

    late=None: no watermark; rows of any age count, and the windows and request ids stay in the state. Such windows never
    close, so they are written with window_totals.
    """
    if late is None:
        once = events.dropDuplicates(["request_id"])
    else:
        once = events.withWatermark(at, late).dropDuplicatesWithinWatermark(["request_id"])
    return once.groupBy(F.window(at, every), "event_name").agg(
        F.count("*").alias("n"), F.count_if("fallback_used").alias("fallbacks"), F.round(F.avg(F.when(F.col("elapsed_ms") >= 0, F.col("elapsed_ms"))), 4).alias("avg_ms")
    ).select(F.col("window.start").alias("start"), "event_name", "n", "fallbacks", "avg_ms")


def window_totals(spark: SparkSession, windows: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """All windows of windowed_requests(..., late=None) after the input at hand, none of them held back.

    Each micro-batch writes the windows that it changed under its batch id; the last state of each window is returned.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    q = windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    names = windows.columns
    last = F.max_by(F.struct(*names), "batch").alias("w")
    written = spark.read.schema(f"{_ddl(windows)}, batch long").parquet(target)
    return written.groupBy("start", "event_name").agg(last).select("w.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def last_good_turns(events: DataFrame, key: str = "topic_id") -> DataFrame:
    """(key, request_id, last_good): for each request the last one of its key with evidence, kept as state over batches.

    The order is that of (ts, request_id) within a micro-batch; over micro-batches the input must come in time order
    (in_time_order). Rows without a key are the key 'none'.
    """
    good = F.coalesce(F.col("audit_ok") & (F.col("evidence_count") > 0), F.lit(False)).alias("good")
    narrow = events.select(F.coalesce(key, F.lit("none")).alias(key), "request_id", "ts", good)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        # the rows of a key come in several pieces, which only together can be put in order
        rows = pd.concat([b[["request_id", "ts", "good"]] for b in batches]).sort_values(["ts", "request_id"], na_position="first")
        ids = rows["request_id"].astype("Int64")
        reached = ids.where(rows["good"].astype(bool)).ffill()
        before = reached.shift()
        if last is not None:
            before, reached = before.fillna(last), reached.fillna(last)
        end = reached.iloc[-1]
        state.update((None if pd.isna(end) else int(end),))
        yield pd.DataFrame({key: k[0], "request_id": ids, "last_good": before})

    return narrow.groupBy(key).applyInPandasWithState(
        step, f"{key} string, request_id long, last_good long", "last long", "append", GroupStateTimeout.NoTimeout
    )


def in_time_order(events: DataFrame, target: str, at: str = "ts", slices: int = 4) -> None:
    """Write the rows as files that a stream reads in time order: slices by time, one file each, the oldest written first."""
    cuts = events.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)])).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None]):
        after = F.lit(True) if low is None else F.col(at) > low
        within = F.lit(True) if high is None else F.col(at) <= high
        if low is None:
            within = within | F.col(at).isNull()
        events.filter(after & within).coalesce(1).write.mode("append").parquet(target)
