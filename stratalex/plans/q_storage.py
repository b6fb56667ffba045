"""Queries that write and read back: persisted indexes, vector tables, staged builds and streams, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalex.operators import ranking as R
from stratalex.plans import pipeline
from stratalex.plans.base import body_rows, narrow, questions
from stratalex.plans.catalog import query
from stratalex.plans.q_ranking import _BM25_SQL
from stratalex.session import ensure_checkpoint_dir, table
from stratalex.sources import writers as W
from stratalex.streaming import loads


def scratch(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


@query("s07_staged_build", None)
def s07(spark, d):
    n = pipeline.build(spark, table(spark, d, "records"), scratch(spark))
    return spark.createDataFrame(sorted(n.items()), "stage string, n long")


@query("s14_load_resumes", None)
def s14(spark, d):
    at = scratch(spark)
    rows = narrow(spark, d, "paragraph_text").filter("length(paragraph_text) > 0")
    rows.write.parquet(f"{at}/in")
    args = (spark, f"{at}/in", "paragraph_id string, paragraph_text string", f"{at}/out", f"{at}/ck", {"model": "none"})
    first = loads.load_chunks(*args)
    again = loads.load_chunks(*args)
    return spark.createDataFrame([("first", first), ("again", again)], "run string, n long")


@query("s16_vector_table", "SELECT vec_id, label FROM embeddings")
def s16(spark, d):
    path = scratch(spark)
    W.write_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", path)
    return spark.read.parquet(path).select("vec_id", "label")


_TOP_SQL = f"WITH {_BM25_SQL} SELECT item_id, paragraph_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, paragraph_id) AS rank FROM sc QUALIFY rank <= 8"


@query("s18_persisted_index", _TOP_SQL)
def s18(spark, d):
    path = scratch(spark)
    W.write_index(body_rows(spark, d), "paragraph_id", "paragraph_text", path)
    return W.search_index(spark, path, "paragraph_id", questions(spark, d), "item_id", "asked")


@query("s19_checked_statistics", None)
def s19(spark, d):
    path = scratch(spark)
    docs = body_rows(spark, d)
    W.write_index(docs, "paragraph_id", "paragraph_text", path)
    _, _, meta = W.read_index(spark, path, docs.select("paragraph_id", "paragraph_text"))
    return spark.createDataFrame([(meta["n"], meta["avgdl"], meta["corpus"])], "n long, avgdl double, corpus string")


@query("s20_stream_windows", None)
def s20_windows(spark, d):
    at = scratch(spark)
    e = table(spark, d, "request_metrics").select("request_id", "event_name", "received_at", "fallback_used", "elapsed_ms")
    e.repartition(4).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    return loads.window_totals(spark, loads.windowed_requests(stream, late=None), f"{at}/out", f"{at}/ck")


@query("w14_stream_last_good", None)
def w14_stream(spark, d):
    at = scratch(spark)
    e = table(spark, d, "request_metrics").select("request_id", "ts", "topic_id", "evidence_count", "audit_ok")
    loads.in_time_order(e, f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    turns = loads.last_good_turns(stream.dropDuplicates(["request_id"]))
    q = turns.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return spark.read.parquet(f"{at}/out")
