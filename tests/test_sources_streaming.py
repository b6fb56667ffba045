"""Readers, writers, the persisted index, incremental loads and the staged build."""

import json

import pytest
from pyspark.sql import functions as F

from stratalex.operators import joins as J
from stratalex.operators import ranking as R
from stratalex.plans import catalog, pipeline
from stratalex.plans.q_aggregates import body
from stratalex.sources import readers, writers
from stratalex.streaming import loads

SF = "/root/testdata/sf0.001"


def test_page_cache(spark, tmp_path):
    d = tmp_path / "书 一.pdf"
    d.mkdir()
    for n in (1, 2, 10):
        (d / f"page_{n}.txt").write_text(f"raw  {n}", encoding="utf-8")
    (d / "page_2.json").write_text(json.dumps({"cleaned_text": "clean 2", "page_type": "body"}), encoding="utf-8")
    (d / "page_10.json").write_text("{broken", encoding="utf-8")
    got = [(r["page"], r["text"], r["from_sidecar"]) for r in readers.pages_with_fallback(spark, str(tmp_path)).orderBy("page").collect()]
    assert got == [(1, "raw 1", False), (2, "clean 2", True), (10, "raw 10", False)]
    assert readers.page_texts(spark, str(tmp_path)).first()["source"] == "书 一.pdf"


def test_json_lines_and_extractor(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    assert sorted(r["a"] for r in readers.json_lines(spark, str(p), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(p), "a int", strict=True).collect()
    files = spark.read.format("binaryFile").load(str(p))
    pages = readers.extracted(files, lambda b: [{"page": i + 1, "text": x} for i, x in enumerate(b.decode().split("\n")) if x], "page int, text string")
    assert pages.count() == 3


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a", "cat dog"), ("b", "cat bird 资本论"), ("c", None)], "id string, t string")
    path = str(tmp_path / "ix")
    writers.write_index(docs, "id", "t", path, 2)
    q = spark.createDataFrame([(1, "cat dog"), (2, "资本")], "q int, x string")
    want = {tuple(r) for r in R.bm25_topk(docs, "id", "t", q, "q", "x").select("q", "id", "score").collect()}
    assert {tuple(r) for r in writers.search_index(spark, path, "id", q, "q", "x").select("q", "id", "score").collect()} == want
    writers.read_index(spark, path, docs.repartition(3))
    with pytest.raises(ValueError, match="another corpus"):
        writers.read_index(spark, path, docs.limit(2))
    meta = next((tmp_path / "ix/meta").glob("part-*"))
    (tmp_path / "ix/meta" / f".{meta.name}.crc").unlink(missing_ok=True)
    meta.write_text(meta.read_text().replace('"n": 3', '"n": 4'))
    with pytest.raises(ValueError, match="checksum"):
        writers.read_index(spark, path)


def test_snapshots_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("s", "a b"), ("t", "c")], "source string, text string")
    assert {r["source"]: r["n"] for r in writers.write_records(df, str(tmp_path / "r")).collect()} == {"s": 1, "t": 1}
    writers.write_snapshot(df, str(tmp_path / "p"))
    with pytest.raises(Exception):
        writers.write_snapshot(df, str(tmp_path / "p"))
    assert writers.content_hash(df) == writers.content_hash(df.repartition(4)) != writers.content_hash(df.limit(1))


def test_load_resumes(spark, tmp_path):
    r = spark.read.parquet(f"{SF}/records.parquet").select("paragraph_id", "paragraph_text").filter("paragraph_text is not null").dropDuplicates(["paragraph_id"])
    src, target, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    part = F.pmod(F.xxhash64("paragraph_id"), F.lit(4))
    r.filter(part == 0).write.parquet(src)
    args = (spark, src, "paragraph_id string, paragraph_text string", target, ck, {"model": "none"})
    n = loads.load_chunks(*args)
    assert n > 0 and loads.load_chunks(*args) == n
    r.filter(part == 1).write.mode("append").parquet(src)
    assert loads.load_chunks(*args) > n
    with pytest.raises(ValueError, match="signature"):
        loads.load_chunks(*args[:5], {"model": "other"})


def test_streams(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/request_metrics.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    q = loads.windowed_requests(stream(), late="400 days").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = e.dropDuplicates(["request_id"]).groupBy(F.window("received_at", "1 hour"), "event_name").count().count()
    assert 0 <= spark.table("w").count() <= batch
    q = loads.last_good_turns(stream().filter("topic_id is not null")).writeStream.format("memory").queryName("g").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("g").count() == e.filter("topic_id is not null").count()


def test_staged_build(spark, tmp_path):
    target = str(tmp_path / "build")
    assert pipeline.preflight([SF, "/no/such"], [target]) == ["missing input: /no/such"]
    n = pipeline.build(spark, spark.read.parquet(f"{SF}/records.parquet"), target)
    assert n["records"] == spark.read.parquet(f"{SF}/records.parquet").select("paragraph_id").distinct().count()
    assert n["chunks"] > 0 and n["terms"] > 0
    with pytest.raises(Exception):
        pipeline.build(spark, spark.read.parquet(f"{SF}/records.parquet"), target)


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return store.executorSummary("driver").totalShuffleWrite()


def test_staged_build_moves_repeated_rows_only(spark, tmp_path, monkeypatch):
    records = spark.read.parquet(f"{SF}/records.parquet")
    wanted = records.select("paragraph_id").distinct().count()
    # texts that do not shrink
    big = records.withColumn("paragraph_text", F.concat("paragraph_text", *[F.sha2(F.concat("paragraph_id", F.lit(str(i))), 512) for i in range(40)]))
    big.write.parquet(str(tmp_path / "in"))
    big = spark.read.parquet(str(tmp_path / "in"))
    monkeypatch.setattr(pipeline.W, "write_index", lambda docs, key, text, path: docs.select(F.col(key).alias("term")).write.parquet(f"{path}/terms"))
    before = shuffled_bytes(spark)
    n = pipeline.build(spark, big, str(tmp_path / "build"))
    assert n["records"] == wanted
    assert shuffled_bytes(spark) - before < 0.2 * sum(p.stat().st_size for p in (tmp_path / "in").glob("*.parquet"))
    for stage in ("records", "issues", "chunks"):
        assert list((tmp_path / "build" / stage).glob("*.zstd.parquet"))


def test_audit_folds_each_title_and_text_once(spark):
    df = spark.read.parquet(f"{SF}/records.parquet")
    plan = pipeline.A.audit(df, ["目录", "注释"], ["Ã"], ["paragraph"], ["toc"], ["x"])._jdf.queryExecution().optimizedPlan().toString()
    # the title's form for both rules of pollution and for that of unknown titles; no text is rewritten to see whether it is blank
    assert plan.count("regexp_replace(coalesce(article") == 3 and "regexp_replace(coalesce(paragraph_text" not in plan


def test_once_is_one_row_of_each_key(spark, monkeypatch):
    rows = [("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3), ("", 4), ("c", 5), ("c", 5), ("c", 5)]
    df = spark.createDataFrame(rows, "id string, n int")
    want = sorted(set(rows), key=str)
    assert sorted(map(tuple, J.once(df, "id").collect()), key=str) == want
    alone, others = J.split_repeated(df, "id")
    assert sorted(map(tuple, alone.collect())) == [("", 4), ("b", 2)] and others.count() == 7
    monkeypatch.setattr(J, "REPEATED_KEYS", 2)
    alone, others = J.split_repeated(df, "id")
    assert alone.isEmpty() and others.count() == len(rows)
    assert sorted(map(tuple, J.once(df, "id").collect()), key=str) == want
    assert J.once(df.limit(0), "id").isEmpty()


def test_stream_windows_are_those_of_the_batch(spark):
    d = "/root/testdata/sf0.01"
    once = spark.read.parquet(f"{d}/request_metrics.parquet").dropDuplicates(["request_id"])
    valid = F.when(F.col("elapsed_ms") >= 0, F.col("elapsed_ms"))
    batch = once.groupBy(F.window("received_at", "1 hour"), "event_name").agg(F.count("*"), F.count_if("fallback_used"), F.avg(valid))
    key = lambda rows: sorted((r[0], r[1] or "", r[2], r[3]) for r in rows)
    got = catalog.queries()["s20_stream_windows"](spark, d).collect()
    want = [(r[0]["start"], *r[1:]) for r in batch.collect()]
    assert key(got) == key(want) and sum(r["n"] for r in got) == once.count()
    means = {(r[0], r[1]): r[4] for r in want}
    assert all(r["avg_ms"] == pytest.approx(means[r["start"], r["event_name"]], abs=1e-4) for r in got)


def test_streamed_last_good_is_that_of_the_batch(spark):
    d = "/root/testdata/sf0.1"
    rows = lambda q: sorted((r["request_id"], r["last_good"] or 0) for r in catalog.queries()[q](spark, d).collect())
    assert rows("w14_stream_last_good") == rows("w14_last_good_turn")


def test_checked_statistics_cover_all_sources(spark):
    got = catalog.queries()["s19_checked_statistics"](spark, SF).first()
    assert got["n"] == body(spark, SF).count()


def test_segments_give_the_ranking_of_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "SEGMENT_TOKENS", 3)
    rows = [("a", "猫猫狗 cat"), ("a", "猫猫狗 cat"), ("a", "dog cat"), ("a", "cat fish"), ("b", "cat cat cat"), ("c", None), ("d", "dog " * 300 + "cat"), (None, "cat")]
    docs = spark.createDataFrame(rows, "id string, t string")
    q = spark.createDataFrame([(1, "cat 猫狗"), (2, "bird"), (3, "dog dog cat")], "q int, x string")
    for at, buckets in (("one", 1), ("three", 3)):
        path = str(tmp_path / at)
        writers.write_index(docs, "id", "t", path, buckets)
        for k in (2, 8):
            want = sorted(tuple(r) for r in R.bm25_topk(docs.fillna("", ["id"]), "id", "t", q, "q", "x", k).collect())
            assert sorted((r[0], r[1] or "", *r[2:]) for r in writers.search_index(spark, path, "id", q, "q", "x", k).collect()) == want
        meta = writers.read_index(spark, path, docs.distinct())[2]
        assert meta["n"] == 7


def test_packed_numbers_come_back():
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**31 - 1, 5]
    raw, sizes = writers._packed(writers.np.array(values))
    assert writers._unpacked(raw.tobytes()).tolist() == values and sizes.sum() == len(raw)
    assert writers._unpacked(b"").tolist() == []


def test_repeated_rows_are_the_same_corpus(spark, tmp_path):
    docs = spark.createDataFrame([("a", "cat"), ("b", None)], "id string, t string")
    writers.write_index(docs.union(docs), "id", "t", str(tmp_path / "ix"))
    meta = writers.read_index(spark, str(tmp_path / "ix"), docs)[2]
    assert meta["n"] == 2 and meta["avgdl"] == 0.5


@pytest.mark.parametrize("most", [10, 10_000])
def test_texts_of_many_repeated_keys_move_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(writers.I, "DIMENSION_ROWS", 10)
    monkeypatch.setattr(J, "REPEATED_KEYS", most)
    texts = spark.range(500).select(F.col("id").cast("string").alias("id"), F.concat(*[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(20)]).alias("t"))
    path = str(tmp_path / "in")
    texts.union(texts).write.parquet(path)
    before = shuffled_bytes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        writers._by_key(spark.read.parquet(path), "id", "t").write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = spark.read.parquet(str(tmp_path / "out")).select("id", F.size("texts").alias("n")).collect()
    assert sorted((r["id"], r["n"]) for r in got) == sorted((str(i), 1) for i in range(500))
    assert shuffled_bytes(spark) - before < 1.3 * sum(p.stat().st_size for p in (tmp_path / "in").glob("*.parquet"))
