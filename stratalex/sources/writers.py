"""Writers: versioned snapshots, per-source records, persisted indexes with checked statistics, incremental loads."""

from __future__ import annotations

import hashlib
import json
import uuid
from array import array
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from stratalex.functions import text as T
from stratalex.operators import intervals as I
from stratalex.operators import joins as J
from stratalex.operators import ranking as R
from stratalex.session import cut


def write_records(df: DataFrame, path: str, partition: str = "source") -> DataFrame:
    """Write records once, partitioned by source, and return the rows per source. An existing path is an error."""
    df.write.mode("errorifexists").partitionBy(partition).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(partition).agg(F.count("*").alias("n"))


def write_snapshot(pages: DataFrame, path: str, text: str = "text") -> None:
    """An immutable snapshot with hashes of the raw and of the compacted text."""
    out = pages.withColumn("raw_sha256", F.sha2(text, 256)).withColumn("normalized_sha256", F.sha2(T.compact(text), 256))
    out.write.mode("errorifexists").parquet(path)


def content_hash(df: DataFrame) -> str:
    """An order-free hash of all rows: sums of two row hashes and the row count, combined before they are collected."""
    return _hashed(_row_hashes(df))


def _row_hashes(df: DataFrame) -> DataFrame:
    cols = [F.to_json(F.struct(c)) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in df.dtypes]
    return df.select(F.xxhash64(F.lit(1), *cols).alias("a"), F.xxhash64(F.lit(2), *cols).alias("b"))


def corpus_hash(df: DataFrame) -> str:
    """content_hash of the rows, equal ones once; only the hashes are shuffled for it."""
    return _hashed(_row_hashes(df).distinct())


def _hashed(hashes: DataFrame) -> str:
    r = hashes.agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in "ab"]).first()
    return hashlib.sha256(f"{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()


def _by_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, texts): the texts of each key, rows equal in all columns once. Only the rows of repeated keys are shuffled."""
    alone, others = J.split_repeated(docs, key)
    rows = F.collect_set(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]))
    several = others.groupBy(key).agg(rows.alias("_rows"))
    return alone.select(key, F.array(text).alias("texts")).unionByName(several.select(key, F.transform("_rows", lambda r: r[f"c{docs.columns.index(text)}"]).alias("texts")))


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of whole numbers in groups of 7 bits, low ones first, and how many bytes each takes."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= (1 << bits)
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for i in range(5):
        some = size > i
        out[at[some] + i] = (values[some] >> (7 * i)) & 127 | np.where(size[some] > i + 1, 128, 0)
    return out, size


def _unpacked(data: bytes) -> np.ndarray:
    """The numbers of _packed."""
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if len(raw) else np.zeros(0, np.int64)
    number = np.cumsum(last) - last
    shifted = (raw & 127).astype(np.int64) << (7 * (np.arange(len(raw)) - first[number]))
    return np.bincount(number, weights=shifted, minlength=len(first)).astype(np.int64)


def _postings(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, occurrences) of the numbers of a term in a segment."""
    d, tf, here = [], [], 0
    for v in (it := iter(values.tolist())):
        here += v >> 1
        d.append(here)
        tf.append(next(it) if v & 1 else 1)
    return np.array(d, np.int64), np.array(tf, np.float64)


#: Tokens of a segment of an index; bounds the memory of a task.
SEGMENT_TOKENS = 3_000_000


def _segments(docs: DataFrame, key: str) -> DataFrame:
    """(segment, term, n, data, keys, rows, tokens): inverted segments of the documents of each task.

    A row with a term holds its postings: gaps between the numbers of the documents, doubled, odd where the number of
    occurrences follows because it is not one. The row without a term holds the keys of the documents, their lengths
    (data) and how many texts and tokens they stand for. Texts of one key and length are one document; those of a key adjoin.
    """
    schema = StructType(
        [
            StructField("segment", StringType()), StructField("term", StringType()), StructField("n", LongType()), StructField("data", BinaryType()),
            StructField("keys", ArrayType(docs.schema[key].dataType)), StructField("rows", LongType()), StructField("tokens", LongType()),
        ]
    )
    target = to_arrow_schema(schema)

    def built(batches):
        def empty():
            return defaultdict(lambda: array("i")), [], [], 0

        def flushed():
            name = uuid.uuid4().hex
            lengths, _ = _packed(np.array(dls, np.int64))
            one = [[name], [None], [len(keys)], [lengths.tobytes()], [keys], [rows], [held]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, target)], schema=target)
            terms = sorted(lists)
            if not terms:
                return
            counts = np.array([len(lists[t]) for t in terms], np.int64)
            docs_ = np.frombuffer(b"".join(lists[t].tobytes() for t in terms), np.int32).astype(np.int64)
            of = np.repeat(np.arange(len(terms)), counts)
            lists.clear()
            new = np.ones(len(docs_), bool)
            new[1:] = (docs_[1:] != docs_[:-1]) | (of[1:] != of[:-1])
            at = np.flatnonzero(new)
            tf = np.diff(np.append(at, len(docs_)))
            d, t = docs_[at], of[at]
            gap = d.copy()
            gap[1:] -= np.where(t[1:] == t[:-1], d[:-1], 0)
            often = tf > 1
            place = np.cumsum(1 + often) - (1 + often)
            values = np.zeros(len(d) + int(often.sum()), np.int64)
            values[place] = gap * 2 + often
            values[place[often] + 1] = tf[often]
            raw, sizes = _packed(values)
            ends = np.cumsum(sizes)
            df = np.bincount(t, minlength=len(terms))
            last = np.cumsum(1 + often)[np.cumsum(df) - 1] - 1
            offsets = np.concatenate([[0], ends[last]]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
            n = len(terms)
            columns = [pa.array([name] * n), pa.array(terms), pa.array(df, pa.int64()), data, pa.nulls(n, target.field("keys").type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            whole = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)
            for i in range(0, n, 10_000):
                yield whole.slice(i, 10_000)

        lists, keys, dls, rows = empty()
        held = 0
        for batch in batches:
            for k, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts: dict[int, list[str]] = {}
                for x in texts:
                    tokens = T.plain_tokens(x or "")
                    parts.setdefault(len(tokens), []).extend(tokens)
                    rows += 1
                    held += len(tokens)
                for dl, tokens in parts.items():
                    j = len(keys)
                    keys.append(k)
                    dls.append(dl)
                    for x in tokens:
                        lists[x].append(j)
                if held >= SEGMENT_TOKENS:
                    yield from flushed()
                    (lists, keys, dls, rows), held = empty(), 0
        if keys:
            yield from flushed()

    return docs.mapInArrow(built, schema)


def write_index(docs: DataFrame, key: str, text: str, path: str, buckets: int | None = None) -> str:
    """Postings, document frequencies and corpus statistics of a text column, bound to its hash. Equal rows count once.

    The index is made of segments, one or more a task, each written by its task in the order of terms: no posting is shuffled.
    buckets: so many tasks read the documents.
    """
    docs = docs.repartition(buckets) if buckets else docs
    corpus = corpus_hash(docs.select(key, text))
    _segments(_by_key(docs, key, text), key).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/postings")
    spark = docs.sparkSession
    held = spark.read.parquet(f"{path}/postings")
    held.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/terms")
    sums = held.filter("term is null").agg(F.sum("rows").alias("n"), F.sum("tokens").alias("tokens")).first()
    n = sums["n"] or 0
    meta = {"corpus": corpus, "n": n, "avgdl": sums["tokens"] / n if n else None, "k1": R.K1, "b": R.B, "version": 2}
    meta["checksum"] = hashlib.sha256(json.dumps(meta, sort_keys=True).encode()).hexdigest()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/meta")
    return corpus


def read_index(spark: SparkSession, path: str, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(postings, terms, meta) of a persisted index; refused if its statistics were changed or the corpus is another one."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    checksum = meta.pop("checksum", None)
    if checksum != hashlib.sha256(json.dumps(meta, sort_keys=True).encode()).hexdigest():
        raise ValueError("the index statistics do not match their checksum")
    if meta.get("version") != 2:
        raise ValueError(f"unknown index version {meta.get('version')}")
    if docs is not None and corpus_hash(docs) != meta["corpus"]:
        raise ValueError("the index belongs to another corpus")
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), meta


def search_index(spark: SparkSession, path: str, key: str, questions: DataFrame, qkey: str, qtext: str, k: int = 8) -> DataFrame:
    """BM25 over a persisted index: only the postings of the question terms are read; each segment gives its k best."""
    postings, terms, meta = read_index(spark, path)
    q = questions.select(qkey, F.explode(T.tokens(qtext)).alias("term")).groupBy(qkey, "term").agg(F.count("*").alias("qtf"))
    idf = F.log1p((F.lit(meta["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = I.dimension(cut(q.join(terms, "term").groupBy("term").agg(F.collect_list(F.struct(F.col(qkey).alias("q"), (idf * idf * (1.0 + F.log(F.col("qtf").cast("double")))).alias("w"))).alias("asked"))))
    asked = postings.filter("term is not null").join(w, "term").select("segment", "data", "asked")
    listed = postings.filter("term is null").select(F.col("segment").alias("of"), F.col("data").alias("lengths"), "keys")
    k1, b, avgdl = meta["k1"], meta["b"], meta["avgdl"] or 1.0
    schema = StructType([StructField(qkey, questions.schema[qkey].dataType), StructField(key, postings.schema["keys"].dataType.elementType), StructField("score", DoubleType())])

    def best(held: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        keys = list(segment["keys"].iloc[0]) if len(segment) else []
        scores: dict = {}
        if len(keys) and len(held):
            norm = k1 * (1.0 - b + b * _unpacked(segment["lengths"].iloc[0]) / avgdl)
            # documents of one key adjoin and add up
            number = np.cumsum([0, *(x != y for x, y in zip(keys, keys[1:]))])
            first = np.flatnonzero(np.diff(number, prepend=-1))
            for data, pairs in zip(held["data"], held["asked"]):
                values = _unpacked(data)
                d, tf = _postings(values)
                part = tf * (k1 + 1.0) / (tf + norm[d])
                for x in pairs:
                    at = scores.setdefault(x["q"], np.zeros(len(first)))
                    np.add.at(at, number[d], x["w"] * part)
        out = []
        for x, s in scores.items():
            some = np.flatnonzero(s > 0)
            rounded = np.round(s[some], 6)
            if len(some) > k:
                keep = rounded >= -np.partition(-rounded, k - 1)[k - 1]
                some, rounded = some[keep], rounded[keep]
            found = sorted(((float(r), keys[first[i]]) for r, i in zip(rounded, some)), key=lambda y: (-y[0], y[1] is not None, y[1]))[:k]
            out += [(x, y, r) for r, y in found]
        return pd.DataFrame(out, columns=[qkey, key, "score"])

    scored = asked.groupBy("segment").cogroup(listed.groupBy("of")).applyInPandas(best, schema)
    return R.top_k(scored, [qkey], [F.desc("score"), F.asc(key)], k)


def write_vectors(df: DataFrame, key: str, vector: str, path: str, cells: int = 16) -> None:
    """A vector table partitioned by cell, written to a new versioned path; readers switch by path."""
    df.withColumn("cell", F.pmod(F.xxhash64(key), F.lit(cells)).cast("int")).write.mode("errorifexists").partitionBy("cell").parquet(path)
