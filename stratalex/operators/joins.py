"""Joins of the retrieval pipeline: windows of neighbours, enrichment by intervals, containment, hybrid merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from stratalex.functions import text as T
from stratalex.operators import intervals as I
from stratalex.operators import ranking as R
from stratalex.session import cut

#: Repeated keys up to which their hashes, 8 bytes each, are sent to all tasks.
REPEATED_KEYS = 1_200_000


def neighbour_windows(hits: DataFrame, paragraphs: DataFrame, source: str, index: str, key: str, text: str, reach: int) -> DataFrame:
    """(hit, n_parts, window_text, first_index, last_index): the paragraphs within `reach` of each hit, joined by blank lines.

    The range condition becomes an equi-join on (source, index): each hit asks for 2 * reach + 1 indexes.
    """
    ask = hits.select(F.col(key).alias("hit"), source, F.explode(F.sequence(F.col(index) - reach, F.col(index) + reach)).alias(index))
    p = paragraphs.select(source, index, F.col(key).alias("_k"), F.coalesce(text, F.lit("")).alias("_t"))
    parts = ask.join(p, [source, index]).groupBy("hit").agg(F.array_sort(F.collect_list(F.struct(index, "_k", "_t"))).alias("p"))
    return parts.select(
        "hit", F.size("p").alias("n_parts"), F.array_join(F.transform("p", lambda x: x["_t"]), "\n\n").alias("window_text"),
        F.element_at("p", 1)[index].alias("first_index"), F.element_at("p", -1)[index].alias("last_index"),
    )


def narrowest_interval(points: DataFrame, intervals: DataFrame, key: str, on: str, point: Column, start: str, end: str, tie: list[Column], how: str = "left") -> DataFrame:
    """Each point with the narrowest interval that holds it; ties by start, then `tie`."""
    found = I.interval_join(points, I.dimension(intervals), on, point, start, end, how="inner")
    best = R.first_per(found, [key], [(F.col(end) - F.col(start)).asc(), F.asc(start), *tie])
    extra = [c for c in best.columns if c not in points.columns]
    return points.join(best.select(key, *extra), key, how)


def containing(large: DataFrame, text: str, small: DataFrame, needle: str, block: int = I.DIMENSION_ROWS) -> DataFrame:
    """The rows of large joined to those of small whose needle their text contains.

    One Aho-Corasick automaton over all needles reads each text once, in Arrow batches and without a shuffle, so the work
    grows with the texts, not with texts times needles. The needles go out in blocks of at most `block`, one pass
    each. Null and empty needles and null texts match nothing; column names must not clash.
    """
    import pyarrow as pa

    rows: list = []
    out: DataFrame | None = None
    spark = large.sparkSession

    def against(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast([r[needle] for r in rows])
        names = large.columns
        at = names.index(text)

        def search(batches):
            import ahocorasick

            places: dict[str, list[int]] = {}
            for i, x in enumerate(sent.value):
                places.setdefault(x, []).append(i)
            automaton = ahocorasick.Automaton()
            for x, i in places.items():
                automaton.add_word(x, i)
            if places:
                automaton.make_automaton()
            for batch in batches:
                found = []
                for t in batch.column(at).to_pylist():
                    seen: set[int] = set()
                    if t and places:
                        for _, i in automaton.iter(t):
                            seen.update(i)
                    found.append(sorted(seen))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*names, "_needles"])

        schema = StructType([*large.schema.fields, StructField("_needles", ArrayType(IntegerType()))])
        numbered = StructType([StructField("_needle", IntegerType()), *small.schema.fields])
        held = large.mapInArrow(search, schema).withColumn("_needle", F.explode("_needles")).drop("_needles")
        return held.join(F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], numbered)), "_needle").drop("_needle")

    for r in small.filter(F.length(needle) > 0).toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            part = against(rows)
            out = part if out is None else out.unionByName(part)
            rows = []
    if rows or out is None:
        part = against(rows)
        out = part if out is None else out.unionByName(part)
    return out


def gram_candidates(pages: DataFrame, page: str, text: Column, quotes: DataFrame, quote: str, needle: Column, top: int) -> DataFrame:
    """(quote, page, shared, rank): pages by the number of distinct Han bigrams they share with each quote.

    The join with the bigrams of the quotes, a side of checked size, cuts the exploded pages before anything is shuffled.
    """
    q = I.dimension(quotes.select(F.col(quote), F.explode(T.han_bigrams(needle)).alias("g")))
    p = pages.select(F.col(page), T.exploded(T.han_bigrams(text), "g"))
    n = p.join(q, "g").groupBy(quote, page).agg(F.count("*").alias("shared"))
    return R.top_k(n, [quote], [F.desc("shared"), F.asc(page)], top)


def hybrid_merge(dense: DataFrame, sparse: DataFrame, query: str, doc: str, both: float = 1.15, alone: float = 0.72) -> DataFrame:
    """Two ranked lists merged: 1/(60+dense rank) + w/(55+sparse rank), w larger where both lists have the row."""
    m = dense.select(query, doc, F.col("rank").alias("dense_rank")).join(sparse.select(query, doc, F.col("rank").alias("sparse_rank")), [query, doc], "full")
    w = F.when(F.col("dense_rank").isNotNull(), both).otherwise(alone)
    score = F.coalesce(1.0 / (60 + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(w / (55 + F.col("sparse_rank")), F.lit(0.0))
    tag = F.when(F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull(), "fused").when(F.col("sparse_rank").isNotNull(), "sparse").otherwise("dense")
    return m.select(query, doc, "dense_rank", "sparse_rank", F.round(score, 6).alias("score"), tag.alias("tag"))


def nearest(points: DataFrame, targets: DataFrame, key: str, on: str, value: str, target: str, other: str, reach: int = 3) -> DataFrame:
    """Each point with the nearest target of its key within `reach`; ties to the smaller target, then the smaller other column."""
    found = I.nearest_within(points, targets.select(on, target, other), on, value, target, reach)
    return R.first_per(found, [key], [F.abs(F.col(value) - F.col(target)).asc(), F.asc(target), F.asc(other)])


def enclosing(entries: DataFrame, key: str, on: str, start: str, end: str) -> DataFrame:
    """(key, parent): the smallest strictly wider interval of the same source that contains each interval; null at the top."""
    outer = entries.select(F.col(key).alias("parent"), F.col(on).alias("_on"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    inside = (F.col(on) == F.col("_on")) & (F.col("_s") <= F.col(start)) & (F.col("_e") >= F.col(end)) & (F.col("_e") - F.col("_s") > F.col(end) - F.col(start))
    found = R.first_per(entries.join(I.dimension(outer), inside), [key], [(F.col("_e") - F.col("_s")).asc(), F.asc("_s"), F.asc("parent")])
    return entries.select(key).join(found.select(key, "parent"), key, "left")


def levels(parents: DataFrame, key: str, passes: int = 4, cap: int = 6) -> DataFrame:
    """(key, level): 1 at the top, else the parent's level + 1, for at most `passes` steps up, capped."""
    at = parents.select(F.col(key), F.col("parent").alias("up"), F.lit(1).alias("level"))
    step = parents.select(F.col(key).alias("_k"), F.col("parent").alias("_up"))
    for _ in range(passes):
        at = at.join(step, F.col("up") == F.col("_k"), "left").select(key, F.col("_up").alias("up"), (F.col("level") + F.when(F.col("_k").isNotNull(), 1).otherwise(0)).alias("level"))
    return at.select(key, F.least("level", F.lit(cap)).alias("level"))


def known_only_once(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the keys that have exactly one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).filter("_n = 1").drop("_n")


def split_repeated(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key no other row has, all other rows): only hashes of the keys are shuffled to tell them apart.

    Different keys of one hash are among the others. Where more than REPEATED_KEYS keys are repeated, all rows are, so that
    whatever groups the others moves each row once at most.
    """
    held = df.withColumn("_key", F.xxhash64(key, F.isnull(key)))
    again = cut(held.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"))
    if again.limit(REPEATED_KEYS + 1).count() > REPEATED_KEYS:
        return df.filter(F.lit(False)), df
    again = F.broadcast(again)
    return held.join(again, "_key", "left_anti").drop("_key"), held.join(again, "_key", "left_semi").drop("_key")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row of each key, as dropDuplicates keeps it; only the rows of repeated keys are shuffled."""
    alone, others = split_repeated(df, key)
    return alone.unionByName(others.dropDuplicates([key]))
