"""Operators next to the sources: gates, parsing, manifests, map merging and link harvesting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_gate(df: DataFrame, source: str, order: list[str], page_type: str, text: str, least: int = 20) -> DataFrame:
    """Rows of toc and title pages and short rows dropped; the last title page's text carried forward as title_context."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col(page_type) == "title_page", F.trim(text)), ignorenulls=True).over(w)
    return df.withColumn("title_context", title).filter(~F.col(page_type).isin("toc", "title_page") & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= least))


def parse_jsonl(lines: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines (value) as rows; blank and malformed lines are skipped, or fail the query if strict."""
    kept = lines.filter(F.trim("value") != "")
    first = schema.split()[0]
    if strict:
        return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("j")).select("j.*")
    return kept.select(F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j")).select("j.*").filter(
        F.col("_corrupt_record").isNull() & F.col(first).isNotNull()
    ).drop("_corrupt_record")


def manifest(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Rows, bytes and an order-free digest per group: sums of partial hashes, combined before the shuffle."""
    t = F.coalesce(text, F.lit(""))
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(key), t), 256), 1, 8), 16, 10).cast("long")
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.octet_length(t)).cast("long").alias("bytes"), F.sum(part).alias("digest"))


def first_wins(maps: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first map that has a key."""
    united = reduce(lambda a, b: a.unionByName(b), [m.withColumn("prio", F.lit(i)) for i, m in enumerate(maps)])
    return united.withColumn("_least", F.min("prio").over(Window.partitionBy(key))).filter("prio = _least").drop("_least")


def links(pages: DataFrame, html: str, base: str, suffix: str) -> DataFrame:
    """(…, url): the targets of links that end in a suffix, relative ones resolved against the base."""
    root = "/".join(base.split("/")[:3])
    href = F.explode(F.regexp_extract_all(html, F.lit('(?i)<a\\s[^>]*href="([^"]*)"'), F.lit(1)))
    out = pages.withColumn("href", href).filter(F.lower("href").endswith(suffix))
    url = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(F.lit(root), "href")).otherwise(F.concat(F.lit(base), "href"))
    return out.select(*[x for x in pages.columns if x != html], url.alias("url"))
