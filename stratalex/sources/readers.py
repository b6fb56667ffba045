"""Readers: page caches, JSON lines, catalogs, event logs; all with declared schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_FIELDS = "raw_text string, cleaned_text string, page_type string, title string, author string, reasons array<string>"


def page_texts(spark: SparkSession, root: str) -> DataFrame:
    """(source, page, path, text) of the page files root/<source>/page_N.txt, N compared as a number."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "page_*.txt").text(root).withColumn("path", F.input_file_name())
    return _placed(files).select("source", "page", "path", F.col("value").alias("text"))


def page_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(source, page, fields…) of the JSON files beside the page texts; a corrupt file gives a row of nulls."""
    read = spark.read.schema(PAGE_FIELDS + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true")
    files = read.option("pathGlobFilter", "page_*.json").json(root).withColumn("path", F.input_file_name())
    names = [x.split()[0] for x in PAGE_FIELDS.split(", ")]
    return _placed(files).filter(F.col("_corrupt_record").isNull()).select("source", "page", *names)


def _placed(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumn("source", F.url_decode(F.regexp_extract(path, "([^/]+)/page_[0-9]+\\.[a-z]+$", 1))).withColumn("page", F.regexp_extract(path, "page_([0-9]+)\\.[a-z]+$", 1).cast("int"))


def pages_with_fallback(spark: SparkSession, root: str) -> DataFrame:
    """(source, page, text, page_type, from_sidecar): the sidecar's text where there is one, else the cleaned raw text."""
    raw, side = page_texts(spark, root), page_sidecars(spark, root)
    j = raw.join(side, ["source", "page"], "left")
    text = F.coalesce("cleaned_text", F.trim(F.regexp_replace("text", "[ \\t]+", " ")))
    return j.select("source", "page", text.alias("text"), F.coalesce("page_type", F.lit("unknown")).alias("page_type"), F.col("cleaned_text").isNotNull().alias("from_sidecar"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file or folder; malformed lines are dropped, or fail the read if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A nested catalog document; entries that are switched off are left out."""
    c = spark.read.schema(schema).option("multiLine", "true").json(path)
    return c.filter(F.coalesce("active", F.lit(True))) if "active" in c.columns else c


def extracted(files: DataFrame, extractor: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Pages of binary files (path, content) by an injected extractor, e.g. of a PDF or OCR library.

    No such library is part of this package: the extractor gives one dict per page in the given schema.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = extractor(bytes(content))
                if rows:
                    yield pd.DataFrame(rows).assign(path=path)

    return files.select("path", "content").mapInPandas(run, "path string, " + schema)


def band(center_y: str, height: str, part: float = 0.12):
    """head, foot or body of a page, by the height of a box's centre."""
    return F.when(F.col(center_y) <= F.col(height) * part, "head").when(F.col(center_y) >= F.col(height) * (1 - part), "foot").otherwise("body")


def digit_place(center_x: str, width: str, page: str):
    """margin, inner or outer place of a number box, and whether it suits the page's parity."""
    r = F.col(center_x) / F.col(width)
    place = F.when(r < 0.12, "margin").when(r < 0.75, "inner").otherwise("outer")
    return F.struct(place.alias("place"), ((F.col(page) % 2 == 1) == (r >= 0.5)).alias("suits_parity"))
