"""Cleaning and segmentation of page text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from stratalex.functions.text import c

_CHUNK = Ty.ArrayType(Ty.StructType([Ty.StructField("start", Ty.IntegerType()), Ty.StructField("end", Ty.IntegerType())]))
#: Separators of the recursive splitter, strongest first.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")


def split_recursively(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size`, cut at the strongest separator that does it, each piece keeping its separator."""
    if len(text) <= size:
        return [text] if text else []
    sep, rest = separators[0], separators[1:]
    if sep == "":
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = re.split(f"(?<={re.escape(sep)})", text)
    out: list[str] = []
    for p in parts:
        if len(p) > size:
            out.extend(split_recursively(p, size, rest))
        elif p:
            out.append(p)
    return out


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most `size` made of whole pieces, each beginning with pieces of the last one that fit the overlap."""
    pieces = split_recursively(text, max(1, size - overlap))
    spans: list[tuple[int, int]] = []
    ends, at = [], 0
    for p in pieces:
        at += len(p)
        ends.append(at)
    starts = [0, *ends[:-1]]
    i = 0
    while i < len(pieces):
        j = i
        while j + 1 < len(pieces) and ends[j + 1] - starts[i] <= size:
            j += 1
        spans.append((starts[i], ends[j]))
        if j + 1 >= len(pieces):
            break
        k = j + 1
        while k - 1 > i and ends[j] - starts[k - 1] <= overlap:
            k -= 1
        i = k
    return spans


def recursive_chunks(text: str, size: int = 320, overlap: int = 64) -> Column:
    """Array of (start, end) of the recursive splitter."""

    @F.pandas_udf(_CHUNK)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": a, "end": b} for a, b in chunk_spans(t, size, overlap)] if t else [])

    return run(c(text))


_STARTS = re.compile("^(?:[●○•\\-]\\s*|第[一二三四五六七八九十百0-9]+[章节篇部]|[一二三四五六七八九十]+、)")
_ENDS = re.compile("[。！？!?.…”」』）)]$")


def lines_to_paragraphs(text: str, least: int = 35) -> list[str]:
    """Lines of a page as paragraphs: a heading or bullet begins one; a closed sentence ends one that is long enough."""
    out: list[str] = []
    cur: list[str] = []
    size = 0
    for raw in text.splitlines():
        line = "".join(raw.split())
        if not line:
            continue
        if cur and _STARTS.match(line):
            out.append("".join(cur))
            cur, size = [], 0
        cur.append(line)
        size += len(line)
        if size >= least and _ENDS.search(line):
            out.append("".join(cur))
            cur, size = [], 0
    if cur:
        out.append("".join(cur))
    return out


@F.pandas_udf(Ty.ArrayType(Ty.StringType()))
def page_paragraphs(s: pd.Series) -> pd.Series:
    return s.map(lambda t: lines_to_paragraphs(t) if t else [])


def page_class(text: str) -> Column:
    """blank, toc (numbered and dotted lines weigh at least 4), title_page (short, no sentence) or body."""
    t = c(text)
    lines = F.split(t, "\n")
    numbered = F.size(F.filter(lines, lambda x: x.rlike("[0-9]+\\s*$") & (F.length(x) < 60)))
    dotted = F.size(F.filter(lines, lambda x: x.rlike("…{2,}|\\.{4,}")))
    return (
        F.when(F.trim(t) == "", "blank").when(numbered + 2 * dotted >= 4, "toc").when((F.length(t) < 30) & ~t.rlike("[。！？.!?]"), "title_page").otherwise("body")
    )


def clean_toc_line(x: str) -> Column:
    """Leader dots and runs of blanks as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(c(x), "[.…·]{2,}", " "), "\\s+", " "))


def clean_title(x: str) -> Column:
    """Cut at leader dots, bullets off the front."""
    return F.trim(F.regexp_replace(F.regexp_replace(c(x), "[.…·]{2,}.*$", ""), "^[\\s●○•\\-*]+", ""))


def title_kind(x: str) -> Column:
    return F.when(c(x).rlike("^致.*信"), "letter").when(c(x).rlike("(目录|注释|索引)$"), "non_body").otherwise("article")


def margin_lines(df: DataFrame, key: str, text: str, reach: int = 3) -> DataFrame:
    """(key, pos, region, line): the first and last lines of each page as candidates for heads and feet."""
    x = df.select(key, F.split(text, "\n").alias("l")).select(key, F.size("l").alias("n"), F.posexplode("l").alias("pos", "line"))
    region = F.when(F.col("pos") < reach, "head").when(F.col("pos") >= F.col("n") - reach, "foot")
    return x.withColumn("region", region).filter("region is not null and trim(line) <> ''").select(key, "pos", "region", "line")


def page_candidates(df: DataFrame, key: str, text: str, pdf: str) -> DataFrame:
    """(key, pos, how, page, plausible): numbers that stand alone in a line or at one of its edges."""
    x = df.select(key, pdf, F.posexplode(F.split(text, "\n")).alias("pos", "x")).withColumn("x", F.translate(F.trim("x"), "０１２３４５６７８９", "0123456789"))
    how = F.when(F.col("x").rlike("^[-—·\\[\\s]*[0-9]{1,4}[-—·\\]\\s]*$"), "line").when(F.col("x").rlike("^[0-9]{1,4}[　 ·]"), "left").when(F.col("x").rlike("[　 ][0-9]{1,4}$"), "right")
    k = x.withColumn("how", how).filter("how is not null")
    number = F.when(F.col("how") == "right", F.regexp_extract("x", "([0-9]{1,4})$", 1)).otherwise(F.regexp_extract("x", "([0-9]{1,4})", 1)).cast("int")
    return k.withColumn("page", number).filter("page between 1 and 1200").select(key, "pos", "how", "page", (F.col(pdf) - F.col("page")).between(-80, 220).alias("plausible"))


def toc_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, grp, entry): title lines gathered up to the line that ends with a page number."""
    x = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "x")).withColumn("x", F.trim("x")).filter("x <> ''")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    e = x.withColumn("ends", F.col("x").rlike("[0-9]+\\s*$")).withColumn("grp", F.coalesce(F.sum(F.when(F.col("ends"), 1).otherwise(0)).over(w), F.lit(0)))
    g = e.groupBy(key, "grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]), " ").alias("entry"), F.max("ends").alias("ends"))
    return g.filter("ends").select(key, "grp", "entry")
