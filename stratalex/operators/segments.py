"""Chunking, packing and ordered-state operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(n: Column, size: int, overlap: int) -> Column:
    """(start, end) pairs of fixed windows over n code points; the last one ends at the end."""
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))
    return F.when(n > 0, made)


def chunked(df: DataFrame, key: str, text: str, size: int = 320, overlap: int = 64) -> DataFrame:
    """(key, child_index, child_total, start, end, chunk): windows of each text, as an explode without any shuffle."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    w = df.select(F.col(key), F.col(text).alias("_t"), windows(F.length(F.col(text)), size, overlap).alias("_w"))
    e = w.select(key, "_t", F.size("_w").alias("child_total"), F.posexplode("_w").alias("child_index", "_s"))
    start, end = F.col("_s.start"), F.col("_s.end")
    return e.select(key, "child_index", "child_total", start.alias("start"), end.alias("end"), F.substring("_t", start + 1, end - start).alias("chunk"))


def packed_parents(df: DataFrame, key: list[str], page: str, order: list[str], text: str, most: int) -> DataFrame:
    """Paragraphs packed into parents: a new parent on a page gap over 1 or when the running length would pass `most`.

    Gaps are window islands; the running length is a fold, which streams over rows sorted within partitions, so that no
    group is held in memory.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    island = F.sum(F.when(F.col(page) - F.lag(page).over(w) > 1, 1).otherwise(0)).over(w)
    rows = df.withColumn("island", island).withColumn("_n", F.length(text))
    group = [*key, "island"]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "_n") + ", parent_no int"

    def pack(batches):
        last, parent, size = None, 0, 0
        for pdf in batches:
            parents = []
            for *k, n in pdf[[*group, "_n"]].itertuples(index=False, name=None):
                k = tuple(None if x != x else x for x in k)
                if k != last:
                    last, parent, size = k, 0, 0
                n = 0 if n != n else int(n)
                if size and size + n > most:
                    parent, size = parent + 1, 0
                size += n
                parents.append(parent)
            out = pdf.drop(columns="_n")
            out["parent_no"] = parents
            yield out

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(pack, schema)


def filled_pages(df: DataFrame, source: str, pdf: str, printed: str, trusted: str, gap: int = 3, run: int = 3) -> DataFrame:
    """Printed page numbers filled and corrected in page order.

    A missing number within `gap` pages of the last trusted one is counted on from it; an untrusted number that departs
    from a run of at least `run` agreeing pages is replaced. The run length is carried along, so this is a fold per source.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", page int, how string"

    def fold(pdf_: pd.DataFrame) -> pd.DataFrame:
        pdf_ = pdf_.sort_values([pdf], kind="stable")
        out, how = [], []
        last_pdf = last_page = None
        streak = 0
        for at, value, sure in zip(pdf_[pdf], pdf_[printed], pdf_[trusted]):
            step = at - last_pdf if last_pdf is not None else None
            expected = last_page + step if step is not None else None
            if pd.isna(value):
                if expected is not None and 0 < step <= gap:
                    page, kind = int(expected), "filled"
                else:
                    out.append(None)
                    how.append("unknown")
                    continue
            else:
                page, kind = int(value), "read"
                if expected is not None and step <= gap and page != expected:
                    if not sure and streak >= run:
                        page, kind = int(expected), "corrected"
                    else:
                        streak = 0
            streak = streak + 1 if kind != "read" or expected is None or page == expected else 1
            last_pdf, last_page = at, page
            out.append(page)
            how.append(kind)
        pdf_ = pdf_.copy()
        pdf_["page"] = pd.array(out, dtype="Int32")
        pdf_["how"] = how
        return pdf_

    return df.groupBy(source).applyInPandas(fold, schema)


def sentence_packed(text: Column, most: int) -> Column:
    """Sentences, closing mark kept, joined while they fit `most`; a longer sentence is cut hard."""
    parts = F.filter(F.split(text, "(?<=[。！？；;!?])"), lambda s: F.length(s) > 0)
    hard = F.flatten(
        F.transform(parts, lambda s: F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / most).cast("int") - 1), lambda i: F.substring(s, i * most + 1, F.lit(most))))
    )

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when(F.size(acc) == 0, F.array(s)).when(
            F.length(last) + F.length(s) <= most, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, s)))
        ).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(hard, F.array().cast("array<string>"), step)
