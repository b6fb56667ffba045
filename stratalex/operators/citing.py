"""Citations: rendering, evidence cards, extraction, audit and repair; and rule scoring of questions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from stratalex.functions import text as T
from stratalex.functions.text import c
from stratalex.operators import ranking as R


def rendered(book: Column, article: Column, printed: Column, citation: Column, pdf: Column) -> Column:
    """《book》, article, page: the printed page, else the citation page, else the page of the file."""
    page = F.when(printed.isNotNull(), F.concat(F.lit("第"), printed.cast("string"), F.lit("页"))).when(citation.isNotNull(), F.concat(F.lit("第"), citation.cast("string"), F.lit("页"))).when(
        pdf.isNotNull(), F.concat(F.lit("PDF第"), pdf.cast("string"), F.lit("页"))
    )
    return F.concat_ws("，", F.concat(F.lit("《"), book, F.lit("》")), F.nullif(F.trim(article), F.lit("")), page)


def evidence_cards(ranked: DataFrame, query: str, rank: str, text: str, same: list[str], limit: int = 12, width: int = 80) -> DataFrame:
    """Cards of unique evidence (same columns and the first `width` characters), numbered after de-duplication."""
    x = ranked.withColumn("excerpt", F.substring(F.coalesce(text, F.lit("")), 1, width))
    one = R.first_per(x, [query, *same, "excerpt"], [F.asc(rank)])
    return R.top_k(one, [query], [F.asc(rank)], limit, "card_no")


def cited_pages(answer: Column) -> Column:
    """The distinct page numbers that an answer cites, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("第([0-9]+)页"), F.lit(1)), lambda x: x.cast("int")))


def cited_refs(answer: Column) -> Column:
    """The distinct numbers of evidence references [En], in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit("\\[E([0-9]+)\\]"), F.lit(1)), lambda x: x.cast("int")))


def audited(answers: DataFrame, query: str, answer: str, evidence: DataFrame, page: str, card: str) -> DataFrame:
    """(query, issues): references beyond the evidence, cited pages that no evidence has, and forbidden marks."""
    e = evidence.groupBy(query).agg(F.collect_set(page).alias("_pages"), F.max(card).alias("_n"))
    x = answers.join(e, query, "left")
    pages = F.coalesce("_pages", F.array().cast("array<int>"))
    issues = F.array_compact(
        F.array(
            F.when(F.exists(cited_refs(c(answer)), lambda r: r > F.coalesce("_n", F.lit(0))), "ref_out_of_range"),
            F.when(F.size(F.array_except(cited_pages(c(answer)), pages)) > 0, "page_not_in_evidence"),
            F.when(c(answer).rlike("\\[(?:来源|source)[^\\]]*\\]"), "forbidden_mark"),
        )
    )
    return x.select(query, F.array_join(issues, ",").alias("issues"))


@F.pandas_udf(Ty.StringType())
def _repair(answer: pd.Series, cards: pd.Series) -> pd.Series:
    def one(text: str | None, known) -> str | None:
        if text is None:
            return None
        known = list(known) if known is not None else []

        def sub(m: re.Match) -> str:
            i = int(m.group(1))
            return f"（{known[i - 1]}）" if 1 <= i <= len(known) else ""

        body = re.sub(r"\[E([0-9]+)\]", sub, text)
        body = re.sub(r"\[(?:来源|source)[^\]]*\]", "", body).rstrip()
        used = [k for k in dict.fromkeys(known) if f"（{k}）" in body]
        return body + ("\n\n" + "\n".join(f"{i}. {k}" for i, k in enumerate(used, 1)) if used else "")

    return pd.Series([one(a, k) for a, k in zip(answer, cards)])


def repaired(answer: Column, cards: Column) -> Column:
    """References replaced by the citations they stand for, unsupported ones dropped, a note section rebuilt."""
    return _repair(answer, cards)


def ibid_resolved(lines: DataFrame, query: str, pos: str, line: str) -> DataFrame:
    """Lines that only say "ibid" replaced by the last full citation line above them."""
    w = Window.partitionBy(query).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    is_ibid = F.trim(line).rlike("^(?:同上|ibid\\.?|注：同上。?)$")
    last = F.last(F.when(~is_ibid, c(line)), ignorenulls=True).over(w)
    return lines.withColumn(line, F.when(is_ibid, F.coalesce(last, c(line))).otherwise(c(line)))


def numbered_lines(ranked: DataFrame, query: str, rank: str, text: str, least: int = 2, most: int = 8, width: int = 60) -> DataFrame:
    """(query, answer): a numbered list of the best excerpts, for queries with at least `least` of them."""
    top = R.top_k(ranked, [query], [F.asc(rank)], most, "_i")
    line = F.concat(F.col("_i").cast("string"), F.lit(". "), T.preview(text, width))
    g = top.groupBy(query).agg(F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("l")))), lambda x: x["l"]), "\n").alias("answer"))
    return g.filter(F.col("_n") >= least).select(query, "answer")


def question_kind(x: Column, kinds: dict[str, list[str]], otherwise: str) -> Column:
    """The kind whose longest marker the text holds; ties to the kind named first."""
    pairs = [(m, k, i) for i, (k, ms) in enumerate(kinds.items()) for m in ms]
    rows = F.array(*[F.when(F.contains(x, F.lit(m)), F.struct(F.lit(-len(m)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k"))) for m, k, i in pairs])
    return F.coalesce(F.element_at(F.array_sort(F.array_compact(rows)), 1)["k"], F.lit(otherwise)) if pairs else F.lit(otherwise)


def additive_score(x: Column, rules: list[tuple[str, float]], floor: float = 0.0) -> Column:
    """Sum of the weights of the patterns that match, kept between floor and 1."""
    s = F.lit(0.0)
    for p, w in rules:
        s = s + F.when(x.rlike(p), w).otherwise(0.0)
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), s))
