"""The queries of the training-text operators over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm import leakage, lookalikes, near_duplicates, oracles, packing, scan_noise, sentences, shared_spans, splitting, truncation
from stratalex.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "records"), "paragraph_id", "paragraph_text", "retrieval_unit")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).select("paragraph_id").distinct()


def p2_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = table(spark, sf_dir, "core_classics").select(F.explode("quotes").alias("quote"))
    return shared_spans.shared_text(table(spark, sf_dir, "records"), "paragraph_id", "paragraph_text", quotes, "quote")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_shared(spark, sf_dir).filter(F.col("longest_span") >= shared_spans.LEAST).select("paragraph_id").distinct()


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.without_shared(table(spark, sf_dir, "records"), "paragraph_id", "paragraph_text")


def _lookalikes(spark: SparkSession, sf_dir: str, canonical: bool) -> DataFrame:
    records = table(spark, sf_dir, "records")
    texts = lookalikes.lookalike_texts(records, "paragraph_id", "paragraph_text", canonical)
    titles = lookalikes.lookalike_titles(records, "paragraph_id", "article", "source", table(spark, sf_dir, "article_map"), canonical)
    return texts.withColumn("field_name", F.lit("paragraph_text")).unionByName(titles.withColumn("field_name", F.lit("article")))


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookalikes(spark, sf_dir, True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookalikes(spark, sf_dir, False).distinct()


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "records").filter("page_type = 'body'"), "paragraph_id", "paragraph_text").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = table(spark, sf_dir, "records").filter("page_type = 'body'")
    words = sentences.corpus_words(body, "paragraph_text")
    layer = body.filter("text_source = 'pdf_text_layer'")  # as p4_found is defined
    return sentences.sentences(layer, "paragraph_id", "paragraph_text", words).select("paragraph_id", "end_pos").distinct()


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").filter("page_type = 'body'").withColumn("scanned", F.col("text_source").isNull() | (F.col("text_source") != "pdf_text_layer"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_noise.marked(_body(spark, sf_dir), "paragraph_id", "paragraph_text", "source", ["book", "section", "article"], "scanned")
    return found.distinct()


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan_noise.marked(_body(spark, sf_dir), "paragraph_id", "paragraph_text", "source", ["book", "section", "article"], "scanned", lines=True)
    return scan_noise.paragraphs(lines, "paragraph_id")


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_pairs(table(spark, sf_dir, "records"), "paragraph_id", "paragraph_text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pairs(spark, sf_dir).select("paragraph_id_a", "paragraph_id_b").distinct()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf_dir, "records"), "paragraph_id", "paragraph_text")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p7_packed(spark, sf_dir))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = leakage.item_quotes(table(spark, sf_dir, "eval_items"))
    return leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", quotes)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_cut(spark, sf_dir).filter("cut").select("doc_id").distinct()


def p9_share_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.share_by_source(p9_cut(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_shared, p2_cleaned, p3_found, p3_canonical, p4_found, p4_sentences, p5_found, p5_paragraphs, p6_found, p6_pairs, p6_groups, p7_packed, p7_fill, p8_found, p8_leaks, p9_found, p9_cut, p9_share_by_source)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
