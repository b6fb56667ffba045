"""Small trainable classifiers on feature vectors, and their blend with rule scores."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_by_hash(df: DataFrame, key: str, test_part: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the hash of their key: the same split on every run and any partitioning."""
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10_000))
    cutoff = int(test_part * 10_000)
    return df.filter(h >= cutoff), df.filter(h < cutoff)


def fitted(df: DataFrame, vector: str, label: str, c: float = 1.0, rows: int = 200_000):
    """A multinomial logistic regression on at most `rows` labelled rows (chosen by hash); regularized as 1 / (C n)."""
    few = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("label")).orderBy(F.xxhash64("v")).limit(rows)
    data = few.select(array_to_vector("v").alias("features"), "label")
    n = max(1, data.count())
    return LogisticRegression(regParam=1.0 / (c * n), maxIter=60, standardization=False).fit(data)


def predicted(model, df: DataFrame, vector: str) -> DataFrame:
    """The rows with `prediction` and `probability` (array)."""
    x = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return model.transform(x).withColumn("probability", vector_to_array("probability")).drop("features", "rawPrediction")


def blended(model: Column, rules: Column, weight: float = 0.6) -> Column:
    return weight * model + (1 - weight) * rules


def f1_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, support, precision, recall, f1) of each class, from one grouped count."""
    n = df.groupBy(F.col(label).cast("int").alias("l"), F.col(prediction).cast("int").alias("p")).agg(F.count("*").alias("n"))
    true = n.groupBy(F.col("l").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = n.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    r = true.join(said, "label", "left").na.fill(0)
    precision, recall = F.try_divide(F.col("hit"), F.col("said")), F.col("hit") / F.col("support")
    p, q = F.coalesce(precision, F.lit(0.0)), recall
    return r.select("label", "support", F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0)), 6).alias("f1"))
