"""Clustering quality from a contingency table; pairs are counted, never made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"), F.count("*").alias("clusters"))


def pairwise_f1(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1, cluster counts of rows (truth, predicted)."""
    cells = _pairs(rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))).select(F.col("pairs").alias("tp"))
    truth = _pairs(rows.groupBy("truth").agg(F.count("*").alias("n"))).select(F.col("pairs").alias("t"), F.col("clusters").alias("truth_clusters"))
    found = _pairs(rows.groupBy("predicted").agg(F.count("*").alias("n"))).select(F.col("pairs").alias("p"), F.col("clusters").alias("predicted_clusters"))
    total = rows.agg(F.count("*").alias("items"))
    one = cells.join(truth).join(found).join(total)  # four single rows
    one = one.withColumn("fp", F.col("p") - F.col("tp")).withColumn("fn", F.col("t") - F.col("tp"))
    one = one.withColumn("tn", F.expr("items * (items - 1) div 2") - F.col("tp") - F.col("fp") - F.col("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    one = one.withColumn("precision", ratio(F.col("tp"), F.col("p"))).withColumn("recall", ratio(F.col("tp"), F.col("t")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return one.select("items", "tp", "fp", "fn", "tn", "precision", "recall", f1.alias("f1"), "truth_clusters", "predicted_clusters")


def mapped(items: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """items (id, file) with the truth of their file (file, truth) and what was predicted for them (id, predicted); null
    where there is none. A file or id that repeats in truth or predicted counts with its least value."""
    t = truth.groupBy("file").agg(F.min("truth").alias("truth"))
    p = predicted.groupBy("id").agg(F.min("predicted").alias("predicted"))
    return items.join(t, "file", "left").join(p, "id", "left").select("id", "file", "truth", "predicted")


def mapping_counts(rows: DataFrame) -> DataFrame:
    """One row of mapped(): items, records that have both, missing_truth, and missing_prediction of those with a truth."""
    t, p = F.col("truth"), F.col("predicted")
    return rows.agg(F.count("*").alias("items"), F.count_if(t.isNotNull() & p.isNotNull()).alias("records"), F.count_if(t.isNull()).alias("missing_truth"), F.count_if(t.isNotNull() & p.isNull()).alias("missing_prediction"))


def size_histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))
