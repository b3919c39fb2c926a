"""Confusion matrices and precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pairs: DataFrame) -> DataFrame:
    """actual, predicted, n. pairs: actual, predicted."""
    return pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def precision_recall(matrix: DataFrame) -> DataFrame:
    """class, true_positive, false_positive, false_negative, precision, recall, f1; class null sums all."""
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.select(F.col("actual").alias("class"), right.alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("n") - right).alias("fn"))
    rows = rows.unionByName(matrix.select(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("tp"), (F.col("n") - right).alias("fp"), F.lit(0).cast("long").alias("fn")))
    summed = rows.rollup("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return summed.select("class", tp.cast("long").alias("true_positive"), fp.cast("long").alias("false_positive"), fn.cast("long").alias("false_negative"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


#: What `rated` gives for each row of counts.
RATED = ("true_positive", "false_positive", "false_negative", "precision", "recall", "f1")


def rated(counts: DataFrame) -> DataFrame:
    """counts (true_positive, false_positive, false_negative) with precision, recall and f1, zero where there is nothing to divide by."""
    tp, fp, fn = (F.col(c) for c in RATED[:3])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def slot_counts(found: DataFrame, truth: DataFrame) -> DataFrame:
    """slot_name, true_positive, false_positive, false_negative by trimmed raw values. Both: id, slot_name, raw_value."""
    a = found.select("id", "slot_name", F.trim("raw_value").alias("raw_value")).distinct().withColumn("found", F.lit(1))
    b = truth.select("id", "slot_name", F.trim("raw_value").alias("raw_value")).distinct().withColumn("true", F.lit(1))
    both = a.join(b, ["id", "slot_name", "raw_value"], "full")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.groupBy("slot_name").agg(F.sum(is_("found") * is_("true")).alias("true_positive"), F.sum(is_("found") * (1 - is_("true"))).alias("false_positive"), F.sum((1 - is_("found")) * is_("true")).alias("false_negative"))
