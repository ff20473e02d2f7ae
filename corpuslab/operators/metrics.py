"""Scores of a (label, prediction) table, all derived from its confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per pair of label and prediction; the only pass over the predictions."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def f_measure(precision: Column, recall: Column, beta: float = 1.0) -> Column:
    b2 = beta * beta
    return _ratio((1 + b2) * precision * recall, b2 * precision + recall)


def accuracy(confusion: DataFrame) -> DataFrame:
    """Share of right predictions; with one label per row this is also overall
    precision, recall and F1."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)))
    return confusion.agg((right / F.sum("n")).alias("accuracy"))


def test_error(confusion: DataFrame) -> DataFrame:
    return accuracy(confusion).select((1 - F.col("accuracy")).alias("test_error"))


def overall(confusion: DataFrame) -> DataFrame:
    value = F.col("accuracy")
    return accuracy(confusion).select(
        value.alias("accuracy"), value.alias("precision"), value.alias("recall"), value.alias("f1")
    )


def per_class(confusion: DataFrame) -> DataFrame:
    """Counts and scores of every class that occurs as a label.

    Each confusion count is given to its label and to its prediction, so one
    aggregation replaces joins of three count tables.
    """
    right = F.col("label") == F.col("prediction")
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"), F.when(right, F.col("n")).otherwise(none).alias("tp"),
            F.col("n").alias("n_label"), none.alias("n_predicted"),
        ),
        F.struct(
            F.col("prediction").alias("class"), none.alias("tp"), none.alias("n_label"),
            F.col("n").alias("n_predicted"),
        ),
    )
    counts = (
        confusion.select(F.inline(sides))
        .groupBy("class")
        .agg(F.sum("tp").alias("tp"), F.sum("n_label").alias("n_label"),
             F.sum("n_predicted").alias("n_predicted"))
    )
    # One row per class from here on.
    total = F.sum("n_label").over(Window.partitionBy())
    scored = counts.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("n_predicted")),
            "recall": _ratio(F.col("tp"), F.col("n_label")),
            "false_positive_rate": _ratio(
                F.col("n_predicted") - F.col("tp"), total - F.col("n_label")
            ),
        }
    )
    return scored.withColumn("f1", f_measure(F.col("precision"), F.col("recall"))).where(
        F.col("n_label") > 0
    )


def weighted(classes: DataFrame, beta: float = 0.5) -> DataFrame:
    """Averages over the rows of ``per_class``, weighted by the share of each label."""
    def mean(value: Column) -> Column:
        return F.sum(F.col("n_label") * value) / F.sum("n_label")

    recall = mean(F.col("recall"))
    return classes.agg(
        recall.alias("weighted_recall"),
        mean(F.col("precision")).alias("weighted_precision"),
        mean(F.col("f1")).alias("weighted_f1"),
        mean(f_measure(F.col("precision"), F.col("recall"), beta)).alias("weighted_f_beta"),
        mean(F.col("false_positive_rate")).alias("weighted_fpr"),
        recall.alias("weighted_tpr"),
    )
