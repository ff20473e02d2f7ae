"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(key, label) for every key in a link; the label is the component's smallest key.

    Each round takes the smallest label among neighbours, then the label that this one had,
    so long chains halve. Nothing is collected but the number of rows that changed. Links are
    taken in both directions; repeated links and loops change nothing. No links: no rows.
    """
    both = links.select(F.col(a).alias("key"), F.col(b).alias("other")).union(
        links.select(F.col(b).alias("key"), F.col(a).alias("other")))
    labels = both.groupBy("key").agg(F.min("other").alias("least")).select(
        "key", F.least("key", "least").alias("label"))
    labels = materialize(labels, "component-labels")
    while True:
        around = both.join(labels.withColumnRenamed("key", "other"), "other").groupBy("key").agg(
            F.min("label").alias("near"))
        step = labels.join(around, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("new"))
        ahead = labels.select(F.col("key").alias("new"), F.col("label").alias("next"))
        step = materialize(step.join(ahead, "new").select("key", "old", F.col("next").alias("label")), "component-labels")
        labels = step.select("key", "label")
        if step.where("old <> label").isEmpty():
            return labels
