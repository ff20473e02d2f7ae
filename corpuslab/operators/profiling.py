"""Class balance: counts, shares, ranks, indexes and size tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.joins import lookup_join
from corpuslab.session import materialize

# How many classes, by descending size, form each tier.
TIER_SIZES = (5, 9, 13)
# Fixed value: rows shown by a table preview.
PREVIEW_ROWS = 20


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def class_counts(df: DataFrame, class_column: str) -> DataFrame:
    return df.groupBy(class_column).agg(F.count(F.lit(1)).alias("n"))


def sorted_counts(df: DataFrame, class_column: str, ascending: bool = False) -> DataFrame:
    """Class counts in order of size; names break ties."""
    counts = class_counts(df, class_column)
    by_size = F.col("n").asc() if ascending else F.col("n").desc()
    return counts.orderBy(by_size, F.col(class_column))


def extreme_classes(df: DataFrame, class_column: str, k: int = PREVIEW_ROWS,
                    largest: bool = True) -> DataFrame:
    return sorted_counts(df, class_column, ascending=not largest).limit(k)


def sql_class_counts(df: DataFrame, class_column: str, view: str) -> DataFrame:
    """The same counts through a temporary view and SQL text."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(
        f"SELECT {class_column}, count(*) AS n FROM {view} "
        f"GROUP BY {class_column} ORDER BY n, {class_column}"
    )


def preview(df: DataFrame, order_by: Sequence[str], k: int = PREVIEW_ROWS) -> DataFrame:
    return df.orderBy(*order_by).limit(k)


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct().orderBy(label)


def number_of_classes(df: DataFrame, class_column: str) -> DataFrame:
    return df.agg(F.count_distinct(class_column).alias("n_classes"))


def class_count_spread(df: DataFrame, class_column: str) -> DataFrame:
    return class_counts(df, class_column).agg(F.stddev_samp("n").alias("stddev_n"))


def class_table(df: DataFrame, class_column: str) -> DataFrame:
    """One row per class: count, share of all rows, index by descending count.

    The window has no partition key, but its input is the counted table, one
    row per class, and not the corpus.
    """
    everything = Window.partitionBy()
    by_size = Window.orderBy(F.col("n").desc(), F.col(class_column))
    return class_counts(df, class_column).select(
        class_column,
        "n",
        (F.col("n") / F.sum("n").over(everything)).alias("share"),
        (F.row_number().over(by_size) - 1).cast("bigint").alias("class_index"),
    )


def class_size_tiers(df: DataFrame, class_column: str,
                     tier_sizes: Sequence[int] = TIER_SIZES) -> DataFrame:
    """Class table with ``tier`` 1, 2, … by size; classes beyond the last tier get 0."""
    tier = F.lit(0)
    upper = sum(tier_sizes)
    for number in range(len(tier_sizes), 0, -1):
        tier = F.when(F.col("class_index") < upper, F.lit(number)).otherwise(tier)
        upper -= tier_sizes[number - 1]
    return class_table(df, class_column).withColumn("tier", tier.cast("bigint"))


def in_tier(df: DataFrame, class_column: str, id_column: str, tier: int,
            tier_sizes: Sequence[int] = TIER_SIZES) -> DataFrame:
    """Rows whose class belongs to the tier."""
    tiers = materialize(class_size_tiers(df, class_column, tier_sizes), "class-tiers")
    chosen = tiers.where(F.col("tier") == tier).select(class_column, F.col("n").alias("__weight"))
    joined = lookup_join(df, chosen, class_column, "__weight", id_column, "inner")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns])


def exclude_classes(df: DataFrame, class_column: str, classes: Sequence[str]) -> DataFrame:
    """Rows of all classes but the named ones; as with ``!=``, a null class goes too."""
    return df.where(~F.col(class_column).isin(list(classes)))


def with_class_index(df: DataFrame, class_column: str, id_column: str) -> DataFrame:
    """Adds ``class_index``: 0 for the most frequent class, ties by name."""
    table = materialize(class_table(df, class_column), "class-index")
    chosen = table.select(class_column, F.col("n").alias("__weight"), F.col("class_index").alias("__index"))
    joined = lookup_join(df, chosen, class_column, "__weight", id_column, "inner")
    kept = [F.col(f"`{c}`") for c in df.columns if c != "class_index"]
    return joined.select(*kept, F.col("__index").alias("class_index"))


def index_counts(df: DataFrame, class_column: str) -> DataFrame:
    """Rows per class index. Index and class are one to one, so one count serves both."""
    return class_table(df, class_column).select("class_index", "n")
