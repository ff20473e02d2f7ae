"""Samples and splits: Spark's seeded ones, and hash forms fixed by the row id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.hashing import hash_unit
from corpuslab.operators.joins import lookup_join
from corpuslab.operators.profiling import class_table
from corpuslab.session import materialize


def bernoulli_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Each row with the given probability; rows chosen depend on the partitioning."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def class_sample(df: DataFrame, class_column: str, fractions: Mapping, seed: int) -> DataFrame:
    """Bernoulli sample with one fraction per class; classes not named give no rows."""
    return df.sampleBy(class_column, fractions=dict(fractions), seed=seed)


def random_split(df: DataFrame, weights: Sequence[float], seed: int | None = None) -> list[DataFrame]:
    """Weights need not add up to one. The parts are disjoint and complete only
    while every read of ``df`` gives the same partitions in the same order."""
    return df.randomSplit(list(weights), seed)


def hash_sample(df: DataFrame, id_column: str, fraction: float, seed: int | None = None) -> DataFrame:
    """Sample by the hash of the id: the same rows on every run and cluster size."""
    return df.where(hash_unit(F.col(id_column), seed) < fraction)


def hash_class_sample(df: DataFrame, id_column: str, class_column: str, fractions: Mapping,
                      seed: int | None = None) -> DataFrame:
    """Hash sample with one fraction per class; classes not named give no rows."""
    threshold = F.lit(0.0)
    for value, fraction in fractions.items():
        threshold = F.when(F.col(class_column) == F.lit(value), F.lit(fraction)).otherwise(threshold)
    return df.where(hash_unit(F.col(id_column), seed) < threshold)


def share_sample(df: DataFrame, id_column: str, class_column: str, seed: int | None = None) -> DataFrame:
    """Hash sample that takes from each class its share of all rows.

    Large classes are sampled more densely, so the sample is more uneven than
    the corpus.
    """
    shares = materialize(class_table(df, class_column), "class-shares")
    chosen = shares.select(class_column, F.col("n").alias("__weight"), F.col("share").alias("__share"))
    joined = lookup_join(df, chosen, class_column, "__weight", id_column, "inner")
    return joined.where(hash_unit(F.col(id_column), seed) < F.col("__share")).select(*[F.col(f"`{c}`") for c in df.columns])


def hash_split(df: DataFrame, id_column: str, weights: Sequence[float],
               seed: int | None = None, split_column: str = "split") -> DataFrame:
    """Adds the number of the part each row belongs to, in proportion to ``weights``.

    Filter on the column to get a part; the parts are disjoint and complete.
    """
    total = sum(weights)
    bounds = [b / total for b in accumulate(weights)][:-1]
    unit = hash_unit(F.col(id_column), seed)
    part = F.lit(len(bounds))
    for number in reversed(range(len(bounds))):
        part = F.when(unit < bounds[number], F.lit(number)).otherwise(part)
    return df.withColumn(split_column, part.cast("bigint"))
