"""Parquet tables and the news-style corpus view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.session import dealt


def load_table(
    spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
    spread_by: str | None = None,
) -> DataFrame:
    """One table, pruned to ``columns``; ``spread_by`` deals it out where the session asks for that."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return dealt(df, spread_by) if spread_by else df


def first_line(column: str):
    """Text up to the first newline: the summary of a body."""
    return F.substring_index(F.col(column), "\n", 1)
