"""Queries of this subpackage: name, plan and SQL text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = (plan, sql)
        return plan

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
