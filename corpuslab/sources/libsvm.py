"""LibSVM sink and source for (label, features) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> str:
    df.selectExpr(f"`{label}` AS label", f"`{features}` AS features").write.format("libsvm").save(path)
    return path


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """``num_features`` is given, so that no extra pass has to find it."""
    return spark.read.format("libsvm").option("numFeatures", num_features).load(path)
