"""K-means: fitting with pyspark.ml, and its single steps for given centres."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.hashing import hash_unit
from corpuslab.session import persisted

# The usual fit.
CLUSTERS, ITERATIONS, TOLERANCE, RUNS = 27, 5, 1e-4, 2


def fit_kmeans(df: DataFrame, features: str, k: int = CLUSTERS, max_iter: int = ITERATIONS,
               tol: float = TOLERANCE, runs: int = RUNS, seed: int = 1234) -> KMeansModel:
    """Best of several runs from random centres, by the sum of squared distances.

    Rows are compared one by one: the solver by blocks fails where equal rows are drawn as centres.
    """
    with persisted(df.select(features)) as rows:
        models = [
            KMeans(featuresCol=features, predictionCol="cluster", k=k, maxIter=max_iter, tol=tol,
                   initMode="random", seed=seed + run, solver="row").fit(rows)
            for run in range(runs)
        ]
    return min(models, key=lambda m: m.summary.trainingCost)


def random_centres(df: DataFrame, id_column: str, vector: str, k: int,
                   seed: int | None = None) -> list[list[float]]:
    """``k`` rows drawn by the hash of their id; the model of a K-means run, so k vectors long."""
    chosen = df.orderBy(hash_unit(F.col(id_column), seed), id_column).limit(k)
    return [list(map(float, r[0])) for r in chosen.select(id_column, vector).select(vector).collect()]


def assign(df: DataFrame, vector: str, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Adds the nearest centre, ties to the lower number, and the squared distance to it.

    The centres travel with the function; rows stay where they are.
    """
    points = np.asarray(centres, dtype=np.float64)

    @F.pandas_udf("cluster bigint, distance_sq double")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            rows = np.array(vectors.tolist(), dtype=np.float64).reshape(-1, points.shape[1])
            best = np.full(len(rows), np.inf)
            number = np.zeros(len(rows), dtype=np.int64)
            for i, centre in enumerate(points):
                distance = np.square(rows - centre).sum(axis=1)
                closer = distance < best
                best[closer] = distance[closer]
                number[closer] = i
            yield pd.DataFrame({"cluster": number, "distance_sq": best})

    return df.withColumn("_nearest", nearest(F.col(vector))).select(
        *df.columns, F.col("_nearest.cluster").alias("cluster"),
        F.col("_nearest.distance_sq").alias("distance_sq"),
    )


def update(assigned: DataFrame, vector: str) -> DataFrame:
    """New centres, one row per cluster and slot; vectors are summed in each task first."""
    means = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        Summarizer.mean(array_to_vector(F.col(vector))).alias("centre"),
    )
    return means.select(
        "cluster", "n", F.posexplode(vector_to_array("centre")).alias("slot", "value")
    ).withColumn("slot", F.col("slot").cast("bigint"))


def fit_from_centres(df: DataFrame, vector: str, centres: Sequence[Sequence[float]],
                     max_iter: int = ITERATIONS, tol: float = TOLERANCE) -> list[list[float]]:
    """Centres after up to ``max_iter`` rounds of assignment and update from given ones.

    For a repeatable start; ``fit_kmeans`` draws its own. A centre that attracts
    no rows stays where it is. Only the ``k`` centres pass through the driver.
    """
    current = [list(map(float, c)) for c in centres]
    with persisted(df.select(vector)) as rows:
        for _ in range(max_iter):
            moved = [list(c) for c in current]
            for r in update(assign(rows, vector, current), vector).collect():
                moved[r["cluster"]][r["slot"]] = r["value"]
            shift = max(math.dist(a, b) for a, b in zip(current, moved))
            current = moved
            if shift <= tol:
                break
    return current


def sum_of_distances(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum(F.sqrt("distance_sq")).alias("sum_distance"))


def sum_of_squares(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("distance_sq").alias("wssse"))
