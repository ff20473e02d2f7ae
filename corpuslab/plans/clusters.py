"""K-means over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import clustering, features, profiling
from corpuslab.operators.clustering import CLUSTERS, ITERATIONS
from corpuslab.plans import fragments as sql
from corpuslab.plans.registry import query
from corpuslab.sources.tables import load_table


def _embeddings(spark, sf_dir):
    return load_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])


def _assigned(spark, sf_dir):
    rows = _embeddings(spark, sf_dir)
    centres = clustering.random_centres(rows, "vec_id", "embedding", CLUSTERS)
    return clustering.assign(rows, "embedding", centres)


_START = (
    f"SELECT row_number() OVER (ORDER BY {sql.unit('vec_id')}, vec_id) - 1 AS cluster, embedding::DOUBLE[] AS c "
    f"FROM embeddings ORDER BY {sql.unit('vec_id')}, vec_id LIMIT {CLUSTERS}"
)


def _nearest_sql(centres: str) -> str:
    distance = "list_sum([power(e.embedding[i]::DOUBLE-k.c[i], 2) for i in range(1, len(e.embedding)+1)])"
    return (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance_sq, cluster) AS r "
        f"FROM (SELECT e.vec_id, e.embedding, k.cluster, {distance} AS distance_sq "
        f"FROM embeddings e, {centres} k)) WHERE r = 1"
    )


def _moved_sql(assigned: str, centres: str) -> str:
    return (
        f"SELECT k.cluster, coalesce(m.c, k.c) AS c FROM {centres} k LEFT JOIN (SELECT cluster, list(v ORDER BY slot) AS c "
        "FROM (SELECT cluster, slot, avg(v) AS v FROM (SELECT cluster, generate_subscripts(embedding,1) AS slot, "
        f"unnest(embedding)::DOUBLE AS v FROM {assigned}) GROUP BY cluster, slot) GROUP BY cluster) m USING (cluster)"
    )


_ASSIGN = f"WITH k0 AS ({_START}), a AS ({_nearest_sql('k0')}) "
_ROUNDS = ", ".join(
    f"a{i} AS ({_nearest_sql(f'k{i}')}), k{i + 1} AS ({_moved_sql(f'a{i}', f'k{i}')})" for i in range(ITERATIONS)
)
_FITTED = f"WITH k0 AS ({_START}), {_ROUNDS}, a AS ({_nearest_sql(f'k{ITERATIONS}')}) "


@query("kmeans_assign", _ASSIGN + "SELECT vec_id, cluster, round(distance_sq,6) AS distance_sq FROM a")
def kmeans_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select(
        "vec_id", "cluster", F.round("distance_sq", 6).alias("distance_sq")
    )


@query(
    "kmeans_update",
    _ASSIGN + ", s AS (SELECT cluster, generate_subscripts(embedding,1)-1 AS slot, "
    "unnest(embedding)::DOUBLE AS v FROM a) "
    "SELECT cluster, count(*) AS n, slot, round(avg(v),6) AS value FROM s GROUP BY cluster, slot",
)
def kmeans_update(spark, sf_dir):
    centres = clustering.update(_assigned(spark, sf_dir), "embedding")
    return centres.withColumn("value", F.round("value", 6))


@query("kmeans_sum_distance", _ASSIGN + "SELECT round(sum(sqrt(distance_sq)),4) AS sum_distance FROM a")
def kmeans_sum_distance(spark, sf_dir):
    total = clustering.sum_of_distances(_assigned(spark, sf_dir))
    return total.select(F.round("sum_distance", 4).alias("sum_distance"))


@query("kmeans_wssse", _ASSIGN + "SELECT round(sum(distance_sq),4) AS wssse FROM a")
def kmeans_wssse(spark, sf_dir):
    total = clustering.sum_of_squares(_assigned(spark, sf_dir))
    return total.select(F.round("wssse", 4).alias("wssse"))


def _fitted(spark, sf_dir):
    rows = features.to_vector(_embeddings(spark, sf_dir), "embedding")
    return rows, clustering.fit_kmeans(rows, "features")


@query("kmeans_fit_from_hash_start",
       _FITTED + "SELECT vec_id, cluster, round(distance_sq,6) AS distance_sq FROM a")
def kmeans_fit_from_hash_start(spark, sf_dir):
    """All rounds of a fit whose first centres are drawn by hash."""
    rows = _embeddings(spark, sf_dir)
    start = clustering.random_centres(rows, "vec_id", "embedding", CLUSTERS)
    centres = clustering.fit_from_centres(rows, "embedding", start, ITERATIONS, tol=0.0)
    return clustering.assign(rows, "embedding", centres).select(
        "vec_id", "cluster", F.round("distance_sq", 6).alias("distance_sq")
    )


@query("kmeans_fit")
def kmeans_fit(spark, sf_dir):
    """Cluster sizes of the best of two fits."""
    rows, model = _fitted(spark, sf_dir)
    return profiling.class_counts(model.transform(rows), "cluster")


@query("kmeans_fit_costs")
def kmeans_fit_costs(spark, sf_dir):
    """Sum of distances and of squared distances to the fitted centres."""
    rows, model = _fitted(spark, sf_dir)
    assigned = clustering.assign(rows, "embedding", [c.tolist() for c in model.clusterCenters()])
    return assigned.agg(
        F.sum(F.sqrt("distance_sq")).alias("sum_distance"), F.sum("distance_sq").alias("wssse")
    )


@query("text_kmeans_fit")
def text_kmeans_fit(spark, sf_dir):
    """Clusters of hashed TF-IDF vectors of the documents, with their sizes."""
    from corpuslab.plans.learning import text_vectors

    rows = text_vectors(spark, sf_dir)
    model = clustering.fit_kmeans(rows, "features")
    return profiling.class_counts(model.transform(rows), "cluster")
