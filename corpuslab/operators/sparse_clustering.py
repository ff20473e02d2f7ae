"""K-means steps on sparse rows: centres as a table of slots, distances from dot products.

|x - c|^2 = |x|^2 - 2 (x . c - |c|^2 / 2), so a table of centres is a layer (see ``layers``) with a
weight per slot and centre and -|c|^2 / 2 as bias; the nearest centre has the largest output. Only
entries that a row has are touched, and no row is made as wide as its vector.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.hashing import hash_unit
from corpuslab.operators.layers import BIAS, outputs
from corpuslab.operators.joins import BROADCAST_BYTES
from corpuslab.session import materialize

_DIGITS = 6  # to which distances count as equal


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.arrays_zip("slots", "values")).alias("__e")).select(
        *keep, F.col("__e.slots").cast("long").alias("slot"), F.col("__e.values").alias("value"))


def _as_layer(entries: DataFrame, k: int) -> DataFrame:
    """(slot, weights) with the bias from (cluster, slot, value)."""
    by_slot = entries.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "value"))).alias("m"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    table = materialize(by_slot.select("slot", weights.alias("weights")), "centres")
    norms = table.agg(vector_to_array(Summarizer.sum(array_to_vector(
        F.transform("weights", lambda w: w * w / -2)))).alias("weights"))
    none = F.array_repeat(F.lit(0.0), k)
    whole = F.when(F.size(F.coalesce("weights", F.array().cast("array<double>"))) == k, F.col("weights")).otherwise(none)
    return materialize(table.unionByName(norms.select(F.lit(BIAS).cast("long").alias("slot"), whole.alias("weights"))), "centres")


def drawn_centres(rows: DataFrame, id_column: str, k: int, seed: int | None = None) -> DataFrame:
    """A layer of up to ``k`` rows drawn by the hash of their id, in that order."""
    order = [hash_unit(F.col(id_column), seed), F.col(id_column)]
    chosen = rows.orderBy(*order).limit(k).select(id_column, "slots", "values").withColumn("__u", order[0])
    ids = [r[0] for r in chosen.orderBy("__u", id_column).select(id_column).collect()]  # k at most
    number = F.element_at(F.create_map(*[F.lit(x) for i, d in enumerate(ids) for x in (d, i)]), F.col(id_column))
    numbered = rows.where(F.col(id_column).isin(ids)).withColumn("cluster", number)
    return _as_layer(_exploded(numbered, "cluster"), len(ids))


def model_centres(rows: DataFrame, model) -> DataFrame:
    """A layer of the centres of a fitted K-means model."""
    spark = rows.sparkSession
    centres = [(i, int(slot), float(c[slot])) for i, c in enumerate(model.clusterCenters()) for slot in c.nonzero()[0]]
    entries = spark.createDataFrame(centres, "cluster int, slot bigint, value double")
    return _as_layer(entries, len(model.clusterCenters()))


def _norm(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v)


def assign(rows: DataFrame, id_column: str, centres: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, cluster, distance_sq) of rows with ``slots`` and ``values``; ties to the lower number.

    Ids must be unique. Squared distances never fall below 0.
    """
    found = outputs(rows, id_column, centres, broadcast_bytes).select(F.col(id_column).alias("__id"), "outputs")
    joined = rows.select(id_column, _norm(F.col("values")).alias("norm")).join(found, F.col(id_column) == F.col("__id"))
    distances = F.transform("outputs", lambda o: F.greatest(F.col("norm") - 2 * o, F.lit(0.0)))
    rounded = F.transform("distances", lambda d: F.round(d, _DIGITS))
    best = F.array_position(rounded, F.array_min(rounded)).cast("int")
    return joined.select(id_column, distances.alias("distances")).select(
        id_column, (best - 1).cast("long").alias("cluster"), F.element_at("distances", best).alias("distance_sq"))


def update(rows: DataFrame, id_column: str, assigned: DataFrame) -> DataFrame:
    """(cluster, n, slot, value): the mean of each cluster's rows, for slots where it is not 0."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    member = assigned.select(F.col(id_column).alias("__id"), "cluster")
    sums = _exploded(rows, id_column).join(member, F.col(id_column) == F.col("__id")).groupBy("cluster", "slot").agg(
        F.sum("value").alias("total"))
    return sums.join(F.broadcast(sizes), "cluster").where("total <> 0").select(
        "cluster", "n", "slot", (F.col("total") / F.col("n")).alias("value"))


def moved_centres(rows: DataFrame, id_column: str, assigned: DataFrame, k: int) -> DataFrame:
    """A layer of the clusters' means; a cluster without rows moves to the origin."""
    return _as_layer(update(rows, id_column, assigned).select(F.col("cluster").cast("int").alias("cluster"), "slot", "value"), k)
