"""Linear models and networks as tables of weights, scored by joins with these tables.

A layer is a table with a row per input slot: the weights from it to every output. Slot -1 is
the bias, an input that is always 1. Rows come as arrays of slots and values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators.joins import BROADCAST_BYTES, lookup_join
from corpuslab.session import materialize

BIAS = -1
_DIGITS = 6  # to which class probabilities count as equal
_PIECE = 1 << 22  # products held at a time


def _layer_table(spark: SparkSession, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(slot, weights) from an inputs x outputs matrix."""
    rows = pd.DataFrame({"slot": np.arange(-1, len(weights)), "weights": [bias.tolist(), *weights.tolist()]})
    return materialize(spark.createDataFrame(rows, "slot bigint, weights array<double>"), "layer")


def network_layers(spark: SparkSession, model) -> list[DataFrame]:
    """Layers of a fitted multilayer perceptron, first to last."""
    sizes, flat, at, layers = model.getLayers(), model.weights.toArray(), 0, []
    for inputs, outputs in zip(sizes, sizes[1:]):
        end = at + inputs * outputs
        layers.append(_layer_table(spark, flat[at:end].reshape(inputs, outputs), flat[end:end + outputs]))
        at = end + outputs
    return layers


def regression_layer(spark: SparkSession, model) -> DataFrame:
    """The coefficients of a fitted multinomial regression as one layer."""
    return _layer_table(spark, model.coefficientMatrix.toArray().T, model.interceptVector.toArray())


def _row_sums(spark: SparkSession, layer: DataFrame, width: int):
    """Function over batches of (id, slots, values): each row's weighted sum over its entries and the bias."""
    stored = layer.toArrow()
    known = stored.column("slot").to_numpy()
    order = np.argsort(known)
    weights = stored.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]
    shared = spark.sparkContext.broadcast((known[order], weights))
    bias, piece = BIAS, _PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            slots, values = batch.column(1), batch.column(2)
            ends = np.concatenate([[0], np.cumsum(slots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            slot = slots.flatten().to_numpy(zero_copy_only=False)
            value = values.flatten().to_numpy(zero_copy_only=False)
            sums, met = np.zeros((len(batch), width)), np.zeros(len(batch), dtype=bool)
            at = np.searchsorted(known, bias)
            if at < len(known) and known[at] == bias:
                sums += weights[at]
                met[:] = True
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            at = np.minimum(np.searchsorted(known, slot), len(known) - 1)
            found = known[at] == slot if len(known) else np.zeros(len(slot), dtype=bool)
            row, at, value = row[found], at[found], value[found]
            step = max(piece // width, 1)
            for k in range(0, len(row), step):  # as many entries at a time as memory is set aside for
                own = row[k:k + step]
                begins = np.flatnonzero(np.diff(own, prepend=-1))
                sums[own[begins]] += np.add.reduceat(weights[at[k:k + step]] * value[k:k + step, None], begins, axis=0)
                met[own[begins]] = True
            offsets = pa.array(np.arange(met.sum() + 1, dtype=np.int32) * width, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(met)), pa.ListArray.from_arrays(offsets, pa.array(sums[met].ravel()))],
                names=[batch.schema.names[0], "outputs"])

    return run


def outputs(rows: DataFrame, id_column: str, layer: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, outputs): for each row the weighted sum over its entries and the bias.

    A layer up to ``broadcast_bytes`` is broadcast, and each row is summed where it lies. A larger
    one is joined by shuffle, with the slots that most rows have (the bias first) split. Ids must be unique.
    """
    width = layer.select(F.size("weights")).first()[0]
    if width and layer.count() * (8 * width + 32) <= broadcast_bytes:
        plain = rows.where("slots is not null and values is not null").select(id_column, F.col("slots").cast("array<bigint>"), F.col("values").cast("array<double>"))
        kind = plain.schema[0].dataType.simpleString()
        summed = plain.mapInArrow(_row_sums(rows.sparkSession, layer, width), f"`{id_column}` {kind}, outputs array<double>")
        return summed.groupBy(id_column).agg(vector_to_array(Summarizer.sum(array_to_vector("outputs"))).alias("outputs"))
    entries = rows.select(id_column, F.explode(F.arrays_zip(
        F.concat(F.array(F.lit(BIAS)), F.col("slots").cast("array<int>")).alias("slot"),
        F.concat(F.array(F.lit(1.0)), F.col("values")).alias("value"))).alias("e")).select(
        id_column, F.col("e.slot").cast("long").alias("slot"), F.col("e.value").alias("value"))
    used = entries.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup_join(entries, materialize(layer.join(used, "slot"), "layer-used"), "slot", "n", id_column,
                         "inner", broadcast_bytes=0)
    scaled = F.transform("weights", lambda w: w * F.col("value"))
    return joined.groupBy(id_column).agg(
        vector_to_array(Summarizer.sum(array_to_vector(scaled))).alias("outputs"))


def softmax(values: Column) -> Column:
    """Class probabilities from scores; the largest is taken off first, so nothing overflows."""
    shifted = F.transform(values, lambda v: F.exp(v - F.array_max(values)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x))


def predict(rows: DataFrame, id_column: str, layers: Sequence[DataFrame], labels: Sequence[str],
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, probability, prediction) by a forward pass: logistic units, then softmax.

    One layer is a multinomial regression. Classes that are equally likely: the one indexed first.
    """
    here = rows.select(id_column, "slots", "values")
    for layer in layers[:-1]:
        unit = F.transform("outputs", lambda v: 1 / (1 + F.exp(-v)))
        here = outputs(here, id_column, layer, broadcast_bytes).select(
            id_column, F.sequence(F.lit(0), F.size("outputs") - 1).alias("slots"), unit.alias("values"))
    last = outputs(here, id_column, layers[-1], broadcast_bytes).withColumn("probability", softmax(F.col("outputs")))
    rounded = F.transform("probability", lambda p: F.round(p, _DIGITS))
    return last.select(id_column, "probability", F.element_at(
        F.array(*[F.lit(c) for c in labels]), F.array_position(rounded, F.array_max(rounded)).cast("int")).alias("prediction"))
