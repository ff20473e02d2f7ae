"""Indexing, assembling and scaling of feature columns with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import (
    IndexToString, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler,
    VectorIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows whose vectors are taken apart at a time.
VECTOR_ROWS = 1024


def fit_string_index(df: DataFrame, column: str, output: str = "label_index") -> StringIndexerModel:
    """Index by descending count, ties by name; values unknown later go to an extra index."""
    return StringIndexer(inputCol=column, outputCol=output, handleInvalid="keep",
                         stringOrderType="frequencyDesc").fit(df)


def index_to_string(df: DataFrame, column: str, labels: Sequence[str], output: str) -> DataFrame:
    return IndexToString(inputCol=column, outputCol=output, labels=list(labels)).transform(df)


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def to_vector(df: DataFrame, column: str, output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(column)))


def vector_slots(df: DataFrame, vector: str, keep: Sequence[str], output: str = "value") -> DataFrame:
    """One row per vector slot."""
    return df.select(*keep, F.posexplode(vector_to_array(vector)).alias("slot", output)).withColumn(
        "slot", F.col("slot").cast("bigint")
    )


def vector_reader():
    """Function from a column of vectors to what its rows store: ends of the rows, slots, values."""
    def read(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind, _, indices, values = column.flatten()
        size = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        slots = np.arange(ends[-1]) - np.repeat(ends[:-1], size)
        is_sparse = pc.equal(pc.fill_null(kind, 1), 0).to_numpy(zero_copy_only=False)
        slots[np.repeat(is_sparse, size)] = indices.flatten().to_numpy(zero_copy_only=False)
        return ends, slots, values.flatten().to_numpy(zero_copy_only=False)

    return read


def vector_entries(df: DataFrame, vector: str, keep: Sequence[str]) -> DataFrame:
    """Vectors as two arrays, ``slots`` and ``values``, as long as what the vector stores.

    A null vector has no entries. Sparse vectors stay sparse: nothing of their full width is built.
    """
    names, step = list(keep), VECTOR_ROWS
    inner = df.select(*[F.col(f"`{c}`") for c in names], F.col(vector).alias("__vector"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1]]
                       + ["slots array<int>", "values array<double>"])
    read = vector_reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, len(whole), step):
                batch = whole.slice(first, step)
                ends, slots, values = read(batch.column(len(names)))
                offsets = pa.array(ends.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(slots.astype(np.int32))),
                     pa.ListArray.from_arrays(offsets, pa.array(values))], names=[*names, "slots", "values"])

    return inner.mapInArrow(run, schema)


def index_vector(df: DataFrame, vector: str, max_categories: int, output: str = "indexed",
                 fit_on: DataFrame | None = None) -> DataFrame:
    """Re-index slots with few distinct values; fit on training rows to keep test rows unseen."""
    indexer = VectorIndexer(inputCol=vector, outputCol=output, maxCategories=max_categories,
                            handleInvalid="keep")
    return indexer.fit(df if fit_on is None else fit_on).transform(df)


def slot_cardinality(df: DataFrame, columns: Sequence[str], max_categories: int) -> DataFrame:
    """Distinct values per slot and whether the slot counts as categorical.

    Values are made distinct per slot first, with partial results in each
    task, so a value that fills most rows is shuffled once per task.
    """
    slots = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("slot"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(columns)
    ])
    return (
        df.select(F.inline(slots)).distinct()
        .groupBy("slot").agg(F.count(F.lit(1)).alias("n_values"))
        .withColumn("is_categorical", F.col("n_values") <= max_categories)
    )


def standard_scale(df: DataFrame, vector: str, output: str = "scaled", with_mean: bool = True,
                   with_std: bool = True) -> DataFrame:
    scaler = StandardScaler(inputCol=vector, outputCol=output, withMean=with_mean, withStd=with_std)
    return scaler.fit(df).transform(df)
