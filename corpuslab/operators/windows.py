"""Moving average over neighbouring rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.session import materialize

ROWS_PER_TASK = 2_000_000


def moving_average(
    df: DataFrame, key: str, order_by: list[str], value: str, before: int, after: int,
    output: str = "moving_avg", rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Average of ``value`` from ``before`` rows back to ``after`` rows ahead.

    ``order_by`` must order the rows of a key totally; nulls come first in it, and a null
    key is a key like any other. All rows stay.

    A window keeps all rows of a key in one task. Rows of keys with more than
    ``rows_per_task`` rows are therefore numbered by a range sort and cut into runs of
    that many neighbours, each with copies of the few rows its frame needs from the runs
    beside it. The cutting changes no result.
    """
    counts = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    frequent = materialize(counts.where(F.col("__n") > rows_per_task).select("__key"), "frequent-keys")
    frame = Window.rowsBetween(-before, after)
    whole = F.avg(value).over(frame.partitionBy(key).orderBy(*order_by))
    if frequent.isEmpty():
        return df.withColumn(output, whole)

    is_frequent = F.col(key).eqNullSafe(F.col("__key"))
    usual = df.join(frequent, is_frequent, "left_anti").withColumn(output, whole)
    numbered = _numbered(df.join(frequent, is_frequent, "left_semi"), key, order_by)
    cut = _in_runs(numbered, before, after, rows_per_task)
    averaged = cut.withColumn(
        output, F.avg(value).over(frame.partitionBy(key, "__run").orderBy("__position"))
    )
    return usual.unionByName(averaged.where("__own").select(*[F.col(f"`{c}`") for c in df.columns], output))


def _numbered(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Rows with their position among the rows of their key.

    A range sort spreads each key over tasks in order; numbers inside a task and a running
    sum over the tasks of each key give the position. The sorted rows are stored, so that
    both steps see the same ones.
    """
    placed = (
        df.repartitionByRange(key, *order_by).sortWithinPartitions(key, *order_by)
        .withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    )
    placed = materialize(placed, "range-sorted")
    earlier = Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(
        F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    parts = parts.withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    # one row per key and task that holds it
    joined = placed.join(parts, (F.col("__part") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")))
    position: Column = F.col("__offset") + F.col("__at") - F.col("__first")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], position.alias("__position"))


def _in_runs(numbered: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """Rows copied to each run that needs them; ``__own`` marks the run they belong to."""
    size = max(size, before + after)
    home = F.floor(F.col("__position") / size)
    first = F.floor((F.col("__position") - after) / size)
    last = F.floor((F.col("__position") + before) / size)
    return numbered.withColumn("__run", F.explode(F.sequence(first, last))).withColumn(
        "__own", F.col("__run") == home
    )
