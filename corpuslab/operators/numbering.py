"""Numbers for all rows of a table in a total order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import materialize

_PLACE_BITS = 33  # of monotonically_increasing_id: the place in the partition; above it the partition


def numbered(df: DataFrame, order: Sequence[Column], output: str) -> DataFrame:
    """``df`` with each row's place, from 0, in the given order, which should be total.

    Rows are range-sorted and stored; a row's number is its place in its partition plus the
    rows of all partitions before. The table of partitions has one row per task that wrote.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", _PLACE_BITS).cast("int")
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, total = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before.append((r["part"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(before, "__part int, __before bigint")
    number = F.col("__before") + F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.withColumn("__part", part).join(F.broadcast(first), "__part").select(
        *[F.col(f"`{c}`") for c in df.columns], number.alias(output))
