"""Joining a large table to a lookup table that may or may not be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
# A key heavier than this share of a mean shuffle partition is split.
HOT_SHARE = 0.125
_ROW_OVERHEAD = 32


def table_bytes(table: DataFrame, key: str) -> int:
    """Memory estimate of a lookup table: key text plus eight bytes per other value."""
    width = _ROW_OVERHEAD + 8 * len(table.columns)
    row = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(F.col(key).cast("string"))), F.lit(0)).alias("chars"),
    ).first()
    return row.n * width + 2 * row.chars


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, weight: str, spread_by: str, how: str = "left",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` to ``table``, which holds each ``key`` once with its frequency ``weight``.

    ``table`` should be materialised, because its size is measured first. When it is small
    it is broadcast and ``rows`` do not move. Otherwise both sides shuffle on the key, and
    each key with more than an eighth of a mean partition's weight is split into pieces of
    that size, told apart by the row id ``spread_by``, with its table row repeated for each
    piece. There are at most eight such keys per partition, so their table is broadcast.
    Rows with a null key match nothing and are spread over all partitions.
    """
    if table_bytes(table, key) <= broadcast_bytes:
        return rows.join(F.broadcast(table), key, how)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = table.agg(F.sum(weight)).first()[0] or 0
    piece = max(total / parts * HOT_SHARE, 1.0)
    hot = table.where(F.col(weight) > piece).select(
        F.col(key).alias("__hot"), F.ceil(F.col(weight) / piece).cast("int").alias("__pieces"))
    is_hot = F.col(key) == F.col("__hot")
    spread = F.xxhash64(spread_by)
    salt = F.when(F.col(key).isNull(), F.pmod(spread, F.lit(parts))).when(
        F.col("__pieces").isNotNull(), F.pmod(spread, F.col("__pieces"))).otherwise(F.lit(0))
    salted_rows = rows.join(F.broadcast(hot), is_hot, "left").withColumn("__salt", salt.cast("int")).drop("__hot", "__pieces")
    salted_table = table.join(F.broadcast(hot), is_hot, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__pieces"), F.lit(1)) - 1))
    ).drop("__hot", "__pieces")
    return salted_rows.join(salted_table, [key, "__salt"], how).drop("__salt")
