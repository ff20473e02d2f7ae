"""Reproducible pseudo-random numbers from row ids, equal on any engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 8
_RANGE = float(16**_HEX_DIGITS)


def md5_bits(column: Column) -> Column:
    """First 32 bits of the MD5 of the value's text, as a non-negative bigint."""
    digest = F.md5(column.cast("string"))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("bigint")


def hash_unit(column: Column, seed: int | None = None) -> Column:
    """A number in [0, 1) fixed by the value and the seed, whatever the partitioning."""
    if seed is not None:
        column = F.concat(F.lit(f"{seed}:"), column.cast("string"))
    return md5_bits(column) / F.lit(_RANGE)


def hash_bucket(column: Column, buckets: int) -> Column:
    return F.pmod(md5_bits(column), F.lit(buckets).cast("bigint"))
