"""Delimited files whose records hold newlines, read by many tasks.

Spark reads such a file in one task, because a newline may lie inside quotes. Whether it does
follows from the number of quotes before it: inside a field it is odd. So files are read as
lines, by byte range; the quotes of each range are counted; and running sums over the ranges
of a file say in which state each begins. Tasks then put the lines of their range together,
and the few records that cross a range's edge are joined from their pieces. Parsing is Spark's.

Quotes must be paired, as by doubling them inside quoted fields.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpuslab.session import materialize
from corpuslab.sources.delimited import CORRUPT_COLUMN, NEWS_SCHEMA, QUOTING, SEPARATOR

QUOTE = '"'
KEEP, DROP, MARK = "keep", "drop", "mark"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): lines with the byte range that they were read with."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _range_states(lines: DataFrame) -> DataFrame:
    """(file, block, open): whether the range begins inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    odd = materialize(lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd")), "quote-parity")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _pieces(lines: DataFrame) -> DataFrame:
    """(file, block, number, begun, closed, text): records and parts of records, range by range.

    ``begun`` says that the record begins in the range, ``closed`` that it ends there.
    """
    quote = QUOTE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, inside, begun, held, out = None, 0, False, True, [], []

        def put(closed):
            nonlocal number, held
            out.append((*place, number, begun, closed, "\n".join(held)))
            number, held = number + 1, []

        def batch_of():
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["file", "block", "number", "begun", "closed", "text"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "block", "open", "value"))
            for file, block, opened, line in zip(*columns):
                if place != (file, block):
                    if held:
                        put(False)
                    place, number, inside, begun = (file, block), 0, opened, not opened
                held.append(line)
                inside ^= line.count(quote) % 2 == 1
                if not inside:
                    put(True)
                    begun = True
            if out:
                yield batch_of()
                out.clear()
        if held:
            put(False)
            yield batch_of()

    return lines.mapInArrow(run, "file string, block long, number long, begun boolean, closed boolean, text string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, is_first, text) of every record below ``path``; ``is_first`` marks the first of a file.

    A record without an end (unpaired quotes) runs to the end of its file. Empty lines between
    records are left out. The table of byte ranges has one row per range and is broadcast;
    only pieces at the edges of ranges are shuffled, two per range at most.
    """
    lines = _lines(spark, path)
    states = F.broadcast(_range_states(lines))
    pieces = materialize(_pieces(lines.join(states, ["file", "block"])), "record-pieces")
    is_first = F.col("begun") & (F.col("block") == 0) & (F.col("number") == 0)
    whole = pieces.where("begun and closed").select("file", is_first.alias("is_first"), "text")
    # the last range in which a record began, for each piece of one
    order = Window.partitionBy("file").orderBy("block", "number")
    parts = pieces.where("not (begun and closed)").withColumn("start", F.max(F.when(F.col("begun"), F.col("block"))).over(order))
    joined = parts.groupBy("file", "start").agg(
        F.bool_or(is_first).alias("is_first"), F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    crossing = joined.select("file", "is_first", F.array_join("parts.text", "\n").alias("text"))
    return whole.unionByName(crossing).where("text <> ''")


def read_records(
    spark: SparkSession, path: str, schema: StructType = NEWS_SCHEMA, sep: str = SEPARATOR,
    header: bool = True, malformed: str = KEEP,
) -> DataFrame:
    """Delimited scan of files with newlines in records, however large a file is.

    Gives what ``read_delimited`` gives, or with ``malformed`` set to ``drop`` or ``mark``, what
    ``read_dropping_malformed`` or ``read_marking_malformed`` give.
    """
    rows = records(spark, path)
    if header:
        rows = rows.where(~F.col("is_first"))
    marked = StructType([*schema.fields, StructField(CORRUPT_COLUMN, StringType())])
    options = QUOTING | {"emptyValue": "", "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN,
                         "maxCharsPerColumn": "-1", "lineSep": "\n"}
    parsed = rows.select(F.from_csv("text", marked.toDDL(), options).alias("r")).select("r.*")
    is_malformed = F.col(CORRUPT_COLUMN).isNotNull()
    if malformed == DROP:
        return parsed.where(~is_malformed).drop(CORRUPT_COLUMN)
    if malformed == MARK:
        return parsed.withColumn("is_malformed", is_malformed).drop(CORRUPT_COLUMN)
    return parsed.drop(CORRUPT_COLUMN)
