"""Delimited text: typed, inferred, header-driven and line-based scans, and the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SEPARATOR = ";"
CORRUPT_COLUMN = "_corrupt_record"

# The corpus schema.
NEWS_SCHEMA = StructType(
    [
        StructField("codigo", IntegerType()),
        StructField("classificacao", StringType()),
        StructField("conteudo", StringType()),
        StructField("resumo", StringType()),
        StructField("titulo", StringType()),
    ]
)

# Quotes are doubled, null has its own mark and the empty string is written as "",
# so text survives a round trip unless it is that mark itself.
QUOTING = {"quote": '"', "escape": '"', "nullValue": "\\N"}


FILE_BYTES = 128 * 1024 * 1024


def _records_per_file(df: DataFrame, file_bytes: int) -> int:
    """Records of mean size that fill a file."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, StringType)]
    width = sum(texts, F.lit(20 * len(df.columns)))
    mean = df.agg(F.avg(width)).first()[0] or 1.0
    return max(int(file_bytes / mean), 1)


def write_delimited(
    df: DataFrame, path: str, sep: str = SEPARATOR, header: bool = True,
    file_bytes: int = FILE_BYTES,
) -> str:
    """Distributed delimited sink.

    Records may hold newlines, so a file cannot be split on reading; files are kept to
    about ``file_bytes`` instead, by the mean size of the records, which is measured first.
    """
    max_records_per_file = _records_per_file(df, file_bytes)
    (
        df.write.options(**QUOTING)
        .option("sep", sep)
        .option("header", header)
        .option("maxRecordsPerFile", max_records_per_file)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def _reader(spark: SparkSession, sep: str, header: bool, multi_line: bool):
    """Reader of what the sink writes."""
    return (
        spark.read.options(**QUOTING)
        .option("emptyValue", "")
        .option("sep", sep)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("lineSep", "\n")
        .option("maxCharsPerColumn", -1)
    )


def read_delimited(
    spark: SparkSession, path: str, schema: StructType | None = NEWS_SCHEMA,
    sep: str = SEPARATOR, header: bool = True, multi_line: bool = True,
) -> DataFrame:
    """Delimited scan; ``schema=None`` infers the types at the cost of one more pass.

    Pass ``multi_line=False`` where no record holds a newline: files then split.
    """
    reader = _reader(spark, sep, header, multi_line)
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema)
    return reader.csv(path)


def _whole_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keeps all ``columns`` in the scan, whatever is selected later.

    A record is checked only as far as its columns are read; a count alone
    reads none and would let malformed records through. The condition holds
    for every row.
    """
    return df.where(F.xxhash64(*columns) >= F.lit(-(2**63)))


def read_dropping_malformed(
    spark: SparkSession, path: str, schema: StructType, sep: str = SEPARATOR,
    header: bool = True, multi_line: bool = True,
) -> DataFrame:
    """Scan that leaves out records not matching ``schema``; records may hold newlines."""
    read = (
        _reader(spark, sep, header, multi_line)
        .schema(schema)
        .option("mode", "DROPMALFORMED")
        .csv(path)
    )
    return _whole_records(read, schema.names)


def read_marking_malformed(
    spark: SparkSession, path: str, schema: StructType, sep: str = SEPARATOR,
    header: bool = True, multi_line: bool = True,
) -> DataFrame:
    """Scan that keeps every record and adds ``is_malformed``; records may hold newlines."""
    read = (
        _reader(spark, sep, header, multi_line)
        .schema(StructType([*schema.fields, StructField(CORRUPT_COLUMN, StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .csv(path)
    )
    return (
        _whole_records(read, schema.names)
        .withColumn("is_malformed", F.col(CORRUPT_COLUMN).isNotNull())
        .drop(CORRUPT_COLUMN)
    )


def header_schema(spark: SparkSession, path: str, sep: str = SEPARATOR) -> StructType:
    """All-string schema named by the first line of the file."""
    line = spark.read.text(path).first()
    names = line.value.split(sep) if line else []
    return StructType([StructField(n.strip('"'), StringType()) for n in names])


def read_split_lines(
    spark: SparkSession, path: str, names: list[str], sep: str = SEPARATOR,
) -> DataFrame:
    """Raw lines cut at every separator, header line included, no quoting rules."""
    parts = F.split(F.col("value"), f"\\Q{sep}\\E", -1)
    return (
        spark.read.text(path)
        .select(parts.alias("parts"))
        .select(*[F.get("parts", i).alias(n) for i, n in enumerate(names)])
    )
