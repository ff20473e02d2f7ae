"""Files with newlines in records, cut into byte ranges at every place."""

import pytest
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from corpuslab.session import scratch_path
from corpuslab.sources import delimited, records

SCHEMA = StructType([StructField("id", LongType()), StructField("text", StringType()), StructField("x", DoubleType())])
TEXTS = ['a;b', 'say "x"', "two\nlines", "", "  padded  ", "back\\slash", None, "\\N;", 'ends with "', '"', '""\n"', "\n", "\n\n;\n",
         "é" * 40, "line\n" * 30, 'q"\n' * 25, "plain", "\r\n", "tab\t"]


def _cut(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture(params=[90, 1 << 27])
def range_bytes(spark, request):
    yield from _cut(spark, request.param)


@pytest.fixture(params=[3, 8, 1 << 27])
def narrow_bytes(spark, request):
    yield from _cut(spark, request.param)


def _file(folder, text):
    (folder / "file.csv").write_text(text, newline="")
    return f"{folder}/file.csv"


def test_same_rows_as_the_reader_of_whole_files(spark, range_bytes):
    rows = [(i, TEXTS[i % len(TEXTS)], i / 2) for i in range(len(TEXTS))]
    path = delimited.write_delimited(spark.createDataFrame(rows, SCHEMA).coalesce(1), scratch_path(spark, "csv"), file_bytes=2**62)
    got = records.read_records(spark, path, SCHEMA)
    assert sorted(map(tuple, got.collect())) == rows
    assert sorted(map(tuple, delimited.read_delimited(spark, path, SCHEMA).collect())) == rows
    if range_bytes < 100:
        assert spark.read.text(path).rdd.getNumPartitions() > 4


def test_several_files_have_their_own_headers(spark, range_bytes):
    rows = [(i, TEXTS[i % len(TEXTS)], None) for i in range(25)]
    path = delimited.write_delimited(spark.createDataFrame(rows, SCHEMA).repartition(5), scratch_path(spark, "csv"), file_bytes=300)
    found = records.records(spark, path)
    assert found.where("is_first").select("text").distinct().collect()[0].text == "id;text;x"
    assert found.where("is_first").count() == found.select("file").distinct().count() > 5
    assert sorted(map(tuple, records.read_records(spark, path, SCHEMA).collect())) == rows


MALFORMED = 'id;"te\nxt"\n1;a\n\n2\nx;b\n4;"d\n\n;"\n5;e;more\n\n'


def test_malformed_records_and_a_header_over_two_lines(spark, tmp_path, narrow_bytes):
    schema = StructType([StructField("id", IntegerType()), StructField("text", StringType())])
    path = _file(tmp_path, MALFORMED)
    pairs = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    kept = records.read_records(spark, path, schema, malformed=records.DROP)
    assert pairs(kept) == pairs(delimited.read_dropping_malformed(spark, path, schema)) == [(1, "a"), (4, "d\n\n;")]
    assert kept.count() == 2 and kept.select("text").count() == 2
    marked = records.read_records(spark, path, schema, malformed=records.MARK)
    assert pairs(marked) == pairs(delimited.read_marking_malformed(spark, path, schema))
    assert marked.where("is_malformed").count() == 3
    assert pairs(records.read_records(spark, path, schema)) == pairs(delimited.read_delimited(spark, path, schema))


def test_unpaired_quotes_run_to_the_end_of_the_file(spark, tmp_path, narrow_bytes):
    path = _file(tmp_path, 'a\n"b\nc\nd')
    assert sorted(r.text for r in records.records(spark, path).collect()) == ['"b\nc\nd', "a"]


def test_no_lines(spark, tmp_path):
    for text in ("\n\n", ""):
        assert records.records(spark, _file(tmp_path, text)).count() == 0
