import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from corpuslab.session import scratch_path
from corpuslab.sources import delimited, libsvm

TEXTS = ['a;b', 'say "x"', "two\nlines", "", "  padded  ", "back\\slash", None, "\\N;", 'ends with "']


@pytest.fixture
def path(spark):
    return scratch_path(spark, "test")


def _schema():
    return StructType([StructField("id", LongType()), StructField("text", StringType())])


def test_delimited_round_trip(spark, path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), _schema())
    delimited.write_delimited(df, path)
    read = {r.id: r.text for r in delimited.read_delimited(spark, path, _schema()).collect()}
    assert read == dict(enumerate(TEXTS))


def test_news_schema_reads_a_file(spark, path):
    lines = ["codigo;classificacao;conteudo;resumo;titulo", '1;Saude;"corpo; com ""aspas""\n e linha";r;t', "2;Politica;c;;t"]
    spark.createDataFrame([("\n".join(lines),)], "v string").coalesce(1).write.text(path)
    rows = delimited.read_delimited(spark, path).orderBy("codigo").collect()
    assert rows[0].conteudo == 'corpo; com "aspas"\n e linha' and rows[1].codigo == 2


def test_types_are_inferred(spark, path):
    df = spark.createDataFrame([(1, "x", 2.5)], "n int, s string, d double")
    delimited.write_delimited(df, path)
    assert delimited.read_delimited(spark, path, schema=None).dtypes == [("n", "int"), ("s", "string"), ("d", "double")]


def test_malformed_records(spark, path):
    spark.createDataFrame([("id;text\n1;a\n2\nx;b\n4;d",)], "v string").coalesce(1).write.text(path)
    schema = StructType([StructField("id", IntegerType()), StructField("text", StringType())])
    kept = delimited.read_dropping_malformed(spark, path, schema)
    assert [r.id for r in kept.orderBy("id").collect()] == [1, 4]
    assert kept.select("id").count() == 2 and kept.count() == 2
    marked = delimited.read_marking_malformed(spark, path, schema)
    counts = {r.is_malformed: r.n for r in marked.groupBy("is_malformed").agg(F.count("*").alias("n")).collect()}
    assert counts == {True: 2, False: 2}


def test_header_schema_and_line_split(spark, path):
    spark.createDataFrame([("codigo;titulo\n1;a;b\n2",)], "v string").coalesce(1).write.text(path)
    assert delimited.header_schema(spark, path).names == ["codigo", "titulo"]
    rows = {r.codigo: r.titulo for r in delimited.read_split_lines(spark, path, ["codigo", "titulo"]).collect()}
    assert rows == {"codigo": "titulo", "1": "a", "2": None}


def test_libsvm_round_trip(spark, path):
    df = spark.createDataFrame([(1.0, Vectors.sparse(4, {1: 2.0})), (0.0, Vectors.dense(1, 0, 0, 3))], ["label", "features"])
    libsvm.write_libsvm(df, path)
    got = {r.label: r.features.toArray().tolist() for r in libsvm.read_libsvm(spark, path, 4).collect()}
    assert got == {1.0: [0, 2, 0, 0], 0.0: [1, 0, 0, 3]}
