"""Cases in which rows or columns could get lost."""

import os
import sys
import unicodedata

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpuslab.operators import classifiers, cleaning, naive_bayes, profiling, sampling, tokens
from corpuslab.session import materialize, scratch_scope, shared_dir
from corpuslab.sources import delimited


@pytest.fixture(scope="module")
def classed(spark):
    rows = [(i, "a" if i % 3 else "b", i * 10) for i in range(60)]
    return spark.createDataFrame(rows, "id bigint, kind string, n bigint")


def test_callers_column_n_stays(classed):
    kept = sampling.share_sample(classed, "id", "kind")
    assert kept.columns == classed.columns and all(r.n == r.id * 10 for r in kept.collect())
    tier = profiling.in_tier(classed, "kind", "id", 1, [1, 1])
    assert tier.columns == classed.columns and all(r.n == r.id * 10 for r in tier.collect())
    indexed = profiling.with_class_index(classed, "kind", "id")
    assert indexed.columns == [*classed.columns, "class_index"] and indexed.where("n <> id * 10").count() == 0


def test_text_that_cleaning_empties_is_blank(spark):
    emptied = [chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000
               and all(unicodedata.combining(c) for c in unicodedata.normalize("NFKD", chr(p)))]
    assert {"\u0f73", "\uff9e"} <= set(emptied)
    df = spark.createDataFrame([(c,) for c in emptied] + [("<b>x",)], "t string")
    assert [r.t for r in cleaning.clean_corpus(df, ["t"], required="t").collect()] == ["x"]


SCHEMA = StructType([StructField("id", IntegerType()), StructField("body", StringType())])


def test_malformed_scans_keep_records_with_line_breaks(spark, tmp_path):
    rows = [(1, "one"), (2, "two\nlines"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    path = delimited.write_delimited(df, str(tmp_path / "out"))
    kept = delimited.read_dropping_malformed(spark, path, SCHEMA)
    assert sorted(tuple(r) for r in kept.collect()) == rows
    marked = delimited.read_marking_malformed(spark, path, SCHEMA).collect()
    assert len(marked) == 4 and not any(r.is_malformed for r in marked)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("int"), F.repeat(F.lit("x"), 1000).alias("body")).coalesce(1)
    path = delimited.write_delimited(df, str(tmp_path / "out"), file_bytes=20_000)
    sizes = [os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".csv")]
    assert len(sizes) >= 10 and max(sizes) < 25_000


def test_scoring_leaves_the_model_as_it_is(spark):
    rows = spark.createDataFrame([(i, "x" if i % 2 else "y", "a b" if i % 2 else "c") for i in range(20)],
                                 "id bigint, label string, text string")
    model = classifiers.fit_classifier(rows, "label", classifiers.naive_bayes(), classifiers.hashed_text_stages("text", 16))
    before = model.stages[0].getHandleInvalid()
    new = spark.createDataFrame([(1, "unseen", "a b")], "id bigint, label string, text string")
    assert [r.prediction for r in classifiers.predictions(model, new, "id", "label").collect()] == ["x"]
    assert model.stages[0].getHandleInvalid() == before


def test_a_vocabulary_is_never_cut(spark):
    rows = spark.createDataFrame([(i, "x" if i % 2 else "y", f"w{i} w{i + 1} same") for i in range(40)],
                                 "id bigint, label string, text string")
    with pytest.raises(ValueError, match="42 terms"):
        classifiers.fit_classifier(rows, "label", classifiers.naive_bayes(), classifiers.counted_text_stages("text", 41))
    model = classifiers.fit_classifier(rows, "label", classifiers.naive_bayes(),
                                       classifiers.counted_text_stages("text", 42, weighted=False))
    tables = naive_bayes.fit_naive_bayes(rows, "label", "text", F.lit(True))
    by_table = {r.id: r.prediction for r in tables.predict(rows, "id", "text", "label").collect()}
    assert {r.id: r.prediction for r in classifiers.predictions(model, rows, "id", "label").collect()} == by_table


def test_terms_are_counted_inside_the_row(spark, capsys):
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "  "), (5, "x")], "id bigint, text string")
    counts = tokens.term_counts(df, "id", "text")
    assert sorted(tuple(r) for r in counts.collect()) == [(1, "a", 1), (1, "b", 2), (2, "", 1), (5, "x", 1)]
    counts.explain()
    assert "Exchange" not in capsys.readouterr().out


def test_default_stop_words_are_sparks(spark):
    df = spark.createDataFrame([(["de", "Casa", "N\u00e3o", "para", "x"],)], "t array<string>")
    own = tokens.remove_stop_words(df, "t").first().kept
    words = StopWordsRemover.loadDefaultStopWords("portuguese")
    theirs = StopWordsRemover(inputCol="t", outputCol="o", stopWords=words).transform(df).first().o
    assert own == theirs == ["Casa", "x"]


def test_a_scope_leaves_nothing_behind(spark):
    before = set(os.listdir(shared_dir(spark)))
    with scratch_scope(spark):
        assert materialize(spark.range(5), "scoped").count() == 5
        assert set(os.listdir(shared_dir(spark))) > before
    assert set(os.listdir(shared_dir(spark))) == before
