import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslab.functions.text import has_content, remove_accents
from corpuslab.operators import cleaning


def _texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, text string")


def _by_id(df, column="text"):
    return {r["id"]: r[column] for r in df.collect()}


def _plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_trim_runs_before_tags_are_stripped(spark):
    df = _texts(spark, ["  <p> x </p> ", "<a\nb>x<i>y", "<br><br>", None])
    cleaned = cleaning.strip_tag_columns(cleaning.trim_columns(df, ["text"]), ["text"])
    assert _by_id(cleaned) == {0: " x ", 1: "<a\nb>xy", 2: "", 3: None}


def test_accents_with_rare_characters_and_null(spark):
    df = _texts(spark, ["São ﬁ ½ ø ê", "plain", None, "", "é", "한글 Ångström…", "①"])
    got = _by_id(cleaning.remove_accent_columns(df, ["text"]))
    assert got[0] == "Sao fi 1⁄2 ø e"
    assert got[2] is None
    for i, text in enumerate(["São ﬁ ½ ø ê", "plain", None, "", "é", "한글 Ångström…", "①"]):
        if text is not None:
            assert got[i] == _plain(text)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=20),
                min_size=40, max_size=80))
def test_accents_equal_decomposition(spark, texts):
    got = _by_id(cleaning.remove_accent_columns(_texts(spark, texts), ["text"]))
    assert got == {i: _plain(t) for i, t in enumerate(texts)}


def test_every_latin_character(spark):
    texts = [chr(p) for p in range(1, 0x2100)]
    got = _by_id(_texts(spark, texts).withColumn("text", remove_accents(F.col("text"))))
    assert got == {i: _plain(t) for i, t in enumerate(texts)}


BLANK = ["", "   ", None, "<br><br>", "́", " <b>́̂</b>"]
FILLED = ["x", "<b>x</b>", "<", "é", "\n", "<a\nb>", "<> y"]


def test_blank_text_is_dropped(spark):
    df = _texts(spark, BLANK + FILLED)
    kept = cleaning.clean_corpus(df, ["text"], required="text")
    assert sorted(_by_id(kept)) == list(range(len(BLANK), len(BLANK) + len(FILLED)))


@pytest.mark.parametrize("text", BLANK + FILLED)
def test_content_test_equals_cleaned_text(spark, text):
    df = _texts(spark, [text])
    cleaned = _by_id(cleaning.clean_corpus(df, ["text"]))[0]
    assert bool(df.select(has_content(F.col("text"))).first()[0]) == bool(cleaned)


def test_python_step_is_planned_once(spark, capsys):
    df = _texts(spark, ["a", "b"]).repartition(4, "id")
    cleaning.clean_corpus(df, ["text"], required="text").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_drop_and_count_blank(spark):
    df = _texts(spark, ["a", "", None])
    assert _by_id(cleaning.drop_blank(df, "text")) == {0: "a"}
    assert cleaning.count_blank(df, ["text"]).first()["text"] == 1


def test_null_audit_counts_nan_only_in_numbers(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (2, None, float("nan")), (None, "NaN", None)], "n bigint, s string, d double"
    )
    assert cleaning.null_audit(df).first().asDict() == {"n": 1, "s": 1, "d": 2}


def test_corpus_by_column_drops_its_own_blanks(spark):
    df = spark.createDataFrame([(1, "body", ""), (2, None, "summary")], "id bigint, body string, summary string")
    assert [r.id for r in cleaning.corpus_of(df, "body", ["id"]).collect()] == [1]
    assert [r.id for r in cleaning.corpus_of(df, "summary", ["id"]).collect()] == [2]
