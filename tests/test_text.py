import math

import pytest
from pyspark.ml.feature import (
    IDF, CountVectorizer, HashingTF, NGram, RegexTokenizer, StopWordsRemover, Tokenizer,
)
from pyspark.sql import functions as F

from corpuslab.functions.hashing import hash_bucket, md5_bits
from corpuslab.operators import tfidf, tokens

TEXTS = ["  A  b\tC\x0bd  ", "", "   ", "\n", "x", "The cat and THE dog ", "a\n\nb \x1c", "É è", "a b c d a b c"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, text string")


def _arrays(df, column):
    return {r.id: r[column] for r in df.collect()}


def test_tokens_equal_the_ml_tokenizer(texts):
    got = _arrays(tokens.tokenize(texts, "text"), "tokens")
    assert got == _arrays(Tokenizer(inputCol="text", outputCol="tokens").transform(texts), "tokens")
    assert got[0] == ["", "", "a", "", "b", "c", "d"]


@pytest.mark.parametrize("pattern, gaps, shortest", [("[^a-z]+", True, 1), ("[^a-z]+", True, 3), ("[a-z]+", False, 1), ("\\s", True, 2)])
def test_pattern_tokens_equal_the_ml_tokenizer(texts, pattern, gaps, shortest):
    ml = RegexTokenizer(inputCol="text", outputCol="tokens", pattern=pattern, gaps=gaps, minTokenLength=shortest)
    got = tokens.regex_tokenize(texts, "text", pattern, gaps, shortest)
    assert _arrays(got, "tokens") == _arrays(ml.transform(texts), "tokens")


@pytest.mark.parametrize("words", [["the", "AND"], None])
def test_stop_words_equal_the_ml_remover(texts, words):
    cut = tokens.tokenize(texts, "text")
    listed = words or StopWordsRemover.loadDefaultStopWords("portuguese")
    ml = StopWordsRemover(inputCol="tokens", outputCol="kept", stopWords=listed)
    assert _arrays(tokens.remove_stop_words(cut, "tokens", words), "kept") == _arrays(ml.transform(cut), "kept")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_equal_the_ml_ngrams(texts, n):
    cut = tokens.tokenize(texts, "text")
    ml = NGram(n=n, inputCol="tokens", outputCol="ngrams")
    assert _arrays(tokens.ngrams(cut, "tokens", n), "ngrams") == _arrays(ml.transform(cut), "ngrams")


def test_counts_and_vocabulary(texts):
    counts = {(r.id, r.term): r.tf for r in tokens.term_counts(texts, "id", "text").collect()}
    assert counts[8, "a"] == 2 and counts[8, "d"] == 1 and (1, "") in counts and not any(i == 2 for i, _ in counts)
    size = tokens.vocabulary_size(texts, "text").first()
    assert size.n_terms == len({t for _, t in counts})
    model = CountVectorizer(inputCol="tokens", outputCol="v").fit(tokens.tokenize(texts, "text"))
    assert size.n_terms == len(model.vocabulary)


def test_hashed_counts_keep_every_token(texts):
    hashed = tokens.hashed_term_counts(texts, "id", "text", 4)
    per_doc = {r.id: r.n for r in hashed.groupBy("id").agg(F.sum("tf").alias("n")).collect()}
    lengths = {r.id: r.n_tokens for r in tokens.token_counts(tokens.tokenize(texts, "text"), "tokens").collect()}
    assert per_doc == {i: n for i, n in lengths.items() if n}
    vectors = tokens.hashed_vectors(tokens.tokenize(texts, "text"), "tokens", 16)
    assert tokens.vector_totals(vectors, "tf").agg(F.sum("total")).first()[0] == sum(lengths.values())


def test_md5_bits(spark):
    row = spark.range(1).select(md5_bits(F.lit("abc")).alias("b"), hash_bucket(F.lit("abc"), 10).alias("k")).first()
    assert row.b == 0x90015098 and row.k == 0x90015098 % 10


def test_idf_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a b")], "id bigint, text string")
    got = {r.term: r.idf for r in tfidf.idf(df, "text").collect()}
    assert got == {"a": pytest.approx(0.0), "b": pytest.approx(math.log(3 / 2))}
    assert {r.term: r.idf for r in tfidf.idf(df, "text", min_doc_freq=2).collect()}["b"] == 0.0


def test_idf_equals_the_ml_model(texts):
    cut = tokens.tokenize(texts, "text")
    counter = CountVectorizer(inputCol="tokens", outputCol="tf").fit(cut)
    model = IDF(inputCol="tf", outputCol="f").fit(counter.transform(cut))
    ml = dict(zip(counter.vocabulary, model.idf.toArray()))
    assert {r.term: pytest.approx(r.idf) for r in tfidf.idf(texts, "text").collect()} == ml


def test_top_terms_break_ties_by_name(spark):
    df = spark.createDataFrame([(1, "b a c"), (2, "z"), (3, "z y y")], "id bigint, text string")
    top = tfidf.top_terms(tfidf.tf_idf(df, "id", "text"), "id", 2).orderBy("id", "rank").collect()
    assert [(r.id, r.term) for r in top] == [(1, "a"), (1, "b"), (2, "z"), (3, "y"), (3, "z")]


def test_tokens_are_computed_once(texts, capsys):
    """No filter that repeats the tokenising may sink to the scan."""
    cut = tokens.tokenize(texts.repartition(4, "id"), "text")
    for frame in (tokens.positions(cut, "tokens", ["id"]), tokens.elements(cut, "tokens", ["id"])):
        frame.explain()
        assert capsys.readouterr().out.count("split(") == 1


def test_hashing_is_fixed_width(texts):
    vectors = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=8).transform(tokens.tokenize(texts, "text"))
    assert {v.tf.size for v in vectors.collect()} == {8}
