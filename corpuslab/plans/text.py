"""Tokens, n-grams, term counts and TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.text import remove_accents
from corpuslab.operators import tfidf, tokens
from corpuslab.operators.classifiers import TEXT_FEATURES
from corpuslab.plans import fragments as sql
from corpuslab.plans.registry import query
from corpuslab.sources.tables import load_table

# A short stop list over the languages of the test corpus.
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "de", "la", "der", "que"]
TOP_TERMS = 5

_TOKENS = f"SELECT doc_id, {sql.tokens('text')} AS tk FROM documents"
_EXPLODED = f"SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents"


def _texts(spark, sf_dir):
    return load_table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")


@query(
    "tokenize",
    f"SELECT doc_id, generate_subscripts(tk,1)-1 AS pos, unnest(tk) AS term FROM ({_TOKENS})",
)
def tokenize(spark, sf_dir):
    return tokens.positions(tokens.tokenize(_texts(spark, sf_dir), "text"), "tokens", ["doc_id"])


_REGEX_TOKENS = (
    "SELECT doc_id, [x for x in string_split_regex(lower(strip_accents(text)),'[^a-z]+') "
    "if length(x) >= 2] AS tk FROM documents"
)


@query(
    "regex_tokenize",
    f"SELECT doc_id, generate_subscripts(tk,1)-1 AS pos, unnest(tk) AS term FROM ({_REGEX_TOKENS})",
)
def regex_tokenize(spark, sf_dir):
    plain = _texts(spark, sf_dir).withColumn("text", remove_accents(F.col("text")))
    cut = tokens.regex_tokenize(plain, "text", "[^a-z]+", min_length=2)
    return tokens.positions(cut, "tokens", ["doc_id"])


@query("token_counts", f"SELECT doc_id, len(tk) AS n_tokens FROM ({_TOKENS})")
def token_counts(spark, sf_dir):
    cut = tokens.tokenize(_texts(spark, sf_dir), "text")
    return tokens.token_counts(cut, "tokens").select("doc_id", "n_tokens")


_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "remove_stop_words",
    f"SELECT doc_id, term, count(*) AS n FROM ({_EXPLODED}) WHERE term NOT IN ({_STOP_LIST}) "
    "GROUP BY doc_id, term",
)
def remove_stop_words(spark, sf_dir):
    cut = tokens.tokenize(_texts(spark, sf_dir), "text")
    kept = tokens.remove_stop_words(cut, "tokens", STOP_WORDS)
    return (
        tokens.elements(kept, "kept", ["doc_id"])
        .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    )


@query("remove_default_stop_words")
def remove_default_stop_words(spark, sf_dir):
    """Tokens left by the default Portuguese stop list."""
    cut = tokens.tokenize(_texts(spark, sf_dir), "text")
    kept = tokens.remove_stop_words(cut, "tokens")
    return (
        tokens.elements(kept, "kept", ["doc_id"])
        .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    )


_NGRAMS = (
    "SELECT unnest([tk[i]||' '||tk[i+1]||' '||tk[i+2] for i in range(1, greatest(len(tk)-1,1))]) AS ngram "
    f"FROM ({_TOKENS})"
)


@query(
    "ngrams_3",
    f"SELECT ngram, count(*) AS n FROM ({_NGRAMS}) GROUP BY ngram",
)
def ngrams_3(spark, sf_dir):
    """Every run of three tokens with its number in the corpus."""
    cut = tokens.tokenize(_texts(spark, sf_dir), "text")
    return (
        tokens.elements(tokens.ngrams(cut, "tokens", 3), "ngrams", output="ngram")
        .groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    )


@query("hashing_tf")
def hashing_tf(spark, sf_dir):
    """Totals per bucket of the hashed counts of all documents."""
    cut = tokens.tokenize(_texts(spark, sf_dir), "text")
    return tokens.vector_totals(tokens.hashed_vectors(cut, "tokens", TEXT_FEATURES), "tf")


@query("hashing_tf_mass", f"SELECT count(*)::DOUBLE AS total FROM ({_EXPLODED})")
def hashing_tf_mass(spark, sf_dir):
    """Hashing moves tokens between buckets but loses none."""
    cut = tokens.tokenize(_texts(spark, sf_dir), "text")
    slots = tokens.vector_totals(tokens.hashed_vectors(cut, "tokens", TEXT_FEATURES), "tf")
    return slots.agg(F.sum("total").alias("total"))


@query(
    "hashed_term_counts",
    f"SELECT doc_id, {sql.bucket('term', TEXT_FEATURES)} AS bucket, count(*) AS tf FROM ({_EXPLODED}) "
    "GROUP BY 1, 2",
)
def hashed_term_counts(spark, sf_dir):
    return tokens.hashed_term_counts(_texts(spark, sf_dir), "doc_id", "text", TEXT_FEATURES)


@query("term_counts", f"SELECT doc_id, term, count(*) AS tf FROM ({_EXPLODED}) GROUP BY doc_id, term")
def term_counts(spark, sf_dir):
    return tokens.term_counts(_texts(spark, sf_dir), "doc_id", "text")


@query(
    "vocabulary_size",
    f"SELECT count(DISTINCT term) AS n_terms FROM ({_EXPLODED})",
)
def vocabulary_size(spark, sf_dir):
    return tokens.vocabulary_size(_texts(spark, sf_dir), "text")


_IDF = (
    "SELECT term, count(DISTINCT doc_id) AS doc_freq, "
    "ln(((SELECT count(*) FROM documents)+1)/(count(DISTINCT doc_id)+1)) AS idf "
    f"FROM ({_EXPLODED}) GROUP BY term"
)


@query("idf", f"SELECT term, doc_freq, round(idf,6) AS idf FROM ({_IDF})")
def idf(spark, sf_dir):
    return tfidf.idf(_texts(spark, sf_dir), "text").withColumn("idf", F.round("idf", 6))


_TF_IDF = (
    f"WITH t AS ({_EXPLODED}), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term), "
    f"i AS ({_IDF}), w AS (SELECT doc_id, term, tf, round(tf*idf,6) AS tf_idf FROM c JOIN i USING (term)) "
)


@query("tf_idf", _TF_IDF + "SELECT doc_id, term, tf, tf_idf FROM w")
def tf_idf(spark, sf_dir):
    weighted = tfidf.tf_idf(_texts(spark, sf_dir), "doc_id", "text")
    return weighted.select("doc_id", "term", "tf", F.round("tf_idf", 6).alias("tf_idf"))


@query(
    "tf_idf_top_terms",
    _TF_IDF + "SELECT * FROM (SELECT doc_id, term, tf_idf, row_number() OVER "
    f"(PARTITION BY doc_id ORDER BY tf_idf DESC, term) AS rank FROM w) WHERE rank <= {TOP_TERMS}",
)
def tf_idf_top_terms(spark, sf_dir):
    weighted = tfidf.tf_idf(_texts(spark, sf_dir), "doc_id", "text")
    return tfidf.top_terms(weighted, "doc_id", TOP_TERMS).select("doc_id", "term", "tf_idf", "rank")
