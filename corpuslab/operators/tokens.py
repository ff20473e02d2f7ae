"""Tokens, n-grams and term counts.

Tokens come from built-in functions, which stay inside code generation; they
give the same arrays as the transformers of ``pyspark.ml.feature``, which the
classifier pipelines use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF, StopWordsRemover
from pyspark.ml.stat import Summarizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.hashing import hash_bucket
from corpuslab.functions.text import (
    counted_elements, joined_ngrams, pattern_tokens, whitespace_tokens, without_words,
)

def tokenize(df: DataFrame, text: str, output: str = "tokens") -> DataFrame:
    return df.withColumn(output, whitespace_tokens(F.col(text)))


def regex_tokenize(df: DataFrame, text: str, pattern: str, gaps: bool = True,
                   min_length: int = 1, output: str = "tokens") -> DataFrame:
    return df.withColumn(output, pattern_tokens(F.col(text), pattern, gaps, min_length))


def remove_stop_words(df: DataFrame, tokens: str, words: Sequence[str] | None = None,
                      language: str = "portuguese", output: str = "kept") -> DataFrame:
    """Arrays without stop words: the given ones, or Spark's list for the language."""
    listed = list(words) if words is not None else StopWordsRemover.loadDefaultStopWords(language)
    return df.withColumn(output, without_words(F.col(tokens), listed))


def ngrams(df: DataFrame, tokens: str, n: int = 3, output: str = "ngrams") -> DataFrame:
    return df.withColumn(output, joined_ngrams(F.col(tokens), n))


def token_counts(df: DataFrame, tokens: str, output: str = "n_tokens") -> DataFrame:
    return df.withColumn(output, F.size(tokens).cast("bigint"))


def elements(df: DataFrame, arrays: str, keep: Sequence[str] = (), output: str = "term") -> DataFrame:
    """One row per array element.

    For a plain ``explode`` of a column Spark adds a filter on the array's size
    and moves it down to the scan, where it computes the whole array once more.
    The outer form, with its null rows dropped afterwards, avoids that.
    """
    return df.select(*keep, F.explode_outer(arrays).alias(output)).where(F.col(output).isNotNull())


def positions(df: DataFrame, arrays: str, keep: Sequence[str], output: str = "term") -> DataFrame:
    """One row per array element, with its position."""
    exploded = df.select(*keep, F.posexplode_outer(arrays).alias("pos", output))
    return exploded.where(F.col("pos").isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))


def top_elements(df: DataFrame, arrays: str, k: int, output: str) -> DataFrame:
    """The ``k`` most frequent array elements, ties by value."""
    return (
        elements(df, arrays, output=output)
        .groupBy(output)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(output))
        .limit(k)
    )


def term_counts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Occurrences of each term in each row's text.

    Terms are counted inside the row, so neither text nor tokens move. An id that occurs in
    several rows has counts for each of them.
    """
    counted = counted_elements(whitespace_tokens(F.col(text)))
    return df.select(id_column, F.explode_outer(counted).alias("__c")).where("__c is not null").select(
        id_column, F.col("__c.term").alias("term"), F.col("__c.tf").alias("tf"))


def hashed_term_counts(df: DataFrame, id_column: str, text: str, buckets: int) -> DataFrame:
    """Occurrences of each hash bucket in each row's text, with an engine-neutral hash."""
    hashed = F.transform(whitespace_tokens(F.col(text)), lambda t: hash_bucket(t, buckets))
    return df.select(id_column, F.explode_outer(counted_elements(hashed)).alias("__c")).where("__c is not null").select(
        id_column, F.col("__c.term").alias("bucket"), F.col("__c.tf").alias("tf"))


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """Every term with its number of occurrences in the corpus."""
    return (
        df.select(F.explode(whitespace_tokens(F.col(text))).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def vocabulary_size(df: DataFrame, text: str) -> DataFrame:
    """Distinct terms of the corpus."""
    return vocabulary(df, text).agg(F.count(F.lit(1)).alias("n_terms"))


def hashed_vectors(df: DataFrame, tokens: str, num_features: int, output: str = "tf") -> DataFrame:
    return HashingTF(inputCol=tokens, outputCol=output, numFeatures=num_features).transform(df)


def vector_totals(df: DataFrame, vectors: str) -> DataFrame:
    """Per vector slot: sum over all rows and number of rows where it is not zero."""
    summary = df.select(
        Summarizer.metrics("sum", "numNonZeros").summary(F.col(vectors)).alias("s")
    ).select(
        F.arrays_zip(
            vector_to_array("s.sum").alias("total"), vector_to_array("s.numNonZeros").alias("rows")
        ).alias("slots")
    )
    return summary.select(F.posexplode("slots").alias("slot", "v")).select(
        F.col("slot").cast("bigint").alias("slot"),
        F.col("v.total").alias("total"),
        F.col("v.rows").cast("bigint").alias("n_rows"),
    )
