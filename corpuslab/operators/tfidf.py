"""Inverse document frequency and TF-IDF as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.functions.text import whitespace_tokens
from corpuslab.operators.joins import lookup_join
from corpuslab.operators.tokens import term_counts
from corpuslab.session import materialize


def smoothed_idf(n_docs: Column, doc_freq: Column) -> Column:
    """ln((documents + 1) / (documents with the term + 1))"""
    return F.log((n_docs + 1) / (doc_freq + 1))


def document_frequency(df: DataFrame, text: str) -> DataFrame:
    """Documents per term. Repeats are dropped inside each row, so that only
    one partial count per term and task is shuffled."""
    distinct = F.array_distinct(whitespace_tokens(F.col(text)))
    return (
        df.select(F.explode(distinct).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("doc_freq"))
    )


def idf(df: DataFrame, text: str, min_doc_freq: int = 0) -> DataFrame:
    """Term, document frequency and weight; terms below ``min_doc_freq`` weigh 0."""
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    weight = smoothed_idf(n_docs, F.col("doc_freq"))
    if min_doc_freq > 0:
        weight = F.when(F.col("doc_freq") >= min_doc_freq, weight).otherwise(F.lit(0.0))
    return document_frequency(df, text).withColumn("idf", weight)


def tf_idf(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Document, term, term count, weight and their product."""
    weights = materialize(idf(df, text), "idf")
    counts = term_counts(df, id_column, text)
    return lookup_join(counts, weights, "term", "doc_freq", id_column, "inner").select(
        id_column, "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tf_idf")
    )


def top_terms(weighted: DataFrame, id_column: str, k: int, digits: int = 6) -> DataFrame:
    """The ``k`` heaviest terms of each document, ties by term. A group is one document."""
    rounded = weighted.withColumn("tf_idf", F.round("tf_idf", digits))
    by_weight = Window.partitionBy(id_column).orderBy(F.col("tf_idf").desc(), F.col("term"))
    ranked = rounded.withColumn("rank", F.row_number().over(by_weight).cast("bigint"))
    return ranked.where(F.col("rank") <= k)
