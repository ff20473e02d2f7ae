"""Term dictionary and sparse count vectors, with nothing as long as the vocabulary in one place.

Terms are numbered by frequency with a range sort, and each document's vector is put together
from its own (term, count) pairs after a join with the numbered terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.operators.joins import BROADCAST_BYTES, lookup_join
from corpuslab.operators.numbering import numbered
from corpuslab.operators.tokens import term_counts
from corpuslab.session import materialize


def term_dictionary(df: DataFrame, id_column: str, text: str, min_doc_freq: int = 1, size: int | None = None) -> DataFrame:
    """(term, term_id, n, doc_freq): the most frequent term is 0, ties by term.

    Terms in fewer than ``min_doc_freq`` rows are left out; ``size``, if given, keeps the first
    terms of that number, as a vocabulary limit does. The table is stored.
    """
    counts = term_counts(df, id_column, text).groupBy("term").agg(
        F.sum("tf").alias("n"), F.count(F.lit(1)).alias("doc_freq")).where(F.col("doc_freq") >= min_doc_freq)
    terms = numbered(counts, [F.col("n").desc(), F.col("term")], "term_id")
    if size is not None:
        terms = terms.where(F.col("term_id") < size)
    return materialize(terms.select("term", "term_id", "n", "doc_freq"), "dictionary")


def count_entries(df: DataFrame, id_column: str, text: str, dictionary: DataFrame,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, term_id, tf): each row's terms that the dictionary has, by number."""
    counts = term_counts(df, id_column, text)
    joined = lookup_join(counts, dictionary.select("term", "term_id", "n"), "term", "n", id_column, "inner", broadcast_bytes)
    return joined.select(id_column, "term_id", "tf")


def count_vectors(df: DataFrame, id_column: str, text: str, dictionary: DataFrame,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, slots, values): sparse count vectors, slots ascending; rows without known terms have none.

    Ids must be unique. A group is one document's distinct terms.
    """
    entries = count_entries(df, id_column, text, dictionary, broadcast_bytes)
    pairs = entries.groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("term_id", "tf"))).alias("pairs"))
    own = pairs.select(F.col(id_column).alias("__id"), "pairs")
    joined = df.select(id_column).join(own, F.col(id_column) == F.col("__id"), "left")
    at = lambda f: F.coalesce(F.transform("pairs", lambda p: p[f]), F.array().cast("array<bigint>"))
    return joined.select(id_column, at("term_id").alias("slots"), at("tf").cast("array<double>").alias("values"))
