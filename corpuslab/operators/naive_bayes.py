"""Multinomial naive Bayes over terms, with counting and scoring left to Spark."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.hashing import hash_bucket
from corpuslab.functions.text import counted_elements, whitespace_tokens
from corpuslab.operators.joins import lookup_join
from corpuslab.operators.tfidf import smoothed_idf
from corpuslab.session import materialize

IDF_NONE, IDF_TRAIN, IDF_ALL = "none", "train", "all"


def term_array(text: Column, buckets: int | None = None) -> Column:
    """Tokens of a text, or their hash buckets."""
    tokens = whitespace_tokens(text)
    return tokens if buckets is None else F.transform(tokens, lambda t: hash_bucket(t, buckets))


@dataclass(frozen=True)
class NaiveBayesModel:
    """Fitted tables. Per-class numbers are plain lists, per-term numbers a stored table
    with columns ``term``, ``n`` (occurrences), ``weight`` and ``counts`` (one per class)."""

    classes: list[str]
    class_rows: list[int]
    terms: DataFrame
    totals: list[float]
    n_features: int
    smoothing: float
    buckets: int | None

    @property
    def log_priors(self) -> list[float]:
        rows, k = sum(self.class_rows), len(self.classes)
        return [
            math.log(n + self.smoothing) - math.log(rows + k * self.smoothing)
            for n in self.class_rows
        ]

    def priors(self, spark: SparkSession) -> DataFrame:
        """One row per class."""
        rows = list(zip(self.classes, self.class_rows, self.log_priors))
        return spark.createDataFrame(rows, "label string, n bigint, log_prior double")

    def _log_likelihoods(self) -> list[Column]:
        return [
            F.log(F.col("counts")[i] + self.smoothing)
            - math.log(total + self.smoothing * self.n_features)
            for i, total in enumerate(self.totals)
        ]

    def log_likelihood(self) -> DataFrame:
        """One row per term and class."""
        per_class = F.array(
            *[
                F.struct(F.lit(c).alias("label"), value.alias("log_likelihood"))
                for c, value in zip(self.classes, self._log_likelihoods())
            ]
        )
        return self.terms.select("term", F.inline(per_class))

    def scores(self, df: DataFrame, id_column: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
        """One row per document with its array of class scores; terms not seen
        in training add nothing."""
        weighted = self.terms.select(
            "term", "n",
            *[(F.col("weight") * v).alias(f"w{i}") for i, v in enumerate(self._log_likelihoods())],
        )
        counted = counted_elements(term_array(F.col(text), self.buckets))
        tokens = df.select(id_column, *keep, F.explode_outer(counted).alias("__c")).select(
            id_column, *keep, F.col("__c.term").alias("term"), F.col("__c.tf").alias("__tf"))
        joined = lookup_join(tokens, weighted, "term", "n", id_column, "left")
        sums = [F.coalesce(F.sum(F.col("__tf") * F.col(f"w{i}")), F.lit(0.0)) for i in range(len(self.classes))]
        return joined.groupBy(id_column, *keep).agg(
            F.array(*[s + F.lit(p) for s, p in zip(sums, self.log_priors)]).alias("scores")
        )

    def predict(self, df: DataFrame, id_column: str, text: str, label: str) -> DataFrame:
        """Document, label, most likely class (ties to the more frequent one) and its score."""
        best = F.array_max("scores")
        names = F.array(*[F.lit(c) for c in self.classes])
        return self.scores(df, id_column, text, [label]).select(
            id_column,
            F.col(label).alias("label"),
            F.element_at(names, F.array_position("scores", best).cast("int")).alias("prediction"),
            best.alias("score"),
        )


def fit_naive_bayes(
    df: DataFrame, label: str, text: str, train: Column, smoothing: float = 1.0,
    idf: str = IDF_NONE, buckets: int | None = None,
) -> NaiveBayesModel:
    """Fit on the rows where ``train`` holds.

    ``idf`` weighs the counts by inverse document frequency, taken from the
    training rows or from all rows of ``df``. ``buckets`` hashes terms to a
    fixed number of features; the term table is then at most that long.

    All per-term numbers come from one aggregation by term with partial counts
    in each task, so a very frequent term costs one row per task.
    """
    df = df.where(F.col(label).isNotNull())
    # One row per class and part; the order is that of a string index.
    sizes = df.groupBy(F.col(label).alias("label"), train.alias("is_train")).agg(
        F.count(F.lit(1)).alias("n")
    ).collect()
    listed = sorted((r for r in sizes if r["is_train"]), key=lambda r: (-r["n"], r["label"]))
    classes = [r["label"] for r in listed]
    n_docs = sum(r["n"] for r in sizes if r["is_train"] or idf == IDF_ALL)

    source = df if idf == IDF_ALL else df.where(train)
    rows = source.select(
        F.col(label).alias("label"), train.alias("is_train"),
        term_array(F.col(text), buckets).alias("terms"),
    )
    # Each document gives its terms with repeats, for the counts, and if weights
    # are wanted once more without, for the document frequencies.
    lists = [F.struct(F.col("terms").alias("terms"), F.lit(True).alias("repeats"))]
    if idf != IDF_NONE:
        lists.append(F.struct(F.array_distinct("terms").alias("terms"), F.lit(False).alias("repeats")))
    exploded = (
        rows.select("label", "is_train", F.inline(F.array(*lists)))
        .select("label", "is_train", "repeats", F.explode("terms").alias("term"))
    )
    counted = F.col("repeats") & F.col("is_train")
    per_class = [
        F.count_if(counted & (F.col("label") == F.lit(c))).cast("double").alias(f"c{i}")
        for i, c in enumerate(classes)
    ]
    counts = exploded.groupBy("term").agg(
        F.count_if(counted).alias("n"), F.count_if(~F.col("repeats")).alias("doc_freq"), *per_class
    ).where(F.col("n") > 0)

    weight = F.lit(1.0)
    if idf != IDF_NONE:
        weight = smoothed_idf(F.lit(n_docs), F.col("doc_freq"))
    terms = materialize(
        counts.withColumn("weight", weight).select(
            "term", "n", "weight",
            F.array(*[F.col("weight") * F.col(f"c{i}") for i in range(len(classes))]).alias("counts"),
        ),
        "term-counts",
    )
    summary = terms.agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.array(*[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0.0)) for i in range(len(classes))]).alias("totals"),
    ).first()
    return NaiveBayesModel(
        classes, [r["n"] for r in listed], terms, list(summary["totals"]),
        buckets if buckets is not None else summary["n_terms"], smoothing, buckets,
    )
