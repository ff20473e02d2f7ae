"""Naive Bayes for any number of classes, and for all folds at once, as one long table of counts.

The table has an entry per term and class that occur together, not a column per class. A pair
that never occurs needs no entry, because it weighs the same for every term of a class:

    score = prior - mass * ln((class total + smoothing * width) / smoothing)
            + sum over terms that the class has of tf * ln((count + smoothing) / smoothing)

with the mass of a row its known tokens, each by the term's weight.

For cross-validation, the counts outside a fold are the counts of all rows less those of the
fold. One pass counts; one pass scores every row with what the other folds leave, for all
smoothing values. Nothing is fitted anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpuslab.functions.hashing import hash_bucket
from corpuslab.functions.text import counted_elements, whitespace_tokens
from corpuslab.operators.joins import BROADCAST_BYTES, lookup_join
from corpuslab.operators.layers import BIAS, outputs
from corpuslab.operators.tfidf import smoothed_idf
from corpuslab.session import materialize

_DIGITS = 9  # to which scores count as equal


def text_entries(df: DataFrame, text: str, keep: Sequence[str], width: int | None = None) -> DataFrame:
    """``keep`` columns and ``entries``: each row's terms (or their hash buckets) with their counts."""
    tokens = whitespace_tokens(F.col(text))
    if width is None:
        return df.select(*keep, counted_elements(tokens).alias("entries"))
    return _counted_buckets(df.select(*keep, F.transform(tokens, lambda t: hash_bucket(t, width)).alias("entries")))


def _counted_buckets(rows: DataFrame) -> DataFrame:
    """Rows whose last column, an array of numbers, becomes its distinct numbers with their counts, in order."""
    entry = StructType([StructField("term", LongType()), StructField("tf", LongType())])
    schema = StructType([*rows.schema.fields[:-1], StructField(rows.columns[-1], ArrayType(entry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.columns[-1]
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            row, term = np.repeat(np.arange(len(batch)), sizes), lists.flatten().to_numpy(zero_copy_only=False)
            order = np.lexsort((term, row))
            row, term = row[order], term[order]
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(term) != 0)])[:len(row)])
            counts = np.diff(np.append(begins, len(row)))
            pairs = pa.StructArray.from_arrays([pa.array(term[begins], pa.int64()), pa.array(counts, pa.int64())], names=["term", "tf"])
            ends = pa.array(np.searchsorted(row[begins], np.arange(len(batch) + 1)), pa.int32())
            entries = pa.ListArray.from_arrays(ends, pairs, mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], entries], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def vector_terms(vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``entries`` of rows with ``slots`` and ``values``."""
    return vectors.select(*keep, F.zip_with("slots", "values", lambda s, v: F.struct(
        s.alias("term"), v.cast("long").alias("tf"))).alias("entries"))


def _exploded(entries: DataFrame, *keep) -> DataFrame:
    return entries.select(*keep, F.explode_outer("entries").alias("__e")).where("__e is not null").select(
        *[F.col(c) for c in entries.select(*keep).columns], F.col("__e.term").alias("term"), F.col("__e.tf").alias("tf"))


@dataclass(frozen=True)
class ClassTerms:
    """Stored tables: ``terms`` (term, n, weight, classes: label and weighted count) and ``classes``
    (label, rank, prior, slope): without a shared term a class scores prior - mass * slope."""

    terms: DataFrame
    classes: DataFrame
    width: int
    smoothing: float


def fit(entries: DataFrame, label: str, smoothing: float = 1.0, width: int | None = None, weighted: bool = False) -> ClassTerms:
    """Count the terms of labelled rows, weighted by inverse document frequency if asked.

    ``width`` is the number of features, by default of the terms met. A term's entry lists the
    classes that it occurs with. ``rank`` orders classes by rows, then name.
    """
    rows = entries.where(F.col(label).isNotNull())
    pairs = _exploded(rows, F.col(label).alias("label")).groupBy("term", "label").agg(
        F.sum("tf").alias("n"), F.count(F.lit(1)).alias("rows"))
    terms = pairs.groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("rows").alias("doc_freq"), F.collect_list(F.struct("label", "n")).alias("found"))
    weight = smoothed_idf(F.lit(rows.count()), F.col("doc_freq")) if weighted else F.lit(1.0)
    terms = materialize(terms.withColumn("weight", weight).select("term", "n", "weight", F.transform(
        "found", lambda c: F.struct(c["label"].alias("label"), (c["n"] * F.col("weight")).alias("n"))).alias("classes")), "class-terms")
    width = width if width is not None else terms.count()
    totals = terms.select(F.inline("classes")).groupBy(F.col("label").alias("__label")).agg(F.sum("n").alias("mass"))
    sizes = materialize(rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_rows")), "class-sizes")
    whole = sizes.agg(F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("k")).first()
    order = Window.orderBy(F.col("n_rows").desc(), F.col("label"))  # one row per class
    classes = sizes.join(totals, F.col("label") == F.col("__label"), "left").select(
        "label", F.row_number().over(order).alias("rank"),
        (F.log(F.col("n_rows") + smoothing) - F.log(F.lit(float((whole.rows or 0) + whole.k * smoothing)))).alias("prior"),
        (F.log(F.coalesce("mass", F.lit(0.0)) + smoothing * width) - F.log(F.lit(float(smoothing)))).alias("slope"))
    return ClassTerms(terms, materialize(classes, "classes"), width, smoothing)


def _candidate(score: Column, rank: Column, label: Column) -> Column:
    """What is compared: the score, then the rank of the class."""
    return F.struct(F.round(score, _DIGITS).alias("rounded"), (-rank).alias("rank"), score.alias("score"), label.alias("label"))


def predict(model: ClassTerms, entries: DataFrame, id_column: str, label: str,
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, label, prediction, score) of each row; ties go to the class with more rows, then by name.

    Terms that training rows did not have add nothing. A row meets only the classes that it
    shares a term with; the best of all classes without regard to shared terms follows from the
    row's mass alone, and a class gains by each term shared. Ids must be unique.
    """
    s = float(model.smoothing)
    tokens = _exploded(entries, id_column)
    met = lookup_join(tokens, model.terms, "term", "n", id_column, "inner", broadcast_bytes)
    part = F.col("tf") * F.col("weight")
    gains = F.transform("classes", lambda c: F.struct(
        c["label"].alias("class"), (part * (F.log(c["n"] + s) - F.log(F.lit(s)))).alias("gain"), F.lit(0.0).alias("mass")))
    own = F.struct(F.lit(None).cast("string").alias("class"), F.lit(0.0).alias("gain"), part.alias("mass"))
    pairs = materialize(met.select(id_column, F.inline(F.concat(gains, F.array(own)))).groupBy(id_column, "class").agg(
        F.sum("gain").alias("gain"), F.sum("mass").alias("mass")), "row-classes")
    masses = pairs.where("class is null").select(F.col(id_column).alias("__id"), "mass")
    shared = pairs.where("class is not null").select(id_column, "class", "gain").join(
        masses, F.col(id_column) == F.col("__id")).join(model.classes, F.col("class") == F.col("label"))
    best = shared.groupBy(F.col(id_column).alias("__best_id")).agg(F.max(_candidate(
        F.col("prior") - F.col("mass") * F.col("slope") + F.col("gain"), F.col("rank"), F.col("class"))).alias("best"))
    rows = entries.select(id_column, F.col(label).alias("label")).join(masses, F.col(id_column) == F.col("__id"), "left").join(
        best, F.col(id_column) == F.col("__best_id"), "left")
    mass = F.coalesce("mass", F.lit(0.0))
    edge = F.array_max(F.array(*[_candidate(F.lit(r["prior"]) - mass * F.lit(r["slope"]), F.lit(r["rank"]), F.lit(r["label"]))
                                 for r in upper_edge(model.classes)]))
    return rows.select(id_column, "label", F.greatest(F.coalesce("best", edge), edge).alias("c")).select(
        id_column, "label", F.col("c.label").alias("prediction"), F.col("c.score").alias("score"))


def upper_edge(lines: DataFrame) -> list:
    """The classes whose line prior - mass * slope is the highest for some mass, as rows.

    Walks the edge from mass 0 on: the next line is the flatter one that meets this one first.
    One aggregation a step, and nothing but the edge reaches the driver.
    """
    edge = []
    current = lines.orderBy(F.col("prior").desc(), "rank").first()
    while current is not None:
        edge.append(current)
        meets = (F.lit(current["prior"]) - F.col("prior")) / (F.lit(current["slope"]) - F.col("slope"))
        current = lines.where(F.col("slope") < current["slope"]).orderBy(meets, "slope", "rank").first()
    return edge


def cross_validated(entries: DataFrame, id_column: str, label: str, fold: str, smoothings: Sequence[float],
                    width: int, held_out: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(fold, smoothing, n, n_right): each fold scored by naive Bayes on the rows of all others.

    Rows of the fold ``held_out`` are scored by all others too, but never counted. ``width`` is
    the number of hashed features. Classes, folds and smoothing values are few: a term's entry
    lists its counts by class and fold. A class with no row outside a fold is no choice there.
    Ties go to the class with more rows outside the fold, then by name. Ids must be unique.
    """
    rows = entries.where(F.col(label).isNotNull()).select(
        id_column, F.col(label).alias("label"), F.col(fold).cast("int").alias("fold"), "entries")
    sizes = {(r["label"], r["fold"]): r["n"] for r in rows.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    pairs = _exploded(rows, "label", "fold").groupBy("term", "label", "fold").agg(F.sum("tf").alias("n"))
    terms = materialize(pairs.groupBy("term").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("label", "fold", "n")).alias("parts")), "fold-terms")
    totals = {(r["label"], r["fold"]): r["n"] for r in
              terms.select(F.inline("parts")).groupBy("label", "fold").agg(F.sum("n").alias("n")).collect()}
    labels, folds = sorted({c for c, _ in sizes}), sorted({f for _, f in sizes})

    def outside(counts: dict, c: str, f: int) -> int:
        return sum(n for (d, g), n in counts.items() if d == c and g not in (f, held_out))

    # a term has a slot per fold: the logarithms that the other folds leave, and 1, so that tokens are summed too
    place = F.transform(F.array(*[F.lit(f) for f in folds]), lambda f, k: F.struct(f.alias("f"), k.alias("k"))) if folds else F.array()
    weights = []
    for c in labels:
        def mine(p, c=c):
            is_counted = (p["label"] == c) & (p["fold"] != F.col("at.f"))
            return is_counted if held_out is None else is_counted & (p["fold"] != held_out)

        count = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.when(mine(p), p["n"]).otherwise(F.lit(0)))
        weights += [F.log(count + float(s)) for s in smoothings]
    slot = lambda term, k: term.cast("long") * len(folds) + k
    none = terms.sparkSession.range(1).select(
        F.lit(BIAS).cast("long").alias("slot"), F.array_repeat(F.lit(0.0), len(weights) + 1).alias("weights"))
    layer = none if not folds else materialize(none.unionByName(
        terms.select("term", "parts", F.explode(place).alias("at")).select(
            slot(F.col("term"), F.col("at.k")).alias("slot"), F.array(*weights, F.lit(1.0)).alias("weights"))), "fold-layer")
    mine = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in folds]), F.col("fold")) - 1, F.lit(0)) if folds else F.lit(0)
    vectors = rows.select(id_column, F.transform("entries", lambda e: slot(e["term"], mine)).alias("slots"),
                          F.transform("entries", lambda e: e["tf"].cast("double")).alias("values"))
    scored = outputs(vectors, id_column, layer, broadcast_bytes).select(
        F.col(id_column).alias("__id"), F.col("outputs").alias("sums"), F.element_at("outputs", -1).alias("n_tokens"))
    own = rows.select(id_column, "label", "fold").join(scored, F.col(id_column) == F.col("__id"), "left")
    n_tokens = F.coalesce("n_tokens", F.lit(0))
    guesses = []
    for k, s in enumerate(smoothings):
        guess = F.lit(None).cast("string")
        for f in folds:
            there = sorted((c for c in labels if outside(sizes, c, f)), key=lambda c: (-outside(sizes, c, f), c))
            whole = sum(outside(sizes, c, f) for c in there) + len(there) * s
            candidates = [_candidate(
                F.log(F.lit(float(outside(sizes, c, f) + s))) - F.log(F.lit(float(whole)))
                + F.coalesce(F.get("sums", F.lit(labels.index(c) * len(smoothings) + k)), F.lit(0.0))
                - n_tokens * F.log(F.lit(float(outside(totals, c, f) + s * width))), F.lit(rank), F.lit(c))
                for rank, c in enumerate(there)]
            if candidates:
                guess = F.when(F.col("fold") == f, F.array_max(F.array(*candidates))["label"]).otherwise(guess)
        guesses.append(F.struct(F.lit(float(s)).alias("smoothing"), guess.alias("guess")))
    return own.select("fold", "label", F.inline(F.array(*guesses))).groupBy("fold", "smoothing").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess") == F.col("label")).alias("n_right"))


def tuning_table(folds: DataFrame, held_out: int) -> DataFrame:
    """Per smoothing value: mean accuracy over the folds, whether it is best (ties: the smaller
    value), and if so its accuracy on the held-out rows."""
    accuracy = F.col("n_right") / F.col("n")
    table = folds.groupBy("smoothing").agg(
        F.avg(F.when(F.col("fold") != held_out, accuracy)).alias("mean_accuracy"),
        F.max(F.when(F.col("fold") == held_out, accuracy)).alias("test_accuracy"))
    best = Window.orderBy(F.round("mean_accuracy", _DIGITS).desc(), "smoothing")  # one row per value
    is_best = F.row_number().over(best) == 1
    return table.select("smoothing", "mean_accuracy", is_best.alias("is_best"),
                        F.when(is_best, F.col("test_accuracy")).alias("test_accuracy"))
