"""Fitted models as tables: the tables alone must say what the fitted objects say."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpuslab.operators import classifiers, features, forests, layers, numbering, optimality

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two measures, two categories and a slot that is often missing; labels follow them with some noise."""
    rng = random.Random(4)
    out = []
    for i in range(600):
        x, y, colour, shape = rng.random(), rng.gauss(0, 1), rng.randrange(6), rng.randrange(3)
        label = 2 if colour in (1, 4) and x > 0.4 else 1 if y + shape > 1 else 0
        if rng.random() < 0.08:
            label = rng.randrange(3)
        values = {0: x, 1: y, 2: float(colour), 3: float(shape)} | ({4: rng.random()} if i % 3 == 0 else {})
        out.append((i, Vectors.sparse(6, values) if i % 2 else Vectors.dense([values.get(k, 0.0) for k in range(6)]), label))
    return spark.createDataFrame(out, ["id", "v", "y"])


def test_entries_of_sparse_dense_and_null_vectors(spark):
    df = spark.createDataFrame([(1, Vectors.sparse(9, {7: 2.0, 1: -1.0}), "x"), (2, Vectors.dense([0.0, 3.0]), None),
                                (3, None, "y"), (4, Vectors.sparse(5, {}), "z")], ["id", "v", "slots_of"])
    got = {r.id: (r.slots_of, r.slots, r.values_) for r in
           features.vector_entries(df, "v", ["id", "slots_of"]).withColumnRenamed("values", "values_").collect()}
    assert got == {1: ("x", [1, 7], [-1.0, 2.0]), 2: (None, [0, 1], [0.0, 3.0]), 3: ("y", [], []), 4: ("z", [], [])}


def test_numbers_follow_a_total_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("other")).repartition(6)
    got = numbering.numbered(df, [F.col("k").desc()], "at")
    assert got.columns == ["k", "other", "at"]
    assert {(r.k, r["at"]) for r in got.collect()} == {(4999 - i, i) for i in range(5000)}
    assert numbering.numbered(df.where("k < 0"), [F.col("k")], "at").count() == 0


@pytest.mark.parametrize("broadcast_bytes", [forests.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("kind, settings", [
    (RandomForestClassifier, {"numTrees": 7, "maxDepth": 6}), (DecisionTreeClassifier, {"maxDepth": 9}),
    (RandomForestClassifier, {"numTrees": 2, "maxDepth": 0})])
def test_node_tables_score_like_the_forest(spark, rows, kind, settings, broadcast_bytes):
    train = rows.where("id % 4 > 0 and id <> 2")
    # some categories are missing from the rows that the slots are indexed on
    index = VectorIndexer(inputCol="v", outputCol="i", maxCategories=6, handleInvalid="keep").fit(
        train.where(F.col("id") % 4 > 0).where(F.col("y") != 1))
    model = kind(featuresCol="i", labelCol="y", seed=3, **settings).fit(index.transform(train))
    scored = model.transform(index.transform(rows))
    nodes = forests.forest_nodes(spark, model)
    entries = features.vector_entries(index.transform(rows), "i", ["id"])
    got = {r.id: r for r in forests.score_nodes(entries, "id", nodes, LABELS, broadcast_bytes).collect()}
    for r in scored.select("id", "probability", "prediction").collect():
        assert got[r.id].probability == pytest.approx(r.probability.tolist(), abs=1e-9)
        assert got[r.id].prediction == LABELS[int(r.prediction)]
    trees = getattr(model, "trees", [model])
    summary = {r.tree: r for r in forests.nodes_summary(nodes).collect()}
    for k, t in enumerate(trees):
        assert (summary[k].depth, summary[k].n_nodes) == (t.depth, t.numNodes)
    found = {r.slot: r.importance for r in forests.nodes_importances(nodes).collect()}
    want = model.featureImportances.toArray()
    assert [found.get(k, 0.0) for k in range(6)] == pytest.approx(want.tolist(), abs=1e-9)


@pytest.fixture(scope="module")
def entries(rows):
    return features.vector_entries(rows, "v", ["id", "y"]).withColumn(
        "label", F.element_at(F.array(*[F.lit(c) for c in LABELS]), F.col("y").cast("int") + 1))


@pytest.mark.parametrize("broadcast_bytes", [layers.BROADCAST_BYTES, 0])
def test_layers_score_like_the_network(spark, rows, entries, broadcast_bytes):
    train = rows.withColumn("label", F.element_at(F.array(*[F.lit(c) for c in LABELS]), F.col("y").cast("int") + 1))
    model = classifiers.fit_perceptron(train.withColumnRenamed("v", "features"), "label", [5, 4], max_iter=15)
    network, names = model.stages[1], model.stages[0].labels
    scored = network.transform(train.withColumnRenamed("v", "features"))
    tables = layers.network_layers(spark, network)
    assert [t.count() for t in tables] == [7, 6, 5]
    got = {r.id: r for r in layers.predict(entries, "id", tables, names, broadcast_bytes).collect()}
    for r in scored.select("id", "probability", "prediction").collect():
        assert got[r.id].probability == pytest.approx(r.probability.tolist(), abs=1e-9)
        assert got[r.id].prediction == names[int(r.prediction)]


def test_softmax_of_large_scores(spark):
    got = spark.range(1).select(layers.softmax(F.array(F.lit(1000.0), F.lit(999.0), F.lit(-1e6))).alias("p")).first().p
    assert got == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.e), 0.0])


def conditions(x, y, weights, bias, reg, share):
    """Violations by numpy: (class, slot) to number, slot -1 the intercept."""
    scores = x @ weights.T + bias
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    excess = p / p.sum(axis=1, keepdims=True) - np.eye(len(bias))[y]
    out = {(k, -1): abs(excess[:, k].mean()) for k in range(len(bias))}
    for j in range(x.shape[1]):
        scale = x[:, j].std(ddof=1)
        for k in range(len(bias)):
            if scale > 1e-12:
                slope, w = (excess[:, k] * x[:, j]).mean() / scale, weights[k, j] * scale
                out[k, j] = (max(abs(slope) - reg * share, 0) if w == 0
                             else abs(slope + reg * (1 - share) * w + reg * share * np.sign(w)))
    return out


@pytest.mark.parametrize("reg, share, max_iter", [(0.05, 0.8, 500), (0.02, 0.0, 500), (0.05, 1.0, 1), (0.5, 1.0, 100)])
def test_violations_equal_the_conditions_worked_out_by_hand(spark, rows, entries, reg, share, max_iter):
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=reg, elasticNetParam=share, maxIter=max_iter,
                               tol=1e-12, family="multinomial").fit(rows)
    layer = layers.regression_layer(spark, model)
    found = optimality.violations(entries, "id", "label", layer, LABELS, reg, share)
    got = {(LABELS.index(r["class"]), r.slot): r.violation for r in found.collect()}
    local = rows.orderBy("id").collect()
    want = conditions(np.array([r.v.toArray() for r in local]), np.array([r.y for r in local]),
                      model.coefficientMatrix.toArray(), model.interceptVector.toArray(), reg, share)
    assert got == pytest.approx(want, abs=1e-9)
    worst = {r["class"]: r.worst for r in optimality.certificate(found).collect()}
    # a fit that ran to its end is optimal, one that was stopped at once is not
    assert (max(worst.values()) < 1e-4) == (max_iter > 1)


def test_moved_coefficients_lose_the_certificate(spark, rows, entries):
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=0.01, elasticNetParam=0.5, maxIter=500,
                               tol=1e-12, family="multinomial").fit(rows)
    layer = layers.regression_layer(spark, model)
    moved = layer.withColumn("weights", F.when(F.col("slot") == 1, F.transform("weights", lambda w: w + 0.1)).otherwise(F.col("weights")))
    worst = lambda t: optimality.certificate(
        optimality.violations(entries, "id", "label", t, LABELS, 0.01, 0.5)).agg(F.max("worst")).first()[0]
    assert worst(layer) < 1e-4 < 1e-3 < worst(moved)
