"""Trees on sparse rows: the same trees as pyspark.ml where these leave nothing to chance, whole forests elsewhere."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpuslab.operators import classifiers, forests, sparse_trees

WIDTH = 40


@pytest.fixture(scope="module")
def rows(spark):
    """Slots with few values, with many, with negative ones, and never used; three classes, the last two told apart badly."""
    draw = np.random.default_rng(11)
    data = []
    for i in range(700):
        values = {int(s): float(draw.integers(1, 3 + s % 9)) for s in draw.choice(np.arange(2, 30), 5, replace=False)}
        values |= {0: draw.normal()} if i % 2 else {}
        values |= {1: float(draw.integers(-3, 60))} if i % 5 else {}
        score = values.get(0, 0.0) + values.get(4, 0.0) - 0.1 * values.get(1, 0.0) + values.get(7, 0.0) % 3
        data.append((Vectors.sparse(WIDTH, values), float(int(score > 0.5) + int(draw.random() < 0.3 and score > 1))))
    return spark.createDataFrame([*data, *data[:20]], ["features", "y"])


def same_nodes(spark, model, other):
    listed = lambda m: sorted((r.tree, r.node, r.slot, r.threshold, sorted(r.left_categories or []), r.n_categories, r.left,
                               r.right, r.n, r.gain, r.counts) for r in forests.forest_nodes(spark, m).collect())
    a, b = listed(model), listed(other)
    return len(a) > 1 and [r[:9] for r in a] == [r[:9] for r in b] and all(
        x[9] == pytest.approx(y[9]) and x[10] == y[10] for x, y in zip(a, b))


@pytest.mark.parametrize("labels, indexed, settings", [
    (3, None, {"impurity": "entropy", "maxDepth": 7, "maxBins": 16}), (2, None, {}), (3, 4, {}), (2, 12, {"impurity": "entropy"}),
    (3, 12, {"minInstancesPerNode": 9, "minInfoGain": 0.01})])
def test_a_tree_is_that_of_pyspark(spark, rows, monkeypatch, labels, indexed, settings):
    df = rows.where(F.col("y") < labels)
    if indexed:
        df = VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=indexed, handleInvalid="keep").fit(df).transform(df)
    own = classifiers._Tree(labelCol="y", featuresCol="indexed" if indexed else "features", seed=1, **settings)
    plain = DecisionTreeClassifier(labelCol="y", featuresCol="indexed" if indexed else "features", seed=1, **settings).fit(df)
    assert same_nodes(spark, own.fit(df), plain)  # small: by pyspark.ml
    monkeypatch.setattr(classifiers, "TREE_TASK_BYTES", 1000)
    monkeypatch.setattr(sparse_trees, "SUM_BYTES", 100_000)  # several passes a level, several pieces a node
    monkeypatch.setattr(sparse_trees, "PIECE", 300)
    fitted = []
    monkeypatch.setattr(sparse_trees, "fit", lambda *a, f=sparse_trees.fit: fitted.append(1) or f(*a))
    model = own.fit(df.repartition(5))
    assert fitted and same_nodes(spark, model, plain)
    assert model.numFeatures == WIDTH and model.depth == plain.depth
    assert model.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray())
    assert model.getLabelCol() == "y" and model.transform(df).where("prediction is null").count() == 0


def test_one_tree_of_all_rows_is_that_of_pyspark(spark, rows, monkeypatch):
    settings = dict(labelCol="y", numTrees=2, bootstrap=False, featureSubsetStrategy="all", seed=3)
    monkeypatch.setattr(classifiers, "TREE_TASK_BYTES", 1000)
    assert same_nodes(spark, classifiers._Forest(**settings).fit(rows), RandomForestClassifier(**settings).fit(rows))


def test_forests_draw_rows_and_slots(spark, rows, monkeypatch):
    monkeypatch.setattr(classifiers, "TREE_TASK_BYTES", 1000)
    forest = classifiers._Forest(labelCol="y", numTrees=9, seed=3)
    model = forest.fit(rows)
    assert model.getNumTrees == 9 and same_nodes(spark, model, forest.fit(rows))
    nodes = forests.forest_nodes(spark, model)
    roots = [r.n for r in nodes.where("node = 0").collect()]
    assert len(set(roots)) > 3 and all(600 < n < 840 for n in roots)  # 720 rows, drawn with putting back
    assert len({r.slot for r in nodes.where("node = 0").collect()}) > 1
    plain = RandomForestClassifier(labelCol="y", numTrees=9, seed=3).fit(rows)
    right = lambda m: m.transform(rows).where("prediction = y").count()
    assert right(model) >= 0.95 * right(plain)
    whole = forest.copy({forest.numTrees: 2}).fit(rows)
    assert whole.getNumTrees == 2


def test_thresholds_of_a_sample(spark, monkeypatch):
    """With more rows than are looked at, thresholds still part them about evenly."""
    monkeypatch.setattr(sparse_trees, "SAMPLE", 1024)
    df = spark.range(20_000).selectExpr("array(0.0D, cast(id % 997 as double), 0.0D) v").select(array_to_vector("v").alias("v"))
    found = sparse_trees.thresholds(df, "v", 3, {}, 20_000, 32, 7)
    assert list(found) == [1] and 25 <= len(found[1]) <= 36
    assert np.diff([0, *found[1], 997]) == pytest.approx([31.2] * (len(found[1]) + 1), abs=35)


def test_forest_settings_that_are_not_known_stay_with_pyspark(spark, rows, monkeypatch):
    monkeypatch.setattr(classifiers, "TREE_TASK_BYTES", 1000)
    monkeypatch.setattr(sparse_trees, "fit", None)
    assert classifiers._Forest(labelCol="y", numTrees=2, subsamplingRate=0.5, seed=1).fit(rows).getNumTrees == 2
    dense = rows.limit(50).rdd.map(lambda r: (Vectors.dense(r.features.toArray()), r.y)).toDF(["features", "y"])
    assert classifiers._Tree(labelCol="y").fit(dense).numNodes >= 1
