"""Networks on sparse rows: slopes, the fit beside that of pyspark.ml, and which rows go where."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors

from corpuslab.operators import classifiers, features, perceptron

WIDTH = 40


@pytest.fixture(scope="module")
def rows(spark):
    """Rows whose label is told by one slot; some rows twice, one without entries, one without a label."""
    draw = np.random.default_rng(5)
    data = []
    for i in range(90):
        slots = sorted({i % 3, *(int(s) for s in draw.choice(np.arange(3, WIDTH), 4, replace=False))})
        data.append((i, "abc"[i % 3], Vectors.sparse(WIDTH, slots, [1.0 + (s % 2) for s in slots])))
    data += [data[0], data[1], (90, "a", Vectors.sparse(WIDTH, [], [])), (91, None, data[2][2])]
    return spark.createDataFrame(data, ["id", "label", "features"])


def test_slopes_are_those_of_the_loss(spark, rows):
    entries = features.vector_entries(rows.where("label is not null"), "features", ["label"]).selectExpr(
        "cast(ascii(label) - 97 as double) label_index", "slots", "values").repartition(3)
    sizes = [WIDTH, 5, 4, 3]
    at = perceptron._mean_loss(entries, sizes)
    weights = np.random.default_rng(1).normal(0, 0.5, sum((a + 1) * b for a, b in zip(sizes, sizes[1:])))
    loss, slope = at(weights)
    for k in (0, 17, 5 * WIDTH, 5 * WIDTH + 7, len(weights) - 1):
        moved = weights.copy()
        moved[k] += 1e-5
        assert (at(moved)[0] - loss) / 1e-5 == pytest.approx(slope[k], abs=1e-4)
    again = at(weights)
    assert again[0] == loss and (again[1] == slope).all()


def test_pieces_and_blocks_change_nothing(spark, rows, monkeypatch):
    entries = features.vector_entries(rows.where("label is not null"), "features", ["label"]).selectExpr(
        "cast(ascii(label) - 97 as double) label_index", "slots", "values")
    weights = np.random.default_rng(2).normal(0, 0.5, (WIDTH + 1) * 4 + 5 * 3)
    loss, slope = perceptron._mean_loss(entries, [WIDTH, 4, 3])(weights)
    monkeypatch.setattr(perceptron, "BLOCK", 7)
    monkeypatch.setattr(perceptron, "PIECE", 50)
    cut = perceptron._mean_loss(entries, [WIDTH, 4, 3])(weights)
    assert cut[0] == pytest.approx(loss) and cut[1] == pytest.approx(slope)


def test_sparse_rows_are_not_fitted_at_full_width(spark, rows, monkeypatch):
    fits, plain = [], MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: fits.append(
        (self.getMaxIter(), df.count())) or plain(self, df))
    model = classifiers.fit_perceptron(rows, "label", [6], max_iter=60)
    assert fits == [(0, 1), (0, 1)]
    scored = classifiers.predictions(model, rows, "id", "label").where("label is not null").collect()
    assert len(scored) == 93 and all(r.label == r.prediction for r in scored if r.id != 90)


def test_fit_gets_as_low_as_pyspark(spark, rows):
    model = classifiers.fit_perceptron(rows, "label", [6], max_iter=25)
    indexed = model.stages[0].transform(rows).where("label is not null")
    plain = MultilayerPerceptronClassifier(layers=[WIDTH, 6, 4], maxIter=25, seed=classifiers.SEED, labelCol="label_index").fit(indexed)
    entries = features.vector_entries(indexed, "features", ["label_index"])
    at = perceptron._mean_loss(entries, [WIDTH, 6, 4])
    assert at(model.stages[1].weights.toArray())[0] <= 1.5 * at(plain.weights.toArray())[0] + 1e-3


def test_minimum_of_a_bowl_with_unlike_axes():
    scale = np.array([1.0, 30.0, 900.0])
    found = perceptron.minimum(lambda x: (0.5 * (scale * (x - 3) ** 2).sum(), scale * (x - 3)), np.zeros(3), 100, 1e-9)
    assert found == pytest.approx([3.0] * 3, abs=1e-2)


def test_dense_rows_stay_with_pyspark(spark):
    data = [(i, "xy"[i % 2], Vectors.dense([float(i % 2), 1.0])) for i in range(8)]
    model = classifiers.fit_perceptron(spark.createDataFrame(data, ["id", "label", "features"]), "label", [3], max_iter=7)
    assert model.stages[1].getMaxIter() == 7


def test_many_rows_take_the_first_layer_in_single_precision(spark, rows, monkeypatch):
    entries = features.vector_entries(rows.where("label is not null"), "features", ["label"]).selectExpr(
        "cast(ascii(label) - 97 as double) label_index", "slots", "values")
    weights = np.random.default_rng(3).normal(0, 0.5, (WIDTH + 1) * 5 + 6 * 3)
    loss, slope = perceptron._mean_loss(entries, [WIDTH, 5, 3])(weights)
    for full in (0.5, 2.0):  # blocks at full width, blocks packed
        monkeypatch.setattr(perceptron, "FULL", full)
        near = perceptron._mean_loss(entries, [WIDTH, 5, 3], single=True)(weights)
        assert near[0] == pytest.approx(loss, rel=1e-6) and near[1] == pytest.approx(slope, abs=1e-5)
        assert (near[1] != slope).any()
    asked, plain = [], perceptron.fit_weights
    monkeypatch.setattr(perceptron, "fit_weights", lambda *a: asked.append(a[-1]) or plain(*a))
    classifiers.fit_perceptron(rows, "label", [3], max_iter=2)
    monkeypatch.setattr(classifiers, "SINGLE_ROWS", 94)
    model = classifiers.fit_perceptron(rows, "label", [3], max_iter=2)
    assert asked == [False, True] and len(model.stages[1].weights) == (WIDTH + 1) * 3 + 4 * 4
