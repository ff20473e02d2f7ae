"""Dictionaries, long class tables, folds and sparse clusters against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from corpuslab.operators import class_terms, classifiers, dictionary, features, sparse_clustering
from corpuslab.operators.joins import BROADCAST_BYTES

WORDS = [f"w{i}" for i in range(60)]


def some_texts(n, n_classes, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = min(int(rng.expovariate(0.6)), n_classes - 1)
        own = [WORDS[(c * 7 + k) % 60] for k in range(12)]
        words = [rng.choice(own if rng.random() < 0.6 else WORDS) for _ in range(rng.randrange(0, 25))]
        rows.append((i, f"c{c:03d}", " ".join(words), i % 3))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_texts(300, 6), "id bigint, label string, text string, fold int")


@pytest.mark.parametrize("broadcast_bytes", [BROADCAST_BYTES, 0])
def test_dictionary_and_vectors(spark, docs, broadcast_bytes):
    tokens = {i: ([] if t and not t.strip() else t.split(" ")) for i, _, t, _ in some_texts(300, 6)}
    counts, freq = Counter(), Counter()
    for own in tokens.values():
        counts.update(own)
        freq.update(set(own))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    table = dictionary.term_dictionary(docs, "id", "text")
    assert {tuple(r) for r in table.collect()} == {(w, k, counts[w], freq[w]) for k, w in enumerate(order)}
    got = {r.id: (r.slots, r.own) for r in dictionary.count_vectors(docs, "id", "text", table, broadcast_bytes).select(
        "id", "slots", F.col("values").alias("own")).collect()}
    for i, own in tokens.items():
        want = sorted((order.index(w), float(n)) for w, n in Counter(own).items())
        assert list(zip(*got[i])) == want
    few = [w for w in order if freq[w] >= 40][:10]
    assert [r.term for r in dictionary.term_dictionary(docs, "id", "text", 40, 10).orderBy("term_id").collect()] == few


def plain_scores(train, text, smoothing, weighted=False):
    """Score of each class by the definition."""
    rows = Counter(c for _, c, _, _ in train)
    counts, freq = {c: Counter() for c in rows}, Counter()
    for _, c, t, _ in train:
        counts[c].update(t.split(" "))
        freq.update(set(t.split(" ")))
    weight = {w: math.log((len(train) + 1) / (n + 1)) if weighted else 1.0 for w, n in freq.items()}
    out = {}
    for c in rows:
        total = sum(n * weight[w] for w, n in counts[c].items())
        out[c] = math.log(rows[c] + smoothing) - math.log(len(train) + len(rows) * smoothing) + sum(
            weight[w] * (math.log(counts[c][w] * weight[w] + smoothing) - math.log(total + smoothing * len(freq)))
            for w in text.split(" ") if w in weight)
    best = max(out, key=lambda c: (round(out[c], 9), rows[c], [-ord(x) for x in c]))
    return best, out[best]


@pytest.mark.parametrize("smoothing, weighted, broadcast_bytes", [(1.0, False, BROADCAST_BYTES), (0.1, True, 0), (20.0, False, 0)])
def test_class_terms_equal_the_definition(spark, smoothing, weighted, broadcast_bytes):
    """Fifty classes, so that most share no term with a row; a heavy smoothing lets such classes win."""
    rows = [r for r in some_texts(400, 50, seed=9)] + [(900 + k, f"x{k}", "rare" + str(k) + " " * (k % 2), 1) for k in range(9)]
    rows = [(i, c, t.strip(), f) for i, c, t, f in rows]
    train, test = [r for r in rows if r[3]], [r for r in rows if not r[3]] + [(1000, "x1", "never seen", 0), (1001, None, "w1 " * 400 + "w1", 0)]
    schema = "id bigint, label string, text string, fold int"
    entries = lambda rs: class_terms.text_entries(spark.createDataFrame(rs, schema), "text", ["id", "label"])
    model = class_terms.fit(entries(train), "label", smoothing, weighted=weighted)
    got = {r.id: r for r in class_terms.predict(model, entries(test), "id", "label", broadcast_bytes).collect()}
    assert len(got) == len(test)
    for i, c, t, _ in test:
        name, score = plain_scores(train, t, smoothing, weighted)
        assert (got[i].label, got[i].prediction) == (c, name) and got[i].score == pytest.approx(score)


def test_upper_edge_of_lines(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 40):
        lines = [(f"l{k}", k, float(p), float(s)) for k, (p, s) in enumerate(zip(rng.integers(-9, 0, n), rng.integers(1, 30, n)))]
        edge = class_terms.upper_edge(spark.createDataFrame(lines, "label string, rank int, prior double, slope double"))
        for x in np.linspace(0, 12, 200):
            assert max(r.prior - x * r.slope for r in edge) == pytest.approx(max(p - x * s for _, _, p, s in lines))
    none = spark.createDataFrame([], "label string, rank int, prior double, slope double")
    assert class_terms.upper_edge(none) == []


@pytest.mark.parametrize("held_out", [None, 2])
def test_folds_equal_a_fit_without_them(spark, docs, held_out):
    """Every fold against pyspark.ml fitted on the rows of the others."""
    width, smoothings = 40, [0.5, 2.0]
    entries = class_terms.text_entries(docs, "text", ["id", "label", "fold"], width)
    got = {(r.fold, r.smoothing): (r.n, r.n_right) for r in class_terms.cross_validated(
        entries, "id", "label", "fold", smoothings, width, held_out).collect()}
    dense = entries.select("id", "label", "fold", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(
        F.try_element_at(F.map_from_entries("entries"), k.cast("long")),
        F.lit(0)).cast("double"))).alias("v"))
    for fold in range(3):
        train = dense.where((F.col("fold") != fold) & (F.lit(held_out is None) | (F.col("fold") != F.lit(held_out))))
        labels = features.fit_string_index(train, "label", "y")
        test = labels.transform(dense.where(F.col("fold") == fold))
        for s in smoothings:
            model = NaiveBayes(featuresCol="v", labelCol="y", smoothing=s).fit(labels.transform(train))
            rows = model.transform(test).select("y", "prediction").collect()
            assert got[fold, s] == (len(rows), sum(r.y == r.prediction for r in rows))
    assert len(got) == 6


def test_a_class_of_one_fold_is_no_choice_there(spark):
    df = spark.createDataFrame([(1, "only", "a a", 0), (2, "b", "a", 1), (3, "b", "c", 0), (4, None, "c", 1), (5, "b", None, 0)],
                               "id bigint, label string, text string, fold int")
    entries = class_terms.text_entries(df, "text", ["id", "label", "fold"], 8)
    got = {r.fold: (r.n, r.n_right) for r in class_terms.cross_validated(entries, "id", "label", "fold", [1.0], 8).collect()}
    assert got[0] == (3, 2) and got[1][0] == 1
    none = class_terms.cross_validated(entries.where("id < 0"), "id", "label", "fold", [1.0], 8)
    assert none.count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(6)
    dense = np.where(rng.random((150, 12)) < 0.3, rng.normal(0, 3, (150, 12)), 0.0)
    dense[7] = 0
    dense[8] = dense[9]
    rows = [(i, [int(s) for s in np.flatnonzero(v)], [float(x) for x in v[v != 0]]) for i, v in enumerate(dense)]
    return dense, spark.createDataFrame(rows, "id bigint, slots array<int>, values array<double>")


@pytest.mark.parametrize("broadcast_bytes", [BROADCAST_BYTES, 0])
def test_sparse_clusters_equal_all_distances(points, broadcast_bytes):
    dense, rows = points
    layer = sparse_clustering.drawn_centres(rows, "id", 9, seed=2)
    weights = {r.slot: r.weights for r in layer.collect()}
    centres = np.array([weights.get(s, [0.0] * 9) for s in range(12)]).T
    assert all(any((c == d).all() for d in dense) for c in centres)
    distance = ((dense[:, None] - centres[None]) ** 2).sum(axis=2)
    assigned = sparse_clustering.assign(rows, "id", layer, broadcast_bytes)
    got = {r.id: r for r in assigned.collect()}
    for i in range(150):
        assert got[i].cluster == int(np.round(distance[i], 6).argmin())
        assert got[i].distance_sq == pytest.approx(distance[i].min(), abs=1e-9)
    own = np.array([got[i].cluster for i in range(150)])
    moved = sparse_clustering.moved_centres(rows, "id", assigned, 9)
    weights = {r.slot: r.weights for r in moved.collect()}
    for k in range(9):
        mean = dense[own == k].mean(axis=0) if (own == k).any() else np.zeros(12)
        assert [weights.get(s, [0.0] * 9)[k] for s in range(12)] == pytest.approx(mean.tolist(), abs=1e-9)
    assert weights[-1] == pytest.approx([-(np.array([weights.get(s, [0.0] * 9)[k] for s in range(12)]) ** 2).sum() / 2 for k in range(9)])


def test_stored_stages_name_their_settings(spark, docs, tmp_path):
    model = classifiers.fit_classifier(docs, "label", classifiers.naive_bayes(0.5), classifiers.hashed_text_stages("text", 32))
    model.write().save(f"{tmp_path}/m")
    stages = {r.stage: r for r in classifiers.stored_stages(spark, f"{tmp_path}/m").collect()}
    assert [stages[k].kind for k in range(6)] == [
        "StringIndexerModel", "Tokenizer", "HashingTF", "IDFModel", "NaiveBayesModel", "IndexToString"]
    assert stages[2].params["numFeatures"] == "32" and stages[4].params["smoothing"] == "0.5"
    assert stages[4].params["modelType"] == "multinomial"
