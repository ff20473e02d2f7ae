import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpuslab.operators import classifiers, clustering, features, metrics, naive_bayes, tokens

DOCS = [
    (0, "pol", "vote law vote senate", True), (1, "pol", "law senate minister", True),
    (2, "pol", "vote minister budget", True), (3, "eco", "budget bank rate", True),
    (4, "eco", "bank rate rate market", True), (5, "spo", "goal match goal", True),
    (6, "pol", "law budget unseen", False), (7, "eco", "rate bank", False),
    (8, "spo", "goal", False), (9, "spo", "never seen words", False), (10, "new", "", False),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id bigint, label string, text string, train boolean")


@pytest.mark.parametrize("idf", [naive_bayes.IDF_NONE, naive_bayes.IDF_TRAIN])
def test_tables_equal_the_ml_model(docs, idf):
    model = naive_bayes.fit_naive_bayes(docs, "label", "text", F.col("train"), idf=idf)
    got = {r.id: (r.prediction, r.score) for r in
           model.predict(docs.where("not train"), "id", "text", "label").collect()}

    cut = tokens.tokenize(docs, "text")
    train, test = cut.where("train"), cut.where("not train")
    counter = CountVectorizer(inputCol="tokens", outputCol="tf").fit(train)
    train, test = counter.transform(train), counter.transform(test)
    column = "tf"
    if idf == naive_bayes.IDF_TRAIN:
        weights = IDF(inputCol="tf", outputCol="w").fit(train)
        train, test, column = weights.transform(train), weights.transform(test), "w"
    labels = StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep").fit(train)
    ml = NaiveBayes(featuresCol=column, labelCol="y", smoothing=1.0).fit(labels.transform(train))
    for row in ml.transform(test).collect():
        name, score = got[row.id]
        assert name == labels.labels[int(row.prediction)]
        assert score == pytest.approx(max(row.rawPrediction.toArray()))
    assert len(got) == 5


def test_unknown_terms_leave_the_prior(docs):
    model = naive_bayes.fit_naive_bayes(docs, "label", "text", F.col("train"))
    got = {r.id: r for r in model.predict(docs.where("not train"), "id", "text", "label").collect()}
    assert got[9].prediction == "pol" and got[9].score == pytest.approx(model.log_priors[0])


def test_hashed_tables_have_a_fixed_number_of_features(docs):
    model = naive_bayes.fit_naive_bayes(docs, "label", "text", F.col("train"), idf=naive_bayes.IDF_ALL, buckets=8)
    assert model.n_features == 8 and model.terms.count() <= 8
    assert model.predict(docs, "id", "text", "label").count() == len(DOCS)


@pytest.mark.parametrize("partitions", ["8", "150"])
def test_scores_do_not_depend_on_the_join(spark, docs, monkeypatch, partitions):
    model = naive_bayes.fit_naive_bayes(docs, "label", "text", F.col("train"))
    def score():
        return {r.id: pytest.approx(r.score) for r in model.predict(docs, "id", "text", "label").collect()}
    small = score()
    original, calls = naive_bayes.lookup_join, []
    monkeypatch.setattr(naive_bayes, "lookup_join",
                        lambda *a, **k: calls.append(1) or original(*a, **k, broadcast_bytes=0))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert score() == small and calls
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_metrics_of_a_small_table(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    confusion = metrics.confusion_matrix(df)
    assert metrics.accuracy(confusion).first()[0] == pytest.approx(2 / 3)
    assert metrics.test_error(confusion).first()[0] == pytest.approx(1 / 3)
    row = metrics.weighted(metrics.per_class(confusion)).first()
    assert row.weighted_precision == pytest.approx(0.8333, abs=1e-4)
    assert row.weighted_f1 == pytest.approx(0.6667, abs=1e-4)


def test_metrics_equal_the_ml_evaluator(spark):
    pairs = [(float(i * 7 % 4), float(i * i % 5)) for i in range(60)]
    df = spark.createDataFrame(pairs, "label double, prediction double")
    confusion = metrics.confusion_matrix(df)
    classes = metrics.per_class(confusion)
    row = metrics.weighted(classes).first()
    names = {
        "weightedRecall": "weighted_recall", "weightedPrecision": "weighted_precision", "f1": "weighted_f1",
        "weightedFalsePositiveRate": "weighted_fpr", "weightedTruePositiveRate": "weighted_tpr",
    }
    for name, column in names.items():
        value = MulticlassClassificationEvaluator(metricName=name).evaluate(df)
        assert row[column] == pytest.approx(value), name
    half = MulticlassClassificationEvaluator(metricName="weightedFMeasure", beta=0.5).evaluate(df)
    assert row.weighted_f_beta == pytest.approx(half)
    assert row.weighted_recall == pytest.approx(metrics.accuracy(confusion).first()[0])
    for r in classes.collect():
        value = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=r["class"]).evaluate(df)
        assert r.f1 == pytest.approx(value)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, [float(i % 3) * 10 + (i % 7) * 0.1, float(i % 3) * -5 + (i % 5) * 0.1]) for i in range(90)]
    return spark.createDataFrame(rows, "id bigint, v array<double>")


def test_assignment_against_all_distances(points):
    centres = clustering.random_centres(points, "id", "v", 5, seed=3)
    for r in clustering.assign(points, "v", centres).collect():
        distances = [sum((a - b) ** 2 for a, b in zip(r.v, c)) for c in centres]
        assert r.cluster == distances.index(min(distances))
        assert r.distance_sq == pytest.approx(min(distances))


def test_ties_go_to_the_lower_centre(spark):
    df = spark.createDataFrame([(1, [1.0])], "id bigint, v array<double>")
    assert clustering.assign(df, "v", [[0.0], [2.0]]).first().cluster == 0


def test_update_is_the_mean_of_each_cluster(points):
    assigned = clustering.assign(points, "v", [[0.0, 0.0], [10.0, -5.0], [20.0, -10.0]])
    members = {}
    for r in assigned.collect():
        members.setdefault(r.cluster, []).append(r.v)
    for r in clustering.update(assigned, "v").collect():
        values = [v[r.slot] for v in members[r.cluster]]
        assert r.n == len(values) and r.value == pytest.approx(sum(values) / len(values))


def test_rounds_from_given_centres(points):
    rows = {r.id: r.v for r in points.collect()}
    centres = [[0.0, 0.0], [1.0, 1.0], [500.0, 500.0]]
    expected = [list(c) for c in centres]
    for _ in range(4):
        groups = {}
        for v in rows.values():
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in expected]
            groups.setdefault(d.index(min(d)), []).append(v)
        for k, vs in groups.items():
            expected[k] = [sum(x) / len(vs) for x in zip(*vs)]
    got = clustering.fit_from_centres(points, "v", centres, max_iter=4, tol=0.0)
    assert [pytest.approx(c) for c in expected] == got
    assert got[2] == [500.0, 500.0]


def test_fitted_centres_cost(points):
    vectors = features.to_vector(points, "v")
    model = clustering.fit_kmeans(vectors, "features", k=3, max_iter=10)
    assigned = clustering.assign(points, "v", [c.tolist() for c in model.clusterCenters()])
    assert clustering.sum_of_squares(assigned).first()[0] == pytest.approx(model.summary.trainingCost)


def test_classifiers_learn_separable_points(points):
    labelled = features.to_vector(points, "v").select(
        "id", (F.col("id") % 3).cast("string").alias("label"), "features"
    )
    fits = [
        classifiers.fit_classifier(labelled, "label", classifiers.random_forest(5, "entropy"), max_categories=5),
        classifiers.fit_classifier(labelled, "label", classifiers.decision_tree(), max_categories=29),
        classifiers.fit_classifier(labelled, "label", classifiers.logistic_lbfgs()),
        classifiers.fit_perceptron(labelled, "label", [4], max_iter=200),
    ]
    for model in fits:
        scored = classifiers.predictions(model, labelled, "id", "label")
        assert metrics.accuracy(metrics.confusion_matrix(scored)).first()[0] > 0.95


def test_labels_missing_in_training_are_still_scored(points):
    labelled = features.to_vector(points, "v").select(
        "id", (F.col("id") % 3).cast("string").alias("label"), "features"
    )
    model = classifiers.fit_classifier(labelled.where("label <> '2'"), "label", classifiers.decision_tree("features"))
    scored = classifiers.predictions(model, labelled, "id", "label").collect()
    assert len(scored) == 90 and {r.prediction for r in scored} == {"0", "1"}


def test_vector_index_and_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 7.0), (3.0, 5.0)], "a double, b double")
    vectors = features.assemble(df, ["a", "b"])
    assert [r.indexed for r in features.index_vector(vectors, "features", 2).collect()] == [
        Vectors.dense(1.0, 0.0), Vectors.dense(2.0, 1.0), Vectors.dense(3.0, 0.0)]
    slots = {r.slot: (r.n_values, r.is_categorical) for r in features.slot_cardinality(df, ["a", "b"], 2).collect()}
    assert slots == {0: (3, False), 1: (2, True)}
    scaled = features.standard_scale(vectors, "features").collect()
    assert scaled[0].scaled[0] == pytest.approx(-1.0) and scaled[1].scaled[0] == pytest.approx(0.0)


def test_string_index_and_back(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "k string")
    model = features.fit_string_index(df, "k", "i")
    assert model.labels == ["c", "a", "b"]
    back = features.index_to_string(model.transform(df), "i", model.labels, "again").collect()
    assert all(r.k == r.again for r in back)


def test_hashed_pipeline_width(docs):
    train = docs.where("train")
    vectors = classifiers.text_features(train, docs, "text", ["id", "train"], 32)
    assert vectors.first().features.size == 32 and vectors.count() == len(DOCS)
    assert HashingTF(numFeatures=32).getNumFeatures() == 32
