"""Every registered query against its SQL text, and checks of the plans."""

import pytest

import __spark_entry__ as entry_module
from corpuslab.plans import QUERIES
from tests.compare import differences, oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_query_equals_sql(spark, connection, capsys, name):
    q = QUERIES[name]
    frame = q.plan(spark, SF_DIR)
    frame.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert differences(name, frame, connection, q.sql) == []


def _pairs(spark, name):
    return [(r.label, r.prediction) for r in QUERIES[name].plan(spark, SF_DIR).collect()]


@pytest.mark.parametrize("name", [
    "nb_hashed_ml_predict", "random_forest_predict", "entropy_forest_predict", "decision_tree_predict",
    "logistic_predict", "logistic_lbfgs_predict", "mlp_predict", "pipeline_predict",
])
def test_predictions_are_known_labels_and_complete(spark, name):
    pairs = _pairs(spark, name)
    labels = {label for label, _ in pairs}
    assert pairs and {p for _, p in pairs} <= labels
    right = sum(label == prediction for label, prediction in pairs)
    most_frequent = max(sum(label == c for label, _ in pairs) for c in labels)
    assert right >= 0.9 * most_frequent


def test_fitted_clusters_cover_all_rows(spark):
    sizes = QUERIES["kmeans_fit"].plan(spark, SF_DIR).collect()
    assert sum(r.n for r in sizes) == 500 and len(sizes) <= 27


def test_tuning_names_one_best_setting(spark):
    rows = QUERIES["cv_grid_metrics"].plan(spark, SF_DIR).collect()
    assert sorted(r.num_trees for r in rows) == [5, 6, 7]
    best = [r for r in rows if r.is_best]
    assert len(best) == 1 and best[0].mean_accuracy == max(r.mean_accuracy for r in rows)
    assert 0 <= best[0].test_accuracy <= 1


def test_entry_points(spark):
    assert entry_module.entry(spark).columns == ["doc_id", "label", "prediction", "score"]
    assert entry_module.queries().keys() >= entry_module.oracle_sql().keys()
