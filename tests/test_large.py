"""What has to stay bounded, or whole, when tables grow."""

import glob

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpuslab.operators import class_terms, classifiers, clustering, layers
from corpuslab.plans import QUERIES
from corpuslab.session import shared_dir

SF_DIR = "/root/testdata/sf0.001"


def test_outputs_sum_rows_where_they_lie(spark, capsys):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(40, 3))
    layer = layers._layer_table(spark, weights, np.array([0.5, 0.0, -1.0]))
    data = [(i, [int(s) for s in rng.choice(50, i % 7, replace=False)]) for i in range(60)]
    rows = spark.createDataFrame([(i, s, [float(x + 1) for x in s]) for i, s in data], "id long, slots array<int>, values array<double>")
    out = layers.outputs(rows, "id", layer)
    out.explain()
    assert "Generate" not in capsys.readouterr().out  # no row per entry
    got = {r.id: r.outputs for r in out.collect()}
    for i, slots in data:
        want = np.array([0.5, 0.0, -1.0]) + sum((weights[s] * (s + 1) for s in slots if s < 40), np.zeros(3))
        assert got[i] == pytest.approx(want.tolist())


def test_clusters_of_rows_with_many_copies(spark):
    rows = spark.createDataFrame([(Vectors.dense([float(i % 3), 1.0]),) for i in range(60)], ["v"])
    model = clustering.fit_kmeans(rows, "v", k=20)
    assert 1 <= len(model.clusterCenters()) <= 3
    assert model.transform(rows).where("cluster is null").count() == 0


def test_trees_keep_a_bounded_part_of_the_rows_per_task(spark, monkeypatch):
    rows = spark.createDataFrame([(Vectors.sparse(100, {i % 100: 1.0}), "ab"[i % 2]) for i in range(200)], ["features", "y"]).coalesce(1)
    assert classifiers._dealt_for_trees(rows, 100).rdd.getNumPartitions() == 1
    dealt = classifiers._dealt_for_trees(rows, 100, 8000)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 200 and max(r["count"] for r in sizes) <= 30
    width = 4_000_000  # 16 MB a row
    most = max(r["count"] for r in classifiers._dealt_for_trees(rows, width).groupBy(F.spark_partition_id()).count().collect())
    assert 4 * width * most <= 400e6
    monkeypatch.setattr(classifiers, "TREE_TASK_BYTES", 8000)
    seen = []
    plain = classifiers.Pipeline.fit
    monkeypatch.setattr(classifiers.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df))
    classifiers.fit_classifier(rows, "y", classifiers.decision_tree("features"))
    assert seen == [10]


def test_documents_are_written_by_many_tasks(spark):
    before = set(glob.glob(f"{shared_dir(spark)}/csv-*"))
    assert QUERIES["csv_records_roundtrip"].plan(spark, SF_DIR).count() == 200
    path, = set(glob.glob(f"{shared_dir(spark)}/csv-*")) - before
    assert len(glob.glob(f"{path}/part-*")) > 1


def test_folds_are_scored_where_the_rows_lie(spark, capsys):
    data = [(i, "ab"[i % 2], None if i == 9 else " ".join(f"w{(i * k) % 7}" for k in range(i % 5)), i % 3) for i in range(60)]
    docs = spark.createDataFrame(data, "id long, label string, text string, fold int")
    entries = class_terms.text_entries(docs, "text", ["id", "label", "fold"], 20)
    entries.explain()
    assert "MapInArrow" in capsys.readouterr().out  # buckets are counted many rows at a time
    assert [r.entries for r in entries.where("id = 9").collect()] == [None]
    out = class_terms.cross_validated(entries, "id", "label", "fold", [1.0, 2.0], 20)
    out.explain()
    assert "Generate explode(entries" not in capsys.readouterr().out  # no row per entry
    assert sum(r.n for r in out.collect()) == 2 * 60


def test_rows_in_one_of_many_tasks_are_dealt(spark):
    """Empty tasks beside a full one do not count as dealt."""
    rows = spark.range(1000).repartition(40, F.expr("pmod(id, 1)"))
    dealt = classifiers._dealt_for_trees(rows, 100, 40_000)  # a hundred rows a task
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 110
    assert classifiers._dealt_for_trees(rows.where("id < 0"), 100, 40_000).count() == 0
