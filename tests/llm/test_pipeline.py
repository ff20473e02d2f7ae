"""Registered queries of the subpackage, and the pipeline stage by stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm.queries import QUERIES
from corpuslab.session import materialize
from tests.compare import differences, oracle
from tests.llm import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, name):
    plan, sql = QUERIES[name]
    assert differences(name, plan(spark, SF_DIR), oracle(SF_DIR), sql) == []


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    stored = [docs]
    for _, stage in corpus_pipeline.STAGES:
        stored.append(materialize(stage(spark, stored[-1], SF_DIR), "stage"))
    assert all(df.columns == docs.columns for df in stored[:-1])
    texts = [[(r.doc_id, r.text) for r in df.collect()] for df in stored[:-1]]
    assert not [i for i, t in texts[1] if brute.base_failed(t)] and len(texts[1]) > 0.7 * len(texts[0])
    classes = brute.near_classes(dict(texts[1]))
    assert sorted(i for i, _ in texts[2]) == sorted(set(classes.values()))
    grams = {tuple(w[k:k + 13]) for t in items for w in [brute.ALNUM_WORD.findall(brute.lower(t))] for k in range(len(w) - 12)}

    def leaks(t):
        w = brute.ALNUM_WORD.findall(brute.lower(t))
        return any(tuple(w[k:k + 13]) in grams for k in range(len(w) - 12))

    assert not [i for i, t in texts[3] if leaks(t)]
    gone = {i for i, _ in texts[2]} - {i for i, _ in texts[3]}
    assert all(leaks(t) or any(brute.shared_passage(t, b) for b in items) for i, t in texts[2] if i in gone)
    assert {i for i, _ in texts[4]} <= {i for i, _ in texts[3]}
    final = [r.doc_id for r in stored[-1].orderBy("start").collect()]
    in_order = stored[4].select("doc_id", "source", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    in_order = in_order.orderBy("f", "i").collect()
    assert final == [r.doc_id for r in in_order]
    # the schedules show in the files: sources that fall come early, sources that rise come late
    rank = {s: k for k, s in enumerate(sorted({r.source for r in stored[3].select("source").collect()}, key=lambda s: (s is None, s)))}
    middle = {k: np.mean([at / len(final) for at, r in enumerate(in_order) if rank[r.source] % 3 == k]) for k in range(3)}
    assert middle[0] < middle[1] < middle[2]


def test_stages_keep_columns_of_any_name(spark):
    """Values of columns that are named like what the stages add come through as they are."""
    names = ["n_words", "posterior", "kept", "base_failed", "_v_length", "word_chars", "size", "target", "taken", "copies",
             "source_size", "_key", "_copy", "_doc", "key", "label", "node"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    own = docs.withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")) for n in names})
    own = materialize(own, "own")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = materialize(stage(spark, own, SF_DIR), "own")
        assert own.columns == [*docs.columns, *names] and own.count() > 0
        for r in own.collect():
            assert all(r[n] == f"{n}-{r.doc_id}" for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, own, SF_DIR).count() == own.count()


def test_stages_take_empty_tables_and_nulls(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for own in (docs.limit(0), spark.createDataFrame([(None, None, None, None, None)] * 3, docs.schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, own, SF_DIR)
            assert found.columns == docs.columns and found.count() <= own.count()
        assert corpus_pipeline.STAGES[-1][1](spark, own, SF_DIR).count() == own.count()
