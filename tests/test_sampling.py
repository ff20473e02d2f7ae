from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslab.operators import sampling


def _ids(df):
    return {r.id for r in df.select("id").collect()}


@settings(max_examples=5, deadline=None)
@given(weights=st.lists(st.floats(0.1, 5.0), min_size=1, max_size=4), seed=st.integers(0, 99))
def test_hash_split_is_disjoint_complete_and_repeatable(spark, weights, seed):
    df = spark.range(2000)
    split = sampling.hash_split(df, "id", weights, seed)
    rows = split.collect()
    assert sorted(r.id for r in rows) == list(range(2000))
    assert {r.split for r in rows} <= set(range(len(weights)))
    again = sampling.hash_split(df.repartition(13), "id", weights, seed)
    assert {r.id: r.split for r in again.collect()} == {r.id: r.split for r in rows}


def test_uneven_weights_are_normalised(spark):
    split = sampling.hash_split(spark.range(20000), "id", [0.7, 0.4])
    share = split.where("split = 0").count() / 20000
    assert abs(share - 0.7 / 1.1) < 0.02


def test_samples_follow_their_fractions(spark):
    df = spark.range(20000).selectExpr("id", "if(id % 4 = 0, 'a', 'b') AS k")
    assert abs(sampling.hash_sample(df, "id", 0.1).count() - 2000) < 200
    counts = {r.k: r["count"] for r in sampling.hash_class_sample(
        df, "id", "k", {"a": 0.5}, 7).groupBy("k").count().collect()}
    assert set(counts) == {"a"} and abs(counts["a"] - 2500) < 200
    assert abs(sampling.bernoulli_sample(df, 0.1, 42).count() - 2000) < 200
    assert set(r.k for r in sampling.class_sample(df, "k", {"b": 0.1}, 7).collect()) == {"b"}


def test_share_sample_takes_more_of_large_classes(spark):
    df = spark.range(20000).selectExpr("id", "if(id % 4 = 0, 'a', 'b') AS k")
    counts = {r.k: r["count"] for r in sampling.share_sample(df, "id", "k").groupBy("k").count().collect()}
    assert abs(counts["a"] - 5000 * 0.25) < 150 and abs(counts["b"] - 15000 * 0.75) < 300


def test_random_split_covers_all_rows(spark):
    df = spark.range(1000)
    first, second = sampling.random_split(df, [0.7, 0.3], 1234)
    assert _ids(first) | _ids(second) == set(range(1000)) and not _ids(first) & _ids(second)
