import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import windows
from corpuslab.operators.joins import lookup_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one key."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, term string")


@pytest.fixture(scope="module")
def lookup(spark, skewed):
    counts = skewed.where("term <> 'k7'").groupBy("term").agg(F.count("*").alias("n"))
    return counts.withColumn("value", F.length("term").cast("double"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_broadcast_join(skewed, lookup, how):
    small = lookup_join(skewed, lookup, "term", "n", "id", how)
    salted = lookup_join(skewed, lookup, "term", "n", "id", how, broadcast_bytes=0)
    columns = ["id", "term", "n", "value"]
    assert sorted(small.select(columns).collect()) == sorted(salted.select(columns).collect())
    assert salted.count() == (3000 if how == "left" else skewed.where("term <> 'k7'").count())


def test_salted_join_spreads_the_hot_key(spark, skewed, lookup):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(skewed, lookup, "term", "n", "id", "inner", broadcast_bytes=0)
        parts = joined.where("term = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts > 1


def _expected(rows, before, after):
    groups = {}
    for key, day, i, v in rows:
        groups.setdefault(key, []).append((day, i, v))
    result = {}
    for group in groups.values():
        group.sort(key=lambda r: (r[0] is not None, r[0], r[1]) if r[0] is not None else (False, 0, r[1]))
        for p, (_, i, _v) in enumerate(group):
            frame = [v for *_, v in group[max(0, p - before): p + after + 1]]
            result[i] = sum(frame) / len(frame)
    return result


@pytest.mark.parametrize("before, after", [(1, 1), (3, 0), (0, 2)])
@pytest.mark.parametrize("rows_per_task", [10_000, 25, 2])
def test_moving_average_with_frequent_keys(spark, before, after, rows_per_task):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", rng.randrange(30), i, float(rng.randrange(100)))
            for i in range(600)]
    df = spark.createDataFrame(rows, "key string, day int, id bigint, v double")
    got = windows.moving_average(df, "key", ["day", "id"], "v", before, after,
                                 rows_per_task=rows_per_task)
    found = {r.id: r.moving_avg for r in got.collect()}
    expected = _expected(rows, before, after)
    assert found.keys() == expected.keys()
    assert all(found[i] == pytest.approx(expected[i]) for i in expected)


@pytest.mark.parametrize("rows_per_task", [10_000, 2])
def test_moving_average_keeps_null_keys_null_days_and_clashing_names(spark, rows_per_task):
    rng = random.Random(7)
    rows = [(None if i % 3 == 0 else ("one day" if i % 3 == 1 else f"k{i % 7}"),
             None if i % 11 == 0 else (5 if i % 3 == 1 else rng.randrange(4)), i, float(rng.randrange(50)))
            for i in range(200)]
    df = spark.createDataFrame(rows, "key string, day int, id bigint, v double").withColumn("_n", F.lit(1)).withColumn(
        "_run", F.lit(2))
    got = windows.moving_average(df, "key", ["day", "id"], "v", 1, 1, rows_per_task=rows_per_task)
    assert got.columns == [*df.columns, "moving_avg"]
    found = {r.id: r.moving_avg for r in got.collect()}
    expected = _expected(rows, 1, 1)
    assert found.keys() == expected.keys()
    assert all(found[i] == pytest.approx(expected[i]) for i in expected)


def test_split_keys_leave_no_task_with_twice_the_mean(spark):
    """A Zipf spread and null keys over 200 partitions, through the branch that shuffles."""
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(3)
        data = [(i, None if i % 5 == 0 else f"w{int(20000 ** rng.random())}") for i in range(100_000)]
        rows = spark.createDataFrame(data, "id bigint, term string")
        table = rows.where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
        joined = lookup_join(rows, table, "term", "n", "id", "left", broadcast_bytes=0)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 100_000 and max(sizes) <= 2 * 100_000 / 200
