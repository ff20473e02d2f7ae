"""Fits on labels that a feature fixes, so that SQL knows the right prediction of every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import classifiers, clustering, features, sampling
from corpuslab.plans.corpus import SEED
from corpuslab.plans.registry import query
from corpuslab.sources.tables import load_table

_LABEL = "CASE WHEN p_size >= 30 THEN 'large' ELSE 'small' END"
_RIGHT = f"SELECT p_partkey, {_LABEL} AS label, {_LABEL} AS prediction FROM part"


def _parts(spark, sf_dir):
    """Parts by tens of their size; a part is large from 30 on."""
    parts = load_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    tens = parts.withColumn("tens", F.floor(F.col("p_size") / 10).cast("double"))
    return features.assemble(tens, ["tens"]).select("p_partkey", F.expr(_LABEL).alias("label"), "features")


def _predicted(spark, sf_dir, classifier):
    rows = _parts(spark, sf_dir)
    model = classifiers.fit_classifier(rows, "label", classifier)
    return classifiers.predictions(model, rows, "p_partkey", "label")


@query("planted_tree_predict", _RIGHT)
def planted_tree_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, classifiers.decision_tree("features"))


@query("planted_forest_predict", _RIGHT)
def planted_forest_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, classifiers.random_forest(features="features"))


@query("planted_entropy_forest_predict", _RIGHT)
def planted_entropy_forest_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, classifiers.random_forest(5, "entropy", "features"))


@query("planted_lbfgs_predict", _RIGHT)
def planted_lbfgs_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, classifiers.logistic_lbfgs())


@query("planted_mlp_predict", _RIGHT)
def planted_mlp_predict(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    model = classifiers.fit_perceptron(rows, "label", [4])
    return classifiers.predictions(model, rows, "p_partkey", "label")


@query("planted_tree_summary",
       "SELECT 0::BIGINT AS tree, 1::BIGINT AS depth, 3::BIGINT AS n_nodes, 1::BIGINT AS n_features_used")
def planted_tree_summary(spark, sf_dir):
    """One split tells the classes apart, so the tree has two leaves."""
    model = classifiers.fit_classifier(_parts(spark, sf_dir), "label", classifiers.decision_tree("features"))
    return classifiers.tree_summary(spark, model.stages[1])


@query("bernoulli_sample_cover",
       "SELECT 0::BIGINT AS n_foreign, 0::BIGINT AS n_repeated, true AS near_fraction")
def bernoulli_sample_cover(spark, sf_dir):
    """A sample holds rows of the table only, each once, and about as many as asked for."""
    docs = load_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"])
    drawn = sampling.bernoulli_sample(docs, 0.1, SEED).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    whole = docs.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n_whole"))
    both = whole.join(drawn, ["l_orderkey", "l_linenumber"], "full")
    share = F.coalesce(F.sum("n"), F.lit(0)) / F.sum("n_whole")
    return both.agg(
        F.count_if(F.col("n_whole").isNull()).alias("n_foreign"),
        F.count_if(F.col("n") > F.col("n_whole")).alias("n_repeated"),
        F.abs(share - 0.1).__lt__(0.03).alias("near_fraction"))


@query("sample_by_cover",
       "SELECT l_returnflag, count(*) AS n_rows, true AS near_fraction FROM lineitem WHERE l_returnflag <> 'N' "
       "GROUP BY l_returnflag")
def sample_by_cover(spark, sf_dir):
    """Classes that are named come with about their fraction; the others do not come at all."""
    fractions = {"A": 0.5, "R": 0.2}
    lines = load_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"])
    drawn = sampling.class_sample(lines, "l_returnflag", fractions, SEED).groupBy("l_returnflag").agg(F.count("*").alias("n"))
    whole = lines.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"))
    wanted = F.create_map(*[F.lit(x) for pair in fractions.items() for x in pair])
    share = F.col("n") / F.col("n_rows") - F.try_element_at(wanted, F.col("l_returnflag"))
    return drawn.join(whole, "l_returnflag").select("l_returnflag", "n_rows", (F.abs(share) < 0.05).alias("near_fraction"))


@query("kmeans_fit_cover",
       "SELECT count(*) AS n, true AS nearest, true AS cost_fell FROM embeddings")
def kmeans_fit_cover(spark, sf_dir):
    """Every vector is in the cluster of its nearest centre, and the last round did not raise the cost."""
    rows = features.to_vector(load_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), "embedding")
    model = clustering.fit_kmeans(rows, "features")
    own = clustering.assign(model.transform(rows).withColumnRenamed("cluster", "own"), "embedding",
                            [c.tolist() for c in model.clusterCenters()])
    cost = model.summary.trainingCost
    return own.agg(
        F.count("*").alias("n"), F.bool_and(F.col("own") == F.col("cluster")).alias("nearest"),
        (F.sum("distance_sq") <= cost * (1 + 1e-6)).alias("cost_fell"))
