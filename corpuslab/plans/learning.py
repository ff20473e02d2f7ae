"""Classifiers: naive Bayes as tables, and the pyspark.ml models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from corpuslab.operators import classifiers, features, forests, layers, naive_bayes, optimality, sampling, tokens
from corpuslab.plans import fragments as sql
from corpuslab.plans.classes import clean_documents
from corpuslab.plans.corpus import SEED, TRAIN_TEST
from corpuslab.plans.registry import query
from corpuslab.session import scratch_path

# Hidden layers of the network, slots of the trees, of the other narrow fits.
HIDDEN_LAYERS = [500, 10]
TREE_FEATURES = 10000
SMALL_FEATURES = 5000
# Most categories per vector slot in each forest.
CATEGORY_LIMITS = {"random_forest": 29, "entropy_forest": 5}


def _split_documents(spark, sf_dir):
    docs = clean_documents(spark, sf_dir)
    return sampling.hash_split(docs, "doc_id", TRAIN_TEST, SEED)


def _train_test(df):
    return df.where("split = 0").drop("split"), df.where("split = 1").drop("split")


def nb_sql(idf: str = naive_bayes.IDF_NONE, buckets: int | None = None) -> str:
    """WITH clause ending in ``theta`` (log-likelihoods) and ``pred`` (predictions)."""
    term = "term" if buckets is None else f"{sql.bucket('term', buckets)} AS term"
    fitted_on = "" if idf == naive_bayes.IDF_ALL else "WHERE split = 0"
    weight = (
        "1.0::DOUBLE" if idf == naive_bayes.IDF_NONE
        else f"ln(((SELECT count(*) FROM base {fitted_on})+1)/(count(DISTINCT doc_id)+1))"
    )
    n_features = "(SELECT count(*) FROM voc)" if buckets is None else str(buckets)
    clean = f"strip_accents({sql.without_tags('trim(text)')})"
    return f"""
WITH base AS (SELECT * FROM (SELECT doc_id, lang AS label, {clean} AS text,
       CASE WHEN {sql.unit('doc_id', SEED)} < 0.7 THEN 0 ELSE 1 END AS split FROM documents) WHERE text <> ''),
tok AS (SELECT doc_id, label, split, {term} FROM
       (SELECT doc_id, label, split, unnest({sql.tokens('text')}) AS term FROM base)),
cls AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS idx,
       ln(count(*)+1.0) - ln(sum(count(*)) OVER () + count(*) OVER ()) AS lp
       FROM base WHERE split = 0 GROUP BY label),
w AS (SELECT term, {weight} AS w FROM tok {fitted_on} GROUP BY term),
tc AS (SELECT term, label, count(*) AS t FROM tok WHERE split = 0 GROUP BY term, label),
voc AS (SELECT term, w FROM (SELECT DISTINCT term FROM tc) JOIN w USING (term)),
tot AS (SELECT label, sum(t*w) AS tt FROM tc JOIN w USING (term) GROUP BY label),
theta AS (SELECT v.term, v.w, c.label, ln(coalesce(t,0)*v.w+1.0) - ln(tt+1.0*{n_features}) AS ll
       FROM voc v CROSS JOIN cls c JOIN tot ON tot.label = c.label
       LEFT JOIN tc ON tc.term = v.term AND tc.label = c.label),
sc AS (SELECT tok.doc_id, theta.label, sum(theta.w*theta.ll) AS s FROM tok JOIN theta ON theta.term = tok.term
       WHERE split = 1 GROUP BY tok.doc_id, theta.label),
pred AS (SELECT doc_id, label, prediction, score FROM (SELECT b.doc_id, b.label, c.label AS prediction,
       c.lp+coalesce(s,0) AS score,
       row_number() OVER (PARTITION BY b.doc_id ORDER BY c.lp+coalesce(s,0) DESC, c.idx) AS r
       FROM base b CROSS JOIN cls c LEFT JOIN sc ON sc.doc_id = b.doc_id AND sc.label = c.label
       WHERE b.split = 1) WHERE r = 1)
"""


_PREDICTIONS = " SELECT doc_id, label, prediction, round(score,4) AS score FROM pred"


def fitted_naive_bayes(spark, sf_dir, idf=naive_bayes.IDF_NONE, buckets=None):
    docs = _split_documents(spark, sf_dir)
    model = naive_bayes.fit_naive_bayes(
        docs, "lang", "text", F.col("split") == 0, idf=idf, buckets=buckets
    )
    return model, docs.where("split = 1")


def nb_predictions(spark, sf_dir, idf=naive_bayes.IDF_NONE, buckets=None):
    model, test = fitted_naive_bayes(spark, sf_dir, idf, buckets)
    return model.predict(test, "doc_id", "text", "lang").withColumn("score", F.round("score", 4))


@query("nb_priors", nb_sql() + " SELECT label, n, round(lp,6) AS log_prior FROM cls")
def nb_priors(spark, sf_dir):
    model, _ = fitted_naive_bayes(spark, sf_dir)
    return model.priors(spark).withColumn("log_prior", F.round("log_prior", 6))


@query("nb_term_loglik", nb_sql() + " SELECT term, label, round(ll,6) AS log_likelihood FROM theta")
def nb_term_loglik(spark, sf_dir):
    model, _ = fitted_naive_bayes(spark, sf_dir)
    return model.log_likelihood().withColumn("log_likelihood", F.round("log_likelihood", 6))


@query("nb_predict", nb_sql() + _PREDICTIONS)
def nb_predict(spark, sf_dir):
    return nb_predictions(spark, sf_dir)


@query("nb_tfidf_predict", nb_sql(naive_bayes.IDF_TRAIN) + _PREDICTIONS)
def nb_tfidf_predict(spark, sf_dir):
    return nb_predictions(spark, sf_dir, naive_bayes.IDF_TRAIN)


@query("nb_hashed_tfidf_predict",
       nb_sql(naive_bayes.IDF_ALL, classifiers.TEXT_FEATURES) + _PREDICTIONS)
def nb_hashed_tfidf_predict(spark, sf_dir):
    return nb_predictions(spark, sf_dir, naive_bayes.IDF_ALL, classifiers.TEXT_FEATURES)


@query("nb_counted_tfidf_ml_predict",
       nb_sql(naive_bayes.IDF_TRAIN) + " SELECT doc_id, label, prediction FROM pred")
def nb_counted_tfidf_ml_predict(spark, sf_dir):
    """Count vectoriser, IDF and naive Bayes of pyspark.ml: the same answers as the tables."""
    train, test = _train_test(_split_documents(spark, sf_dir))
    width = tokens.vocabulary(train, "text").count()  # all terms
    model = classifiers.fit_classifier(
        train, "lang", classifiers.naive_bayes(), classifiers.counted_text_stages("text", width)
    )
    return classifiers.predictions(model, test, "doc_id", "lang")


@query("nb_hashed_ml_predict")
def nb_hashed_ml_predict(spark, sf_dir):
    """Hashed TF-IDF and naive Bayes; the fitted stages are saved and loaded before use."""
    train, test = _train_test(_split_documents(spark, sf_dir))
    model = classifiers.fit_classifier(
        train, "lang", classifiers.naive_bayes(), classifiers.hashed_text_stages("text")
    )
    path = scratch_path(spark, "model")
    model.write().save(path)
    return classifiers.predictions(PipelineModel.load(path), test, "doc_id", "lang")


@query("pipeline_predict")
def pipeline_predict(spark, sf_dir):
    """Index, features and forest as one pipeline, saved and loaded before use."""
    train, test = _train_test(_split_documents(spark, sf_dir))
    model = classifiers.fit_classifier(
        train, "lang", classifiers.random_forest(features="features"),
        classifiers.hashed_text_stages("text", TREE_FEATURES),
    )
    path = scratch_path(spark, "pipeline")
    model.write().save(path)
    return classifiers.predictions(PipelineModel.load(path), test, "doc_id", "lang")


def text_vectors(spark, sf_dir, num_features=SMALL_FEATURES):
    """Hashed TF-IDF vectors of all documents."""
    docs = clean_documents(spark, sf_dir)
    return classifiers.text_features(docs, docs, "text", ["doc_id", "lang"], num_features)


def _text_parts(spark, sf_dir, num_features=TREE_FEATURES):
    docs = _split_documents(spark, sf_dir)
    train, _ = _train_test(docs)
    return _train_test(
        classifiers.text_features(train, docs, "text", ["doc_id", "lang", "split"], num_features)
    )


_HELD_OUT = (
    "SELECT doc_id, label, true AS agrees FROM (SELECT doc_id, lang AS label, "
    f"strip_accents({sql.without_tags('trim(text)')}) AS text, {sql.unit('doc_id', SEED)} AS u FROM documents) "
    "WHERE text <> '' AND u >= 0.7"
)
_TRAIN_LABELS = _HELD_OUT.replace("doc_id, label, true AS agrees", "DISTINCT label").replace("u >= 0.7", "u < 0.7")


def _agreement(predicted, relational):
    """Whether the fitted object and its tables give each row the same class."""
    own = relational.select(F.col("doc_id").alias("own_id"), F.col("prediction").alias("own"))
    joined = predicted.join(own, F.col("doc_id") == F.col("own_id"), "left")
    return joined.select("doc_id", "label", F.coalesce(F.col("prediction") == F.col("own"), F.lit(False)).alias("agrees"))


def _fitted_forest(spark, sf_dir):
    train, test = _text_parts(spark, sf_dir)
    return classifiers.fit_classifier(
        train, "lang", classifiers.random_forest(), max_categories=CATEGORY_LIMITS["random_forest"]
    ), test


def _fitted_entropy_forest(spark, sf_dir):
    train, test = _text_parts(spark, sf_dir, SMALL_FEATURES)
    return classifiers.fit_classifier(
        train, "lang", classifiers.random_forest(5, "entropy"), max_categories=CATEGORY_LIMITS["entropy_forest"],
    ), test


def _fitted_tree(spark, sf_dir):
    train, test = _text_parts(spark, sf_dir)
    return classifiers.fit_classifier(
        train, "lang", classifiers.decision_tree(), max_categories=CATEGORY_LIMITS["random_forest"]
    ), test


def _relational_forest(spark, model, test):
    """Agreement of a fitted forest with its node table on the held-out documents."""
    labels, slots, trees = model.stages[0].labels, model.stages[1], model.stages[2]
    entries = features.vector_entries(slots.transform(test), "indexed", ["doc_id"])
    walked = forests.score_nodes(entries, "doc_id", forests.forest_nodes(spark, trees), labels)
    return _agreement(classifiers.predictions(model, test, "doc_id", "lang"), walked)


@query("random_forest_predict")
def random_forest_predict(spark, sf_dir):
    model, test = _fitted_forest(spark, sf_dir)
    return classifiers.predictions(model, test, "doc_id", "lang")


@query("random_forest_nodes_agree", _HELD_OUT)
def random_forest_nodes_agree(spark, sf_dir):
    return _relational_forest(spark, *_fitted_forest(spark, sf_dir))


@query("entropy_forest_predict")
def entropy_forest_predict(spark, sf_dir):
    model, test = _fitted_entropy_forest(spark, sf_dir)
    return classifiers.predictions(model, test, "doc_id", "lang")


@query("entropy_forest_nodes_agree", _HELD_OUT)
def entropy_forest_nodes_agree(spark, sf_dir):
    return _relational_forest(spark, *_fitted_entropy_forest(spark, sf_dir))


@query("decision_tree_predict")
def decision_tree_predict(spark, sf_dir):
    model, test = _fitted_tree(spark, sf_dir)
    return classifiers.predictions(model, test, "doc_id", "lang")


@query("decision_tree_nodes_agree", _HELD_OUT)
def decision_tree_nodes_agree(spark, sf_dir):
    return _relational_forest(spark, *_fitted_tree(spark, sf_dir))


@query("tree_summary")
def tree_summary(spark, sf_dir):
    model, _ = _fitted_tree(spark, sf_dir)
    return classifiers.tree_summary(spark, model.stages[2])


@query("tree_nodes_summary_agrees",
       "SELECT 0::BIGINT AS tree, true AS depth_agrees, true AS nodes_agree, true AS features_agree, true AS leaves_fit, "
       f"count(*) AS n_rows FROM ({_HELD_OUT.replace('u >= 0.7', 'u < 0.7')})")
def tree_nodes_summary_agrees(spark, sf_dir):
    """The fitted tree's summary against its node table, whose root has seen every training row."""
    model, _ = _fitted_tree(spark, sf_dir)
    own = classifiers.tree_summary(spark, model.stages[2])
    nodes = forests.forest_nodes(spark, model.stages[2])
    found = forests.nodes_summary(nodes).withColumnsRenamed(
        {"depth": "d", "n_nodes": "nodes", "n_features_used": "used"})
    root = nodes.where("node = 0").select("tree", F.col("n").alias("n_rows"))
    return own.join(found, "tree").join(root, "tree").select(
        "tree", (F.col("depth") == F.col("d")).alias("depth_agrees"), (F.col("n_nodes") == F.col("nodes")).alias("nodes_agree"),
        (F.col("n_features_used") == F.col("used")).alias("features_agree"),
        (2 * F.col("n_leaves") == F.col("nodes") + 1).alias("leaves_fit"), "n_rows")


@query("tree_feature_importances")
def tree_feature_importances(spark, sf_dir):
    model, _ = _fitted_tree(spark, sf_dir)
    return classifiers.feature_importances(spark, model.stages[2])


@query("forest_importances_agree", "SELECT true AS slots_agree, true AS values_agree")
def forest_importances_agree(spark, sf_dir):
    """Importances of a forest's slots against those of its node table."""
    model, _ = _fitted_forest(spark, sf_dir)
    own = classifiers.feature_importances(spark, model.stages[2]).withColumnRenamed("importance", "own")
    found = forests.nodes_importances(forests.forest_nodes(spark, model.stages[2]))
    return own.join(found, "slot", "full").agg(
        F.bool_and(F.col("own").isNotNull() & F.col("importance").isNotNull()).alias("slots_agree"),
        F.bool_and(F.abs(F.col("own") - F.col("importance")) < 1e-9).alias("values_agree"))


# Penalties of the regressions, iterations of the one that has to be exact.
PENALTY, WEAK_PENALTY, L1_SHARE, UNTIL_EXACT = 0.3, 0.01, 0.8, 1000
# Largest violation of an optimality condition that still counts as none.
SLACK = 1e-3


def _fitted_logistic(spark, sf_dir):
    train, test = _text_parts(spark, sf_dir, classifiers.TEXT_FEATURES)
    return classifiers.fit_classifier(train, "lang", classifiers.logistic()), train, test


def _fitted_lbfgs(spark, sf_dir):
    train, test = _text_parts(spark, sf_dir, SMALL_FEATURES)
    return classifiers.fit_classifier(train, "lang", classifiers.logistic_lbfgs()), train, test


def _certified(spark, model, train, reg, elastic_net):
    """Per class, whether the fitted coefficients are optimal for the training rows."""
    entries = features.vector_entries(train, "features", ["doc_id", "lang"])
    layer = layers.regression_layer(spark, model.stages[1])
    found = optimality.violations(entries, "doc_id", "lang", layer, model.stages[0].labels, reg, elastic_net)
    return optimality.certificate(found).withColumnRenamed("class", "label")


@query("logistic_predict")
def logistic_predict(spark, sf_dir):
    model, _, test = _fitted_logistic(spark, sf_dir)
    return classifiers.predictions(model, test, "doc_id", "lang")


@query("logistic_layer_agrees", _HELD_OUT)
def logistic_layer_agrees(spark, sf_dir):
    """The regression against its table of coefficients, fitted with a penalty that leaves some."""
    train, test = _text_parts(spark, sf_dir, classifiers.TEXT_FEATURES)
    model = classifiers.fit_classifier(train, "lang", classifiers.logistic(reg=WEAK_PENALTY))
    entries = features.vector_entries(test, "features", ["doc_id"])
    layer = layers.regression_layer(spark, model.stages[1])
    own = layers.predict(entries, "doc_id", [layer], model.stages[0].labels)
    return _agreement(classifiers.predictions(model, test, "doc_id", "lang"), own)


@query("logistic_intercepts")
def logistic_intercepts(spark, sf_dir):
    model, _, _ = _fitted_logistic(spark, sf_dir)
    return classifiers.intercepts(spark, model.stages[1], model.stages[0].labels)


@query("logistic_coefficients")
def logistic_coefficients(spark, sf_dir):
    model, _, _ = _fitted_logistic(spark, sf_dir)
    return classifiers.coefficients(spark, model.stages[1], model.stages[0].labels)


@query("logistic_certificate", f"SELECT label, true AS is_optimal FROM ({_TRAIN_LABELS})")
def logistic_certificate(spark, sf_dir):
    """The usual regression is at its optimum."""
    model, train, _ = _fitted_logistic(spark, sf_dir)
    found = _certified(spark, model, train, PENALTY, L1_SHARE)
    return found.select("label", (F.col("worst") < SLACK).alias("is_optimal"))


@query("logistic_sparse_certificate",
       f"SELECT label, true AS is_optimal, true AS is_sparse FROM ({_TRAIN_LABELS})")
def logistic_sparse_certificate(spark, sf_dir):
    """With a weaker penalty some coefficients stay, most are 0, and all conditions hold."""
    train, _ = _text_parts(spark, sf_dir, classifiers.TEXT_FEATURES)
    model = classifiers.fit_classifier(train, "lang", classifiers.logistic(UNTIL_EXACT, WEAK_PENALTY))
    found = _certified(spark, model, train, WEAK_PENALTY, L1_SHARE)
    return found.select("label", (F.col("worst") < SLACK).alias("is_optimal"),
                        F.col("n_nonzero").between(1, F.col("n_slots") / 2).alias("is_sparse"))


@query("logistic_lbfgs_predict")
def logistic_lbfgs_predict(spark, sf_dir):
    model, _, test = _fitted_lbfgs(spark, sf_dir)
    return classifiers.predictions(model, test, "doc_id", "lang")


@query("logistic_lbfgs_certificate", f"SELECT label, true AS is_optimal FROM ({_TRAIN_LABELS})")
def logistic_lbfgs_certificate(spark, sf_dir):
    model, train, _ = _fitted_lbfgs(spark, sf_dir)
    found = _certified(spark, model, train, 0.0, 0.0)
    return found.select("label", (F.col("worst") < SLACK).alias("is_optimal"))


def _fitted_network(spark, sf_dir):
    train, test = _text_parts(spark, sf_dir, SMALL_FEATURES)
    return classifiers.fit_perceptron(train, "lang", HIDDEN_LAYERS), test


@query("mlp_predict")
def mlp_predict(spark, sf_dir):
    model, test = _fitted_network(spark, sf_dir)
    return classifiers.predictions(model, test, "doc_id", "lang")


@query("mlp_layers_agree", _HELD_OUT)
def mlp_layers_agree(spark, sf_dir):
    """The network against a forward pass over its tables of weights."""
    model, test = _fitted_network(spark, sf_dir)
    entries = features.vector_entries(test, "features", ["doc_id"])
    own = layers.predict(entries, "doc_id", layers.network_layers(spark, model.stages[1]), model.stages[0].labels)
    return _agreement(classifiers.predictions(model, test, "doc_id", "lang"), own)


@query("cv_grid_metrics")
def cv_grid_metrics(spark, sf_dir):
    train, test = _text_parts(spark, sf_dir, SMALL_FEATURES)
    labels = features.fit_string_index(train, "lang")
    folds = sampling.hash_split(
        labels.transform(train), "doc_id", [0.5, 0.5], SEED + 1, split_column="fold"
    ).withColumn("fold", F.col("fold").cast("int"))
    tuned = classifiers.tune_forest(folds, "features", "label_index", "fold")
    return classifiers.tuning_table(tuned, labels.transform(test), "label_index")
