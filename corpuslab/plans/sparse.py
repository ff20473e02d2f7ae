"""Dictionaries, count vectors, class tables, folds and clusters on sparse text features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from corpuslab.operators import (
    class_terms, classifiers, clustering, dictionary, naive_bayes, sampling, sparse_clustering, tfidf,
)
from corpuslab.operators.clustering import CLUSTERS
from corpuslab.operators.features import vector_entries
from corpuslab.plans import fragments as sql
from corpuslab.plans.classes import clean_documents
from corpuslab.plans.corpus import SEED
from corpuslab.plans.learning import (
    _HELD_OUT, _PREDICTIONS, _agreement, _split_documents, _train_test, nb_sql, text_vectors,
    SMALL_FEATURES, TREE_FEATURES,
)
from corpuslab.plans.registry import query
from corpuslab.session import materialize, scratch_path
from corpuslab.sources.tables import load_table

_EXPLODED = f"SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents"
_TERM_IDS = (
    f"WITH t AS ({_EXPLODED}), d AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS doc_freq, "
    "row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS term_id FROM t GROUP BY term) "
)


def _texts(spark, sf_dir):
    return load_table(spark, sf_dir, "documents", ["doc_id", "text"], "doc_id")


@query("term_dictionary", _TERM_IDS + "SELECT term, term_id, n, doc_freq FROM d")
def term_dictionary(spark, sf_dir):
    return dictionary.term_dictionary(_texts(spark, sf_dir), "doc_id", "text")


@query(
    "term_dictionary_limited",
    "WITH d AS (SELECT *, row_number() OVER (ORDER BY n DESC, term) - 1 AS term_id FROM (SELECT term, count(*) AS n, "
    f"count(DISTINCT doc_id) AS doc_freq FROM ({_EXPLODED}) GROUP BY term) WHERE doc_freq >= 2) "
    "SELECT term, term_id, n, doc_freq FROM d WHERE term_id < 1000",
)
def term_dictionary_limited(spark, sf_dir):
    """The usual limits of a vocabulary: least document frequency and number of terms."""
    return dictionary.term_dictionary(_texts(spark, sf_dir), "doc_id", "text", min_doc_freq=2, size=1000)


@query(
    "count_vectors",
    _TERM_IDS + ", c AS (SELECT doc_id, term_id, count(*) AS tf FROM t JOIN d USING (term) GROUP BY doc_id, term_id) "
    "SELECT doc_id, count(term_id) AS n_slots, coalesce(string_agg(term_id || ':' || tf, ' ' ORDER BY term_id), '') AS vector "
    "FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id",
)
def count_vectors(spark, sf_dir):
    """Sparse count vectors of all documents over all terms, written as slot:count."""
    docs = _texts(spark, sf_dir)
    vectors = dictionary.count_vectors(docs, "doc_id", "text", dictionary.term_dictionary(docs, "doc_id", "text"))
    pairs = F.zip_with("slots", "values", lambda s, v: F.concat_ws(":", s.cast("string"), v.cast("long").cast("string")))
    return vectors.select("doc_id", F.size("slots").cast("long").alias("n_slots"), F.array_join(pairs, " ").alias("vector"))


def _scored(predicted):
    return predicted.withColumn("score", F.round("score", 4))


@query("nb_class_terms_predict", nb_sql() + _PREDICTIONS)
def nb_class_terms_predict(spark, sf_dir):
    """Naive Bayes from the long table of terms and classes."""
    train, test = _train_test(_split_documents(spark, sf_dir))
    model = class_terms.fit(class_terms.text_entries(train, "text", ["lang"]), "lang")
    return _scored(class_terms.predict(model, class_terms.text_entries(test, "text", ["doc_id", "lang"]), "doc_id", "lang"))


@query("nb_dictionary_tfidf_predict", nb_sql(naive_bayes.IDF_TRAIN) + _PREDICTIONS)
def nb_dictionary_tfidf_predict(spark, sf_dir):
    """Dictionary, count vectors, IDF and naive Bayes with nothing as long as the vocabulary on the driver."""
    docs = _split_documents(spark, sf_dir)
    train, test = _train_test(docs)
    terms = dictionary.term_dictionary(train, "doc_id", "text")

    def entries(rows):
        vectors = dictionary.count_vectors(rows, "doc_id", "text", terms)
        return class_terms.vector_terms(vectors.join(rows.select("doc_id", "lang"), "doc_id"), ["doc_id", "lang"])

    model = class_terms.fit(entries(train), "lang", weighted=True)
    return _scored(class_terms.predict(model, entries(test), "doc_id", "lang"))


_SOURCE_SQL = nb_sql().replace("lang AS label", "source AS label")


@query("nb_many_classes_predict", _SOURCE_SQL + _PREDICTIONS)
def nb_many_classes_predict(spark, sf_dir):
    """The long table where classes are many: the source of each document."""
    docs = sampling.hash_split(clean_documents(spark, sf_dir, "source"), "doc_id", [0.7, 0.3], SEED)
    train, test = _train_test(docs)
    model = class_terms.fit(class_terms.text_entries(train, "text", ["source"]), "source")
    return _scored(class_terms.predict(model, class_terms.text_entries(test, "text", ["doc_id", "source"]), "doc_id", "source"))


# Folds and smoothing values of the cross-validation.
FOLDS = [0.5, 0.5]
SMOOTHINGS = [0.25, 1.0, 4.0]
_HELD_OUT_FOLD = -1
_CLEAN = f"strip_accents({sql.without_tags('trim(text)')})"
_FOLDS_SQL = f"""
WITH base AS (SELECT doc_id, lang AS label, {_CLEAN} AS text, CASE WHEN {sql.unit('doc_id', SEED)} >= 0.7 THEN {_HELD_OUT_FOLD}
       WHEN {sql.unit('doc_id', SEED + 1)} < 0.5 THEN 0 ELSE 1 END AS fold FROM documents WHERE {_CLEAN} <> ''),
tok AS (SELECT doc_id, label, fold, term, count(*) AS tf FROM (SELECT doc_id, label, fold, {sql.bucket('t', SMALL_FEATURES)} AS term
       FROM (SELECT doc_id, label, fold, unnest({sql.tokens('text')}) AS t FROM base)) GROUP BY ALL),
grid AS (SELECT unnest({SMOOTHINGS}::DOUBLE[]) AS s),
folds AS (SELECT DISTINCT fold AS f FROM base),
cls AS (SELECT f, label, count(*) AS n FROM folds JOIN base ON fold NOT IN (f, {_HELD_OUT_FOLD}) GROUP BY ALL),
sizes AS (SELECT f, sum(n) AS rows_, count(*) AS k FROM cls GROUP BY f),
tc AS (SELECT f, term, label, sum(tf) AS t FROM folds JOIN tok ON fold NOT IN (f, {_HELD_OUT_FOLD}) GROUP BY ALL),
tot AS (SELECT f, label, sum(t) AS tt FROM tc GROUP BY ALL),
sc AS (SELECT tok.doc_id, cls.label, s, sum(tok.tf*ln(coalesce(tc.t,0)+s)) AS x, sum(tok.tf) AS m FROM tok
       JOIN cls ON cls.f = tok.fold LEFT JOIN tc ON tc.f = tok.fold AND tc.term = tok.term AND tc.label = cls.label, grid GROUP BY ALL),
guess AS (SELECT base.doc_id, base.fold, base.label, g.s, cls.label AS guess, row_number() OVER (PARTITION BY base.doc_id, g.s
       ORDER BY round(ln(n+g.s)-ln(rows_+k*g.s)+coalesce(x,0)-coalesce(m,0)*ln(coalesce(tt,0)+g.s*{SMALL_FEATURES}),9) DESC, n DESC, cls.label) AS r
       FROM base JOIN cls ON cls.f = base.fold JOIN sizes ON sizes.f = base.fold JOIN grid g ON true
       LEFT JOIN tot ON tot.f = base.fold AND tot.label = cls.label
       LEFT JOIN sc ON sc.doc_id = base.doc_id AND sc.label = cls.label AND sc.s = g.s),
parts AS (SELECT fold, s AS smoothing, count(*) AS n, count(*) FILTER (guess = label) AS n_right FROM guess WHERE r = 1 GROUP BY ALL)
"""


def _folds(spark, sf_dir):
    docs = sampling.hash_split(_split_documents(spark, sf_dir), "doc_id", FOLDS, SEED + 1, split_column="part")
    fold = F.when(F.col("split") == 1, _HELD_OUT_FOLD).otherwise(F.col("part")).cast("int")
    entries = class_terms.text_entries(docs.withColumn("fold", fold), "text", ["doc_id", "lang", "fold"], SMALL_FEATURES)
    entries = materialize(entries, "fold-entries")
    return class_terms.cross_validated(entries, "doc_id", "lang", "fold", SMOOTHINGS, SMALL_FEATURES, _HELD_OUT_FOLD)


@query("cv_naive_bayes_folds", _FOLDS_SQL + "SELECT fold::INTEGER AS fold, smoothing, n, n_right FROM parts")
def cv_naive_bayes_folds(spark, sf_dir):
    """Right predictions of every fold and smoothing value, and of the held-out rows."""
    return _folds(spark, sf_dir)


@query(
    "cv_naive_bayes_metrics", _FOLDS_SQL +
    f"SELECT smoothing, round(mean_accuracy,6) AS mean_accuracy, r = 1 AS is_best, round(CASE WHEN r = 1 THEN test_accuracy END,6) "
    "AS test_accuracy FROM (SELECT *, row_number() OVER (ORDER BY round(mean_accuracy,9) DESC, smoothing) AS r FROM (SELECT smoothing, "
    f"avg(n_right/n) FILTER (fold <> {_HELD_OUT_FOLD}) AS mean_accuracy, max(n_right/n) FILTER (fold = {_HELD_OUT_FOLD}) AS test_accuracy "
    "FROM parts GROUP BY smoothing))",
)
def cv_naive_bayes_metrics(spark, sf_dir):
    """Mean accuracy of each smoothing value, the best one, and its accuracy on held-out rows."""
    table = class_terms.tuning_table(_folds(spark, sf_dir), _HELD_OUT_FOLD)
    return table.withColumns({c: F.round(c, 6) for c in ("mean_accuracy", "test_accuracy")})


_TEXT_POINTS = f"""
WITH base AS (SELECT doc_id, {_CLEAN} AS text FROM documents WHERE {_CLEAN} <> ''),
tf AS (SELECT doc_id, {sql.bucket('t', SMALL_FEATURES)} AS slot, count(*) AS tf
       FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS t FROM base) GROUP BY ALL),
x AS (SELECT doc_id, slot, tf * ln(((SELECT count(*) FROM base)+1)/(count(*) OVER (PARTITION BY slot)+1)) AS v FROM tf),
k0 AS (SELECT row_number() OVER (ORDER BY {sql.unit('doc_id')}, doc_id) - 1 AS cluster, doc_id FROM base
       ORDER BY {sql.unit('doc_id')}, doc_id LIMIT {CLUSTERS}),
c AS (SELECT cluster, slot, v AS w FROM k0 JOIN x USING (doc_id)),
nx AS (SELECT base.doc_id, coalesce(sum(v*v),0) AS nx FROM base LEFT JOIN x USING (doc_id) GROUP BY ALL),
nc AS (SELECT cluster, nx AS nc FROM k0 JOIN nx USING (doc_id)),
dot AS (SELECT x.doc_id, cluster, sum(v*w) AS d FROM x JOIN c USING (slot) GROUP BY ALL),
a AS (SELECT doc_id, cluster, dist AS distance_sq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(dist,6), cluster) AS r
      FROM (SELECT nx.doc_id, nc.cluster, greatest(nx+nc-2*coalesce(d,0),0) AS dist FROM nx JOIN nc ON true
      LEFT JOIN dot ON dot.doc_id = nx.doc_id AND dot.cluster = nc.cluster)) WHERE r = 1)
"""


def _text_points(spark, sf_dir):
    """Sparse TF-IDF rows of all documents with content, by an engine-neutral hash."""
    docs = materialize(clean_documents(spark, sf_dir).select("doc_id", "text"), "clean")
    counts = materialize(class_terms.text_entries(docs, "text", ["doc_id"], SMALL_FEATURES), "hashed")
    weights = counts.select(F.explode("entries.term").alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("doc_freq")).select(
        "bucket", tfidf.smoothed_idf(F.lit(docs.count()), F.col("doc_freq")).alias("idf"))
    idf = [0.0] * SMALL_FEATURES
    for r in weights.collect():  # a row per slot, as many as are fixed
        idf[r["bucket"]] = r["idf"]
    own_pairs = F.transform("entries", lambda e: F.struct(
        e["term"].alias("slot"), (e["tf"] * F.get(F.lit(idf), e["term"].cast("int"))).alias("value")))
    # a row's entries travel as one array
    pairs = counts.select("doc_id", own_pairs.alias("own")).groupBy("doc_id").agg(
        F.sort_array(F.flatten(F.collect_list("own"))).alias("pairs"))
    own = pairs.withColumnRenamed("doc_id", "own_id")
    empty = F.array().cast("array<struct<slot:bigint,value:double>>")
    joined = docs.select("doc_id").join(own, F.col("doc_id") == F.col("own_id"), "left").select(
        "doc_id", F.coalesce("pairs", empty).alias("pairs"))
    return materialize(joined.select("doc_id", F.col("pairs.slot").alias("slots"), F.col("pairs.value").alias("values")), "points")


def _text_assigned(spark, sf_dir):
    rows = _text_points(spark, sf_dir)
    centres = sparse_clustering.drawn_centres(rows, "doc_id", CLUSTERS)
    return rows, sparse_clustering.assign(rows, "doc_id", centres)


@query("text_kmeans_assign", _TEXT_POINTS + "SELECT doc_id, cluster, round(distance_sq,3) AS distance_sq FROM a")
def text_kmeans_assign(spark, sf_dir):
    """The nearest of 27 drawn documents to each document."""
    _, assigned = _text_assigned(spark, sf_dir)
    return assigned.withColumn("distance_sq", F.round("distance_sq", 3))


@query("text_kmeans_costs", _TEXT_POINTS + "SELECT round(sum(sqrt(distance_sq)),2) AS sum_distance, round(sum(distance_sq),1) AS wssse FROM a")
def text_kmeans_costs(spark, sf_dir):
    _, assigned = _text_assigned(spark, sf_dir)
    return assigned.agg(F.round(F.sum(F.sqrt("distance_sq")), 2).alias("sum_distance"),
                        F.round(F.sum("distance_sq"), 1).alias("wssse"))


@query("text_kmeans_update", _TEXT_POINTS +
       ", z AS (SELECT cluster, count(*) AS n FROM a GROUP BY cluster), m AS (SELECT cluster, slot, sum(v) AS total "
       "FROM a JOIN x USING (doc_id) GROUP BY ALL) SELECT cluster, n, slot, round(total/n,6) AS value FROM m JOIN z USING (cluster) WHERE total <> 0")
def text_kmeans_update(spark, sf_dir):
    """The mean of each cluster of documents, slot by slot."""
    rows, assigned = _text_assigned(spark, sf_dir)
    return sparse_clustering.update(rows, "doc_id", assigned).withColumn("value", F.round("value", 6))


@query("text_kmeans_fit_cover",
       f"SELECT count(*) AS n, true AS nearest, true AS cost_agrees FROM (SELECT {_CLEAN} AS text FROM documents) WHERE text <> ''")
def text_kmeans_fit_cover(spark, sf_dir):
    """Every document is in the fitted cluster that the sparse distances say is nearest, at the model's cost."""
    rows = text_vectors(spark, sf_dir)
    model = clustering.fit_kmeans(rows, "features")
    entries = vector_entries(rows, "features", ["doc_id"])
    own = sparse_clustering.assign(entries, "doc_id", sparse_clustering.model_centres(rows, model))
    fitted = model.transform(rows).select(F.col("doc_id").alias("own_id"), F.col("cluster").alias("own"))
    cost = model.summary.trainingCost
    joined = own.join(fitted, F.col("doc_id") == F.col("own_id"))
    return joined.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("own") == F.col("cluster")).alias("nearest"),
                      (F.sum("distance_sq") <= cost * (1 + 1e-6)).alias("cost_agrees"))


@query(
    "pipeline_stages",
    "SELECT * FROM (VALUES (0::BIGINT,'StringIndexerModel','label_index'), (1,'Tokenizer','tokens'), (2,'HashingTF','tf'), "
    "(3,'IDFModel','features'), (4,'RandomForestClassificationModel',NULL), (5,'IndexToString','predicted_label')) AS t(stage, kind, output)",
)
def pipeline_stages(spark, sf_dir):
    """Kind and output column of each stage of the stored forest pipeline, read from its files."""
    path, _, _ = _stored_pipeline(spark, sf_dir)
    stages = classifiers.stored_stages(spark, path)
    return stages.select("stage", "kind", F.col("params")["outputCol"].alias("output"))


def _stored_pipeline(spark, sf_dir):
    train, test = _train_test(_split_documents(spark, sf_dir))
    model = classifiers.fit_classifier(
        train, "lang", classifiers.random_forest(features="features"), classifiers.hashed_text_stages("text", TREE_FEATURES))
    path = scratch_path(spark, "pipeline")
    model.write().save(path)
    return path, model, test


@query("pipeline_reload_agrees", _HELD_OUT)
def pipeline_reload_agrees(spark, sf_dir):
    """The stored pipeline, read again, predicts for every held-out document what it did before."""
    path, model, test = _stored_pipeline(spark, sf_dir)
    before = classifiers.predictions(model, test, "doc_id", "lang")
    after = classifiers.predictions(PipelineModel.load(path), test, "doc_id", "lang")
    return _agreement(before, after)
