"""Scores of two deterministic (label, prediction) tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.operators import metrics
from corpuslab.plans.learning import nb_predictions, nb_sql
from corpuslab.plans.registry import query
from corpuslab.sources.tables import load_table

_LABELS = "WITH p AS (SELECT quality AS label, toxic AS prediction FROM labels)"
_NB = nb_sql() + ", p AS (SELECT label, prediction FROM pred)"

_PER_CLASS = """
, c AS (SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction),
pc AS (SELECT l.class, l.tp::BIGINT AS tp, l.n_label::BIGINT AS n_label, coalesce(q.n_predicted,0)::BIGINT AS n_predicted,
       CASE WHEN coalesce(q.n_predicted,0)=0 THEN 0 ELSE l.tp/q.n_predicted END AS pr, l.tp/l.n_label AS re,
       CASE WHEN (SELECT sum(n) FROM c)=l.n_label THEN 0 ELSE
         (coalesce(q.n_predicted,0)-l.tp)/((SELECT sum(n) FROM c)-l.n_label) END AS fpr
  FROM (SELECT label AS class, sum(n) AS n_label, sum(CASE WHEN label=prediction THEN n ELSE 0 END) AS tp
        FROM c GROUP BY label) l
  LEFT JOIN (SELECT prediction AS class, sum(n) AS n_predicted FROM c GROUP BY prediction) q USING (class)),
m AS (SELECT *, CASE WHEN pr+re=0 THEN 0 ELSE 2*pr*re/(pr+re) END AS f1,
       CASE WHEN pr+re=0 THEN 0 ELSE 1.25*pr*re/(0.25*pr+re) END AS f05 FROM pc)
"""
_ACCURACY = "avg(CASE WHEN label=prediction THEN 1.0 ELSE 0.0 END)"
_PER_CLASS_ROWS = (
    " SELECT class, tp, n_label, n_predicted, round(pr,6) AS precision, round(re,6) AS recall, "
    "round(f1,6) AS f1, round(fpr,6) AS false_positive_rate FROM m"
)
_WEIGHTED = " SELECT " + ", ".join(
    f"round(sum(n_label*{c})/sum(n_label),6) AS weighted_{name}"
    for c, name in [("re", "recall"), ("pr", "precision"), ("f1", "f1"), ("f05", "f_beta"),
                    ("fpr", "fpr"), ("re", "tpr")]
) + " FROM m"


def _label_confusion(spark, sf_dir):
    pairs = load_table(spark, sf_dir, "labels", ["quality", "toxic"])
    return metrics.confusion_matrix(pairs, "quality", "toxic")


def _nb_confusion(spark, sf_dir):
    return metrics.confusion_matrix(nb_predictions(spark, sf_dir))


def _rounded(df):
    return df.select(*[
        F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


@query("confusion_matrix", _LABELS + " SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction")
def confusion_matrix(spark, sf_dir):
    return _label_confusion(spark, sf_dir)


@query("metric_accuracy", _LABELS + f" SELECT round({_ACCURACY},6) AS accuracy FROM p")
def metric_accuracy(spark, sf_dir):
    return _rounded(metrics.accuracy(_label_confusion(spark, sf_dir)))


@query("metric_test_error", _LABELS + f" SELECT round(1-{_ACCURACY},6) AS test_error FROM p")
def metric_test_error(spark, sf_dir):
    return _rounded(metrics.test_error(_label_confusion(spark, sf_dir)))


@query("metric_overall", _LABELS + " SELECT " + ", ".join(
    f"round({_ACCURACY},6) AS {n}" for n in ("accuracy", "precision", "recall", "f1")) + " FROM p")
def metric_overall(spark, sf_dir):
    return _rounded(metrics.overall(_label_confusion(spark, sf_dir)))


@query("metric_weighted_f1", _LABELS + _PER_CLASS + " SELECT round(sum(n_label*f1)/sum(n_label),6) AS weighted_f1 FROM m")
def metric_weighted_f1(spark, sf_dir):
    scores = metrics.weighted(metrics.per_class(_label_confusion(spark, sf_dir)))
    return _rounded(scores.select("weighted_f1"))


@query("metric_per_class", _LABELS + _PER_CLASS + _PER_CLASS_ROWS)
def metric_per_class(spark, sf_dir):
    return _rounded(metrics.per_class(_label_confusion(spark, sf_dir)))


@query("metric_weighted", _LABELS + _PER_CLASS + _WEIGHTED)
def metric_weighted(spark, sf_dir):
    return _rounded(metrics.weighted(metrics.per_class(_label_confusion(spark, sf_dir))))


@query("nb_confusion_matrix", _NB + " SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction")
def nb_confusion_matrix(spark, sf_dir):
    return _nb_confusion(spark, sf_dir)


@query("nb_metric_per_class", _NB + _PER_CLASS + _PER_CLASS_ROWS)
def nb_metric_per_class(spark, sf_dir):
    return _rounded(metrics.per_class(_nb_confusion(spark, sf_dir)))


@query("nb_metric_weighted", _NB + _PER_CLASS + _WEIGHTED)
def nb_metric_weighted(spark, sf_dir):
    return _rounded(metrics.weighted(metrics.per_class(_nb_confusion(spark, sf_dir))))
