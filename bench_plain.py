"""

Row-at-a-time accent function on all text, filters after it, nothing stored or cached.
Same settings as bench.py; prints one JSON line.
"""

from __future__ import annotations

import json
import os
import time
import unicodedata

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, StringIndexer, Tokenizer, VectorIndexer
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslab.session import local_session
from corpuslab.sources.tables import load_table

WIDTH, TREES = 10000, 3


def plain_accents(text):
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def cleaned(spark, sf_dir):
    accents = F.udf(plain_accents, StringType())
    docs = load_table(spark, sf_dir, "documents", ["doc_id", "lang", "text"], "doc_id")
    for c in ("text", "lang"):
        docs = docs.withColumn(c, F.trim(c))
    docs = docs.withColumn("text", F.regexp_replace("text", "<.*?>", ""))
    for c in ("text", "lang"):
        docs = docs.withColumn(c, accents(c))
    return docs.where(F.col("text") != "")


def class_counts(spark, sf_dir):
    return cleaned(spark, sf_dir).groupBy("lang").count()


def classified(classifier, stages=()):
    def flow(spark, sf_dir):
        docs = cleaned(spark, sf_dir)
        train, test = docs.randomSplit([0.7, 0.3], 1234)
        features = [Tokenizer(inputCol="text", outputCol="tokens"),
                    HashingTF(inputCol="tokens", outputCol="tf", numFeatures=WIDTH), IDF(inputCol="tf", outputCol="features")]
        label = StringIndexer(inputCol="lang", outputCol="label")
        return Pipeline(stages=[label, *features, *stages, classifier]).fit(train).transform(test).select("doc_id", "prediction")

    return flow


FLOWS = {
    "clean_class_counts": class_counts,
    "nb_hashed_ml_predict": classified(NaiveBayes()),
    "random_forest_predict": classified(
        RandomForestClassifier(numTrees=TREES, seed=1234, featuresCol="indexed"),
        [VectorIndexer(inputCol="features", outputCol="indexed", maxCategories=29, handleInvalid="keep")]),
    "logistic_predict": classified(LogisticRegression(maxIter=10, regParam=0.3, elasticNetParam=0.8, family="multinomial")),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("plain", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, flow in FLOWS.items():
        for _ in range(2):  # the second run counts
            start = time.perf_counter()
            flow(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "plain_flow_seconds", "queries": times, "unit": "sec"}))


if __name__ == "__main__":
    main()
