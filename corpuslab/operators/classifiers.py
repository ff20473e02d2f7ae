"""Text and vector classifiers of pyspark.ml as pipelines, their summaries and tuning."""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    CountVectorizer, HashingTF, IDF, IndexToString, StringIndexer, Tokenizer, VectorIndexer,
)
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.operators import class_terms, perceptron, sparse_trees
from corpuslab.operators.features import vector_entries
from corpuslab.operators.tokens import vocabulary
from corpuslab.session import materialize, persisted

# Settings of the usual fits.
TEXT_FEATURES = 10000
SEED = 1234
# Of what a fit of trees keeps per task: four bytes for every row and slot.
TREE_TASK_BYTES = 256 * 1024 * 1024
# Vectors are sparse for a network or trees if they are this many times as wide as what they store.
SPARSE = 4
# Rows that are worth a task of their own in a step of a network, as each task sends slopes as long as the network.
NETWORK_ROWS = 1024
# Of a fitted vocabulary and naive Bayes over it on the driver; a larger one is kept as tables.
VOCABULARY_BYTES = 64 * 1024 * 1024
# Rows from which a network takes the products with its first layer in single precision.
SINGLE_ROWS = 100_000


def hashed_text_stages(text: str, num_features: int = TEXT_FEATURES, output: str = "features") -> list:
    """Tokens, hashed counts and IDF weights: a fixed width, whatever the vocabulary."""
    return [
        Tokenizer(inputCol=text, outputCol="tokens"),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol=output),
    ]


def counted_text_stages(text: str, vocabulary: int, output: str = "features",
                        weighted: bool = True) -> list:
    """Tokens and exact counts of ``vocabulary`` terms at most, IDF-weighted if asked.

    The fitted vocabulary lives on the driver. :func:`fit_classifier` refuses a corpus with
    more terms than the width given here, and fits naive Bayes over a large vocabulary as tables.
    """
    counts = "tf" if weighted else output
    stages = [
        Tokenizer(inputCol=text, outputCol="tokens"),
        CountVectorizer(inputCol="tokens", outputCol=counts, vocabSize=vocabulary),
    ]
    return stages + [IDF(inputCol="tf", outputCol=output)] if weighted else stages


def text_features(fit_on: DataFrame, df: DataFrame, text: str, keep: Sequence[str],
                  num_features: int = TEXT_FEATURES) -> DataFrame:
    """Hashed TF-IDF vectors of ``df``, weights fitted on ``fit_on``.

    The vectors are stored, because fits read them many times. Keep the split
    column and filter on it afterwards: text is then read once for all parts.
    """
    model = Pipeline(stages=hashed_text_stages(text, num_features)).fit(fit_on)
    return materialize(model.transform(df).select(*keep, "features"), "features")


def naive_bayes(smoothing: float = 1.0) -> Estimator:
    return NaiveBayes(smoothing=smoothing, modelType="multinomial", labelCol="label_index")


class _BoundedTrees:
    """Trees of pyspark.ml, but sparse rows of which these would keep more than a task's share go to :mod:`sparse_trees`."""

    def _fit(self, dataset: DataFrame):
        features = self.getFeaturesCol()
        first = dataset.select(features).first()
        width, n_rows = (len(first[0]) if first and first[0] is not None else 0), dataset.count()
        if 4 * width * n_rows > TREE_TASK_BYTES and sparse_trees.supported(self, sparse_trees.categories(dataset, features), n_rows):
            stored = vector_entries(dataset, features, []).agg(F.avg(F.size("slots"))).first()[0]
            if SPARSE * stored <= width:
                return sparse_trees.fit(self, super()._fit, dataset, n_rows, width)
        return super()._fit(dataset)


class _Forest(_BoundedTrees, RandomForestClassifier):
    pass


class _Tree(_BoundedTrees, DecisionTreeClassifier):
    pass


class _SlotIndex(VectorIndexer):
    """Each task sends the values of all slots to the driver, so a few tasks read the rows."""

    def _fit(self, dataset: DataFrame):
        return super()._fit(dataset.coalesce(2 * dataset.sparkSession.sparkContext.defaultParallelism))


def random_forest(trees: int = 3, impurity: str = "gini", features: str = "indexed") -> Estimator:
    return _Forest(numTrees=trees, impurity=impurity, seed=SEED,
                                  labelCol="label_index", featuresCol=features)


def decision_tree(features: str = "indexed") -> Estimator:
    return _Tree(labelCol="label_index", featuresCol=features, seed=SEED)


def logistic(max_iter: int = 10, reg: float = 0.3, elastic_net: float = 0.8) -> Estimator:
    return LogisticRegression(maxIter=max_iter, regParam=reg, elasticNetParam=elastic_net,
                              labelCol="label_index", family="multinomial")


def logistic_lbfgs(max_iter: int = 100) -> Estimator:
    """Without penalty Spark solves the regression by L-BFGS; classes come from the data."""
    return LogisticRegression(maxIter=max_iter, regParam=0.0, labelCol="label_index",
                              family="multinomial")


def fit_classifier(train: DataFrame, label: str, classifier: Estimator,
                   feature_stages: Sequence = (), max_categories: int | None = None) -> PipelineModel:
    """Label index, feature stages, optional slot index, classifier, and back to label names."""
    labels = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip").fit(train)
    stages = [labels, *feature_stages]
    if max_categories is not None:
        stages.append(_SlotIndex(inputCol="features", outputCol="indexed",
                                 maxCategories=max_categories, handleInvalid="keep"))
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels.labels)
    for stage in feature_stages:
        if isinstance(stage, CountVectorizer):
            terms = _refuse_cut(train, feature_stages, stage)
            if terms * (8 * len(labels.labels) + 100) > VOCABULARY_BYTES and _is_counted_bayes(feature_stages, classifier):
                with persisted(train) as rows:
                    return PipelineModel([labels, _TableBayes.fitted(rows, label, labels.labels, feature_stages, classifier), back])
    with persisted(train) as rows:
        if not isinstance(classifier, (DecisionTreeClassifier, RandomForestClassifier)):
            return Pipeline(stages=[*stages, classifier, back]).fit(rows)
        with _kept_for_trees(rows, _width(rows, feature_stages)) as dealt:
            return Pipeline(stages=[*stages, classifier, back]).fit(dealt)


def _width(train: DataFrame, stages: Sequence, features: str = "features") -> int:
    """Slots of the vectors that the stages make, or that the rows have."""
    for stage in stages:
        if isinstance(stage, HashingTF):
            return stage.getNumFeatures()
        if isinstance(stage, CountVectorizer):
            return stage.getVocabSize()
    first = train.select(features).first()
    return len(first[features]) if first else 0


def _dealt_for_trees(rows: DataFrame, width: int, task_bytes: int | None = None) -> DataFrame:
    """Rows over enough tasks for what trees keep of them, which is as wide as the vectors, to stay bounded.

    Files may fill some tasks and leave others empty, so the fullest task counts, not their number.
    """
    most = (task_bytes or TREE_TASK_BYTES) // (4 * width) if width else None
    sizes = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    n, fullest = sizes.agg(F.sum("n"), F.max("n")).first()
    if not width or not n or fullest <= max(most, 1):
        return rows
    return rows.repartition(math.ceil(4 * width * n / (task_bytes or TREE_TASK_BYTES)))


@contextmanager
def _kept_for_trees(rows: DataFrame, width: int):
    """Cached rows dealt for trees; if they had to be dealt anew, only the new ones stay cached."""
    dealt = _dealt_for_trees(rows, width)
    if dealt is rows:
        yield rows
        return
    with persisted(dealt):
        dealt.count()
        rows.unpersist()
        yield dealt


def _is_counted_bayes(stages: Sequence, classifier: Estimator) -> bool:
    """Whether these are the stages of :func:`counted_text_stages` before :func:`naive_bayes`."""
    return [type(s) for s in stages] in ([Tokenizer, CountVectorizer], [Tokenizer, CountVectorizer, IDF]) and isinstance(
        classifier, NaiveBayes) and classifier.getModelType() == "multinomial" and not classifier.isSet("weightCol") and not (
        classifier.isSet("thresholds") or any(stages[1].isSet(p) for p in ("minTF", "minDF", "maxDF", "binary")) or any(
            s.isSet("minDocFreq") for s in stages[2:]))


class _TableBayes(Model):
    """Counts, weights and naive Bayes of a large vocabulary as the tables of :mod:`class_terms`: the answers of the fitted stages."""

    def __init__(self, model: class_terms.ClassTerms, labels: Sequence[str], text: str):
        super().__init__()
        self.model, self.labels, self.text = model, labels, text

    @classmethod
    def fitted(cls, train: DataFrame, label: str, labels: Sequence[str], stages: Sequence, classifier: NaiveBayes) -> _TableBayes:
        text = stages[0].getInputCol()
        model = class_terms.fit(class_terms.text_entries(train.withColumn(label, F.col(label).cast("string")), text, [label]), label,
                                classifier.getSmoothing(), weighted=len(stages) > 2)
        return cls(model, labels, text)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # ids of rows may repeat, so they get numbers of their own, which storing them fixes
        rows = materialize(dataset.withColumn("__row", F.monotonically_increasing_id()), "rows-to-score")
        entries = class_terms.text_entries(rows.withColumn("__label", F.lit(None).cast("string")), self.text, ["__row", "__label"])
        found = class_terms.predict(self.model, entries, "__row", "__label")
        index = F.array_position(F.array(*[F.lit(c) for c in self.labels]), F.col("prediction")) - 1
        own = found.select(F.col("__row").alias("__own"), index.cast("double").alias("prediction"))
        return rows.join(own, F.col("__row") == F.col("__own"), "left").drop("__row", "__own")


def _refuse_cut(train: DataFrame, stages: Sequence, vectorizer: CountVectorizer) -> int:
    """Number of terms of the training rows; an error if the vectoriser would keep fewer."""
    tokenizer = next(s for s in stages if isinstance(s, Tokenizer))
    terms = vocabulary(train, tokenizer.getInputCol()).count()
    if terms > vectorizer.getVocabSize():
        raise ValueError(f"{terms} terms do not fit a vocabulary of {vectorizer.getVocabSize()}")
    return terms


def fit_perceptron(train: DataFrame, label: str, hidden: Sequence[int], max_iter: int = 100,
                   block_size: int = 128) -> PipelineModel:
    """Feed-forward network; the data give the sizes of its first and last layer.

    Rows that store at most a quarter of their width are fitted as they are stored, by
    :mod:`perceptron`, from the same start; the network of pyspark.ml takes each at its full width.
    """
    width = len(train.select("features").first()["features"])
    n_classes = train.select(label).distinct().count()
    sizes = [width, *hidden, n_classes]
    network = MultilayerPerceptronClassifier(
        layers=sizes, maxIter=max_iter, blockSize=block_size, seed=SEED, labelCol="label_index",
    )
    labels = StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="skip").fit(train)
    indexed = labels.transform(train).select("label_index", "features")
    n_rows = train.count()
    tasks = min(train.sparkSession.sparkContext.defaultParallelism, max(1, math.ceil(n_rows / NETWORK_ROWS)))
    entries = vector_entries(indexed, "features", ["label_index"]).repartition(tasks)
    with persisted(entries) as rows:
        stored = rows.agg(F.avg(F.size("slots"))).first()[0]
        is_sparse = stored is not None and SPARSE * stored <= width
        if is_sparse:
            # without an iteration pyspark.ml gives its start, and takes weights as they are
            first = indexed.limit(1)
            start = network.copy({network.maxIter: 0}).fit(first).weights.toArray()
            found = Vectors.dense(perceptron.fit_weights(
                rows, sizes, start, max_iter, network.getTol(), n_rows >= SINGLE_ROWS))
    if not is_sparse:
        return fit_classifier(train, label, network)
    fitted = network.copy({network.maxIter: 0, network.initialWeights: found}).fit(first)
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels.labels)
    return PipelineModel([labels, fitted, back])


def predictions(model: PipelineModel, df: DataFrame, id_column: str, label: str) -> DataFrame:
    """Rows with their label and predicted label. Scoring needs no label, so labels not
    seen in training are kept too."""
    # the label index is of no use in scoring; without it the caller's model stays as it is
    return PipelineModel(model.stages[1:]).transform(df).select(
        id_column, F.col(label).alias("label"), F.col("predicted_label").alias("prediction")
    )


def stored_stages(spark: SparkSession, path: str) -> DataFrame:
    """(stage, kind, params) of a saved pipeline, from the metadata that it was stored with.

    ``params`` holds set and default parameters as JSON text without outer quotes.
    """
    lines = spark.read.text(f"{path}/stages/*/metadata").select("value", F.col("_metadata.file_path").alias("file"))
    stage = F.regexp_extract("file", r"/stages/(\d+)_", 1).cast("long")
    listed = lambda name: F.coalesce(F.from_json(F.get_json_object("value", f"$.{name}"), "map<string,string>"),
                                     F.create_map().cast("map<string,string>"))
    own, default = listed("paramMap"), listed("defaultParamMap")
    unset = F.map_filter(default, lambda k, _: ~F.array_contains(F.map_keys(own), k))
    kind = F.element_at(F.split(F.get_json_object("value", "$.class"), r"\."), -1)
    return lines.select(stage.alias("stage"), kind.alias("kind"), F.map_concat(own, unset).alias("params"))


def tree_summary(spark: SparkSession, model) -> DataFrame:
    """One row per tree of a fitted forest or single tree: depth, nodes, features used."""
    trees = getattr(model, "trees", [model])
    rows = [
        (i, int(t.depth), int(t.numNodes), int(len(t.featureImportances.indices)))
        for i, t in enumerate(trees)
    ]
    return spark.createDataFrame(rows, "tree bigint, depth bigint, n_nodes bigint, n_features_used bigint")


def feature_importances(spark: SparkSession, model) -> DataFrame:
    importances = model.featureImportances
    rows = [(int(i), float(v)) for i, v in zip(importances.indices, importances.values)]
    return spark.createDataFrame(rows, "slot bigint, importance double")


def intercepts(spark: SparkSession, model, labels: Sequence[str]) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(labels, model.interceptVector.toArray())]
    return spark.createDataFrame(rows, "label string, intercept double")


def coefficients(spark: SparkSession, model, labels: Sequence[str]) -> DataFrame:
    """One row per class and slot."""
    rows = [
        (label, slot, float(value))
        for label, row in zip(labels, model.coefficientMatrix.toArray())
        for slot, value in enumerate(row)
    ]
    return spark.createDataFrame(rows, "label string, slot bigint, coefficient double")


def tune_forest(train: DataFrame, features: str, label_index: str, fold_column: str,
                trees: Sequence[int] = (5, 6, 7), folds: int = 2,
                parallelism: int = 2) -> CrossValidatorModel:
    """Cross-validate the number of trees; ``fold_column`` makes the folds repeatable."""
    forest = _Forest(labelCol=label_index, featuresCol=features, seed=SEED)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).build()
    evaluator = MulticlassClassificationEvaluator(labelCol=label_index, metricName="accuracy")
    validator = CrossValidator(
        estimator=Pipeline(stages=[forest]), estimatorParamMaps=grid, evaluator=evaluator,
        numFolds=folds, foldCol=fold_column, parallelism=parallelism, seed=SEED,
    )
    with persisted(train) as rows, _kept_for_trees(rows, _width(rows, [], features)) as dealt:
        return validator.fit(dealt)


def tuning_table(tuned: CrossValidatorModel, test: DataFrame, label_index: str) -> DataFrame:
    """One row per setting: mean accuracy over the folds, whether it won, and if so
    its accuracy on the held-out rows."""
    evaluator = MulticlassClassificationEvaluator(labelCol=label_index, metricName="accuracy")
    held_out = evaluator.evaluate(tuned.bestModel.transform(test))
    best = tuned.bestModel.stages[-1].getNumTrees
    rows = []
    for params, accuracy in zip(tuned.getEstimatorParamMaps(), tuned.avgMetrics):
        trees = next(iter(params.values()))
        rows.append((trees, float(accuracy), trees == best, held_out if trees == best else None))
    return test.sparkSession.createDataFrame(
        rows, "num_trees bigint, mean_accuracy double, is_best boolean, test_accuracy double"
    )

