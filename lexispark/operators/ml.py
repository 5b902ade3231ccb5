"""Spark ML pipelines."""

from __future__ import annotations

import math
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    ClusteringEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import (
    IDF,
    PCA,
    CountVectorizer,
    HashingTF,
    Normalizer,
    OneHotEncoder,
    RegexTokenizer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
    Word2Vec,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F


#: Width of hashed token counts: no token is left out, rare ones may share a place, nothing is kept on the driver.
HASH_WIDTH = 1 << 16


#: Between words.
BLANKS_AND_MARKS = r"[\s.,;:!?]+"


def text_features(text: str, width: int = HASH_WIDTH, min_df: int = 2, delimiter: str = BLANKS_AND_MARKS) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=delimiter),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=width),
        IDF(inputCol="counts", outputCol="features", minDocFreq=min_df),
    ]


def indexed(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc", handleInvalid="skip")


def text_classifier(
    text: str, label: str, width: int = HASH_WIDTH, max_iter: int = 100, weight: str | None = None,
    delimiter: str = BLANKS_AND_MARKS,
) -> Pipeline:
    """Counts with inverse document frequency into a (multinomial, optionally weighted) logistic regression."""
    model = LogisticRegression(labelCol="target", maxIter=max_iter, regParam=0.01)
    if weight:
        model.setWeightCol(weight)
    return Pipeline(stages=[indexed(label), *text_features(text, width, delimiter=delimiter), model])


def _word2vec(df: DataFrame, tokens: str, vector: str, size: int, min_count: int, max_iter: int) -> Word2Vec:
    """All texts are learnt from, a share of them on every core; the library's default is one task for all."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    return Word2Vec(
        inputCol=tokens, outputCol=vector, vectorSize=size, minCount=min_count, maxIter=max_iter, numPartitions=parts, seed=1
    )


def mlp_classifier(df: DataFrame, text: str, label: str, hidden: int = 16, max_iter: int = 100) -> Pipeline:
    """A perceptron over averaged word vectors with one output per label of ``df``."""
    labels = indexed(label).fit(df)
    classes = len(labels.labels)
    return Pipeline(
        stages=[
            labels,
            RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"[\s.,;:!?]+"),
            _word2vec(df, "tokens", "features", 32, min_count=5, max_iter=1),
            MultilayerPerceptronClassifier(labelCol="target", layers=[32, hidden, classes], maxIter=max_iter, seed=1),
        ]
    )


def tabular_classifier(
    df: DataFrame, categories: list[str], numbers: list[str], label: str, max_iter: int = 100
) -> Pipeline:
    """Index, one-hot, assemble, scale; a perceptron with two outputs. Categories are those of ``df`` and "other"."""
    index = StringIndexer(
        inputCols=categories, outputCols=[f"{c}_i" for c in categories], stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(df)
    width = sum(len(values) + 1 for values in index.labelsArray) + len(numbers)
    onehot = OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories], dropLast=False)
    assemble = VectorAssembler(inputCols=[*[f"{c}_v" for c in categories], *numbers], outputCol="raw", handleInvalid="skip")
    scale = StandardScaler(inputCol="raw", outputCol="features")
    model = MultilayerPerceptronClassifier(labelCol=label, layers=[width, 8, 2], maxIter=max_iter, seed=1)
    return Pipeline(stages=[index, onehot, assemble, scale, model])


def multiclass_score(predictions: DataFrame, label: str = "target") -> dict[str, float]:
    return {
        m: MulticlassClassificationEvaluator(labelCol=label, metricName=m).evaluate(predictions) for m in ("accuracy", "f1")
    }


def binary_auc(predictions: DataFrame, label: str, raw: str = "rawPrediction") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw).evaluate(predictions)


def multilabel(df: DataFrame, text: str, labels: list[str], test: DataFrame, width: int = HASH_WIDTH, max_iter: int = 100) -> DataFrame:
    """One logistic regression per label on shared features of ``df``; adds ``<label>_pred`` to the rows of ``test``."""
    prepare = Pipeline(stages=text_features(text, width)).fit(df)
    features, out = prepare.transform(df), prepare.transform(test)
    for label in labels:
        model = LogisticRegression(
            labelCol=label, maxIter=max_iter, regParam=0.01, predictionCol=f"{label}_pred",
            rawPredictionCol=f"{label}_raw", probabilityCol=f"{label}_prob",
        ).fit(features)
        out = model.transform(out).drop(f"{label}_raw", f"{label}_prob")
    return out.drop("features", "counts", "tokens")


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _digamma(x: np.ndarray) -> np.ndarray:
    x, below = np.array(x, float), 0.0
    for _ in range(8):
        below, x = below + 1 / x, x + 1
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - below


def _bounds(batches, topics, alpha):
    """The part of every document in the bound; ``topics`` holds exp(E[log beta]) by term and topic."""
    for batch in batches:
        terms, counts = (batch["features"].field(f) for f in ("indices", "values"))
        doc = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
        at, n = terms.flatten().to_numpy(), counts.flatten().to_numpy()
        total = np.bincount(doc, n, len(batch))
        # What a document's posterior sums to is fixed by its length, so its shares tell the whole of it.
        gamma = batch["shares"].flatten().to_numpy().reshape(len(batch), -1) * (alpha.sum() + total)[:, None]
        gamma = np.where(total[:, None] > 0, gamma, 1.0)
        theta = _digamma(gamma) - _digamma(gamma.sum(axis=1))[:, None]
        likely = sum(np.exp(theta[doc, k]) * topics.value[at, k] for k in range(len(alpha)))
        bound = np.bincount(doc, n * np.log(likely), len(batch)) + ((alpha - gamma) * theta + _lgamma(gamma) - _lgamma(alpha)).sum(axis=1)
        bound += math.lgamma(alpha.sum()) - _lgamma(gamma.sum(axis=1))
        yield pa.RecordBatch.from_pydict({"bound": bound[total > 0]})


def _log_likelihood(model: LDAModel, shared: DataFrame, eta: float) -> float:
    """The variational bound that ``LDAModel.logLikelihood`` gives, of documents with their topic shares.

    The library works out the exponentials of all terms and topics anew for every document; here that is done once.
    """
    weights = model.topicsMatrix().toArray()
    beta = _digamma(weights) - _digamma(weights.sum(axis=0))
    of_topics = ((eta - weights) * beta + _lgamma(weights) - math.lgamma(eta)).sum()
    of_topics += (math.lgamma(eta * len(weights)) - _lgamma(weights.sum(axis=0))).sum()
    alpha = model.estimatedDocConcentration().toArray()
    topics = shared.sparkSession.sparkContext.broadcast(np.exp(beta))
    found = shared.mapInArrow(partial(_bounds, topics=topics, alpha=alpha), "bound double")
    return float(found.agg(F.coalesce(F.sum("bound"), F.lit(0.0))).first()[0] + of_topics)


def topic_model(df: DataFrame, doc_id: str, text: str, topics: int, max_iter: int = 20):
    """``(terms, mixture, log_likelihood)``: top terms per topic and the topic shares of every document."""
    prepare = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"[\s.,;:!?]+", minTokenLength=3),
            CountVectorizer(inputCol="tokens", outputCol="features", minDF=2),
        ]
    ).fit(df)
    rows = prepare.transform(df).select(doc_id, "features").cache()
    eta = 1.0 / topics  # the library's default
    model = LDA(k=topics, maxIter=max_iter, seed=1, featuresCol="features", topicConcentration=eta).fit(rows)
    spark = df.sparkSession
    vocabulary = spark.createDataFrame(list(enumerate(prepare.stages[-1].vocabulary)), "term_id int, term string")
    described = model.describeTopics(10).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x")
    )
    terms = described.select("topic", "rank", F.col("x.termIndices").alias("term_id"), F.col("x.termWeights").alias("weight")).join(
        vocabulary, "term_id"
    )
    shared = model.transform(rows).select(doc_id, "features", vector_to_array("topicDistribution").alias("shares"))
    return terms, shared.select(doc_id, "shares"), _log_likelihood(model, shared.select("features", "shares"), eta)


def word_embeddings(df: DataFrame, tokens: str, size: int = 32, min_count: int = 5, max_iter: int = 1) -> DataFrame:
    """``word, vector``."""
    model = _word2vec(df, tokens, "v", size, min_count, max_iter).fit(df)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def regressors(features: str, label: str, hashed: bool = False, components: int = 8) -> dict[str, Pipeline]:
    """Forest, boosted trees and linear regression over hashed tokens or principal components."""
    if hashed:
        prepare = [HashingTF(inputCol=features, outputCol="x", numFeatures=1 << 10), Normalizer(inputCol="x", outputCol="z")]
    else:
        prepare = [PCA(k=components, inputCol=features, outputCol="z")]
    models = {
        "forest": RandomForestRegressor(featuresCol="z", labelCol=label, numTrees=128, maxDepth=5, seed=1),
        "boosted": GBTRegressor(featuresCol="z", labelCol=label, maxIter=20, maxDepth=3, seed=1),
        "linear": LinearRegression(featuresCol="z", labelCol=label, maxIter=100, regParam=0.01),
    }
    return {name: Pipeline(stages=[*prepare, model]) for name, model in models.items()}


def r2(predictions: DataFrame, label: str) -> float:
    return RegressionEvaluator(labelCol=label, metricName="r2").evaluate(predictions)


def forecast(train: DataFrame, valid: DataFrame, inputs: list[str], targets: list[str], keys: list[str]) -> DataFrame:
    """One linear model per horizon step on scaled inputs; ``keys, horizon, actual, estimate`` of the valid rows."""
    prepare = Pipeline(
        stages=[
            VectorAssembler(inputCols=inputs, outputCol="raw", handleInvalid="skip"),
            StandardScaler(inputCol="raw", outputCol="features"),
        ]
    ).fit(train)
    fitted, unseen = prepare.transform(train).cache(), prepare.transform(valid)
    parts = []
    for step, target in enumerate(targets, start=1):
        model = LinearRegression(labelCol=target, predictionCol="estimate", regParam=0.1).fit(fitted.filter(F.col(target).isNotNull()))
        known = unseen.filter(F.col(target).isNotNull())
        parts.append(
            model.transform(known).select(*keys, F.lit(step).alias("horizon"), F.col(target).alias("actual"), "estimate")
        )
    return reduce(DataFrame.unionByName, parts)


def grid_search(df: DataFrame, pipeline: Pipeline, grid: dict, folds: int = 2, parallelism: int = 2, label: str = "target") -> list[dict]:
    """Mean score per parameter setting, cross-validated."""
    model = pipeline.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), values)
    settings = builder.build()
    fitted = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=settings,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        numFolds=folds,
        parallelism=parallelism,
        seed=1,
    ).fit(df)
    return [
        {**{p.name: v for p, v in s.items()}, "accuracy": score} for s, score in zip(settings, fitted.avgMetrics)
    ]


def save_and_load(model: PipelineModel, path: str) -> PipelineModel:
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def silhouette(df: DataFrame, features: str, cluster: str) -> float:
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(df)
