"""Model queries: fits and their scores; checked by rows, and by invariants in the tests."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lexispark.catalog.dialogue import acts
from lexispark.catalog.graphs import KEYS, trees
from lexispark.catalog.numeric import daily, vectors
from lexispark.catalog.registry import query, table
from lexispark.functions import text as tx
from lexispark.operators import dialog as dg, graph as gr, metrics as mt, ml, series as sr, transitions as tr
from lexispark.operators.corpus import hash_split
from lexispark.plans.checkpoints import cut_lineage, scratch_path


def _rated(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return docs.join(table(spark, sf, "labels"), "doc_id")


def _score_row(spark, model: str, rows: int, **scores):
    names = list(scores)
    schema = "model string, rows bigint, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame([(model, rows, *[float(scores[n]) for n in names])], schema)


def _halves(df, key="doc_id"):
    split = hash_split(df, key, 0.25, seed=11).cache()
    return split.filter("split = 'train'"), split.filter("split = 'test'")


@query("classify_text")
def classify_text(spark, sf):
    rows = _rated(spark, sf).withColumn("label", F.col("quality").cast("string"))
    train, test = _halves(rows)
    scored = ml.text_classifier("text", "label").fit(train).transform(test)
    return scored.select("doc_id", "quality", "prediction")


@query("classify_language")
def classify_language(spark, sf):
    train, test = _halves(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    scored = ml.text_classifier("text", "lang").fit(train).transform(test)
    return scored.select("doc_id", "lang", "target", "prediction")


@query("classify_mlp")
def classify_mlp(spark, sf):
    train, test = _halves(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    scored = ml.mlp_classifier(train, "text", "lang").fit(train).transform(test)
    return scored.select("doc_id", "lang", "target", "prediction")


@query("classify_tabular")
def classify_tabular(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("string").alias("nation"),
        (F.col("c_acctbal") > 4500).cast("double").alias("y"),
    )
    train, test = _halves(rows, "c_custkey")
    model = ml.tabular_classifier(train, ["c_mktsegment", "nation"], ["c_acctbal"], "y")
    scored = model.fit(train).transform(test)
    return _score_row(spark, "tabular", test.count(), auc=ml.binary_auc(scored, "y"))


@query("classify_transitions")
def classify_transitions(spark, sf):
    contexts = cut_lineage(tr.transition_contexts(trees(spark, sf), KEYS))
    weights = mt.class_weights(contexts, "transition").select("transition", F.col("w_ten").alias("weight"))
    rows = contexts.join(weights, "transition")
    train, test = _halves(rows)
    model = ml.text_classifier("features_text", "transition", width=1 << 14, weight="weight", delimiter=r"\s+")
    named = lambda df: df.withColumnRenamed("features", "features_text")
    scored = model.fit(named(train)).transform(named(test))
    counts = scored.groupBy("transition", "target", "prediction").agg(F.count("*").alias("n"))
    return counts.select("transition", (F.col("target") == F.col("prediction")).cast("int").alias("hit"), "n")


@query("topic_model")
def topic_model(spark, sf):
    _, mixture, _ = ml.topic_model(table(spark, sf, "documents"), "doc_id", "text", topics=5)
    return mixture.select("doc_id", F.posexplode("shares").alias("topic", "share"))


@query("topic_terms")
def topic_terms(spark, sf):
    terms, _, _ = ml.topic_model(table(spark, sf, "documents"), "doc_id", "text", topics=5)
    return terms.select("topic", "rank", "term", "weight")


@query("word_embeddings")
def word_embeddings(spark, sf):
    rows = table(spark, sf, "documents").select(tx.words(F.lower("text")).alias("tokens"))
    return ml.word_embeddings(rows, "tokens").select("word", F.posexplode("vector").alias("position", "value"))


@query("regress_embeddings")
def regress_embeddings(spark, sf):
    rows = vectors(spark, sf).select("vec_id", array_to_vector("v").alias("features"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("y"))
    train, test = _halves(rows, "vec_id")
    out = None
    for name, pipeline in ml.regressors("features", "y").items():
        score = _score_row(spark, name, test.count(), r2=ml.r2(pipeline.fit(train).transform(test), "y"))
        out = score if out is None else out.unionByName(score)
    return out


@query("classify_and_vote")
def classify_and_vote(spark, sf):
    train, test = _halves(acts(spark, sf).select("conv_id", "turn", "text", "role"), "conv_id")
    scored = ml.text_classifier("text", "role").fit(train).transform(test)
    scored = scored.select("conv_id", F.col("prediction").cast("int").alias("vote"))
    return dg.majority_vote(scored, "conv_id", "vote")


@query("classify_multilabel")
def classify_multilabel(spark, sf):
    rows = _rated(spark, sf).select("doc_id", "text", "quality", "toxic")
    train, test = _halves(rows)
    out = ml.multilabel(train, "text", ["quality", "toxic"], test)
    return out.select("doc_id", "quality", "toxic", "quality_pred", "toxic_pred")


@query("forecast_horizons")
def forecast_horizons(spark, sf):
    rows = sr.roll(daily(spark, sf).withColumn("month", F.month("date").cast("double")), "series", 4, 3, ["month"])
    inputs = [c for c in rows.columns if "_m" in c] + ["month", "y"]
    targets = ["y_p1", "y_p2", "y_p3"]
    train, valid = rows.filter(F.year("date") <= 1999), rows.filter(F.year("date") >= 2000)
    out = ml.forecast(train, valid, inputs, targets, ["series", "date"])
    return out.groupBy("series", "horizon").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("actual") - F.col("estimate"))).alias("mae")
    )


@query("grid_search")
def grid_search(spark, sf):
    rows = table(spark, sf, "documents").select("text", "lang")
    ready = Pipeline(stages=[ml.indexed("lang"), *ml.text_features("text", 1 << 10)]).fit(rows).transform(rows).select("target", "features").cache()
    model = Pipeline(stages=[ml.LogisticRegression(labelCol="target")])
    results = ml.grid_search(ready, model, {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5]})
    return spark.createDataFrame(
        [(r["regParam"], r["elasticNetParam"], float(r["accuracy"])) for r in results], "reg double, elastic double, accuracy double"
    )


@query("preprocessor_roundtrip")
def preprocessor_roundtrip(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fitted = Pipeline(stages=[ml.indexed("lang"), *ml.text_features("text")]).fit(rows)
    loaded = ml.save_and_load(fitted, scratch_path(spark, "preprocessor"))
    before = fitted.transform(rows).select("doc_id", F.col("features").alias("a"))
    after = loaded.transform(rows).select("doc_id", "target", F.col("features").alias("b"))
    return before.join(after, "doc_id").select("doc_id", "target", (F.col("a") == F.col("b")).cast("int").alias("same"))


@query("assemble_features", "SELECT series, CAST(date AS VARCHAR) AS date, 2 AS size FROM (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, lag(1) OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) AS l FROM orders GROUP BY 1, 2) WHERE l IS NOT NULL")
def assemble_features(spark, sf):
    rows = sr.roll(daily(spark, sf), "series", look_back=2, horizon=0, features=[])
    out = VectorAssembler(inputCols=["y_m1", "y"], outputCol="x", handleInvalid="skip").transform(rows)
    return out.select("series", F.col("date").cast("string").alias("date"), F.size(vector_to_array("x")).alias("size"))


@query("silhouette")
def silhouette(spark, sf):
    rows = vectors(spark, sf).select(array_to_vector("v").alias("features"), F.col("label").cast("int").alias("label"))
    return _score_row(spark, "embeddings", rows.count(), silhouette=ml.silhouette(rows, "features", "label"))


@query("node_embeddings")
def node_embeddings(spark, sf):
    parsed = cut_lineage(trees(spark, sf))
    walks = gr.random_walks(gr.integer_graph(gr.corpus_nodes(parsed, KEYS), gr.corpus_edges(parsed)))
    paths = walks.groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("step", "node"))).alias("p"))
    tokens = paths.select(F.col("p.node").cast("array<string>").alias("tokens"))
    vectors_of = ml.word_embeddings(tokens, "tokens", size=32, min_count=1)
    return vectors_of.select(F.col("word").cast("bigint").alias("node"), "vector")
