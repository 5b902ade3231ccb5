"""Regression and joint scores, tokenization job and node labels on small rows."""

import math

from pyspark.sql import functions as F

from lexispark.operators import graph as gr, metrics as mt
from lexispark.plans.checkpoints import scratch_path
from lexispark.sources import files


def test_regression_scores(spark):
    rows = [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", 5.0, 4.0), ("a", None, 1.0), ("a", 1.0, None), ("b", 2.0, 1.0), ("b", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, y double, p double")
    got = {r.k: r for r in mt.regression_scores(df, "y", "p", ["k"]).collect()}
    a = got["a"]
    assert (a.n, a.mae, a.mse) == (3, 2 / 3, 2 / 3) and abs(a.rmse - math.sqrt(2 / 3)) < 1e-12 and abs(a.r2 - 0.75) < 1e-12
    assert got["b"].n == 2 and got["b"].r2 is None
    far = spark.createDataFrame([(1e9 + i, 1e9 + i + 0.5) for i in range(100)], "y double, p double")
    assert abs(mt.regression_scores(far, "y", "p").first().r2 - (1 - 0.25 / (9999 / 12))) < 1e-9
    assert mt.regression_scores(df.limit(0), "y", "p").first().n == 0


def test_joint_scores(spark):
    rows = [
        ([3, 2, 0, 7, 8, 0], [3, 2, 0, 7, 9, 0]), ([1, 5], [1]), ([4, 6], [4, 6]), ([], []), (None, [1, 1]), ([2, 2], None),
    ]
    got = mt.joint_scores(spark.createDataFrame(rows, "g array<int>, p array<int>"), "g", "p").first()
    assert (got.tokens, got.joint) == (5, 2 / 5)


def test_tokenization_job(spark):
    out = scratch_path(spark, "tokens")
    df = spark.createDataFrame([(1, "One two.  Three\nfour? Five"), (2, None), (3, "")], "id long, text string")
    for _ in range(2):  # a second run replaces the first
        files.tokenize_to_json(df, out, keep=["id"], files=2)
    got = {r.id: r.tokens for r in files.read_jsonl(spark, out, "id long, tokens string").collect()}
    assert got == {1: "One two.\nThree four?\nFive", 2: None, 3: ""}


def test_node_labels(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x"), ("d", None)], "node string, first_label string")
    told, labels = gr.integer_labels(nodes)
    assert sorted(r.label_id for r in labels.collect()) == [0, 1] and told.count() == 4
    joined = told.join(labels, "label_id", "left").groupBy("label").agg(F.count("*").alias("n")).collect()
    assert {r.label: r.n for r in joined} == {"x": 2, "y": 1, None: 1}
