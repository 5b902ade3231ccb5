"""Blocked windows against plain windows."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from lexispark.plans.blocked import neighbours, row_numbers, running_sum
from lexispark.plans.skew import salted_join


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    # One key owns most rows; positions have gaps.
    data = [("hot" if rng.random() < 0.7 else rng.choice("abc"), p, rng.randint(0, 9)) for p in rng.sample(range(900), 400)]
    return spark.createDataFrame(data, "k string, p int, v int")


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_running_sum_and_neighbours(rows, width):
    block = F.floor(F.col("p") / width)
    w = W.partitionBy("k").orderBy("p")
    wanted = {"l1": ("v", 1), "l3": ("v", 3), "n2": ("p", -2)}
    got = running_sum(rows, ["k"], ["p"], block, F.col("v"), "total")
    got = neighbours(got, ["k"], ["p"], block, wanted)
    got = row_numbers(got, ["k"], ["p"], block, "rn")
    want = rows.select(
        "*",
        F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"),
        F.lag("v", 1).over(w).alias("l1"),
        F.lag("v", 3).over(w).alias("l3"),
        F.lead("p", 2).over(w).alias("n2"),
        F.row_number().over(w).alias("rn"),
    )
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_global_numbering(rows):
    got = row_numbers(rows.select("p"), [], ["p"], F.floor(F.col("p") / 50), "rn", start=0).orderBy("p").collect()
    assert [r.rn for r in got] == list(range(len(got)))


def test_salted_join_equals_plain_join(rows, spark):
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, d int")
    got = salted_join(rows, dim, "k", ["p"], "left").select("k", "p", "d").collect()
    want = rows.join(dim, "k", "left").select("k", "p", "d").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_null_keys_stay(spark):
    data = [(k, p, p % 5) for k in ("a", None) for p in range(40)]
    rows = spark.createDataFrame(data, "k string, p int, v int")
    block = F.floor(F.col("p") / 7)
    got = running_sum(rows, ["k"], ["p"], block, F.col("v"), "total")
    got = neighbours(got, ["k"], ["p"], block, {"before": ("v", 2), "after": ("v", -1)})
    w = W.partitionBy("k").orderBy("p")
    want = rows.select(
        "*",
        F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("total"),
        F.lag("v", 2).over(w).alias("before"),
        F.lead("v", 1).over(w).alias("after"),
    )
    key = lambda x: sorted(map(tuple, x.select(*want.columns).collect()), key=str)
    assert key(got) == key(want)


def test_salted_copies_are_not_gathered_on_the_driver(rows, spark, tmp_path):
    # A file far below the broadcast limit, copied sixteen times by the join.
    spark.range(20000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("d")).write.parquet(str(tmp_path / "dim"))
    joined = salted_join(rows, spark.read.parquet(str(tmp_path / "dim")), "k", ["p"], "left")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
