"""Dense numbering over ranges against a sort in Python."""

import random

from pyspark.sql import functions as F

from lexispark.plans.numbering import number_rows


def test_numbers_are_dense_by_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.choice([None, *range(2000)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(7)
    got = number_rows(df, ["k"], ["v", "i"], "no", total="n").collect()
    want = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(r[0], []).append(r)
    assert sorted((str(r.k), r.no, r.v, r.i, r.n) for r in got) == sorted(
        (str(k), no, v, i, len(x)) for k, x in want.items() for no, (_, v, i) in enumerate(x, 1)
    )


def test_without_keys_and_rows(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.hash("id"), F.lit(50)))
    got = number_rows(df, [], [F.col("v").desc(), "id"], "no", start=0).orderBy("no").collect()
    assert [r.no for r in got] == list(range(1000))
    assert [(-r.v, r.id) for r in got] == sorted((-r.v, r.id) for r in got)
    assert number_rows(df.limit(0), [], ["v"], "no").count() == 0
