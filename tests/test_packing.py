import random

import pytest
from pyspark.sql import functions as F

from lexispark.functions import draws
from lexispark.operators import packing


@pytest.mark.parametrize("drop_last", [True, False])
def test_packing_against_a_buffer(spark, drop_last):
    rng = random.Random(2)
    docs = [(d, [rng.randint(5, 99) for _ in range(rng.choice([0, 1, 3, 50]))]) for d in range(0, 120, 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, ids array<bigint>")
    got = packing.pack_sequences(df, 8, F.pmod("doc_id", F.lit(2)), drop_last, docs_per_block=5)
    got = {(r.shard, r.seq_no): r.input_ids for r in got.collect()}
    want = {}
    for shard in (0, 1):
        stream = [t for d, ids in docs if d % 2 == shard for t in ids]
        for k in range(0, len(stream), 8):
            body = stream[k : k + 8]
            if len(body) == 8 or not drop_last:
                want[shard, k // 8] = [2, *body, *[0] * (8 - len(body)), 3]
    assert got == want


def test_mask_ratios(spark):
    rows = spark.range(200).select(F.col("id").alias("seq"), packing.with_specials(F.array_repeat(F.lit(7).cast("bigint"), 250)).alias("input_ids"))
    out = packing.mask_tokens(rows, ["seq"], vocab_size=1000).cache()
    pairs = out.select(F.explode(F.arrays_zip("input_ids", "masked_ids", "labels")).alias("x")).select("x.*").cache()
    normal = pairs.filter("input_ids NOT IN (2, 3)")
    chosen = normal.filter("labels <> -100").cache()
    n, m = normal.count(), chosen.count()
    assert abs(m / n - 0.15) < 0.01
    assert abs(chosen.filter("masked_ids = 4").count() / m - 0.8) < 0.02
    assert abs(chosen.filter("masked_ids = 7").count() / m - 0.1) < 0.02
    assert pairs.filter("input_ids IN (2, 3) AND labels <> -100").count() == 0
    assert normal.filter("masked_ids IN (0, 2, 3)").count() == 0
    assert out.filter(F.size("masked_ids") != 252).count() == 0


def test_keep_labels_share(spark):
    kept = spark.range(100).select(packing.keep_labels(F.array_repeat(F.lit(5), 100), [F.col("id")], 0.3).alias("x"))
    n = kept.select(F.explode("x").alias("x")).filter("x = 5").count()
    assert 2800 < n < 3200


def test_draws_along_an_array_are_the_draws(spark):
    rows = spark.createDataFrame([(3, 5, list(range(40))), (-1, 2**40, [9]), (0, 0, [])], "a bigint, b bigint, xs array<bigint>")
    seeds = F.array(draws.draw_state(7, F.col("a"), F.col("b")))
    out = rows.select(
        F.transform(seeds, lambda s: draws.draws_along(F.col("xs"), s))[0].alias("along"),
        F.transform(seeds, lambda s: F.transform("xs", lambda x, i: draws.draw_from(s, i)))[0].alias("single"),
        F.transform("xs", lambda x, i: draws.draw(7, F.col("a"), F.col("b"), i)).alias("want"),
    )
    assert all(r.along == r.want == r.single for r in out.collect())


def test_masks_work_out_what_a_sequence_shares_once(spark):
    rows = spark.createDataFrame([(1, 2, [2, 7, 8, 3])], "a bigint, b bigint, input_ids array<bigint>")
    plan = packing.mask_tokens(rows, ["a", "b"], 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("48271") < 45
