"""Nearest rows of a query set against a plain loop."""

import math
import random

import pytest

from lexispark.operators.similarity import topk_for_queries


def brute(queries, rows, k):
    usable = lambda v: v and None not in v and any(v)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    out = []
    for q, a in queries:
        if usable(a):
            told = [(-round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 6) + 0.0, r) for r, b in rows if usable(b)]
            out += [(q, i, r, -s + 0.0) for i, (s, r) in enumerate(sorted(told)[:k], 1)]
    return out


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 7)], ids=["one block", "many blocks"])
def test_nearest_equal_brute_force(spark, blocks):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]) for i in range(120)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, rows[5][1]), (203, rows[5][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.filter("id % 10 = 0 OR id > 199")
    got = topk_for_queries(asked, df, "id", "v", 6, query_block=blocks[0], row_block=blocks[1])
    assert got.columns == ["query_id", "rank", "id", "similarity"]
    want = brute([r for r in rows if (r[0] % 10 == 0 or r[0] > 199) and r[0] != 203], rows, 6)
    assert sorted(map(tuple, got.filter("query_id <> 203").collect())) == sorted(want)
    assert topk_for_queries(asked.limit(0), df, "id", "v", 6).count() == 0
    assert topk_for_queries(asked, df.limit(0), "id", "v", 6).count() == 0


def test_no_window_and_no_pair_table(spark):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "id long, v array<double>")
    got = topk_for_queries(df, df, "id", "v", 3, query_block=10, row_block=10)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
