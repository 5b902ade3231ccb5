"""Dense numbering of rows in two levels: ranges of the order, then places in a range.

Rows are laid out by ranges of (keys, order), whose bounds Spark samples, and
written once with the number of their range and their place in it. One row per
range and key then says where the range begins, so no key, however large, is
numbered in one task, and the only ordered table has as many rows as there are
ranges (plus one for each key).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexispark.plans.checkpoints import stored


def number_rows(
    df: DataFrame, keys: list[str], order: list[str | Column], name: str, start: int = 1, total: str | None = None
) -> DataFrame:
    """Add ``name``: start, start + 1, ... along ``order`` inside ``keys``; ``total``, if named, counts the key's rows.

    Null keys are keys like any other and nulls come first in the order. Rows that
    ``order`` leaves equal get numbers in any order among them, which stay as they
    are once written. The rows are written to the shared scratch folder.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    laid = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = stored(laid.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__range", F.shiftright("__at", 33))
    counts = rows.groupBy(*keys, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    key = W.partitionBy(*keys)
    before = F.sum("__n").over(key.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select(
        *[F.col(k).alias(f"__of_{k}") for k in keys],
        F.col("__range").alias("__of"),
        (F.coalesce(before, F.lit(0)) - F.col("__first") + start).alias("__shift"),
        F.sum("__n").over(key).alias("__total"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] + [F.col("__range") == F.col("__of")]
    placed = rows.join(bases, reduce(and_, same)).withColumn(name, F.col("__at") + F.col("__shift"))
    if total is not None:
        placed = placed.withColumn(total, F.col("__total"))
    return placed.drop("__at", "__range", "__of", "__shift", "__total", *[f"__of_{k}" for k in keys])
