"""Ordered computations over keys of any size.

A plain ``Window.partitionBy(key)`` puts one key into one task. Here each key
is cut into blocks of its own ordering (``block`` must never decrease along
``order``); the window runs inside a block, and a table with one row per block
carries the state across. A null key is a key like any other.

``block`` is a column expression, or the name of a column to use and keep: two
steps that name the same one share its layout, so the rows are shuffled once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | str,
    value: Column,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    work, b, spare = _with_block(df, block)
    work = work.withColumn("__value", value)
    within = (
        W.partitionBy(*keys, b).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    earlier = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    bases = (
        work.groupBy(*keys, b)
        .agg(F.sum("__value").alias("__sum"))
        .select(*keys, b, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    )
    total = F.col("__base") + F.col("__within")
    if not inclusive:
        total = total - F.col("__value")
    out = work.withColumn("__within", F.sum("__value").over(within))
    return _joined(out, bases, [*keys, b]).withColumn(name, total).drop(*spare, "__value", "__within", "__base")


def _joined(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with the table of blocks in which null equals null."""
    other = blocks.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return rows.join(other, same).drop(*[f"__of_{k}" for k in keys])


def _with_block(df: DataFrame, block: Column | str) -> tuple[DataFrame, str, list[str]]:
    if isinstance(block, str):
        return df, block, []
    return df.withColumn("__block", block), "__block", ["__block"]


def row_numbers(
    df: DataFrame, keys: list[str], order: list[str], block: Column | str, name: str, start: int = 1
) -> DataFrame:
    """Dense numbering 'start, start+1, ...' along ``order`` inside ``keys``."""
    counted = running_sum(df, keys, order, block, F.lit(1).cast("bigint"), name)
    return counted.withColumn(name, F.col(name) + (start - 1))


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | str,
    wanted: dict[str, tuple[str, int]],
) -> DataFrame:
    """Add ``lag``-like columns: ``wanted[name] = (column, offset)``; offset > 0 looks back, < 0 ahead."""
    out, b, spare = _with_block(df, block)
    for ahead in (False, True):
        picks = {n: (c, abs(k)) for n, (c, k) in wanted.items() if (k < 0) == ahead}
        if picks:
            out = _shifted(out, keys, order, b, picks, ahead)
    return out.drop(*spare)


def _shifted(df, keys, order, b, picks, ahead):
    depth = max(k for _, k in picks.values())
    sources = sorted({c for c, _ in picks.values()})
    forward = [F.col(c).desc() if ahead else F.col(c).asc() for c in order]
    backward = [F.col(c).asc() if ahead else F.col(c).desc() for c in order]
    part = W.partitionBy(*keys, b)
    by_block = F.col(b).desc() if ahead else F.col(b).asc()

    # The last `depth` rows of every block, in reading order, then of the `depth` blocks before it.
    tails = (
        df.select(*keys, b, *dict.fromkeys([*order, *sources]))
        .withColumn("__from_end", F.row_number().over(part.orderBy(*backward)))
        .filter(F.col("__from_end") <= depth)
        .groupBy(*keys, b)
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.col("__from_end")).alias("__at"), *sources))
            ).alias("__tail")
        )
    )
    reach = W.partitionBy(*keys).orderBy(by_block).rowsBetween(-depth, -1)
    carried = tails.select(
        *keys, b, F.flatten(F.collect_list("__tail").over(reach)).alias("__carried")
    )
    local = part.orderBy(*forward)
    out = df.withColumn("__rn", F.row_number().over(local))
    for name, (source, k) in picks.items():
        out = out.withColumn(f"__in_{name}", F.lag(source, k).over(local))
    out = _joined(out, carried, [*keys, b])
    for name, (source, k) in picks.items():
        index = F.size("__carried") - 1 - (F.lit(k) - F.col("__rn"))
        out = out.withColumn(
            name,
            F.when(F.col("__rn") > k, F.col(f"__in_{name}")).otherwise(
                F.get("__carried", index)[source]
            ),
        )
    return out.drop("__rn", "__carried", *[f"__in_{n}" for n in picks])
