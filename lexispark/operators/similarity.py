"""Nearest rows for a set of query vectors, block by block."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Groups in which the candidates of a query are merged first.
MERGE_PARTS = 64


def _usable(v: Column) -> Column:
    """Vectors that have a direction: not null, no null inside, not zero."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def topk_for_queries(
    queries: DataFrame,
    rows: DataFrame,
    key: str,
    vector: str,
    k: int,
    digits: int = 6,
    query_block: int = 2048,
    row_block: int = 8192,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``key``, ``similarity``: for every query the ``k`` rows of greatest cosine.

    Queries and rows are dealt into blocks by a hash of their key. Each pair of
    blocks is one product of two matrices of bounded size, of which only ``k`` rows
    a query leave the task; these are merged by query. No pair of single rows is
    ever a row of a table. Block sizes set memory (about ``8 * query_block *
    row_block`` bytes a task) and how often vectors are sent: rows once for each
    query block, queries once for each row block.

    Similarities are rounded before they are compared, ties go to the smaller key.
    A query that is among the rows finds itself. Null vectors, zero vectors and
    those with a null or NaN inside are neither asked for nor found; a query
    without any row has no result. Rows that repeat a key are found each.
    """
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q")).filter(_usable(F.col("q")))
    held = rows.select(F.col(key).alias("row_id"), F.col(vector).alias("v")).filter(_usable(F.col("v")))
    n_q, n_r = max(1, ceil(asked.count() / query_block)), max(1, ceil(held.count() / row_block))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int, of: str) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(of), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        )

    a = dealt(asked, "qb", n_q, "rb", n_r, "query_id").groupBy("qb", "rb")
    b = dealt(held, "rb", n_r, "qb", n_q, "row_id").groupBy("qb", "rb")

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query_id": [], "row_id": [], "similarity": []})
        r = r.sort_values("row_id", kind="stable")
        ids = r["row_id"].to_numpy()
        # Adding zero makes a negative zero positive.
        found = np.round(_unit_rows(q["q"]) @ _unit_rows(r["v"]).T, digits) + 0.0
        take = min(k, len(ids))
        least = np.partition(found, len(ids) - take, axis=1)[:, len(ids) - take]
        out_q, out_r, out_s = [], [], []
        for query, line, low in zip(q["query_id"].to_numpy(), found, least, strict=True):
            near = np.flatnonzero(line >= low)  # in order of ids
            near = near[np.argsort(-line[near], kind="stable")[:take]]
            out_q.append(np.full(take, query))
            out_r.append(ids[near])
            out_s.append(line[near])
        return pd.DataFrame(
            {"query_id": np.concatenate(out_q), "row_id": np.concatenate(out_r), "similarity": np.concatenate(out_s)}
        )

    id_type, q_type = held.schema["row_id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    partial = a.cogroup(b).applyInPandas(best, f"query_id {q_type}, row_id {id_type}, similarity double")
    entry = F.struct((-F.col("similarity")).alias("s"), F.col("row_id").alias("r"))

    def merged(df: DataFrame, item: Column, *by: Column | str) -> DataFrame:
        return df.groupBy("query_id", *by).agg(F.slice(F.sort_array(F.collect_list(item)), 1, k).alias("top"))

    # Merged in two steps, so that a query's candidates from very many blocks do not meet in one row.
    first = merged(partial, entry, F.pmod(F.xxhash64("row_id"), F.lit(MERGE_PARTS)).alias("part"))
    ranked = merged(first.select("query_id", F.explode("top").alias("e")), F.col("e"))
    return ranked.select("query_id", F.posexplode("top").alias("p", "t")).select(
        "query_id", (F.col("p") + 1).alias("rank"), F.col("t.r").alias(key), (-F.col("t.s")).alias("similarity")
    )
