"""Dependency trees and corpus graphs.

A tree table has one row per sentence: key columns and the parallel arrays
``forms``, ``upos``, ``heads`` (1-based, 0 = root) and ``labels``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import Column, DataFrame, Observation, functions as F

from lexispark.functions.draws import draw
from lexispark.plans.blocked import row_numbers
from lexispark.plans.checkpoints import remove_scratch, scratch_path, shuffles_removed, stored, write_scratch
from lexispark.plans.numbering import number_rows


def tokens_of(trees: DataFrame, keys: list[str]) -> DataFrame:
    """One row per token: ``id, form, upos, head, label``.

    The arrays are read by number after the sentence is exploded: that is compiled, a lambda over them is interpreted.
    """
    return trees.select(*keys, "upos", "heads", "labels", F.posexplode("forms").alias("p", "form")).select(
        *keys,
        (F.col("p") + 1).alias("id"),
        "form",
        F.get("upos", "p").alias("upos"),
        F.get("heads", "p").alias("head"),
        F.get("labels", "p").alias("label"),
    )


def _node(form: Column, upos: Column) -> Column:
    return F.concat_ws(":", F.lower(form), upos)


def corpus_nodes(trees: DataFrame, keys: list[str]) -> DataFrame:
    """``node`` (`word:TAG`) with form and label of its first occurrence, and its frequency."""
    place = F.struct(*keys, "id", "form", "label")
    return (
        tokens_of(trees, keys)
        .groupBy(_node(F.col("form"), F.col("upos")).alias("node"))
        .agg(F.min(place).alias("f"), F.count("*").alias("n"))
        .select("node", F.col("f.form").alias("first_form"), F.col("f.label").alias("first_label"), "n")
    )


def corpus_edges(trees: DataFrame) -> DataFrame:
    """Distinct ``src`` (head), ``dst`` (dependent), ``label``; heads are looked up inside the row."""

    at = F.get("heads", "p") - 1
    arcs = trees.select("forms", "upos", "heads", "labels", F.posexplode("forms").alias("p", "form"))
    return (
        arcs.filter(F.get("heads", "p") > 0)
        .select(
            _node(F.get("forms", at), F.get("upos", at)).alias("src"),
            _node(F.col("form"), F.get("upos", "p")).alias("dst"),
            F.get("labels", "p").alias("label"),
        )
        .distinct()
    )


def _spell_arcs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, upos, labels = (batch[c].flatten() for c in ("forms", "upos", "labels"))
        begins, heads = _begins(batch["forms"]), batch["heads"].flatten().to_numpy()
        base = np.repeat(begins[:-1], np.diff(begins))
        at = pa.array(base + heads - 1, mask=heads == 0)
        number = lambda n: pa.array(n).cast(pa.string())
        join = lambda *parts: compute.binary_join_element_wise(*parts, "")
        governor = join(number(heads), "-", forms.take(at), ":", upos.take(at))
        own = join(number(np.arange(1, len(forms) + 1) - base), "-", forms, ":", upos)
        arcs = join(labels, "(", compute.fill_null(governor, "0-ROOT"), ",", own, ")")
        text = compute.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), arcs), " ")
        yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), text], [*keys, "arcs"])


def readable_arcs(trees: DataFrame, keys: list[str]) -> DataFrame:
    """``label(head-word:TAG,id-word:TAG)`` per sentence, one arc after another; spelt in Arrow, a batch of sentences at a time."""
    rows = trees.select(*keys, "forms", "upos", "heads", "labels")
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(partial(_spell_arcs, keys=keys), f"{schema}, arcs string")


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """Distinct dependents of one head."""
    return edges.filter(F.col("src") == node).select("dst").distinct()


def collapse(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst), whatever its labels."""
    return edges.select("src", "dst").distinct()


def in_degree(nodes: DataFrame, edges: DataFrame, n_nodes: int) -> DataFrame:
    """In-degree of the collapsed graph over ``n_nodes - 1``."""
    counts = collapse(edges).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("c"))
    return nodes.select("node").join(counts, "node", "left").select(
        "node", (F.coalesce("c", F.lit(0)) / (n_nodes - 1)).alias("centrality")
    )


#: Out-edges of a node that are kept together; those of a hub are cut into so many pieces.
PIECE_EDGES = 100_000


class _Rounds:
    """The collapsed edges in a bucketed table and the state of the nodes, for iterations that send along edges.

    Edges lie in buckets by (source, piece), where the pieces of a node's
    out-edges are drawn by target: a hub's edges are in many buckets. A round
    sends the messages to the buckets, adds up what arrives by target, and meets
    the old state in the same aggregate; the edges stay where they are.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.spark = nodes.sparkSession
        self.names = stored(integer_ids(nodes, "node"), "graph-names")
        flat = _numbered_edges(edges, self.names)
        degree = flat.groupBy("src_id").agg(F.count("*").alias("out")).withColumn(
            "pieces", F.ceil(F.col("out") / PIECE_EDGES).cast("int")
        )
        piece = F.pmod(F.xxhash64("dst_id"), F.col("pieces")).cast("int")
        placed = flat.join(degree, "src_id").select("src_id", piece.alias("piece"), "dst_id")
        self.table = f"edges_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # One task a bucket writes one file of it.
        with shuffles_removed(self.spark):
            placed.repartition(buckets, "src_id", "piece").write.bucketBy(buckets, "src_id", "piece").sortBy(
                "src_id", "piece"
            ).option("path", scratch_path(self.spark, "graph-edges")).option("compression", "zstd").saveAsTable(self.table)
        known = self.names.select("id").join(degree.withColumnRenamed("src_id", "id"), "id", "left")
        self.state = stored(
            known.select("id", F.coalesce("out", F.lit(0)).alias("out"), F.coalesce("pieces", F.lit(0)).alias("pieces")), "graph-state"
        )
        self.n = self.state.count()
        self.held: str | None = None

    def received(self, state: DataFrame, message: Column, kept: list[str]) -> DataFrame:
        """``id``, ``out``, ``pieces``, the columns ``kept`` and ``m``, the sum of what came in (0 if nothing)."""
        piece = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
        sent = state.filter("pieces > 0").select(F.col("id").alias("src_id"), message.alias("m"), piece)
        old = ["out", "pieces", *kept]
        types = {c: state.schema[c].dataType for c in old}
        came = self.spark.table(self.table).join(sent, ["src_id", "piece"]).select(
            F.col("dst_id").alias("id"), "m", *[F.lit(None).cast(types[c]).alias(c) for c in old]
        )
        here = state.select("id", F.lit(None).cast("double").alias("m"), *old)
        return came.union(here).groupBy("id").agg(
            F.coalesce(F.sum("m"), F.lit(0.0)).alias("m"), *[F.max(c).alias(c) for c in old]
        )

    def keep(self, state: DataFrame, *totals: Column) -> tuple[DataFrame, dict]:
        """Write the state of a round and return it with its totals: one job. The state before goes, and all shuffle files."""
        if not self.n:
            return state, {}
        told = Observation()
        path = write_scratch(state.observe(told, *totals), "graph-round")
        self._forget(path)
        return self.spark.read.schema(state.schema).parquet(path), told.get

    def _forget(self, path: str | None) -> None:
        if self.held is not None:
            remove_scratch(self.spark, self.held)
        self.held = path

    def close(self, state: DataFrame) -> DataFrame:
        """The nodes by name with the last state, which needs neither the table nor the kept rounds any more."""
        last = stored(state, "graph-last")
        self._forget(None)
        self.spark.sql(f"DROP TABLE {self.table}")
        return self.names.join(last, "id")


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    iterations: int = 100,
    damping: float = 0.85,
    tolerance: float | None = 1e-6,
    scaled: bool = False,
) -> DataFrame:
    """``node, rank``; the rank of nodes without out-edges spreads evenly.

    Rounds end when ranks move by less than ``tolerance`` per node in all. Ranks
    sum to 1, or to the number of nodes if ``scaled``. One row of totals a round
    comes to the driver: how far ranks moved, and what the next round will send.
    """
    rounds = _Rounds(nodes, edges)
    n = rounds.n
    moved = F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved")
    sends = F.sum(F.when(F.col("out") > 0, F.col("rank")).otherwise(0.0)).alias("sends")
    start = rounds.state.withColumn("rank", F.lit(1.0 / max(n, 1))).withColumn("old", F.lit(0.0))
    state, told = rounds.keep(start, moved, sends)
    for _ in range(iterations if n else 0):
        even = (1.0 - damping * told["sends"]) / n
        got = rounds.received(state, F.col("rank") / F.col("out"), ["rank"])
        fresh = got.select(
            "id", "out", "pieces", (F.col("m") * damping + even).alias("rank"), F.col("rank").alias("old")
        )
        state, told = rounds.keep(fresh, moved, sends)
        if tolerance is not None and told["moved"] < n * tolerance:
            break
    out = rounds.close(state)
    return out.select("node", (F.col("rank") * n if scaled else F.col("rank")).alias("rank"))


def eigenvector_centrality(
    nodes: DataFrame, edges: DataFrame, iterations: int = 100, tolerance: float | None = 1e-6
) -> DataFrame:
    """``node, centrality``: power iteration over incoming edges, scaled to length 1 in every round.

    How far a round moved is known once its length is, so it comes with the totals of the next round.
    """
    rounds = _Rounds(nodes, edges)
    n = rounds.n
    length = F.sum(F.col("y") * F.col("y")).alias("length")
    moved = F.sum(F.abs(F.col("x") - F.col("old"))).alias("moved")
    state = rounds.state.select("id", "out", "pieces", F.lit(1.0 / max(n, 1)).alias("x"))
    for k in range(iterations + 1 if n else 0):
        # x is the scaled vector after k rounds, y the next one before it is scaled.
        kept = ["x"] if k == 0 else ["x", "old"]
        got = rounds.received(state, F.col("x"), kept)
        old = F.lit(None).cast("double") if k == 0 else F.col("old")
        fresh = got.select("id", "out", "pieces", (F.col("x") + F.col("m")).alias("y"), "x", old.alias("old"))
        state, told = rounds.keep(fresh, length, moved)
        if k == iterations or (k and tolerance is not None and told["moved"] < n * tolerance):
            break
        norm = told["length"] ** 0.5 or 1.0
        state = state.select("id", "out", "pieces", (F.col("y") / norm).alias("x"), F.col("x").alias("old"))
    return rounds.close(state.select("id", "x")).select("node", F.col("x").alias("centrality"))


def integer_ids(names: DataFrame, name: str, id_name: str = "id") -> DataFrame:
    """Dense ids from 0 in digest order, numbered by ranges of digests."""
    keyed = names.select(name).distinct().withColumn("__h", F.md5(name))
    return number_rows(keyed, [], ["__h", name], id_name, start=0).drop("__h")


def integer_labels(nodes: DataFrame, label: str = "first_label") -> tuple[DataFrame, DataFrame]:
    """Labels of nodes as numbers: (``id``, ``label_id`` of every node; ``label``, ``label_id`` of the dictionary).

    Nodes and labels are numbered alike, by ``integer_ids``. A node without label has none (null).
    """
    ids = integer_ids(nodes, "node")
    labels = integer_ids(nodes.select(F.col(label).alias("label")).filter("label IS NOT NULL"), "label", "label_id")
    # A label stands for very many nodes; adaptive execution broadcasts the dictionary, which is as small as the label set.
    told = nodes.select("node", F.col(label).alias("label")).join(labels, "label", "left")
    return told.join(ids, "node").select("id", "label_id"), labels


def integer_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``src_id, dst_id``: the collapsed edge list in node numbers."""
    return _numbered_edges(edges, stored(integer_ids(nodes, "node"), "graph-names"))


def _numbered_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The collapsed edges in numbers. Every shuffle is written out before the next one, so that one is on disk at a time."""
    rows, path = edges, None
    for step in ("collapsed", "src", "dst"):
        if step == "collapsed":
            rows = collapse(rows)
        else:
            rows = rows.join(names.select(F.col("node").alias(step), F.col("id").alias(f"{step}_id")), step).drop(step)
        done, path = path, write_scratch(rows, f"graph-{step}")
        rows = edges.sparkSession.read.schema(rows.schema).parquet(path)
        if done:
            remove_scratch(edges.sparkSession, done)
    return rows.select("src_id", "dst_id")


def merge_node_features(tables: dict[str, DataFrame]) -> DataFrame:
    """Several (node, value) tables as one row per node; a missing value is 0."""
    names = list(tables)
    tagged = None
    for name, df in tables.items():
        part = df.toDF("node", "value").select("node", F.lit(name).alias("feature"), F.col("value").cast("double").alias("value"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("node").agg(
        *[F.coalesce(F.max(F.when(F.col("feature") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in names]
    )


def random_walks(edges_by_id: DataFrame, walks: int = 10, steps: int = 20, seed: int = 3) -> DataFrame:
    """``walk_id, step, node``: from every node with an out-edge, ``walks`` walks of at most ``steps`` nodes.

    The out-edges of a node are numbered, not gathered: a walker draws a number
    and meets that one edge by an equi-join, so a node with a billion edges
    spreads like any other. The walker carries the out-degree of its place. The
    edges are stored once and wait in buckets; what a step shuffles goes with it.
    """
    spark = edges_by_id.sparkSession
    edges_by_id = stored(edges_by_id, "walk-edges")
    digit = F.floor(F.col("dst_id") / 4096)
    numbered = row_numbers(edges_by_id, ["src_id"], ["dst_id"], digit, "k", start=0)
    degree = edges_by_id.groupBy("src_id").agg(F.count("*").alias("degree"))
    target = degree.select(F.col("src_id").alias("dst_id"), F.col("degree").alias("next_degree"))
    hops = numbered.join(target, "dst_id", "left").select("src_id", "k", "dst_id", F.coalesce("next_degree", F.lit(0)).alias("next_degree"))
    table = f"hops_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Edges lie in the buckets that a step deals its walkers out to: only walkers move.
    with shuffles_removed(spark):
        hops.repartition(buckets, "src_id", "k").write.bucketBy(buckets, "src_id", "k").sortBy("src_id", "k").option(
            "path", scratch_path(spark, "walk-hops")
        ).option("compression", "zstd").saveAsTable(table)
    at = degree.select(
        F.explode(F.sequence(F.col("src_id") * walks, F.col("src_id") * walks + walks - 1)).alias("walk_id"),
        F.col("src_id").alias("node"),
        "degree",
    )
    at = stored(at, "walk-step")
    path = at.select("walk_id", F.lit(0).alias("step"), "node")
    for step in range(1, steps):
        moving = at.filter("degree > 0").withColumn("k", draw(seed, F.col("walk_id"), F.lit(step)) % F.col("degree"))
        moved = moving.withColumnRenamed("node", "src_id").drop("degree").join(spark.table(table), ["src_id", "k"])
        at = stored(
            moved.select("walk_id", F.col("dst_id").alias("node"), F.col("next_degree").alias("degree")).sortWithinPartitions("walk_id"),
            "walk-step",
        )
        path = path.unionByName(at.select("walk_id", F.lit(step).alias("step"), "node"))
    spark.sql(f"DROP TABLE {table}")
    return path


def head_offsets(trees: DataFrame, keys: list[str], with_label: bool = False) -> DataFrame:
    """Relative head position per token: 0 for the root, 1 when out of range."""

    def offset(h, i):
        d = h - (i + 1)
        value = F.when(h == 0, 0).when(F.abs(d) > F.size("heads") + 1, 1).otherwise(d).cast("string")
        return F.concat_ws(":", value, F.get("labels", i)) if with_label else value

    return trees.select(*keys, F.transform("forms", F.lower).alias("words"), "upos", "labels", F.transform("heads", offset).alias("offsets"))


def split_at_root(trees: DataFrame, keys: list[str], max_len: int, min_len: int = 5) -> DataFrame:
    """Over-long sentences become two parts at the root token, which both share; parts still too long go.

    Head ids stay as they are. Lengths count the artificial root token.
    """
    n = F.size("forms") + 1
    root = F.array_position("heads", F.lit(0)).cast("int")
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(1).alias("first"), F.size("forms").alias("last")))
    halves = F.array(
        F.struct(F.lit(1).alias("part"), F.lit(1).alias("first"), root.alias("last")),
        F.struct(F.lit(2).alias("part"), root.alias("first"), F.size("forms").alias("last")),
    )
    pieces = F.filter(F.when(n <= max_len, whole).otherwise(halves), lambda p: p["last"] - p["first"] + 2 <= max_len)
    cut = lambda c: F.slice(c, F.col("s.first"), F.col("s.last") - F.col("s.first") + 1).alias(c)
    return (
        trees.filter(n >= min_len)
        .withColumn("s", F.explode(pieces))
        .select(*keys, F.col("s.part").alias("part"), *[cut(c) for c in ("forms", "upos", "heads", "labels")])
    )


def _begins(lists: pa.Array) -> np.ndarray:
    """Where the elements of each row begin, and the last one's end, among those of all rows."""
    lengths = compute.fill_null(compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _without_crossings(lists: pa.Array) -> pa.Array:
    begins = _begins(lists)
    n = np.diff(begins)
    row = np.repeat(np.arange(len(n)), n)
    own = np.arange(1, len(row) + 1) - begins[row]
    # A token without head hangs on itself.
    heads = lists.flatten().to_numpy(zero_copy_only=False)
    heads = np.where(np.isnan(heads), own, heads).astype(np.int64) if heads.dtype.kind == "f" else heads.astype(np.int64)
    # Every row has places 0, 1, ... up to its last token or head.
    last = n.copy()
    np.maximum.at(last, row, heads)
    first = np.concatenate([[0], np.cumsum(last + 1)])
    left, right = first[row] + np.minimum(heads, own), first[row] + np.maximum(heads, own)
    # The farthest places that arcs from a place reach, then from 2, 4, 8, ... places in a row.
    lo, hi = np.arange(first[-1]), np.arange(first[-1])
    np.minimum.at(lo, right, left)
    np.maximum.at(hi, left, right)
    ok = np.ones(len(n), bool)
    inner = np.maximum(right - left - 1, 0)
    width = 1
    while (inner >= width).any():
        some = np.flatnonzero((inner >= width) & (inner < 2 * width))
        a, b = left[some] + 1, right[some] - width
        crossed = (np.minimum(lo[a], lo[b]) < left[some]) | (np.maximum(hi[a], hi[b]) > right[some])
        ok[row[some[crossed]]] = False
        lo, hi = np.minimum(lo[:-width], lo[width:]), np.maximum(hi[:-width], hi[width:])
        width *= 2
    return pa.array(ok, mask=lists.is_null().to_numpy(zero_copy_only=False))


def is_projective(heads: Column) -> Column:
    """True when no two arcs cross, the root arc included.

    An arc is crossed when a place inside it is joined to one outside. What the
    places inside reach is looked up in ranges of 1, 2, 4, ... places, for a
    batch of sentences at a time, in Arrow.
    """
    return F.arrow_udf(_without_crossings, "boolean")(heads)


def attachment_scores(gold: DataFrame, pred: DataFrame, keys: list[str], skip_punct: bool = True) -> DataFrame:
    """Unlabelled and labelled attachment of predicted trees, compared token by token."""
    other = pred.select(*keys, F.col("heads").alias("p_heads"), F.col("labels").alias("p_labels"))

    same = F.get("heads", "p") == F.get("p_heads", "p")
    both = gold.join(other, keys).select("heads", "labels", "p_heads", "p_labels", F.posexplode("upos").alias("p", "upos"))
    rows = both.select(
        "upos", same.alias("head_ok"), (same & (F.get("labels", "p") == F.get("p_labels", "p"))).alias("both_ok")
    )
    if skip_punct:
        rows = rows.filter(F.col("upos") != "PUNCT")
    return rows.agg(
        F.count("*").alias("tokens"), F.avg(F.col("head_ok").cast("int")).alias("uas"), F.avg(F.col("both_ok").cast("int")).alias("las")
    )
