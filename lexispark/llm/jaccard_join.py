"""N-gram Jaccard join, size-aware: fixed-size subsets for light sets, inverted lists for heavy ones.

Two sets of sizes r and s link when 100 * common >= 90 * union, that is, when
they differ in at most (r + s) / 19 elements.

* **Classes.** Texts with the same set are one class, named by the digest of the
  set. Only classes are compared.
* **Light sets** (size up to a boundary): any two that link share two of the
  first size/10 + 2 elements in an order that all sets have in common, so every
  pair out of these is a key.
* **Heavy sets**: the elements are dealt into more parts than two sets that link
  can differ in, so some part is the same in both. The lists of sets with equal
  parts are the inverted lists; single elements would give lists as long as the
  corpus.
* **Boundary**: the size with the fewest keys over the histogram of sizes. Sets
  just below it have keys of both kinds, so no link crosses it unseen.
* **Groups of a key** are never paired out. Every member is compared with one
  member, the pivot: the one that meets most others over all of its keys, as a
  rule the text that the others were copied from. Two members of which one isn't
  linked to the pivot can only link if they differ from the pivot in common
  elements. These differences are short, and the elements that few members of
  the group differ in come first, so a prefix join over them finds the pairs
  that are left. Each is checked in full.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.components import components
from lexispark.llm.registry import query, table
from lexispark.plans.checkpoints import cut_lineage

SHINGLE = 3
#: Sizes of a class of heavy sets grow by this ratio; over 10/9, so links reach the next class at most.
RATIO = 1.3
#: Largest boundary that is considered, so the histogram for it has at most so many rows.
MOST_LIGHT = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words between blanks; fewer words make one."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.zeros(0, "<u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", n)
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            x = np.uint64(n)
            for w in h:
                x = _mix(np.array([x * np.uint64(31) + w]))[0]
            return np.array([x], "<u8")
        x = h[: n - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            x = _mix(x) * np.uint64(0x9E3779B97F4A7C15) + h[k : n - SHINGLE + 1 + k]
    return np.unique(_mix(x))


def set_digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def most_different(r: int, s: int) -> int:
    """Elements in which linked sets of these sizes can differ at most."""
    return (r + s) // 19


def class_bounds(n: int) -> tuple[int, int, int]:
    """Number, first and last size of the class of heavy sets that a size belongs to."""
    k, low = 0, 9
    while True:
        high = int(low * RATIO)
        if n <= high:
            return k, low, high
        k, low = k + 1, high + 1


def _parts_of(high: int) -> tuple[int, int]:
    """Differences allowed in a class and its number of parts: some more than enough, as parts may be empty."""
    d = most_different(high, high)
    return d, d + 3 + d // 50


def heavy_keys(tokens: np.ndarray) -> np.ndarray:
    n, out = len(tokens), []
    k, _, high = class_bounds(n)
    classes = [(k, high)]
    if n * 10 // 9 > high:
        classes.append((k + 1, int((high + 1) * RATIO)))
    for number, top in classes:
        d, m = _parts_of(top)
        part = (_mix(tokens ^ np.uint64(number + 1)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        used, begin = np.unique(part[order], return_index=True)
        with np.errstate(over="ignore"):
            body = np.add.reduceat(_mix(tokens[order]), begin)
            if m - len(used) >= m - d:  # so many parts are empty that only these may agree
                empty = np.setdiff1d(np.arange(m), used)
                used, body = np.append(used, empty), np.append(body, np.zeros(len(empty), "<u8"))
            out.append(_mix(body * np.uint64(31) + _mix(used.astype("<u8") * np.uint64(65_537) + np.uint64(number))))
    return np.concatenate(out)


def light_keys(tokens: np.ndarray) -> np.ndarray:
    """Pairs out of the first size/10 + 2 elements; sets below nine elements link with equal sets only."""
    if len(tokens) < 9:
        return np.zeros(0, "<u8")
    prefix = tokens[: len(tokens) // 10 + 2]
    i, j = np.triu_indices(len(prefix), 1)
    with np.errstate(over="ignore"):
        return _mix(_mix(prefix[i]) * np.uint64(31) + prefix[j] + np.uint64(7))


def key_counts(n: int) -> tuple[int, int]:
    """Keys of a set of this size if it is light, and if it is heavy."""
    if n < 9:
        return 0, 0
    k, _, high = class_bounds(n)
    heavy = _parts_of(high)[1]
    if n * 10 // 9 > high:
        heavy += _parts_of(int((high + 1) * RATIO))[1]
    return comb(n // 10 + 2, 2), heavy


def choose_boundary(histogram: dict[int, int]) -> int:
    """Largest size of light sets that makes the fewest keys in all; ties go to the smaller."""
    cost = {}
    for x in range(8, MOST_LIGHT + 1):
        if x > 8 and x not in histogram:
            continue
        cost[x] = sum(
            c * ((key_counts(n)[0] if n <= x else 0) + (key_counts(n)[1] if n * 10 > 9 * x else 0))
            for n, c in histogram.items()
        )
        if len(cost) > 60 and cost[x] > 2 * min(cost.values()):
            break
    return min(cost, key=lambda x: (cost[x], x))


def set_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``digest`` of every row."""
    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(set_digest, sets), pa.binary())],
                names=["doc_id", "n", "digest"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary")


def set_keys(docs: DataFrame, boundary: int, text: str = "text") -> DataFrame:
    """``key``, ``c`` (the first half of the set's digest) of every set, once per task."""
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keys, owner = [], []
            for t in batch.column(0).to_pylist():
                tokens = shingles(t)
                digest = set_digest(tokens)
                if digest in seen or len(tokens) < 9:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(digest)
                own = []
                if len(tokens) <= boundary:
                    own.append(light_keys(tokens))
                if len(tokens) * 10 > 9 * boundary:
                    own.append(heavy_keys(tokens))
                keys.extend(own)
                owner.extend(np.full(len(k), int.from_bytes(digest[:8], "little", signed=True)) for k in own)
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([*keys, empty.view("<u8")]).view(np.int64)),
                    pa.array(np.concatenate([*owner, empty])),
                ],
                names=["key", "c"],
            )

    return docs.select(text).mapInArrow(run, "key long, c long")


def set_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``node``, ``digest``, ``n``, ``tokens`` of the given rows."""
    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, "<u8")]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(set_digest, sets), pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                names=["node", "digest", "n", "tokens"],
            )

    return docs.select(doc_id, text).mapInArrow(run, "node long, digest binary, n long, tokens array<long>")


def _linked(n_a: Column, n_b: Column, common: Column) -> Column:
    return 100 * common >= 90 * (n_a + n_b - common)


def _allowed(n_a: Column, n_b: Column) -> Column:
    return F.floor((n_a + n_b) / 19)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs``; with ``digests`` also that of its set.

    Null and empty texts have the empty set and are linked with nothing. Rows
    without id cannot be reached by a link: their component is that of rows with
    the same set, null if there are none. Repeated ids keep a row each. Ids must
    be numbers, or text that casts to them. Other columns are not used.
    """
    sets = cut_lineage(set_sizes(docs, doc_id, text))
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n")
    )
    histogram = {r.n: r["count"] for r in classes.filter(f"n <= {MOST_LIGHT}").groupBy("n").count().collect()}
    keys = set_keys(docs, choose_boundary(histogram), text)
    links = cut_lineage(_links(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), classes, keys))
    found = components(links, "x", "y")
    named = classes.join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component_id")
    )
    full = sets.filter("n > 0").join(named, "digest", "left")
    own = sets.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"] + (["digest"] if digests else [])
    return full.select(*columns).union(own.select(*columns))


def _links(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """Links (x, y) between classes that connect all that links connect."""
    shared = keys.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high")
    members = cut_lineage(keys.join(shared.select("key"), "key").distinct())
    met = members.join(members.groupBy("key").agg(F.count("*").alias("size")), "key")
    weights = met.groupBy("c").agg(F.sum("size").alias("weight"))
    pivots = (
        members.join(weights, "c")
        .groupBy("key")
        .agg(F.max(F.struct("weight", "c")).alias("best"))
        .select("key", F.col("best.c").alias("p"))
    )
    stars = members.join(pivots, "key").filter("c <> p").select("c", "p").distinct()
    # Half digests find candidates; from here on classes are named by their smallest document.
    named = classes.select(_half(F.col("digest")).alias("c"), "node")
    edges = cut_lineage(
        stars.join(named.withColumnRenamed("node", "x"), "c")
        .select("x", "p")
        .join(named.select(F.col("c").alias("p"), F.col("node").alias("y")), "p")
        .select("x", "y")
    )
    wanted = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct()
    texts = docs.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id")
    tokens = cut_lineage(
        set_tokens(texts).join(classes.select("node", "digest"), ["node", "digest"]).drop("digest")
    )
    side = lambda name: tokens.select(*[F.col(c).alias(f"{c}_{name}") for c in tokens.columns])
    both = edges.join(side("x"), F.col("x") == F.col("node_x")).join(side("y"), F.col("y") == F.col("node_y"))
    compared = cut_lineage(
        both.select(
            "x", F.col("y").alias("pivot"), F.col("n_x").alias("n"), F.col("n_y").alias("n_pivot"),
            F.array_except("tokens_x", "tokens_y").alias("added"),
            F.array_except("tokens_y", "tokens_x").alias("removed"),
        ).select(
            "x", "pivot", "n",
            _linked(F.col("n"), F.col("n_pivot"), F.col("n") - F.size("added")).alias("linked"),
            F.concat("added", "removed").alias("differ"),
        )
    )
    first = compared.filter("linked").select("x", F.col("pivot").alias("y"))
    pairs = _pairs_beside_pivots(compared)
    checked = (
        pairs.join(side("x"), F.col("x") == F.col("node_x"))
        .join(side("y"), F.col("y") == F.col("node_y"))
        .filter(_linked(F.col("n_x"), F.col("n_y"), F.size(F.array_intersect("tokens_x", "tokens_y"))))
    )
    return first.union(checked.select("x", "y"))


def _half(digest: Column) -> Column:
    """The first eight bytes as a little-endian signed number, as in ``set_keys``."""
    text = F.hex(digest)
    swapped = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(8))])
    return F.conv(swapped, 16, -10).cast("long")


def _pairs_beside_pivots(compared: DataFrame) -> DataFrame:
    """Pairs (x, y) with a common pivot that can link though one of them isn't linked to the pivot.

    Of a difference, all but ``most`` elements are common with that of a partner,
    so both hold a common one among their first ``most`` + 1, rare ones first.
    """
    open_pivots = compared.filter("NOT linked").select("pivot").distinct()
    told = compared.join(open_pivots, "pivot", "left_semi").withColumn("size", F.size("differ"))
    single = told.select("pivot", "x", "n", "linked", "size", F.explode("differ").alias("token"))
    counts = single.groupBy("pivot", "token").agg(F.count("*").alias("members")).filter("members > 1")
    common = (
        single.join(counts, ["pivot", "token"])
        .groupBy("pivot", "x", "n", "linked", "size")
        .agg(F.sort_array(F.collect_list(F.struct("members", "token"))).alias("common"))
    )
    most = _allowed(F.col("n"), F.floor(F.col("n") * 10 / 9))
    # Elements that no other member differs in come before all others.
    place = F.col("size") - F.size("common") + F.col("i")
    rows = (
        common.select("pivot", "x", "n", "linked", "size", "common", F.posexplode("common").alias("i", "e"))
        .withColumn("at", place)
        .filter(F.col("at") <= most)
        .select("pivot", "x", "n", "linked", F.col("size").alias("differ"), "at", F.col("e.token").alias("token"))
    )
    a = rows.select("pivot", "token", *[F.col(c).alias(f"{c}_a") for c in ("x", "n", "linked", "differ", "at")])
    b = rows.select("pivot", "token", *[F.col(c).alias(f"{c}_b") for c in ("x", "n", "linked", "differ", "at")])
    needed = (F.col("differ_a") + F.col("differ_b") - _allowed(F.col("n_a"), F.col("n_b"))) / 2
    # At their first common element, what follows must suffice for both.
    rest = F.least(F.col("differ_a") - F.col("at_a"), F.col("differ_b") - F.col("at_b"))
    sizes = (F.col("n_a") * 10 >= F.col("n_b") * 9) & (F.col("n_b") * 10 >= F.col("n_a") * 9)
    ok = (F.col("x_a") < F.col("x_b")) & ~(F.col("linked_a") & F.col("linked_b")) & sizes & (rest >= needed)
    met = a.alias("a").join(
        b.alias("b"),
        (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.token") == F.col("b.token")) & ok,
    )
    return met.select(F.col("x_a").alias("x"), F.col("x_b").alias("y")).distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the row of the smallest id stays.

    Rows without id stay. Rows that repeat an id are told apart by their texts:
    those of a class that stays are kept, all of them, the others go.
    """
    told = near_duplicates(docs, doc_id, text, digests=True)
    goes = F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))
    marked = told.select("doc_id", "digest", goes.alias("goes"))
    ids = marked.groupBy(F.col("doc_id").alias("__id")).agg(F.min("goes").alias("__all"), F.max("goes").alias("__any"))
    met = docs.join(ids.filter("__any"), docs[doc_id].cast("long") == F.col("__id"), "left")
    kept = met.filter("__id IS NULL").select(*docs.columns)
    # Ids of which some rows go and some stay: only these need the digests of their texts.
    some = met.filter("NOT __all").withColumn("__digest", F.arrow_udf(_digests, "binary")(F.col(text)))
    gone = marked.filter("goes").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    return kept.union(some.join(gone, ["__id", "__digest"], "left_anti").select(*docs.columns))


def _digests(texts: pa.Array) -> pa.Array:
    return pa.array([set_digest(shingles(t.as_py())) for t in texts], pa.binary())


@query("op5_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
