"""Near duplicates by one-permutation MinHash: optimal densification, banded buckets, stars of candidates.

* **Signature.** One hash of every shingle: its high bits choose one of
  ``BINS`` bins, a bin keeps the least of its hashes. An empty bin takes the value
  of the first filled one in a sequence of bins that is fixed for that bin, so two
  sets agree in a bin as often as they are alike.
* **Bands.** ``ROWS`` neighbouring bins make a bucket key. At a similarity of 0.8
  two sets miss each other in all 32 bands once in 2 * 10^7 cases.
* **Stars.** A bucket of any size gives one candidate edge a member: that to its
  centre. Every candidate is confirmed on the full sets.
* **Rounds.** A bucket whose members are not all connected by then stays open:
  two members may be alike though one is unlike the centre. Its next centre comes
  from the smallest component in it and meets the members of the others; then
  the key is refined by neighbouring bands (8, then 16 bins), which parts what only
  shares a passage and leaves together what is alike. All rounds work on open
  buckets alone, with at most one edge a member again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.components import components
from lexispark.llm.registry import query, table
from lexispark.plans.checkpoints import cut_lineage

SHINGLE = 4
SIMILARITY = 80
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Bands that make a key in each round over open buckets.
ROUNDS = [1, 1, 2, 4]
#: Edges up to this number are broadcast to the sets (some 20 bytes each); more are joined by a shuffle.
BROADCAST_EDGES = 300_000
#: Edges of a centre that meet its set in one task.
STAR_EDGES = 256
#: Texts are read in runs of about so many characters.
RUN_CHARS = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: A-Z lower-cased, words between blanks; fewer words make one."""
    # Bytes are lowered and split as ASCII: no other letter or blank is touched.
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], "<u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "<u8", len(words))
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        x = h[:n].copy()
        for k in range(1, size):
            x = _mix(x) * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    return np.unique(_mix(x))


def _probes() -> np.ndarray:
    """For every bin the order in which an empty one looks at others; each row ends by passing over all bins."""
    bins = np.arange(BINS, dtype=np.uint64)[:, None]
    draws = _mix(bins * np.uint64(65_537) + np.arange(8 * BINS, dtype=np.uint64)[None, :]) % np.uint64(BINS)
    return np.concatenate([draws, (bins + np.arange(BINS, dtype=np.uint64)[None, :]) % np.uint64(BINS)], axis=1).astype(int)


_PROBES = _probes()
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``BINS`` values of a set that isn't empty; hashes come sorted, so the first of a bin is its least."""
    own, first = np.unique((hashes >> _BIN_SHIFT).astype(np.int64), return_index=True)
    out, filled = np.zeros(BINS, "<u8"), np.zeros(BINS, bool)
    out[own], filled[own] = hashes[first], True
    if len(own) < BINS:
        empty = np.flatnonzero(~filled)
        out[empty] = out[_PROBES[empty, filled[_PROBES[empty]].argmax(1)]]
    return out


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    rows = signature(hashes).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        x = rows[:, 0].copy()
        for k in range(1, ROWS):
            x = _mix(x) * np.uint64(0x9E3779B97F4A7C15) + rows[:, k]
    return _mix(x)


def _runs(column: pa.Array):
    """(begin, texts) of a batch column, some at a time, so that long texts are not all unpacked at once."""
    begin, held, out = 0, 0, []
    for i in range(len(column)):
        t = column[i].as_py()
        out.append(t)
        held += len(t) if t else 0
        if held > RUN_CHARS:
            yield begin, out
            begin, held, out = i + 1, 0, []
    if out:
        yield begin, out


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``digest`` (of the set), ``bands`` of every row; bands only once a task for equal sets."""
    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for begin, texts in _runs(batch.column(1)):
                sizes, digests, bands = [], [], []
                for t in texts:
                    x = shingle_hashes(t)
                    digest = xxhash.xxh3_128_digest(x.tobytes())
                    sizes.append(len(x))
                    digests.append(digest)
                    if len(x) and digest not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(digest)
                        bands.append(band_hashes(x).tobytes())
                    else:
                        bands.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, len(texts)), pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()), pa.array(bands, pa.binary()),
                    ],
                    names=["doc_id", "n", "digest", "bands"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, digest binary, bands binary")


def bucket_keys(classes: DataFrame, width: int) -> DataFrame:
    """``key``, ``c``: for each band that with the ``width`` - 1 bands after it (the first follow the last)."""
    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, BANDS)
            with np.errstate(over="ignore"):
                key = x + np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(1, width):
                    key = _mix(key) + np.roll(x, -k, axis=1)
            names = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mix(key).reshape(-1).view(np.int64)), pa.array(names)], names=["key", "c"]
            )

    return classes.select("c", "bands").mapInArrow(run, "key long, c long")


def _stars(members: DataFrame) -> DataFrame:
    """``x``, ``centre``: an edge from every member of a bucket to its centre.

    That is the member which meets most others over all buckets: as a rule what
    the others were copied from, so a member has the same centre in most buckets.
    """
    met = members.join(members.groupBy("key").agg(F.count("*").alias("size")), "key")
    weights = met.groupBy("c").agg(F.sum("size").alias("weight"))
    weighed = members.join(weights, "c")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", "c")).alias("best"))
    edges = members.join(centres.select("key", F.col("best.c").alias("centre")), "key")
    return edges.filter("c <> centre").select(F.col("c").alias("x"), "centre").distinct()


def _later_stars(members: DataFrame, number: int) -> DataFrame:
    """``x``, ``centre`` between the members of open buckets (``key``, ``c``, ``part``) and a centre from another part.

    The centre belongs to the part with the fewest members. Centres are taken in
    one order of all members, another one each round, so that buckets agree on them.
    """
    best = F.struct(F.xxhash64("c", F.lit(number)).alias("draw"), "c")
    parts = members.groupBy("key", "part").agg(F.count("*").alias("n"), F.max(best).alias("best"))
    least = parts.groupBy("key").agg(F.min(F.struct("n", "best.draw", F.col("best.c").alias("centre"), "part")).alias("m"))
    centres = least.select("key", "m.centre", F.col("m.part").alias("own"))
    edges = members.join(centres, "key").filter("part <> own")
    return edges.select(F.col("c").alias("x"), "centre").distinct()


def _token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``c``, ``tokens`` of the wanted classes (``c``, ``digest``), from the rows that have the id ``c`` and that set."""
    def run(batches):
        seen: set[tuple] = set()
        for batch in batches:
            names, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, texts in _runs(batch.column(2)):
                owners, sets = [], []
                for i, t in enumerate(texts, begin):
                    x, key = shingle_hashes(t), (names[i], digests[i])
                    if key in seen or xxhash.xxh3_128_digest(x.tobytes()) != digests[i]:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    owners.append(names[i])
                    sets.append(x)
                offsets = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
                values = np.concatenate([*sets, np.zeros(0, "<u8")]).view(np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), tokens], names=["c", "tokens"])

    met = docs.join(wanted, docs["doc_id"] == wanted["c"]).select("c", "digest", "text")
    return met.mapInArrow(run, "c long, tokens array<long>")


def _confirmed(edges: DataFrame, tokens: DataFrame, similarity: int) -> DataFrame:
    """``x``, ``centre`` of the edges whose full sets are alike. Centres with many edges are met in several tasks."""
    copies = edges.groupBy("centre").agg(F.ceil(F.count("*") / STAR_EDGES).cast("int").alias("copies"))
    salted = edges.join(copies, "centre").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("copies")).cast("int"))
    if edges.count() <= BROADCAST_EDGES:
        copies, salted = F.broadcast(copies), F.broadcast(salted)
    centres = tokens.join(copies, tokens["c"] == copies["centre"]).select(
        "centre", F.col("tokens").alias("other"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")
    )
    met = tokens.join(salted, tokens["c"] == salted["x"]).select("x", "centre", "salt", "tokens")
    both = met.join(centres, ["centre", "salt"]).withColumn("common", F.size(F.array_intersect("tokens", "other")))
    union = F.size("tokens") + F.size("other") - F.col("common")
    return both.filter(100 * F.col("common") >= similarity * union).select("x", "centre")


def _in_several(members: DataFrame, part: Column) -> DataFrame:
    """Members of the buckets that hold more than one ``part``."""
    still = members.groupBy("key").agg(F.min(part).alias("a"), F.max(part).alias("b")).filter("a <> b")
    return members.join(still.select("key"), "key")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: int = SIMILARITY
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) for every row of ``docs``.

    Links join sets of which ``100 * common >= similarity * union``. Bands are
    laid out for similarities of 80 and more. Null and empty texts have the empty
    set and are linked with nothing. Rows without id cannot be reached by a
    link: their component is that of rows with the same set, null if there are
    none. Repeated ids keep a row each, with the component of the row's set; sets
    with the same smallest id count as one. Ids must be numbers or text that
    casts to them. Other columns are not used.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = cut_lineage(sketches(rows))
    classes = cut_lineage(
        sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
            F.min("doc_id").alias("c"), F.max("bands").alias("bands")
        )
    )
    found = _components(rows, classes, similarity)
    named = classes.join(found, classes["c"] == found["node"], "left").select(
        "digest", F.coalesce("component", "c").alias("component_id")
    )
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    full = sets.filter("n > 0").drop("bands").join(named, "digest", "left")
    own = sets.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return full.select(*columns).union(own.select(*columns))


def _parts(links: DataFrame) -> DataFrame:
    """``node``, ``part``: a member of the same component, the same one for most of its members.

    Every node goes to its neighbour with most links (or stays, if it has more),
    and on to where that one goes. Components would merge more; what stays apart here is compared once more.
    """
    both = links.select(F.col("x").alias("u"), F.col("centre").alias("v"))
    both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    degrees = both.groupBy("u").agg(F.count("*").alias("n"))
    ranked = both.join(degrees.select(F.col("u").alias("v"), "n"), "v").groupBy("u").agg(
        F.max(F.struct("n", "v")).alias("best")
    )
    own = F.struct("n", F.col("u").alias("v"))
    goes = ranked.join(degrees, "u").select("u", F.greatest("best", own)["v"].alias("to"))
    onward = goes.select(F.col("u").alias("to"), F.col("to").alias("part"))
    return goes.join(onward, "to").select(F.col("u").alias("node"), "part")


def _components(rows: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """``node``, ``component`` of the classes that have a link."""
    members = cut_lineage(_in_several(bucket_keys(classes, ROUNDS[0]), F.col("c")).distinct())
    wanted = classes.join(members.select("c").distinct(), "c", "left_semi").select("c", "digest")
    tokens = cut_lineage(_token_sets(rows, wanted))
    compared = cut_lineage(_stars(members))
    links = cut_lineage(_confirmed(compared, tokens, similarity))
    for number, bands in enumerate(ROUNDS[1:], 1):
        if bands != ROUNDS[number - 1]:
            # A refined bucket of a closed one is closed, so the keys of all classes left can be made anew.
            left = classes.join(members.select("c").distinct(), "c", "left_semi")
            members = _in_several(bucket_keys(left, bands), F.col("c")).distinct()
        found = _parts(links)
        named = members.join(found, members["c"] == found["node"], "left")
        named = named.select("key", "c", F.coalesce("part", "c").alias("part"))
        members = cut_lineage(_in_several(named, F.col("part")))
        if members.isEmpty():
            break
        edges = cut_lineage(_later_stars(members, number).join(compared, ["x", "centre"], "left_anti"))
        compared = compared.union(edges)
        links = links.union(cut_lineage(_confirmed(edges, tokens, similarity)))
    return components(links, "x", "centre")


@query("op13_minhash_groups")
def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = near_duplicates(table(spark, sf_dir, "documents"))
    alone = F.col("component_id").isNull()
    return told.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), alone))
