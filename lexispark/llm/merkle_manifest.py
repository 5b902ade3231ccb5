"""Merkle manifest of a table: per-group hash trees under one root, with proofs for every row.

Only every second level of a tree is stored (``STEP``). A stored node stands
for an aligned subtree of ``FAN ** STEP`` stored nodes below it, so proof
extraction works subtree by subtree: the stored nodes of a subtree meet in one
row, the level between them and their stored ancestor is hashed anew, every
node gets its siblings, and the level is dropped again. A group of any size is
cut into subtrees of bounded size; nothing is gathered by group.

All hashes are sha256 over concatenated text: digests go in as lowercase hex.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.registry import fold_of, let, query, table
from lexispark.plans.checkpoints import scratch_path
from lexispark.plans.numbering import number_rows

#: Children of a node, and levels from one stored level to the next.
FAN, STEP = 16, 2

#: Siblings of a node at one level, left and right of it, from the lowest level upwards.
PATH = "array<struct<before:string,after:string>>"


def leaf_hash(*fields: Column) -> Column:
    """sha256 over the fields, each as byte count, colon and value, or "-" if null."""
    texts = [f.cast("string") for f in fields]
    told = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """A manifest stored below ``folder``, and how many levels of each kind of tree are stored.

    ``row-L`` holds stored level L of the groups' trees: ``grp``, ``pos``,
    ``size`` (nodes of the group on this level), ``hash``; ``row-0`` also the key
    columns of the rows. ``top-L`` is the same for the tree over the subroots,
    ``subroots`` has a row per group, ``root`` one row.
    """

    folder: str
    row_levels: int
    top_levels: int

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def root(self, spark: SparkSession) -> str | None:
        found = self.read(spark, "root").first()
        return found.root if found else None


def _runs(nodes: Column) -> Column:
    """The next level: hashes of runs of ``FAN`` nodes, the last one may be shorter."""
    number = F.ceil(F.size(nodes) / FAN).cast("int")
    return F.transform(
        F.sequence(F.lit(0), number - 1),
        lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), "").cast("binary"), 256),
    )


def _subtrees(nodes: DataFrame, *carried: str) -> DataFrame:
    """One row per aligned subtree of stored nodes: ``grp``, ``pos`` of its ancestor, ``width`` (the group's size), ``nodes`` in order."""
    member = F.struct("pos", "hash", *carried)
    return nodes.groupBy("grp", F.floor(F.col("pos") / FAN**STEP).alias("pos")).agg(
        F.max("size").alias("width"), F.sort_array(F.collect_list(member)).alias("nodes")
    )


def _climb(nodes: Column, width: Column) -> Column:
    """The levels over stored ``nodes``, up to the next stored one or the last: an array of arrays, lowest first."""
    hashes = F.transform(nodes, lambda x: x["hash"])
    # A group of one node is done; one of up to FAN nodes is a level below its last node.
    return let(
        _runs(hashes),
        lambda one: F.when(width == 1, F.array(hashes))
        .when(width <= FAN, F.array(hashes, one))
        .otherwise(F.array(hashes, one, _runs(one))),
    )


def _grow(leaves: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Store every ``STEP``-th level over numbered leaves as ``name-L``; return the last nodes and the level count."""
    spark, level, stored = leaves.sparkSession, 0, leaves
    while True:
        open_groups = stored.filter("size > 1")
        if open_groups.isEmpty():
            break
        up = _subtrees(open_groups.select("grp", "pos", "size", "hash"))
        last = F.element_at(F.element_at(_climb(F.col("nodes"), F.col("width")), -1), 1)
        size = F.ceil(F.col("width") / FAN**STEP).cast("long")
        level += 1
        up.select("grp", "pos", size.alias("size"), last.alias("hash")).write.parquet(f"{name}-{level}")
        stored = spark.read.parquet(f"{name}-{level}")
    ends = [spark.read.parquet(f"{name}-{k}").filter("size = 1").select("grp", "hash") for k in range(level + 1)]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out, level + 1


def _group_key(group: Column) -> Column:
    """A text that is never null and orders groups by their bytes, the null group first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def build(
    rows: DataFrame, folder: str, group: str, order: list[str], fields: list[str], keep: list[str] | None = None
) -> Manifest:
    """Write the manifest of ``rows`` below ``folder``, which all executors reach.

    Leaves hash ``fields``. In a group they ascend by ``order`` (nulls first),
    then by hash, so repeated rows are leaves of their own in a fixed order. A
    null group is a group. The columns ``keep`` are stored with the leaves; other
    columns are not used. A table without rows has no group and no root.
    """
    spark = rows.sparkSession
    keys = [F.col(c).alias(f"key_{c}") for c in dict.fromkeys([*order, *(keep or [])])]
    leaf = leaf_hash(*[F.col(c) for c in fields]).alias("hash")
    leaves = rows.select(_group_key(F.col(group)).alias("grp"), *keys, leaf)
    along = [f"key_{c}" for c in order] + ["hash"]
    number_rows(leaves, ["grp"], along, "pos", start=0, total="size").write.parquet(f"{folder}/row-0")
    subroots, row_levels = _grow(spark.read.parquet(f"{folder}/row-0"), f"{folder}/row")
    subroots.write.parquet(f"{folder}/subroots")
    heads = spark.read.parquet(f"{folder}/subroots").select(
        F.lit("").alias("grp"), F.col("grp").alias("key_group"), "hash"
    )
    number_rows(heads, ["grp"], ["key_group"], "pos", start=0, total="size").write.parquet(f"{folder}/top-0")
    root, top_levels = _grow(spark.read.parquet(f"{folder}/top-0"), f"{folder}/top")
    root.select(F.col("hash").alias("root")).write.parquet(f"{folder}/root")
    return Manifest(folder, row_levels, top_levels)


def _siblings(level: Column, at: Column) -> Column:
    """The other nodes of the run of node ``at`` (from 0), left and right of it."""
    first = at - at % FAN
    return F.struct(
        F.array_join(F.slice(level, first + 1, at % FAN), "").alias("before"),
        F.array_join(F.slice(level, at + 2, first + FAN - 1 - at), "").alias("after"),
    )


def _descend(stored: DataFrame, above: DataFrame | None, roots: DataFrame | None) -> DataFrame:
    """``stored`` nodes with ``path``, their siblings up to the root of all, and the ``subroot`` of their group.

    ``roots`` has ``grp`` and the path ``over`` it of every last node (None: nothing
    is over it), ``above`` the paths of the next stored level. The levels between
    are hashed anew inside the row of a subtree and go no further.
    """
    carried = [c for c in stored.columns if c.startswith("key_")]
    columns = ["grp", "pos", "hash", *carried, "subroot", "path"]
    single = stored.filter("size = 1")
    single = single.withColumn("over", F.array().cast(PATH)) if roots is None else single.join(roots, "grp")
    single = single.withColumn("subroot", F.col("hash")).withColumn("path", F.col("over")).select(*columns)
    if above is None:
        return single
    trees = _subtrees(stored.filter("size > 1"), *carried).join(
        above.select("grp", "pos", "subroot", F.col("path").alias("upper")), ["grp", "pos"]
    )
    one = trees.withColumn("levels", _climb(F.col("nodes"), F.col("width"))).select(
        "grp", "subroot", "levels", "upper", F.posexplode("nodes").alias("i", "node")
    )
    # The last of the levels is the ancestor; those below it have siblings.
    own = [_siblings(F.col("levels")[k], F.floor(F.col("i") / FAN**k).cast("int")) for k in range(STEP)]
    steps = F.when(F.size("levels") == 2, F.array(own[0])).otherwise(F.array(*own))
    full = one.select(
        "grp", "node.pos", "node.hash", *[F.col(f"node.{c}") for c in carried], "subroot",
        F.concat(steps, "upper").alias("path"),
    )
    return single.union(full)


def _paths(spark: SparkSession, manifest: Manifest, name: str, levels: int, roots: DataFrame | None) -> DataFrame:
    """Level 0 of a kind of tree with its key columns, ``subroot`` and ``path``, from the top stored level down."""
    found = None
    for k in reversed(range(levels)):
        found = _descend(manifest.read(spark, f"{name}-{k}"), found, roots)
    return found


def prove(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """Every leaf with its proof: the columns ``key_...``, ``leaf``, ``subroot`` and ``path``.

    ``path`` has the siblings of each level from the leaf over the subroot to
    the root, as text left and right of the node.
    """
    tops = _paths(spark, manifest, "top", manifest.top_levels, None)
    roots = tops.select(F.col("key_group").alias("grp"), F.col("path").alias("over"))
    rows = _paths(spark, manifest, "row", manifest.row_levels, roots)
    keys = [c for c in rows.columns if c.startswith("key_")]
    return rows.select(*keys, F.col("hash").alias("leaf"), "subroot", "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(
        path, leaf, lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]).cast("binary"), 256)
    )


def proof_digest(path: Column) -> Column:
    """sha256 over all siblings, level by level from the leaf upwards, left to right."""
    told = F.transform(path, lambda x: F.concat(x["before"], x["after"]))
    return F.sha2(F.array_join(told, "").cast("binary"), 256)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sql() -> str:
    """The same in SQL: crc32 bit by bit, and six levels of each kind of tree, enough for 16 million leaves."""
    def field(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in _FIELDS) + ")"

    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    bit = "CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    byte = f"list_reduce(range(8), lambda a, b: {bit}, xor(s, c))"
    crc = (
        "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),"
        f" lambda s, c: {byte}, 4294967295), 4294967295)"
    )
    steps = [
        f"""doc AS (
            SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf("text")} AS leaf,
                CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS tampered FROM documents),
        row_0 AS (
            SELECT *, leaf AS hash, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                count(*) OVER (PARTITION BY grp) AS size FROM doc)"""
    ]

    def grow(name: str) -> None:
        for k in range(6):
            steps.append(f"""{name}_{k + 1} AS (
                SELECT grp, pos // 16 AS pos, (any_value(size) + 15) // 16 AS size,
                    sha256(string_agg(hash, '' ORDER BY pos)) AS hash
                FROM {name}_{k} WHERE size > 1 GROUP BY grp, pos // 16)""")
        ends = " UNION ALL ".join(f"SELECT grp, hash FROM {name}_{k} WHERE size = 1" for k in range(7))
        steps.append(f"{name}_end AS ({ends})")

    grow("row")
    steps.append("""top_0 AS (
        SELECT '' AS grp, grp AS key_group, hash, row_number() OVER (ORDER BY grp) - 1 AS pos,
            count(*) OVER () AS size FROM row_end)""")
    grow("top")

    def walk(name: str, keys: str) -> None:
        """Rows of level 0 with their siblings up to the last node of their tree, and both folds."""
        for k in range(6):
            before = f"{name}_0" if k == 0 else f"{name}_way_{k - 1}"
            own = ", '' AS proof, [] AS way" if k == 0 else ""
            steps.append(f"""{name}_run_{k} AS (
                SELECT grp, pos, coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
                    coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
                FROM {name}_{k} WHERE size > 1 WINDOW w AS (PARTITION BY grp, pos // 16 ORDER BY pos)),
            {name}_way_{k} AS (
                SELECT d.* REPLACE (proof || coalesce(lefts || rights, '') AS proof,
                    CASE WHEN lefts IS NULL THEN way ELSE list_append(way, {{'l': lefts, 'r': rights}}) END AS way)
                FROM (SELECT *{own} FROM {before}) d
                LEFT JOIN {name}_run_{k} r ON d.grp = r.grp AND d.pos // {16**k} = r.pos)""")

    walk("row", "")
    walk("top", "")
    fold_sql = "list_reduce(list_concat([{'l': coalesce(tampered, leaf), 'r': ''}], d.way, t.way), " \
        "lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l"
    return f"""WITH {", ".join(steps)},
        told AS (
            SELECT doc_id, leaf, s.hash AS subroot, o.hash AS root, sha256(d.proof || t.proof) AS proof_sha256,
                {fold_sql} AS folded_root
            FROM row_way_5 d JOIN row_end s ON d.grp = s.grp JOIN top_way_5 t ON t.key_group = d.grp
            CROSS JOIN top_end o)
        SELECT *, folded_root = root AS verified FROM told"""


@query("op12_merkle_manifest", _sql())
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = [F.translate("text", _UPPER, _LOWER) if c == "text" else F.col(c) for c in _FIELDS]
    tampered = F.when(fold_of("doc_id", 5) == 0, leaf_hash(*lowered))
    manifest = build(
        docs.withColumn("tampered", tampered), scratch_path(spark, "manifest"), "source", ["doc_id"], _FIELDS, ["tampered"]
    )
    told = prove(spark, manifest).select(
        F.col("key_doc_id").alias("doc_id"), "leaf", "subroot", F.lit(manifest.root(spark)).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("key_tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
