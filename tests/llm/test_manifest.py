"""Merkle manifest against a plain tree in Python."""

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from lexispark.llm import merkle_manifest
from lexispark.llm.merkle_manifest import build, fold, proof_digest, prove
from lexispark.plans.checkpoints import scratch_path


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """All levels up to a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at - at % 16
        out.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            node = leaf(r)
            if r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                node = leaf((*r[:4], low))
            for before, after in path:
                node = h(*before, node, *after)
            proof = h(*(x for before, after in path for x in before + after))
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def table_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def key(row):
    return tuple(map(str, row))


def random_rows(sizes, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcDEF gé\n", k=rng.randint(0, 9)))
    doc = iter(rng.sample(range(-5000, 50_000), sum(sizes.values())))
    rows = [(next(doc), s, rng.choice(["en", None]), rng.choice([3, None]), word()) for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1}, {None: 16}, {"a": 17, "": 2}, {"a": 257, None: 256, "": 15, "é": 1},
        {"hot": 4500, **{f"s{i}": i % 3 + 1 for i in range(300)}},
    ],
)
def test_query_equals_plain_tree(spark, tmp_path, sizes):
    rows = random_rows(sizes)
    table_of(spark, rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle_manifest.merkle_manifest(spark, str(tmp_path))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_edge_rows(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (3, "a", "en", 1, "X"), (3, "a", "en", 1, "X"),
        (3, "a", "en", 1, "other"), (4, None, None, None, ""), (7, "a", "en", 9, "Long WORD " * 100_000),
    ]
    table_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle_manifest.merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_only_every_second_level_is_stored(spark):
    rows = random_rows({"a": 5000})
    manifest = build(table_of(spark, rows), scratch_path(spark, "t"), "source", ["doc_id"], ["doc_id", "text"])
    assert [manifest.read(spark, f"row-{k}").count() for k in range(manifest.row_levels)] == [5000, 20, 1]
    told = prove(spark, manifest)
    assert told.filter(fold(F.col("leaf"), F.col("path")) == manifest.root(spark)).count() == 5000
    assert told.filter(fold(F.sha2(F.col("leaf"), 256), F.col("path")) == manifest.root(spark)).count() == 0
    assert told.select(proof_digest(F.col("path"))).distinct().count() == 5000


def test_empty_table_and_clashing_columns(spark):
    docs = table_of(spark, []).withColumn("hash", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("size", F.lit(1))
    manifest = build(docs, scratch_path(spark, "t"), "source", ["doc_id"], ["text"])
    assert manifest.root(spark) is None and prove(spark, manifest).count() == 0
    more = table_of(spark, [(1, "a", "en", 1, "x"), (2, "a", "en", 1, "y")])
    more = more.withColumn("hash", F.lit(1)).withColumn("pos", F.lit(1)).withColumn("grp", F.lit(1))
    manifest = build(more, scratch_path(spark, "t"), "source", ["doc_id"], ["text"], keep=["pos", "hash", "grp"])
    assert prove(spark, manifest).columns == ["key_doc_id", "key_pos", "key_hash", "key_grp", "leaf", "subroot", "path"]
    assert manifest.root(spark) == h(leaf(("x",)), leaf(("y",)))
