"""MinHash groups against all pairs compared in full."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_joins import edited, prose

from lexispark.llm import minhash_groups
from lexispark.llm.minhash_groups import BANDS, BINS, near_duplicates, shingle_hashes, signature


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(rows, least=80):
    sets = []
    for d, t in rows:
        w = words_of(t)
        sets.append((d, {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} - {()}))
    parent = {d: d for d, _ in sets}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if min(len(s), len(t)) * 100 >= least * max(len(s), len(t)) and s:
                common = len(s & t)
                if 100 * common >= least * (len(s) + len(t) - common):
                    low, high = sorted((root(a), root(b)))
                    parent[high] = low
    return {d: (len(s), root(d)) for d, s in sets}


def test_groups_equal_brute_force(spark, make_docs):
    rng = random.Random(7)
    texts = [None, "", "one", "One", "one two three", "ONE two\x0bTHREE", " \n", "é É", "É é"]
    for size, copies, edits in ((9, 12, 2), (25, 25, 3), (60, 60, 5), (150, 60, 9), (400, 25, 20), (1500, 10, 80)):
        origin = prose(rng, size)
        texts += [" ".join(edited(rng, origin, rng.randint(0, edits))) for _ in range(copies)]
    shared = prose(rng, 120)
    texts += [" ".join(prose(rng, rng.randint(5, 60)) + shared + prose(rng, rng.randint(5, 60))) for _ in range(60)]
    texts += [" ".join(prose(rng, rng.randint(1, 30))) for _ in range(30)] + [texts[20]] * 15 + [texts[-1].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = make_docs(rows).withColumnRenamed("seed", "component_id").withColumnRenamed("n", "bands")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_clusters_that_share_buckets(spark, make_docs):
    """Two clusters close to each other yet not linked: edges grow with the members, and no link is lost."""
    rng = random.Random(9)
    first = prose(rng, 200)
    second = list(first)
    for i in range(0, 200, 13):
        second[i] = "other" + second[i]
    texts = [" ".join(edited(rng, o, 3)) for o in (first, second) for _ in range(60)]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len({c for _, c in want.values()}) == 2
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(rows)).collect()}
    assert got == want
    keys = spark.createDataFrame([(k, c) for k in range(40) for c in range(k, k + 100)], "key long, c long")
    parted = keys.withColumn("part", F.col("c") % 3)
    assert max(minhash_groups._stars(keys).count(), minhash_groups._later_stars(parted, 1).count()) <= 40 * 99


def test_edge_rows(spark, make_docs):
    text = " ".join(prose(random.Random(8), 40))
    docs = make_docs([(None, text), (None, "alone here now"), (4, text), (4, text), (3, text + " end"), (9, None)])
    got = sorted(map(tuple, near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 37, 3), (None, 1, None), (4, 37, 3), (4, 37, 3), (3, 38, 3), (9, 0, 9)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    long = " ".join(prose(random.Random(3), 60_000))
    docs = make_docs([(1, long), (2, long + " tail"), (3, long[:-9])])
    assert {r.component_id for r in near_duplicates(docs).collect()} == {1}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700):
        agree, alike = [], []
        for _ in range(300):
            x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            y = np.concatenate([x[: max(1, n * 8 // 10)], rng.integers(0, 2**63, n // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
            agree.append((signature(np.unique(x)) == signature(np.unique(y))).mean())
            alike.append(len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(agree) - np.mean(alike)) < 0.04
    assert BANDS * minhash_groups.ROWS == BINS and len(shingle_hashes("a b c d A B C D")) == 4


def test_query_columns(spark, sample):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sample}/documents.parquet").collect()]
    got = minhash_groups.minhash_groups(spark, sample)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {
        d: (n, c, c == d) for d, (n, c) in want.items()
    }
    assert got.filter(F.col("kept").isNull()).count() == 0
