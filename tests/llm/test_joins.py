"""Line dedup, decontamination, Jaccard join, substring dedup and chat formatting against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lexispark.llm import jaccard_join, perspectives, site_lines, spaced_seeds, substring_dedup, suffix_sort
from lexispark.llm.components import components
from lexispark.llm.registry import ORACLES, QUERIES
from tools.check import compare, connect

VOCABULARY = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]


def prose(rng, n):
    return [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, sample, name):
    got = QUERIES[name](spark, sample).toPandas()
    assert compare(got, connect(sample).execute(ORACLES[name]).df()).startswith("ok")


# Line dedup


def brute_lines(rows, ratio=0.2, least=4):
    hosts, held = {}, {}
    for host, text in rows:
        host = host or ""
        hosts[host] = hosts.get(host, 0) + 1
        for line in {x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")}:
            held[host, line] = held.get((host, line), 0) + 1
    bad = {k for k, n in held.items() if n >= least and n / hosts[k[0]] > ratio}
    return [
        None if text is None else "\n".join(x for x in text.split("\n") if (host or "", x) not in bad)
        for host, text in rows
    ]


def test_lines_equal_brute_force(spark, make_docs):
    rng = random.Random(1)
    pool = ["menu", "footer", "x", " ", "", "ad 1"] + [f"line {i}" for i in range(30)]
    rows = [
        (rng.choice(["a", "b", "c", None, ""]), "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for _ in range(150)
    ]
    rows += [("a", None), ("a", ""), ("hot", "menu\nend")] + [("hot", "menu\nbody\nmenu")] * 40
    rows += [("d", "\n".join(f"l{i}" for i in range(20_000)))] * 5
    docs = make_docs([(i % 150, t, None, h) for i, (h, t) in enumerate(rows)])
    docs = docs.withColumnRenamed("n", "n_lines").withColumnRenamed("seed", "host")
    out = site_lines.drop_boilerplate(docs, F.col("source")).collect()
    assert len(out) == len(rows)
    key = lambda x: (x[0], x[1] or "", x[2] or "", x[2] is None)
    want = [(i % 150, h, t) for i, (h, t) in enumerate(zip([h for h, _ in rows], brute_lines(rows)))]
    assert sorted(((r.doc_id, r.source, r.text) for r in out), key=key) == sorted(want, key=key)
    assert site_lines.drop_boilerplate(docs.limit(0), F.col("source")).count() == 0


# Decontamination


def test_masks_find_every_tolerated_overlap():
    for size in range(spaced_seeds.LEAST_WORDS, spaced_seeds.WINDOW + 1):
        for lost in combinations(range(size), spaced_seeds.spare(size)):
            assert any(
                all(o + p not in lost for p in mask) for mask in spaced_seeds.MASKS for o in range(size - mask[-1])
            ), (size, lost)


def brute_overlaps(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v = words(s)
            size = min(len(v), spaced_seeds.WINDOW)
            if len(v) < spaced_seeds.LEAST_WORDS:
                continue
            best = max(
                (
                    sum(0 <= b + k < len(w) and w[b + k] == v[a + k] for k in range(size))
                    for a in range(len(v) - size + 1)
                    for b in range(-size, len(w))
                ),
                default=0,
            )
            if size - best <= spaced_seeds.spare(size):
                out[d, i] = best
    return out


def test_overlaps_equal_brute_force(spark, make_docs):
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, n))) for i, n in enumerate([9, 10, 12, 16, 17, 25, 40])]
    items += [(7, None), (8, ""), (None, " ".join(prose(rng, 20))), (9, items[5][1].upper())]
    docs = [(0, None), (1, ""), (2, " ".join(prose(rng, 300)))]
    for k in range(40):
        item = rng.choice(items[:7])[1].split()
        begin = rng.randint(0, max(0, len(item) - 16))
        part = item[begin : begin + rng.choice([9, 16, 40])]
        for _ in range(rng.randint(0, 5)):
            part[rng.randrange(len(part))] = "other"
        text = prose(rng, rng.randint(0, 30)) + part + prose(rng, rng.randint(0, 30))
        docs.append((10 + k, ", ".join(text).title()))
    docs += [docs[-1], (None, docs[-1][1]), (99, " ".join(prose(rng, 20_000)))]
    frame = make_docs(docs).withColumnRenamed("seed", "content")
    bench = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, seed string")
    rows = spaced_seeds.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in rows} == brute_overlaps(docs, items)
    flagged = {d for d, _ in brute_overlaps(docs, items)}
    kept = spaced_seeds.clean(frame, bench).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((d for d, _ in docs if d not in flagged), key=str)
    assert spaced_seeds.clean(frame, bench.limit(0)).count() == len(docs)
    assert spaced_seeds.contaminated(frame.limit(0), bench).count() == 0


def test_overlaps_without_broadcast(spark, sample, monkeypatch):
    key = lambda rows: sorted(map(tuple, rows))
    want = key(spaced_seeds.spaced_seeds(spark, sample).collect())
    monkeypatch.setattr(spaced_seeds, "BROADCAST_SEEDS", 0)
    assert want and key(spaced_seeds.spaced_seeds(spark, sample).collect()) == want


# Jaccard join


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(words, words[1:], words[2:])) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 90 * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {d: (len(s), root(d)) for d, s in sets}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[i] = rng.choice(VOCABULARY) + "x"
        elif kind < 0.75 and len(out) > 5:
            del out[i]
        else:
            out.insert(i, rng.choice(VOCABULARY))
    return out


@pytest.mark.parametrize("boundary", [None, 8, 150], ids=["chosen", "all heavy", "mostly light"])
def test_join_equals_brute_force(spark, make_docs, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(jaccard_join, "choose_boundary", lambda histogram: boundary)
    rng = random.Random(7)
    texts = [None, "", "one", "One", "one two", "ONE two", " \n"]
    for size, copies, edits in ((11, 12, 2), (25, 25, 4), (60, 40, 6), (150, 60, 9), (400, 25, 30), (1500, 8, 60)):
        origin = prose(rng, size)
        texts += [" ".join(edited(rng, origin, rng.randint(0, edits))) for _ in range(copies)]
    shared = prose(rng, 60)
    texts += [" ".join(prose(rng, rng.randint(5, 60)) + shared + prose(rng, rng.randint(5, 60))) for _ in range(30)]
    texts += [" ".join(prose(rng, rng.randint(1, 30))) for _ in range(30)] + [texts[20]] * 15 + [texts[-1].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = make_docs(rows).withColumnRenamed("seed", "component_id")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    want = brute_components(rows)
    assert got == want
    if boundary is None:
        kept = sorted(r.doc_id for r in jaccard_join.one_of_each(docs).collect())
        assert kept == sorted(d for d, (_, c) in want.items() if c == d)


def test_join_edge_rows(spark, make_docs):
    text = " ".join(prose(random.Random(8), 40))
    docs = make_docs([(None, text), (None, "alone here now"), (4, text), (4, text), (3, text + " end"), (9, None)])
    got = sorted(map(tuple, jaccard_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 38, 3), (None, 1, None), (4, 38, 3), (4, 38, 3), (3, 39, 3), (9, 0, 9)], key=str)
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard_join.one_of_each(docs).collect()) == ["3", "9", "None", "None"]


def test_repeated_ids_are_told_apart_by_text(spark, make_docs):
    rng = random.Random(18)
    a, b = (" ".join(prose(rng, 40)) for _ in range(2))
    docs = make_docs([(5, a), (3, b), (5, b), (5, a), (6, b + " end")])
    got = sorted((r.doc_id, r.text == a) for r in jaccard_join.one_of_each(docs).collect())
    assert got == [(3, False), (5, True), (5, True)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# Substring dedup


def brute_repeats(rows):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(11)
    passages = [" ".join(prose(rng, rng.randint(15, 60))) for _ in range(12)] + ["é" * 90, "ab" * 200, "z" * 350]
    rows = [(0, None), (1, ""), (2, "short"), (3, "y" * 100), (4, "y" * 99)]
    for d in range(10, 90):
        parts = [rng.choice([*passages, " ".join(prose(rng, rng.randint(1, 40)))]) for _ in range(rng.randint(1, 6))]
        text = rng.choice(["", " ", "\n"]).join(parts)
        if rng.random() < 0.4:
            k = rng.randrange(len(text))
            text = text[:k] + "Q" + text[k + 1 :]
        rows.append((d, text))
    return rows + [(200, rows[20][1]), (201, rows[20][1][7:]), (202, rows[21][1] * 3)]


@pytest.mark.parametrize("batch", [40_000, 300, 3], ids=["one batch", "many batches", "digests"])
def test_repeats_equal_brute_force(spark, make_docs, monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    rows = repeat_rows()
    docs = make_docs(rows).withColumnRenamed("seed", "doc")
    out = substring_dedup.remove_repeats(docs).collect()
    want = brute_repeats(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_repeats_edge_rows(spark, make_docs):
    text = " ".join(prose(random.Random(12), 60))
    docs = make_docs([(None, text), (7, text), (7, text), (7, "A" + text), (8, None), (9, "b" * 200_000)])
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect())
    n = len(text)
    assert got == sorted(
        [("None", n, 0), ("7", n, n), ("7", n, n), ("7", n + 1, n), ("8", 0, 0), ("9", 200_000, 199_999)]
    )
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffixes_are_sorted():
    import numpy as np

    rng = random.Random(13)
    base = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(5)]
    strings = [(rng.choice(base)[: rng.randint(40, 60)] + bytes(rng.choice(b"abc") for _ in range(40)))[:70] for _ in range(400)]
    strings += strings[:50] + [base[0] + b"a" * 10] * 3
    matrix = np.frombuffer(b"".join(s.ljust(70, b"\0") for s in strings), np.uint8).reshape(-1, 70)
    order, lcp = suffix_sort.deep_shallow(matrix)
    rows = [matrix[i].tobytes() for i in order]
    assert rows == sorted(rows)
    assert lcp[1:].tolist() == [suffix_sort._common(a, b) for a, b in zip(rows, rows[1:])]
    distinct = sorted(set(rows), key=lambda s: rng.random())
    assert [distinct[i] for i in suffix_sort.BlindTrie(distinct).order()] == sorted(distinct)


# Chat formatting


def test_rotation(spark):
    schema = "conv_id long, turn long, role string, text string, part string, key string"
    rows = [
        (1, 0, "system", "Be kind."), (1, 2, "ann", "Hi."), (1, 1, "bob", None), (1, 1, "bob", None), (1, 2, "ann", "Also"),
        (2, None, None, "who"), (2, 0, "ann", "x" * 50_000), (None, 0, "eve", ""), (3, 0, "system", "only"),
    ] + [(4, i, "ab"[i % 2], f"t{i}") for i in range(600)]
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], schema)
    out = perspectives.rotate(frame).collect()
    assert sorted((str(r.conv_id), r.perspective, r.part) for r in out) == sorted(
        [("1", "ann", 0), ("1", "bob", 0), ("2", "ann", 0), ("2", "unknown", 0), ("None", "eve", 0)]
        + [("4", p, k) for p in "ab" for k in range(3)]
    )
    ann = next(r for r in out if r.conv_id == 1 and r.perspective == "ann")
    assert ann.rendered == (
        "<|system|>\nBe kind.<|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nAlso<|end|>\n<|assistant|>\nHi.<|end|>\n"
    )
    assert [ann.rendered[s.begin : s.end] for s in ann.mask] == ["Also<|end|>\n", "Hi.<|end|>\n"]
    for r in (r for r in out if r.conv_id == 4):
        own = [f"t{i}<|end|>\n" for i in range(r.part * 256, min(600, r.part * 256 + 256)) if "ab"[i % 2] == r.perspective]
        assert [r.rendered[s.begin : s.end] for s in r.mask] == own and r.n_own == len(own)
    assert perspectives.rotate(frame.limit(0)).count() == 0
