"""Learnt operators: held-out accuracy, method and edge rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import pu_quality, toxicity, weak_quality

SF = "/root/testdata/sf0.01"


def held_out(spark, out, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return out.filter("held_out").join(labels, "doc_id").select("predicted", "score", "y").toPandas()


def test_quality_held_out(spark):
    got = held_out(spark, pu_quality.quality_classifier(spark, SF), "quality")
    assert (got.predicted == got.y).mean() >= 0.95
    assert (got[got.y == 1].predicted == 1).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold some ten toxic texts to learn from
    out = toxicity.toxicity(spark, sf).filter("held_out")
    got = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.96
    assert (got[got.toxic == 1].predicted == 1).mean() > 0.75
    assert (got[got.predicted == 1].passages.str.len() > 0).mean() > 0.9


def test_toxicity_held_out_of_few(spark):
    got = held_out(spark, toxicity.toxicity(spark, SF), "toxic")
    assert got.score.nunique() > 2
    assert (got[got.y == 1].predicted == 1).mean() >= 0.5 and (got[got.y == 0].predicted == 0).mean() >= 0.95


def test_log_odds_leave_no_token_out():
    counts = np.array([[0, 1], [1, 0], [2, 0], [8, 0], [0, 60], [30, 300]], float).T
    odds = toxicity.shrunk_log_odds(*counts, np.array([5000, 600, 50, 12, 40, 400]))
    assert 0 < odds[1] < odds[2] < odds[3] and odds[4] < odds[0] < 0 and abs(odds[5]) < 0.1


def test_model_edge_rows(spark, make_docs):
    docs = make_docs([(1, None), (None, ""), (2, "   "), (3, "one"), (3, "one"), (4, "word " * 100_000)])
    labels = spark.createDataFrame([(3, 1, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model = pu_quality.fit(docs, labels.filter("quality = 1"), docs)
    rows = pu_quality.score(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and rows[0].n == "own"
    none = pu_quality.fit(docs, labels.limit(0), docs.limit(0))
    assert {r.score for r in pu_quality.score(docs, none).collect()} == {0.5}
    assert pu_quality.score(docs.limit(0), model).count() == 0
    toxic = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, toxic).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.passages == [] for r in rows if not (r.text or "").strip())
    nothing = toxicity.fit(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(docs, nothing).collect())


def test_prior_of_mixture():
    rng = np.random.default_rng(1)
    p = rng.normal(2, 1, 4000)
    u = np.where(rng.random(6000) < 0.7, rng.normal(2, 1, 6000), rng.normal(-3, 1, 6000))
    assert abs(pu_quality.estimate_prior(p, u) - 0.7) < 0.05


def brute_segments(values):
    """Maximal segments by their definition: repeatedly the best segment, then what is left and right of it."""
    def cut(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += values[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j)
        if best is None:
            return []
        total, i, j = best
        return cut(a, i) + [(i, j, total)] + cut(j + 1, b)

    return cut(0, len(values))


def test_segments_equal_definition():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 25)
        hits = sorted(rng.sample(range(n), rng.randint(0, n)))
        values = [rng.uniform(0.5, 4.5) for _ in hits]  # no ties
        full = [-0.8] * n
        for i, v in zip(hits, values):
            full[i] = v
        want = [(i, j, round(s, 6)) for i, j, s in brute_segments(full)]
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(hits, values, 0.8)] == want


def brute_counts(text):
    import re
    from collections import Counter

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside),
        n < 10 or 100 * len(inside) > 20 * n,
    )


def test_rules_counts_and_posterior(spark, make_docs):
    rng = random.Random(4)
    texts = [None, "", "   \n", "a b c d e a b c d e", "x\ny\nx\n \n", "a  b\tc\x0bd\x0ce\r\nf"] + [
        " ".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(60)
    ]
    texts += ["word " * 30_000, "Fine text of plain words, with no odd signs in it at all."] * 2
    texts += [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}x*** ###" for _ in range(30)) for _ in range(6)]
    docs = make_docs(list(enumerate(texts)) + [(None, "no id")])
    got = {r.doc_id: r for r in weak_quality.judge(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        r = got[i]
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert counts == brute_counts(t), repr(t)[:80]
        assert not (r.kept and r.base_failed)
    assert weak_quality.judge(docs.limit(0)).count() == 0


def test_em_equals_plain_loop(spark):
    rng = random.Random(9)
    names = ["a", "b", "c"]
    rows = []
    for _ in range(400):
        y = 1 if rng.random() < 0.8 else -1
        rows.append(tuple(0 if rng.random() < 0.3 else (y if rng.random() < q else -y) for q in (0.9, 0.8, 0.95)))
    got = weak_quality.fit_accuracies(spark.createDataFrame(rows, "a int, b int, c int"), names).first()["model"]
    p = [0.2 if min(r) < 0 else 0.95 for r in rows]
    for _ in range(weak_quality.ROUNDS + 1):
        share = (sum(p) + 1) / (len(p) + 2)
        g, b = [], []
        for j in range(3):
            for out, w, s in ((g, p, 1), (b, [1 - x for x in p], -1)):
                right = sum(x for x, r in zip(w, rows) if r[j] == s)
                spoke = sum(x for x, r in zip(w, rows) if r[j] != 0)
                out.append((right + weak_quality.RIGHT) / (spoke + weak_quality.RIGHT + weak_quality.WRONG))
        p = []
        for r in rows:
            z = math.log(share / (1 - share))
            for j, v in enumerate(r):
                z += math.log(g[j] / (1 - b[j])) if v > 0 else math.log((1 - g[j]) / b[j]) if v < 0 else 0
            p.append(1 / (1 + math.exp(-z)))
    assert got["share"] == pytest.approx(share, abs=1e-6)
    assert list(got["on_good"]) == pytest.approx(g, abs=1e-6)
    assert list(got["on_bad"]) == pytest.approx(b, abs=1e-6)


def test_rules_agree_with_labels(spark):
    got = weak_quality.quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    judged = got[~got.base_failed]
    assert (judged.kept == (judged.quality == 1)).mean() > 0.97


def plain_shrinkage(tokens):
    """Shrunk log-odds of (toxic, other) counts, a token at a time."""
    import math

    share = sum(a for a, _ in tokens) / sum(a + b for a, b in tokens)
    if not 0 < share < 1:
        return [0.0] * len(tokens)
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)

    def likelihood(m):
        return [beta(a + m * share, b + m * (1 - share)) - beta(m * share, m * (1 - share)) for a, b in tokens]

    best = None
    for dull in map(likelihood, toxicity.DULL_PRIORS):
        for m in toxicity.TELLING_PRIORS:
            telling, weight = likelihood(m), 0.01
            for _ in range(40):
                tells = [
                    1 / (1 + math.exp(max(-500, min(500, x + math.log(1 - weight) - y - math.log(weight)))))
                    for x, y in zip(dull, telling)
                ]
                weight = min(0.5, max(1e-6, sum(tells) / len(tells)))
            both = [np.logaddexp(x + math.log(1 - weight), y + math.log(weight)) for x, y in zip(dull, telling)]
            if best is None or sum(both) > best[0]:
                best = sum(both), m, tells
    _, m, tells = best
    return [
        t * (math.log(a / (m * share) + 1) - math.log(b / (m * (1 - share)) + 1)) for t, (a, b) in zip(tells, tokens)
    ]


def test_toxicity_fit_equals_plain_loops(spark):
    import math
    from hashlib import md5
    from zlib import crc32

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labelled = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {}
    for r in docs.collect():
        if labelled.get(r.doc_id) is not None:
            digest = md5((r.text or "").encode()).hexdigest()
            texts[digest] = (r.text, max(labelled[r.doc_id], texts.get(digest, (0, 0))[1]), crc32(digest.encode()) % toxicity.FOLDS)
    texts = [(toxicity.words_of(t), y, f) for t, y, f in texts.values()]
    assert sum(y for _, y, _ in texts) > 3

    def odds(rows):
        held = {}
        for words, y, _ in rows:
            for w in set(words):
                a, b = held.get(w, (0, 0))
                held[w] = (a + y, b + 1 - y)
        every = {w: held.get(w, (0, 0)) for words, _, _ in texts for w in words}
        return dict(zip(every, plain_shrinkage(list(every.values()))))

    gap = -math.log(1 - toxicity.SHARE_INSIDE)
    told, chances, harmless = [], [], []
    for fold in range(toxicity.FOLDS):
        known = odds([t for t in texts if t[2] != fold])
        for words, y, f in texts:
            if f == fold:
                values = [known[w] - gap for w in words]
                found = [s for _, _, s in toxicity.segments(range(len(words)), values, 0.0)]
                told.append((y, len(words), found))
                if not y and words:
                    chances += [round(v / toxicity.BIN) * toxicity.BIN for v in values]
                    harmless.append((len(words), max(found, default=0.0)))
    model = toxicity.fit(docs, labels)
    assert abs(sum(math.exp(model.decay * v) for v in chances) / len(chances) - 1) < 1e-6
    factor = len(harmless) / sum(n * math.exp(-model.decay * s) for n, s in harmless)
    assert abs(model.factor / factor - 1) < 1e-6
    final = odds(texts)
    assert all(abs(model.value(w) + gap - v) < 1e-9 for w, v in final.items())
    # The weights are where the penalised likelihood has no slope.
    slope, c = [0.0, 0.0, 0.0], model.weights
    for y, n, found in told:
        expect = sorted((model.decay * s - math.log(factor * max(1, n)) for s in found), reverse=True)
        a = min(50.0, math.log1p(math.exp(expect[0])) + sum(max(0.0, x) for x in expect[1:])) if expect else 0.0
        x = (a, 1.0 if expect else 0.0, 1.0)
        p = 1 / (1 + math.exp(-sum(u * v for u, v in zip(x, c))))
        slope = [s + (p - y) * u for s, u in zip(slope, x)]
    assert all(abs(s + r * v) < 1e-3 for s, r, v in zip(slope, (0.05, 0.05, 1e-6), c))
