"""The pipeline's stages, each on what the one before kept."""

import random

import corpus_pipeline
import pytest
from test_joins import brute_components, brute_lines, brute_overlaps
from tokenizers import Tokenizer

from lexispark.llm import bpe_trie, pu_quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = docs.collect()
    rng = random.Random(1)
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").filter("length(text) > 150").first().text
    rows = [tuple(r) for r in base] + [
        (5000, base[0].text, "en", "src0", 1), (5001, "Before it all. " + item + " After that.", "en", "src1", 2),
        (5002, None, None, None, None), (5003, "", "en", "src1", 0),
        (5004, " ".join(w if rng.random() > 0.001 else "changed" for w in base[1].text.split()), "en", "src2", 3),
    ]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        steps[name] = (before.collect(), docs.collect())
        assert name == "BPE encoding and decoding" or docs.columns == columns

    labels = spark.read.parquet(f"{folder}/labels.parquet")
    before, after = steps["quality classifier"]
    model = pu_quality.fit_on_labels(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    import numpy as np

    good = [r.doc_id for r in before if model.score(np.array([pu_quality.features(r.text or "")]))[0] >= 0.3]
    assert sorted(r.doc_id for r in after) == sorted(good) and len(after) < len(before)

    before, after = steps["line dedup"]
    want = brute_lines([(r.source, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {r.doc_id: t for r, t in zip(before, want)}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)

    before, after = steps["n-gram Jaccard join"]
    found = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(d for d, (_, c) in found.items() if c == d)

    before, after = steps["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    short = [(r.doc_id, r.text) for r in before if len(r.text or "") < 3000]
    flagged = {d for d, _ in brute_overlaps(short, items)}
    kept = {r.doc_id for r in after}
    assert flagged and not flagged & kept and {d for d, _ in short} - flagged <= kept

    before, after = steps["BPE encoding and decoding"]
    tok = Tokenizer.from_file(bpe_trie.default_tokenizer())
    texts = {r.doc_id: r.text or "" for r in before}
    assert len(after) == len(before)
    for r in after:
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes()


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and got.columns[:4] == ["doc_id", "lang", "source", "n_tokens"]


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))


def test_planted_lines_of_a_large_source(spark, make_docs):
    rng = random.Random(3)
    clean = ["\n".join(prose(rng, 12) for _ in range(5)) for _ in range(600)]
    planted = {prose(rng, 8): step for step in (10, 14, 20)}  # 10, 7 and 5 % of the documents
    texts = [
        "\n".join([*(x for x, step in planted.items() if i % step == 0), t]) for i, t in enumerate(clean)
    ]
    docs = make_docs([(i, t, "en", "big") for i, t in enumerate(texts)])
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_site_lines(spark, docs, "").collect()}
    assert got == dict(enumerate(clean))


def test_copies_are_no_boilerplate(spark, make_docs):
    rng = random.Random(5)
    footer = prose(rng, 6)
    other = ["\n".join([prose(rng, 12), prose(rng, 12), footer]) for _ in range(40)]
    copied = [prose(rng, 30) for _ in range(5)]
    near = ["\n".join([*copied[:-1], " ".join([*copied[-1].split()[:-1], f"end{i}"])]) for i in range(10)]
    texts = ["\n".join(copied)] * 20 + near + other
    docs = make_docs([(i, t, "en", "src") for i, t in enumerate(texts)])
    cleaned = corpus_pipeline.drop_site_lines(spark, docs, "")
    got = {r.doc_id: r.text for r in cleaned.collect()}
    assert all(got[i] == t for i, t in enumerate(texts[:30]))
    assert all(got[30 + i] == "\n".join(t.split("\n")[:2]) for i, t in enumerate(other))
    kept = [r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, cleaned, "").collect()]
    assert sorted(kept) == [0, *range(30, 70)]
