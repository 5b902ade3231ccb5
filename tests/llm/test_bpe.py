"""Byte-level BPE and the token store against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexispark.llm import bpe_trie, token_store

PATH = bpe_trie.default_tokenizer()
ODD = [
    "a", "the", "'s", "'re", " ", "  ", "\n", " \n", "\t", " ", "　", "é", "é", "中文", "😀", "23", "²",
    "<|endoftext|>", "!!", "\x1c", "\x85", "ing", "AAAA", "\x00", "supercalifragilistic",
]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("coder", [bpe_trie.encoder(PATH), token_store.library_coder(PATH)], ids=["trie", "library"])
def test_equals_library_on_odd_texts(coder, tok):
    texts = odd_texts(4000) + ["x" * 5000, "ab" * 3000, " " * 700 + "b"]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_cache_starts_anew(tok, monkeypatch):
    from lexispark.llm import pieces

    monkeypatch.setattr(pieces, "CACHE_PIECES", 10)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 10)
    vocabulary = pieces.Vocabulary(PATH)
    coder = pieces.PieceEncoder(vocabulary, bpe_trie.TrieEncoder(vocabulary).encode_words)
    for text in odd_texts(300, 6):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == want


def test_query_on_whole_table(spark, sample, tok):
    import hashlib

    got = {r.doc_id: r for r in bpe_trie.bpe_codes(spark, sample).collect()}
    docs = spark.read.parquet(f"{sample}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        text = tok.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edge_rows(spark, make_docs):
    docs = make_docs([(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "long " * 200_000)])
    docs = docs.withColumnRenamed("seed", "ids").withColumnRenamed("n", "decoded")
    rows = bpe_trie.encode_decode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids) // 4) for r in rows)[:4] == [(0, 0), (1, 0), (2, 2), (2, 2)]
    assert {r.decoded for r in rows if r.doc_id == 3} == {"long " * 200_000}
    assert bpe_trie.encode_decode(docs.limit(0), PATH).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 20_000))
    ph = token_store.PerfectHash.build(keys)
    assert sorted(ph.slots(keys)) == list(range(len(keys)))
    index = token_store.ShardIndex.build(keys, 0, np.ones(len(keys), np.int64))
    again = token_store.ShardIndex.from_bytes(index.to_bytes())
    assert (again.locate(keys) == np.arange(len(keys))).all()
    foreign = np.setdiff1d(keys + 1, keys)
    assert (again.locate(foreign) >= 0).sum() <= 1
    assert token_store.ShardIndex.build(keys[:0], 0, np.zeros(0, np.int64)).locate(keys[:5]).tolist() == [-1] * 5


def test_store_query(spark, sample, tok):
    got = {r.doc_id: r for r in token_store.token_store(spark, sample).collect()}
    start = 0
    for r in sorted(spark.read.parquet(f"{sample}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), crc)
        start += len(ids)


def test_store_edge_rows(spark, make_docs, tmp_path):
    docs = make_docs([(5, "hello world"), (None, "x"), (5, "abc"), (5, "abc"), (None, None), (-2, ""), (9, None)])
    folder = str(tmp_path / "store")
    manifest = token_store.write(docs, folder, PATH, 2)
    rows = token_store.read(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, -2, 5, 5, 5, 9]
    assert sorted(r.n_tokens for r in rows) == [1, 1, 1, 2, 2, 2, 3]
    store = token_store.Store(manifest, folder)
    assert store.get(-2) == [2] and store.get(9) == [2] and store.get(5)[-1] == 2
    assert [store.get(k) for k in (0, 1, 4, 100)] == [None] * 4
    empty = token_store.write(docs.limit(0), folder + "-empty", PATH, 2)
    assert token_store.read(empty, folder + "-empty").count() == 0
