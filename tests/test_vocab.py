"""Vocabularies, postings and encoding beyond what the oracles see."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lexispark.catalog import QUERIES
from lexispark.operators import vocab


def pieces(spark, docs):
    words = vocab.word_table(docs)
    return words.withColumn("language", F.lit("vie")).withColumn("pieces", F.array("word"))


def test_large_ids_and_long_documents(spark):
    base = 1 << 41
    docs = spark.createDataFrame(
        [(base + 2, "b c a"), (base + 1, "d " * 3000 + "b"), (1 << 62, "e")], "doc_id long, text string"
    )
    got = vocab.piece_vocabulary(pieces(spark, docs)).orderBy("id").collect()
    assert [r.token for r in got][5:] == ["d", "b", "c", "a", "e"]


def test_documents_without_words_are_encoded(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "z")], "doc_id long, text string")
    known = pieces(spark, docs.filter("doc_id = 1"))
    ids = vocab.word_ids(known, vocab.piece_vocabulary(known))
    got = {r.doc_id: r.ids for r in vocab.encode(docs, ids).collect()}
    assert got == {1: [5, 6], 2: [], 3: [], 4: [vocab.UNK]}


def test_terms_are_numbered_without_a_cap(spark):
    rows = [(d, f"t{i:03d}") for i in range(300) for d in range(1 + i % 4)]
    tokens = spark.createDataFrame(rows, "doc long, token string")
    got = vocab.term_vocabulary(tokens, "doc", "token").orderBy("id").collect()
    assert [r.id for r in got] == list(range(300))
    assert [r.token for r in got] == [t for _, t in sorted((-(1 + i % 4), f"t{i:03d}") for i in range(300))]
    assert vocab.term_vocabulary(tokens, "doc", "token", max_size=7).count() == 7


def test_no_list_is_shuffled_by_token_alone(spark):
    docs = spark.createDataFrame([(d, ["a", "b"]) for d in range(50)], "doc long, tokens array<string>")
    index = vocab.inverted_index(docs, "doc", "tokens", 5, docs_per_segment=10)
    assert index.filter("token = 'a'").count() == 5
    assert {r.doc_freq for r in index.collect()} == {50}
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_map_only_queries_do_not_shuffle(spark):
    plan = QUERIES["filter_bad_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def one_by_one(words, least):
    """Merge the most frequent pair, count anew, and so on."""
    state, learnt = {w: list(w) for w in words}, []
    while True:
        counts = Counter()
        for w, x in state.items():
            for pair in zip(x, x[1:]):
                counts[pair] += words[w]
        if not counts:
            return learnt
        (a, b), n = min(counts.items(), key=lambda e: (-e[1], e[0]))
        if n < least:
            return learnt
        learnt.append((a, b, n))
        for w, x in state.items():
            out = []
            for sym in x:
                if out and out[-1] == a and sym == b:
                    out[-1] = a + b
                else:
                    out.append(sym)
            state[w] = out


def test_merges_equal_one_by_one_merging(spark):
    rng = random.Random(4)
    syllables = ["ba", "na", "an", "aa", "tion", "er", "\\E", "$1", "é", "th"]
    found = Counter("".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(700))
    found |= Counter({"aaaaaaa": 9, "z": 50, "": 3})
    words = spark.createDataFrame(list(found.items()), "word string, n long")
    want = one_by_one(found, 5)
    assert len(want) > 60
    assert vocab.learn_merges(words, min_frequency=5) == want
    assert vocab.learn_merges(words, merges=7) == want[:7]
    assert vocab.learn_merges(words.limit(0)) == []


def test_rounds_take_what_is_not_in_the_way():
    ranked = [("t", "h", 90), ("i", "n", 80), ("a", "n", 80), ("h", "e", 70), ("o", "u", 60)]
    assert vocab.independent_merges(ranked, True) == ranked[:3]
    assert vocab.independent_merges([("a", "a", 9), ("b", "c", 8)], True) == [("a", "a", 9)]
    assert vocab.independent_merges([("a", "b", 9), ("b", "c", 9), ("d", "e", 9)], True) == [("a", "b", 9)]
    assert vocab.independent_merges(ranked[:3], False) == ranked[:1]


def test_encode_moves_a_word_once_a_block(spark):
    rows = [(1, "a b a"), (2, None), (3, ""), (2000, "b zz a"), (None, "a"), (7, "a"), (7, "b b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = spark.createDataFrame([("a", [5, 6]), ("b", [7])], "word string, ids array<bigint>")
    out = vocab.encode(docs, ids)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" not in plan and "array_distinct" in plan and "Aggregate [block" in plan
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got.pop(7) in ([5, 6, 7, 7], [7, 5, 6, 7])
    assert got == {1: [5, 6, 7, 5, 6], 2: [], 3: [], 2000: [7, 1, 5, 6], None: [5, 6]}
