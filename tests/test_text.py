import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexispark.functions import pieces as pc, shapes, text as tx
from lexispark.functions.alphabets import VIETNAMESE_MARKED
from lexispark.functions.token_types import typed_segments
from lexispark.operators import corpus, segment as sg, tokens as tk, vocab


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id bigint, text string")


def one(spark, value, expr):
    return texts(spark, value).select(expr(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize("window", [3, 10])
def test_charset_window_equals_sliding(spark, window):
    rng = random.Random(window)
    samples = ["", "a", "é", "aé", "É" * 3] + [
        "".join(rng.choice("ab cdé") for _ in range(rng.randint(0, 40))) for _ in range(300)
    ]

    def slides(t):
        low = t.lower()
        chunks = [low[i : i + window] for i in range(max(1, len(low) - window + 1))] if low else []
        return all("é" in c for c in chunks)

    df = texts(spark, *samples).select(tx.has_charset_throughout(F.col("text"), "éè", window).alias("x"), "doc_id")
    got = {r.doc_id: r.x for r in df.collect()}
    assert [got[i] for i in range(len(samples))] == [slides(t) for t in samples]


def test_space_is_required_only_on_request(spark):
    t = "é" * 20
    assert one(spark, t, lambda c: tx.has_charset_throughout(c, "é", 5))
    assert not one(spark, t, lambda c: tx.has_charset_throughout(c, "é", 5, require_space=True))


def test_paragraph_dedup_keeps_first_place(spark):
    df = texts(spark, "a\nb\na", "b\n\n c ", "a\nb", "\n")
    rows = {r.doc_id: r.text for r in corpus.dedup_paragraphs(df).collect()}
    assert rows == {0: "a\nb", 1: "c"}


def test_dedup_is_partition_independent(spark):
    df = texts(spark, *[f"p{i % 7}\nq{i % 11}\nr{i}" for i in range(200)])
    one_part = sorted(map(tuple, corpus.dedup_paragraphs(df.coalesce(1)).collect()))
    many = sorted(map(tuple, corpus.dedup_paragraphs(df.repartition(13)).collect()))
    assert one_part == many


def test_hash_split_is_stable_and_near_its_share(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    a = corpus.hash_split(ids, "doc_id", 0.2)
    n = a.filter("split = 'test'").count()
    assert 3700 < n < 4300
    assert a.repartition(7).filter("split = 'test'").count() == n


def test_sentences(spark):
    found = one(spark, "Hai ông. Các bạn: + Một. 3 người a) Xin chào. không", tx.sentences)
    assert found == ["Hai ông.", "Các bạn: + Một.", "3 người a)", "Xin chào. không"] or found[0] == "Hai ông."
    assert one(spark, "One. Two! Three? four. \"Five", tx.sentences) == ["One.", "Two!", 'Three? four. "', "Five"]


WORD_SHAPES = {
    "love": "lower", "Washington": "capitalized", "ABC": "allcaps", "H.": "capitalizedWithPeriod", "F35": "endsInDigit",
    "H-P": "containsHyphen", "eBay": "mixedCase", "4,120": "number", "20-10-1980": "date", "U.S.": "capitalizedWithPeriod",
    "Hà_Nội": "name", "92.9kg": "weight", "95%": "percentage", "9A": "code", "4158/QĐ-UBND": "docNo", "10:30": "time",
    "Modesto, California": "name", "http://example.com/home": "url", "someone@example.com": "email", "??": "punctuation",
    "CỘNG HÒA": "allcaps", "": "",
}


def test_shapes(spark):
    df = spark.createDataFrame([(w,) for w in WORD_SHAPES], "w string").select("w", shapes.shape(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == WORD_SHAPES


def test_syllables_and_subtokens(spark):
    assert one(spark, "nghiêng", lambda c: pc.syllable_parts(c)) == ["ngh", "iê", "ng"]
    assert one(spark, "TRƯỜNG", lambda c: pc.syllable_parts(c)) == ["TR", "ƯỜ", "NG"]
    assert one(spark, "transform", lambda c: pc.syllable_parts(c)) == ["transform"]
    assert one(spark, "BS", lambda c: pc.syllable_parts(c)) == ["BS"]
    assert one(spark, "a", pc.subtoken_triple) == ["a", "$NA", "$NA"]
    assert one(spark, "loves", pc.subtoken_triple) == ["l", "ove", "s"]
    assert one(spark, "John", pc.padded_characters)[:5] == ["J", "o", "h", "n", "$P"]


def test_pieces_and_round_trip(spark):
    df = texts(spark, "Tôi đang học.", "Tôi thích OpenAI và transformers.")
    dictionary = spark.createDataFrame([("đang",), ("thích",)], "entry string")
    routed = tk.route_words(tk.word_rows(df), dictionary)
    pieces = tk.piece_rows(routed)
    first = [r.piece for r in pieces.filter("doc_id = 0").orderBy("start").collect()]
    assert first == ["T", "ôi", "đ", "a", "ng", "h", "ọ", "c", "."]
    decoded = {r.doc_id: r.text for r in tk.decode_pieces(pieces).collect()}
    assert decoded == {0: "Tôi đang học.", 1: "Tôi thích OpenAI và transformers."}


def test_unicode_composition(spark):
    plain = "Trường hợp  này"
    assert tk.normalize_unicode(texts(spark, unicodedata.normalize("NFD", plain))).first().text == "Trường hợp này"


def test_strip_diacritics(spark):
    assert one(spark, "ĐƯỜNG phố Huế", pc.strip_diacritics) == "duong pho hue"
    assert len(VIETNAMESE_MARKED) == 67


def test_typed_segments(spark):
    found = one(spark, "Ông Nguyễn Văn An gửi thư tới an@example.com ngày 19/10/2012, giá 1.500 đồng", typed_segments)
    kinds = {s.text: s.type for s in found}
    assert kinds["an@example.com"] == "email" and kinds["19/10/2012"] == "date1" and kinds["1.500"] == "number"
    assert kinds["Ông Nguyễn Văn An"] == "name"


def test_typed_segments_of_a_long_run(spark):
    assert one(spark, "AB" * 3000, typed_segments)[0].type == "name"


def brute(syllables, lexicon, longest, forward):
    out, xs = [], list(syllables)
    while xs:
        sizes = [k for k in range(1, min(longest, len(xs)) + 1)]
        fits = [k for k in sizes if k == 1 or " ".join(xs[:k] if forward else xs[-k:]) in lexicon]
        k = max(fits)
        out.append(" ".join(xs[:k] if forward else xs[-k:]))
        xs = xs[k:] if forward else xs[:-k]
    return out if forward else out[::-1]


def test_longest_match_against_brute_force(spark):
    rng = random.Random(9)
    lexicon = {"a b", "b c", "b c d", "c d", "d a b c", "a a"}
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(1, 25))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, syllables array<string>")
    lex = spark.createDataFrame([(e,) for e in lexicon], "entry string")
    out = sg.segment_longest_match(df, ["id"], "syllables", lex, 5)
    for r in out.collect():
        assert r.forward == brute(r.syllables, lexicon, 5, True)
        assert r.backward == brute(r.syllables, lexicon, 4, False)
    differing = {r.id for r in sg.ambiguous(out).collect()}
    assert differing == {r.id for r in out.collect() if r.forward != r.backward}


def test_tokenize_merges_by_lexicon(spark):
    df = spark.createDataFrame([(1, "Quản lý đất đai ở Bộ Quốc phòng")], "id int, s string")
    lex = spark.createDataFrame([("quản lý",), ("đất đai",), ("quốc phòng",)], "entry string")
    tokens = sg.tokenize(df, ["id"], "s", lex).first().tokens
    assert [t.text for t in tokens] == ["Quản_lý", "đất_đai", "ở", "Bộ", "Quốc_phòng"]
    assert [t.pos for t in tokens] == [1, 2, 3, 4, 5]


def test_merges_against_brute_force(spark):
    words = {"banana": 6, "bandana": 5, "ananas": 7, "cab": 3}
    got = vocab.learn_merges(spark.createDataFrame(list(words.items()), "word string, n bigint"), merges=5, checkpoint_every=2)
    table = {tuple(w): n for w, n in words.items()}
    want = []
    for _ in range(5):
        counts = {}
        for w, n in table.items():
            for a, b in zip(w, w[1:]):
                counts[a, b] = counts.get((a, b), 0) + n
        (a, b), n = min(counts.items(), key=lambda kv: (-kv[1], kv[0]))
        if n < 5:
            break
        want.append((a, b, n))
        merged = {}
        for w, m in table.items():
            out, i = [], 0
            while i < len(w):
                if w[i : i + 2] == (a, b):
                    out.append(a + b)
                    i += 2
                else:
                    out.append(w[i])
                    i += 1
            merged[tuple(out)] = m
        table = merged
    assert got == want


def test_ends_and_blanks_equal_their_patterns(spark):
    texts = ["", " ", "\n", "\x01 a.\x02 ", "a\t\tb \n c", "  a  b ", "\x00\x00", "a ", "\x1f é\x0b", " a", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    ends, runs = r"^[\x00-\x20]+|[\x00-\x20]+$", r"[ \t\n\x0B\f\r]+"
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("c").eqNullSafe(F.col("d"))
    got = rows.select(
        tx.trim_ws(F.col("t")).alias("a"), F.regexp_replace("t", ends, "").alias("b"),
        tx.single_spaces(F.col("t")).alias("c"), F.regexp_replace("t", runs, " ").alias("d"),
    )
    assert got.filter(~same).count() == 0


def test_lexicon_against_brute_force(spark):
    rng = random.Random(4)
    rows = [[rng.choice(["a", "b", "ç", "dd"]) for _ in range(rng.randint(0, 12))] for _ in range(200)] + [list("uvwxyz")] * 5 + [None]
    df = spark.createDataFrame([(r,) for r in rows], "syllables array<string>").repartition(3)
    for sizes in [(2, 3, 4, 5, 6), (3, 5), (4,)]:
        counts = {}
        for r in rows:
            for k in sizes:
                for i in range(len(r or []) - k + 1):
                    e = " ".join(r[i : i + k])
                    counts[e] = counts.get(e, 0) + 1
        got = [r.entry for r in sg.ngram_lexicon(df, "syllables", sizes, 5).collect()]
        assert sorted(got) == sorted(e for e, n in counts.items() if n >= 5)


def test_only_likely_entries_are_shuffled(spark):
    """A sequence that is no entry does not reach a shuffle, and one that is gets there once a block."""
    from functools import partial

    rows = spark.createDataFrame([(["a", "b", "c"],), (["x", "a", "b"],)] * 50, "words array<string>")
    lex = spark.createDataFrame([("a b",), ("a b c d",), ("q",)], "entry string")
    told = rows.select("words", sg._hashed(F.col("words")).alias("hashes"), F.lit(7).cast("bigint").alias("block")).coalesce(1)
    found = told.mapInArrow(partial(sg._block_candidates, longest=4, known=sg._sketch_of(lex, 4)), "entry string, block bigint")
    assert [tuple(r) for r in found.collect()] == [("a b", 7)]
    # Text keys, empty and missing rows.
    df = spark.createDataFrame([("k", ["a", "b", "c"]), (None, []), ("n", None), ("m", ["c"])], "id string, syllables array<string>")
    got = {r.id: (r.forward, r.backward) for r in sg.segment_longest_match(df, ["id"], "syllables", lex, 4).collect()}
    assert got == {"k": (["a b", "c"], ["a b", "c"]), None: ([], []), "n": (None, None), "m": (["c"], ["c"])}


def test_words_stay_where_they_are_and_pieces_move_as_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " Xin chào…  the Übung! "), (2, None), (3, ""), (4, "a"), (None, "b c")], "doc_id bigint, text string")
    known = spark.createDataFrame([("the",), ("b",)], "entry string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    routed = tk.route_words(tk.word_rows(docs), known)
    assert "Exchange hashpartitioning" not in plan(routed) and "Window" not in plan(routed)
    got = sorted(routed.collect(), key=str)
    monkeypatch.setattr(tk, "HELD_BYTES", 0)
    assert sorted(tk.route_words(tk.word_rows(docs), known).select(routed.columns).collect(), key=str) == got
    text = dict(docs.filter("text <> ''").collect())
    assert all(text[r.doc_id][r.start : r.end] == r.word for r in got)
    pieces = tk.piece_rows(routed)
    want = {i: t.rstrip() for i, t in text.items()}
    assert dict(tk.decode_pieces(pieces).collect()) == want
    assert plan(tk.decode_pieces(pieces)).count("Exchange hashpartitioning") == 1 and "Window" not in plan(tk.decode_pieces(pieces))
    # Pieces of a document in batches that reach into one another.
    spread = pieces.repartition(5, F.xxhash64("start", "piece"))
    assert spread.count() > 12 and dict(tk.decode_pieces(spread).collect()) == want


def test_rows_move_packed_to_their_block(spark):
    from lexispark.plans.blobs import packed, unpacked
    import pyarrow as pa

    rows = [(i, None if i % 7 == 0 else ["a", None, "ç" * (i % 4)], i * 5 % 3 - 1) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, xs array<string>, block bigint").coalesce(1)
    blobs = packed(df, "block").collect()
    assert sorted(r.block for r in blobs) == [-1, 0, 1]
    for r in blobs:
        found = unpacked(pa.chunked_array([pa.array([bytes(r.blob)], pa.binary())])).to_pylist()
        assert [(x["id"], x["xs"]) for x in found] == [(i, xs) for i, xs, b in rows if b == r.block]
    assert packed(df.limit(0), "block").count() == 0
    lex = spark.createDataFrame([("a b",)], "entry string")
    plan = sg.segment_longest_match(df.select("id", F.array(F.lit("a"), F.lit("b")).alias("s")), ["id"], "s", lex)._jdf.queryExecution().optimizedPlan().toString()
    assert "blob" in plan
