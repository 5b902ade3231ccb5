"""Vocabulary, index, encoding and packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.catalog.registry import query, table
from lexispark.catalog.sqlparts import numbered, words_sql
from lexispark.catalog.textual import dictionary, docs, parts_sql, pieces_sql, triple_sql
from lexispark.functions import text as tx
from lexispark.functions.draws import MODULUS, draw_sql
from lexispark.operators import packing, tokens as tk, vocab
from lexispark.plans.checkpoints import cut_lineage

BIG = "bigint"


def doc_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(tx.words(F.lower("text"))).alias("token"))


_DOC_TOKENS = f"(SELECT doc_id, unnest({words_sql('lower(text)')}) AS token FROM documents)"
_TERMS = f"""(
  SELECT token, doc_freq, term_freq, row_number() OVER (ORDER BY term_freq DESC, token) - 1 AS id FROM (
    SELECT token, count(DISTINCT doc_id) AS doc_freq, count(*) AS term_freq FROM {_DOC_TOKENS} GROUP BY token
  ) WHERE doc_freq >= 2)"""


def terms(spark, sf):
    return vocab.term_vocabulary(doc_tokens(spark, sf), "doc_id", "token", min_df=2)


@query("term_vocabulary", f"SELECT token, doc_freq, term_freq, id FROM {_TERMS}")
def term_vocabulary(spark, sf):
    return terms(spark, sf)


@query(
    "inverted_index",
    f"""
    SELECT token, CAST(doc_id // 256 AS BIGINT) AS segment, any_value(df) AS doc_freq,
           string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS docs
    FROM (SELECT token, doc_id, count(*) OVER (PARTITION BY token) AS df
          FROM (SELECT DISTINCT token, doc_id FROM {_DOC_TOKENS})) WHERE df >= 5 GROUP BY token, doc_id // 256
    """,
)
def inverted_index(spark, sf):
    tokens = docs(spark, sf).select("doc_id", tx.words(F.lower("text")).alias("tokens"))
    index = vocab.inverted_index(tokens, "doc_id", "tokens", 5, docs_per_segment=256)
    return index.select(
        "token", "segment", "doc_freq", F.array_join(F.col("docs").cast("array<string>"), " ").alias("docs")
    )


# Piece vocabulary of the documents.
_PIECES = pieces_sql("documents")
_VOCAB = f"""(
  SELECT 5 + row_number() OVER (ORDER BY first_at) - 1 AS id, token, source, language, frequency FROM (
    SELECT piece AS token, count(*) AS frequency, min(doc_id * 67108864 + word_no * 4 + piece_no) AS first_at,
           arg_min(language, doc_id * 67108864 + word_no * 4 + piece_no) AS language,
           arg_min(source, doc_id * 67108864 + word_no * 4 + piece_no) AS source
    FROM {_PIECES} GROUP BY piece)
  UNION ALL SELECT i, ['<pad>', '<unk>', '<s>', '</s>', '<mask>'][i + 1], 'pad', 'pad', 1 FROM range(5) AS r(i))"""


def split_words(spark, sf):
    return vocab.word_pieces(vocab.word_table(docs(spark, sf)), dictionary(spark, sf))


@query("piece_vocabulary", f"SELECT CAST(id AS BIGINT) AS id, token, source, language, frequency FROM {_VOCAB}")
def piece_vocabulary(spark, sf):
    return vocab.piece_vocabulary(split_words(spark, sf))


@query(
    "piece_vocabulary_pruned",
    f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, token, source, language, frequency FROM {_VOCAB} "
    "WHERE language = 'pad' OR frequency >= 5",
)
def piece_vocabulary_pruned(spark, sf):
    return vocab.prune_vocabulary(vocab.piece_vocabulary(split_words(spark, sf)), 5)


def encoded(spark, sf):
    # Distinct words serve the vocabulary and the encoding: computed once.
    pieces = cut_lineage(split_words(spark, sf))
    return vocab.encode(docs(spark, sf), vocab.word_ids(pieces, vocab.piece_vocabulary(pieces)))


_IDS = f"(SELECT p.doc_id, p.word_no, p.piece_no, CAST(v.id AS BIGINT) AS id FROM {_PIECES} p JOIN {_VOCAB} v ON v.token = p.piece)"


@query(
    "encode_pieces",
    f"""
    SELECT doc_id, '2 ' || string_agg(CAST(id AS VARCHAR), ' ' ORDER BY word_no, piece_no) || ' 3' AS input_ids
    FROM {_IDS} GROUP BY doc_id
    """,
)
def encode_pieces(spark, sf):
    ids = packing.with_specials(F.col("ids")).cast("array<string>")
    return encoded(spark, sf).select("doc_id", F.array_join(ids, " ").alias("input_ids"))


def _packed_sql(length: int, padded: bool) -> str:
    body = f"string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos)"
    tail = f"|| repeat(' 0', CAST({length} - count(*) AS INT))" if padded else ""
    having = "" if padded else f"HAVING count(*) = {length}"
    return f"""
      SELECT shard, CAST(pos // {length} AS BIGINT) AS seq_no, '2 ' || {body} {tail} || ' 3' AS input_ids
      FROM (SELECT doc_id % 4 AS shard, id,
                   row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id, word_no, piece_no) - 1 AS pos FROM {_IDS})
      GROUP BY shard, pos // {length} {having}"""


def _packed(spark, sf, length, drop_last):
    out = packing.pack_sequences(
        encoded(spark, sf), length, F.pmod("doc_id", F.lit(4)), drop_last, docs_per_block=256
    )
    return out.withColumn("input_ids", F.array_join(F.col("input_ids").cast("array<string>"), " "))


@query("pack_sequences", _packed_sql(512, False))
def pack_sequences(spark, sf):
    return _packed(spark, sf, 512, True)


@query("pack_sequences_padded", _packed_sql(100, True))
def pack_sequences_padded(spark, sf):
    return _packed(spark, sf, 100, False)


def talk(spark, sf):
    """Conversation turns with lower-case words."""
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.words(F.lower("text")).alias("words"))


def talk_ids(spark, sf, oov: int):
    rows = talk(spark, sf).select("conv_id", "turn", F.posexplode("words").alias("pos", "token"))
    found = vocab.lookup(
        rows, terms(spark, sf), "token", "id", F.lit(oov).cast(BIG), ["conv_id", "turn", "pos"]
    )
    return (
        found.groupBy("conv_id", "turn")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
        .select("conv_id", "turn", F.col("x.id").alias("ids"))
    )


def talk_ids_sql(oov: int) -> str:
    rows = numbered(words_sql("lower(text)"), "conv_id, turn", "conversations", "token")
    return f"""(
      SELECT conv_id, turn, list(coalesce(t.id, {oov}) ORDER BY i) AS ids
      FROM {rows} r LEFT JOIN {_TERMS} t USING (token) GROUP BY conv_id, turn)"""


def joined(c):
    return F.array_join(c.cast("array<string>"), " ")


@query(
    "lookup_token_ids",
    f"SELECT conv_id, turn, array_to_string(ids, ' ') AS ids FROM {talk_ids_sql(1)}",
)
def lookup_token_ids(spark, sf):
    return talk_ids(spark, sf, 1).withColumn("ids", joined(F.col("ids")))


@query(
    "pad_sequences",
    f"""
    SELECT conv_id, turn,
           array_to_string((ids || list_transform(range(20), lambda x: -1))[1:20], ' ') AS right_padded,
           array_to_string(list_transform(range(20 - len(ids[1:20])), lambda x: 0) || ids[1:20], ' ') AS left_padded
    FROM {talk_ids_sql(0)}
    """,
)
def pad_sequences(spark, sf):
    ids = F.col("ids")
    return talk_ids(spark, sf, 0).select(
        "conv_id",
        "turn",
        joined(packing.pad_right(ids, 20, -1)).alias("right_padded"),
        joined(packing.pad_left(ids, 20, 0)).alias("left_padded"),
    )


@query(
    "encoder_blocks",
    f"""
    SELECT conv_id, turn, array_to_string(
             (ids || list_transform(range(30), lambda x: -1))[1:30] || list_transform(range(30), lambda x: 0)
             || (range(len(ids)) || list_transform(range(30), lambda x: -1))[1:30]
             || (list_transform(ids, lambda x: 1) || list_transform(range(30), lambda x: 0))[1:30], ' ') AS block,
           array_to_string(z || list_transform(range(30), lambda x: 0) || range(30)
             || list_transform(range(30), lambda i: CASE WHEN i < last THEN 1 ELSE 0 END), ' ') AS block_of_padded
    FROM (SELECT *, list_max(list_transform(range(30), lambda i: CASE WHEN z[i + 1] <> 0 THEN i + 1 ELSE 0 END)) AS last
          FROM (SELECT *, (ids || list_transform(range(30), lambda x: 0))[1:30] AS z FROM {talk_ids_sql(0)}))
    """,
)
def encoder_blocks(spark, sf):
    ids = F.col("ids")
    return talk_ids(spark, sf, 0).select(
        "conv_id",
        "turn",
        joined(packing.encoder_block(ids, 30, -1)).alias("block"),
        joined(packing.encoder_block_of_padded(packing.pad_right(ids, 30, 0))).alias("block_of_padded"),
    )


@query(
    "attention_masks",
    f"""
    WITH s AS (SELECT conv_id, turn, [CAST(2 AS BIGINT)] || ids || [CAST(3 AS BIGINT)] AS ids FROM {talk_ids_sql(1)}),
    m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) - len(ids) AS fill FROM s)
    SELECT conv_id, turn, array_to_string(ids || list_transform(range(fill), lambda x: 0), ' ') AS ids,
           array_to_string(list_transform(ids, lambda x: 1) || list_transform(range(fill), lambda x: 0), ' ') AS attention_mask,
           array_to_string(list_transform(ids || list_transform(range(fill), lambda x: 0),
             lambda x: CASE WHEN x IN (0, 2, 3) THEN 1 ELSE 0 END), ' ') AS special_mask
    FROM m
    """,
)
def attention_masks(spark, sf):
    out = packing.attention_masks(talk_ids(spark, sf, 1), ["conv_id"])
    return out.select("conv_id", "turn", *[joined(F.col(c)).alias(c) for c in ("ids", "attention_mask", "special_mask")])


@query(
    "shift_labels",
    f"""
    SELECT conv_id, turn, array_to_string(list_transform(p, lambda x: CASE WHEN x <> -1 THEN x + 7 ELSE x END) || p, ' ') AS labels
    FROM (SELECT conv_id, turn, (ids || list_transform(range(20), lambda x: -1))[1:20] AS p FROM {talk_ids_sql(0)})
    """,
)
def shift_labels(spark, sf):
    padded = packing.pad_right(F.col("ids"), 20, -1)
    return talk_ids(spark, sf, 0).select(
        "conv_id", "turn", joined(F.concat(packing.shift_labels(padded, 7), padded)).alias("labels")
    )


@query(
    "ids_to_labels",
    f"""
    SELECT conv_id, turn, string_agg(coalesce(t.token, '<unk>'), ' ' ORDER BY i) AS labels
    FROM {numbered('ids', 'conv_id, turn', talk_ids_sql(-1), 'id')} LEFT JOIN {_TERMS} t USING (id) GROUP BY conv_id, turn
    """,
)
def ids_to_labels(spark, sf):
    rows = talk_ids(spark, sf, -1).select("conv_id", "turn", F.posexplode("ids").alias("pos", "id"))
    named = vocab.lookup(rows, terms(spark, sf), "id", "token", F.lit("<unk>"), ["conv_id", "turn", "pos"])
    return (
        named.groupBy("conv_id", "turn")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x"))
        .select("conv_id", "turn", F.array_join(F.col("x.token"), " ").alias("labels"))
    )


@query(
    "hash_buckets",
    f"""
    SELECT conv_id, turn, array_to_string((list_transform({words_sql('lower(text)')},
             lambda w: CAST(('0x' || md5(w)[1:4]) AS BIGINT)) || list_transform(range(20), lambda x: -1))[1:20], ' ') AS ids
    FROM conversations
    """,
)
def hash_buckets(spark, sf):
    # The first 16 bits of a digest: below 2^16, and the same in every engine.
    bucket = F.transform("words", lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("bigint"))
    return talk(spark, sf).select("conv_id", "turn", joined(packing.pad_right(bucket, 20, -1)).alias("ids"))


@query(
    "flatten_pad",
    f"""
    SELECT conv_id, turn, array_to_string((flatten(list_transform(words, lambda w: [length(w), length(translate(w, 'aeiou', ''))]))
             || list_transform(range(24), lambda x: 0))[1:24], ' ') AS features
    FROM (SELECT conv_id, turn, {words_sql('lower(text)')} AS words FROM conversations)
    """,
)
def flatten_pad(spark, sf):
    nested = F.transform("words", lambda w: F.array(F.length(w), F.length(F.translate(w, "aeiou", ""))))
    return talk(spark, sf).select(
        "conv_id", "turn", joined(packing.pad_right(F.flatten(nested), 24, 0)).alias("features")
    )


_CHOSEN = f"({draw_sql(17, 'shard', 'seq_no', 'i')}) < {int(0.15 * MODULUS)} AND id NOT IN (0, 2, 3)"
_NORMAL = f"((SELECT count(*) FROM {_VOCAB}) - 4)"


@query(
    "mlm_mask",
    f"""
    WITH s AS ({_packed_sql(128, True)}),
    t AS (SELECT shard, seq_no, i - 1 AS i, CAST(tok AS BIGINT) AS id
          FROM {numbered("string_split(input_ids, ' ')", 'shard, seq_no', 's', 'tok')}),
    m AS (SELECT *, {_CHOSEN} AS chosen, {draw_sql(18, 'shard', 'seq_no', 'i')} AS kind,
                 ({draw_sql(19, 'shard', 'seq_no', 'i')}) % {_NORMAL} AS pick FROM t)
    SELECT shard, seq_no,
           string_agg(CAST(CASE WHEN NOT chosen THEN id WHEN kind < {int(0.8 * MODULUS)} THEN 4
             WHEN kind < {int(0.9 * MODULUS)} THEN CASE WHEN pick = 0 THEN 1 ELSE pick + 4 END ELSE id END AS VARCHAR), ' ' ORDER BY i) AS masked_ids,
           string_agg(CAST(CASE WHEN chosen THEN id ELSE -100 END AS VARCHAR), ' ' ORDER BY i) AS labels
    FROM m GROUP BY shard, seq_no
    """,
)
def mlm_mask(spark, sf):
    pieces = cut_lineage(split_words(spark, sf))
    entries = cut_lineage(vocab.piece_vocabulary(pieces))
    ids = vocab.encode(docs(spark, sf), vocab.word_ids(pieces, entries))
    seqs = packing.pack_sequences(ids, 128, F.pmod("doc_id", F.lit(4)), False)
    out = packing.mask_tokens(seqs, ["shard", "seq_no"], vocab_size=entries.count())
    return out.select("shard", "seq_no", joined(F.col("masked_ids")).alias("masked_ids"), joined(F.col("labels")).alias("labels"))


@query(
    "vocab_semi_join",
    f"""
    SELECT DISTINCT '/c/en/' || w AS key FROM (SELECT unnest({words_sql('lower(text)')}) AS w FROM conversations)
    WHERE w IN (SELECT token FROM {_DOC_TOKENS})
    """,
)
def vocab_semi_join(spark, sf):
    words = talk(spark, sf).select(F.explode("words").alias("word")).distinct()
    keyed = words.select(F.concat(F.lit("/c/en/"), F.col("word")).alias("key"))
    return vocab.semi_join_vocabulary(keyed, doc_tokens(spark, sf), "key", "token", prefix=6).select("key")


_KEPT = f"({draw_sql(5, 'conv_id', 'turn', 'i')}) <= {int(0.3 * MODULUS)}"


@query(
    "mask_labels",
    f"""
    SELECT conv_id, turn, string_agg(CAST(CASE WHEN {_KEPT} THEN id ELSE -1 END AS VARCHAR), ' ' ORDER BY i) AS labels
    FROM (SELECT conv_id, turn, i - 1 AS i, CAST(id AS BIGINT) AS id FROM {numbered('ids', 'conv_id, turn', talk_ids_sql(0), 'id')})
    GROUP BY conv_id, turn
    """,
)
def mask_labels(spark, sf):
    kept = packing.keep_labels(F.col("ids"), [F.col("conv_id"), F.col("turn")], 0.3)
    return talk_ids(spark, sf, 0).select("conv_id", "turn", joined(kept).alias("labels"))


_MERGES = 24


def _merge_steps_sql(merges: int) -> str:
    """One-by-one merging, a step of SQL for each merge; every symbol stands between two blanks of its own."""
    steps = [
        f"""w0 AS MATERIALIZED (SELECT ' ' || array_to_string(string_split(token, ''), '  ') || ' ' AS s, n
            FROM (SELECT token, count(*) AS n FROM {_DOC_TOKENS} GROUP BY token))"""
    ]
    for k in range(merges):
        steps.append(f"""p{k} AS MATERIALIZED (
            SELECT x[i] AS a, x[i + 1] AS b, CAST(sum(n) AS BIGINT) AS c
            FROM (SELECT x, n, unnest(range(1, len(x))) AS i FROM (SELECT string_split(trim(s), '  ') AS x, n FROM w{k}))
            GROUP BY ALL ORDER BY c DESC, a, b LIMIT 1),
        w{k + 1} AS MATERIALIZED (SELECT replace(s, ' ' || a || '  ' || b || ' ', ' ' || a || b || ' ') AS s, n FROM w{k}, p{k})""")
    found = " UNION ALL ".join(f"SELECT {k} AS rank, a, b, c FROM p{k} WHERE c >= 5" for k in range(merges))
    return f"WITH {', '.join(steps)} SELECT rank, a AS left_symbol, b AS right_symbol, c AS n FROM ({found})"


@query("bpe_merges", _merge_steps_sql(_MERGES))
def bpe_merges(spark, sf):
    """The first merges; without a number ``learn_merges`` goes down to the least frequency, in some hundred rounds."""
    counts = tk.word_counts(docs(spark, sf), tx.words(F.lower("text")))
    learnt = vocab.learn_merges(counts, merges=_MERGES)
    rows = [(i, a, b, n) for i, (a, b, n) in enumerate(learnt)]
    return spark.createDataFrame(rows, "rank int, left_symbol string, right_symbol string, n bigint")
