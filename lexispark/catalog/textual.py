"""Sentence, token, shape and piece queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexispark.catalog.registry import query, table
from lexispark.catalog.sqlparts import WSC, numbered, sentences_sql, trim_sql, words_sql
from lexispark.functions import pieces as pc, shapes, text as tx
from lexispark.functions.alphabets import (
    FOREIGN_CONSONANTS,
    MARKED_FROM,
    MARKED_TO,
    VOWELS_MARKED,
)
from lexispark.operators import tokens as tk

BIG = "bigint"


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def shape_sql(word: str, patterns) -> str:
    whens = " ".join(
        f"WHEN regexp_full_match({word}, {q(pattern)}) THEN '{name}'" for name, pattern in patterns
    )
    return f"CASE {whens} ELSE '' END"


def docs(spark, sf, *more):
    return table(spark, sf, "documents").select("doc_id", *more, "text")


@query(
    "sentence_split",
    f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS sent_no, sentence FROM "
    f"{numbered(sentences_sql('text'), 'doc_id', 'documents', 'sentence')}",
)
def sentence_split(spark, sf):
    out = tk.split_sentences(docs(spark, sf))
    return out.withColumn("sent_no", F.col("sent_no").cast(BIG))


_PUNCT_LIST = "[" + ", ".join(q(p) for p in tk.PUNCTUATION_TOKENS) + "]"


@query(
    "normalize_tokens",
    f"""
    SELECT doc_id, array_to_string(list_transform({words_sql('text')}, lambda t:
      CASE WHEN list_contains({_PUNCT_LIST}, t) THEN 'punct'
           WHEN regexp_full_match(replace(t, ',', '.'), '[+-]?[0-9]+([.,]\\d+)*%?') THEN '[num]'
           ELSE lower(replace(t, ',', '.')) END), ' ') AS tokens
    FROM documents
    """,
)
def normalize_tokens(spark, sf):
    out = tk.normalize_tokens(tx.words(F.col("text")), punctuation=True, numbers=True, lowercase=True)
    return docs(spark, sf).select("doc_id", F.array_join(out, " ").alias("tokens"))


_WORDS = f"(SELECT w AS word, count(*) AS n FROM (SELECT unnest({words_sql('text')}) AS w FROM documents) GROUP BY w)"


def words(spark, sf):
    return tk.word_counts(docs(spark, sf), tx.words(F.col("text")))


@query(
    "word_shapes",
    f"""
    SELECT word, n, {shape_sql('word', shapes.GENERAL)} AS shape, {shape_sql('word', shapes.SYNTAX)} AS syntax_shape
    FROM {_WORDS}
    """,
)
def word_shapes(spark, sf):
    w = F.col("word")
    return words(spark, sf).select(
        "word", "n", shapes.shape(w).alias("shape"), shapes.shape(w, shapes.SYNTAX).alias("syntax_shape")
    )


_PLACEHOLDER = " ".join(f"WHEN s = '{k}' THEN '{v}'" for k, v in shapes.PLACEHOLDERS.items())


@query(
    "shape_placeholders",
    f"""
    SELECT word, CASE WHEN d = '' THEN 'NA' ELSE '[' || upper(d) || ']' END AS feature,
           CASE WHEN list_contains({shapes.KEPT_AS_WRITTEN}, s) THEN word ELSE '<' || s || '>' END AS normalized,
           CASE {_PLACEHOLDER} ELSE lower(word) END AS placeholder,
           CASE WHEN list_contains({shapes.NAME_SHAPES}, s) THEN 1 ELSE 0 END AS is_name
    FROM (SELECT word, {shape_sql('word', shapes.GENERAL)} AS s, {shape_sql('word', shapes.DIALOGUE)} AS d FROM {_WORDS})
    """,
)
def shape_placeholders(spark, sf):
    w, s = F.col("word"), F.col("s")
    return words(spark, sf).withColumn("s", shapes.shape(w)).select(
        "word",
        shapes.shape_feature(w).alias("feature"),
        shapes.shape_normalized(w, s).alias("normalized"),
        shapes.topic_placeholder(w, s).alias("placeholder"),
        shapes.is_name(s).cast("int").alias("is_name"),
    )


@query(
    "normalize_nfc",
    f"SELECT doc_id, {trim_sql(f'regexp_replace(nfc_normalize(text), {q(WSC + chr(43))}, {q(chr(32))}, {q(chr(103))})')} AS text FROM documents",
)
def normalize_nfc(spark, sf):
    return tk.normalize_unicode(docs(spark, sf))


@query(
    "strip_diacritics",
    f"SELECT doc_id, translate(lower(text), '{MARKED_FROM}', '{MARKED_TO}') AS text FROM documents",
)
def strip_diacritics(spark, sf):
    return docs(spark, sf).withColumn("text", pc.strip_diacritics(F.col("text")))


_KNOWN = MARKED_FROM + "".join(sorted(set(MARKED_TO)))


@query(
    "map_characters",
    f"""
    SELECT word, CASE WHEN regexp_full_match(word, '[+-]?[0-9]+([.,]\\d+)*') THEN '0'
                      WHEN regexp_matches(word, '^[{_KNOWN + _KNOWN.upper()}]') THEN word ELSE 'S' END AS mapped
    FROM {_WORDS}
    """,
)
def map_characters(spark, sf):
    return words(spark, sf).select("word", pc.character_class(F.col("word")).alias("mapped"))


_V = "aeoiuyAEOIUY" + VOWELS_MARKED + VOWELS_MARKED.upper()
_SYLLABLE = f"(?s)^([^{_V}]*)(?:(.*[{_V}])([^{_V}]*))?$"


def parts_sql(w: str) -> str:
    groups = ", ".join(f"regexp_extract({w}, '{_SYLLABLE}', {g})" for g in (1, 2, 3))
    return f"list_filter([{groups}], lambda p: p <> '')"


def triple_sql(w: str) -> str:
    return (
        f"CASE length({w}) WHEN 0 THEN [] WHEN 1 THEN [{w}, '$NA', '$NA'] "
        f"WHEN 2 THEN [substr({w}, 1, 1), '$NA', right({w}, 1)] "
        f"ELSE [substr({w}, 1, 1), substr({w}, 2, length({w}) - 2), right({w}, 1)] END"
    )


@query(
    "split_syllables",
    f"SELECT word, CASE WHEN length(word) > 7 THEN word ELSE array_to_string({parts_sql('word')}, '|') END AS parts "
    f"FROM {_WORDS}",
)
def split_syllables(spark, sf):
    return words(spark, sf).select("word", F.array_join(pc.syllable_parts(F.col("word")), "|").alias("parts"))


@query(
    "split_subtokens",
    f"""
    SELECT doc_id, array_to_string(flatten(list_transform({words_sql('text')}, lambda w: {triple_sql('w')})), ' ') AS subtokens,
           CAST(3 * len({words_sql('text')}) AS BIGINT) AS n
    FROM documents
    """,
)
def split_subtokens(spark, sf):
    subs = F.flatten(F.transform(tx.words(F.col("text")), pc.subtoken_triple))
    return docs(spark, sf).withColumn("s", subs).select(
        "doc_id", F.array_join("s", " ").alias("subtokens"), F.size("s").cast(BIG).alias("n")
    )


@query(
    "char_sequences",
    f"SELECT word, array_to_string((string_split(word, '') || list_transform(range(13), lambda x: '$P'))[1:13], ' ') AS chars "
    f"FROM {_WORDS}",
)
def char_sequences(spark, sf):
    return words(spark, sf).select("word", F.array_join(pc.padded_characters(F.col("word")), " ").alias("chars"))


# Words of the benchmark texts serve as the syllable dictionary.
_WORD = pc.WORD
_DICT = f"(SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORD}')) AS entry FROM benchmark)"


def dictionary(spark, sf):
    found = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    return table(spark, sf, "benchmark").select(F.explode(found).alias("entry")).distinct()


ROUTE_SQL = f"""CASE WHEN length(word) > 7 THEN 'eng'
  WHEN regexp_matches(lower(word), '[{FOREIGN_CONSONANTS}]') THEN 'eng'
  WHEN regexp_matches(lower(word), '[{VOWELS_MARKED}đ]') THEN 'vie'
  WHEN lower(word) IN (SELECT entry FROM {_DICT}) THEN 'vie'
  WHEN regexp_full_match(word, {q(pc.PUNCTUATION)}) THEN 'vie'
  WHEN regexp_full_match(word, '\\p{{Nd}}+') THEN 'vie'
  WHEN regexp_full_match(word, '[\\x00-\\x7F]*') THEN 'eng' ELSE 'unk' END"""


def routed_sql(source: str) -> str:
    """Word rows of a relation (doc_id, text) with number, language and offsets."""
    return f"""(
      SELECT doc_id, i - 1 AS word_no, word, {ROUTE_SQL} AS language,
             sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS start
      FROM (SELECT doc_id, unnest(ws) AS word, unnest(gaps) AS gap, unnest(range(1, len(ws) + 1)) AS i
            FROM (SELECT doc_id, ws, string_split_regex(text, '{_WORD}')[1:len(ws)] AS gaps
                  FROM (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM {source}))))"""


def pieces_sql(source: str) -> str:
    split = f"""CASE language WHEN 'vie' THEN {parts_sql('word')}
        WHEN 'eng' THEN list_filter({triple_sql('word')}, lambda p: p <> '$NA') ELSE [word] END"""
    rows = numbered("parts", "doc_id, word_no, language, start, parts", f"(SELECT *, {split} AS parts FROM {routed_sql(source)})", "piece", "k")
    return f"""(
      SELECT doc_id, word_no, k - 1 AS piece_no, piece, language,
             CASE WHEN language = 'eng' THEN 'sub' ELSE language END AS source,
             start + coalesce(list_sum(list_transform(parts[1:k-1], lambda p: length(p))), 0) AS start
      FROM {rows})"""


def routed(spark, sf, source=None):
    source = docs(spark, sf) if source is None else source
    return tk.route_words(tk.word_rows(source), dictionary(spark, sf))


@query(
    "route_words",
    f"SELECT doc_id, CAST(word_no AS BIGINT) AS word_no, word, language, CAST(start AS BIGINT) AS start, "
    f"CAST(start + length(word) AS BIGINT) AS \"end\" FROM {routed_sql('documents')}",
)
def route_words(spark, sf):
    return routed(spark, sf)


@query(
    "extract_language_words",
    f"SELECT doc_id, string_agg(word, ' ' ORDER BY word_no) AS words FROM {routed_sql('documents')} "
    "WHERE language = 'eng' GROUP BY doc_id",
)
def extract_language_words(spark, sf):
    return tk.language_words(routed(spark, sf), "eng")


@query(
    "decode_pieces",
    rf"""
    SELECT doc_id, regexp_replace(regexp_replace(text, '[\s\p{{Z}}]', ' ', 'g'), ' +$', '') AS text FROM documents
    WHERE len(regexp_extract_all(text, '{_WORD}')) > 0
    """,
)
def decode_pieces(spark, sf):
    return tk.decode_pieces(tk.piece_rows(routed(spark, sf)))


_STOP = ["the", "and", "of", "de", "la", "que", "der", "die", "und", ",", ".", "…"]


@query(
    "remove_stopwords",
    f"""
    SELECT doc_id, array_to_string(list_filter({words_sql('text')},
      lambda t: NOT list_contains([{', '.join(q(s) for s in _STOP)}], lower(t))), ' ') AS tokens FROM documents
    """,
)
def remove_stopwords(spark, sf):
    kept = tk.remove_stopwords(tx.words(F.col("text")), _STOP)
    return docs(spark, sf).select("doc_id", F.array_join(kept, " ").alias("tokens"))


# Token delimiters.
_DELIMITERS = r"[,;.:()\x22\[\]\s]+"


@query(
    "regex_tokens",
    f"""
    SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '{_DELIMITERS}'),
      lambda t: length(t) >= 3), ' ') AS tokens FROM documents
    """,
)
def regex_tokens(spark, sf):
    found = tk.regex_tokens(F.col("text"), _DELIMITERS, min_chars=3)
    return docs(spark, sf).select("doc_id", F.array_join(found, " ").alias("tokens"))


@query(
    "char_multihot",
    f"""
    WITH w AS (SELECT DISTINCT word FROM {_WORDS}),
    hot AS (
      SELECT word, 'b' AS part, substr(word, 1, 1) AS ch FROM w
      UNION SELECT word, 'm', unnest(string_split(substr(word, 2, length(word) - 2), '')) FROM w WHERE length(word) >= 3
      UNION SELECT word, 'e', right(word, 1) FROM w WHERE length(word) >= 2
    ) SELECT word, part, ch FROM hot
    """,
)
def char_multihot(spark, sf):
    w = F.col("word")
    n = F.length(w)
    hot = F.array(
        F.struct(F.lit("b").alias("part"), F.array(F.substring(w, 1, 1)).alias("chs")),
        F.struct(
            F.lit("m").alias("part"),
            F.when(n >= 3, F.array_distinct(F.split(F.substring(w, F.lit(2), n - 2), "")))
            .otherwise(F.array().cast("array<string>"))
            .alias("chs"),
        ),
        F.struct(
            F.lit("e").alias("part"),
            F.when(n >= 2, F.array(F.right(w, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("chs"),
        ),
    )
    return (
        words(spark, sf)
        .select("word", F.inline(hot))
        .select("word", "part", F.explode("chs").alias("ch"))
        .filter(F.col("ch") != "")
    )
