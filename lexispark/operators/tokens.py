"""Token-level jobs over document tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexispark.functions import pieces as pc, shapes, text as tx
from lexispark.plans.skew import salted_join

# Tokens counted as punctuation.
PUNCTUATION_TOKENS = [
    ",", ".", ":", ";", "?", "!", '"', "'", "/", "...", "-", "LBKT", "RBKT", "--", "``", "''", ")", "(",
]


@F.pandas_udf(T.StringType())
def compose_unicode(texts: pd.Series) -> pd.Series:
    """Decomposed letters to composed ones; Spark has no built-in for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_unicode(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, tx.one_line(compose_unicode(F.col(col))))


def split_sentences(df: DataFrame, col: str = "text", limit: int | None = None) -> DataFrame:
    parts = tx.sentences(F.col(col))
    if limit is not None:
        parts = F.slice(parts, 1, limit)
    return df.select(*[c for c in df.columns if c != col], F.posexplode(parts).alias("sent_no", "sentence"))


def normalize_tokens(tokens: Column, punctuation=False, numbers=False, lowercase=False) -> Column:
    """Optional rewrites of a token array: marks to PUNCT, numbers to [NUM], lower case."""
    number = rf"^(?:{dict(shapes.GENERAL)['number']}%?)$"
    out = tokens
    if punctuation:
        out = F.transform(
            out, lambda t: F.when(t.isin(PUNCTUATION_TOKENS), "PUNCT").otherwise(F.translate(t, ",", "."))
        )
    if numbers:
        out = F.transform(out, lambda t: F.when(t.rlike(number), "[NUM]").otherwise(t))
    return F.transform(out, F.lower) if lowercase else out


def regex_tokens(c: Column, delimiter: str, min_chars: int = 1, lowercase: bool = True) -> Column:
    source = F.lower(c) if lowercase else c
    return F.filter(F.split(source, delimiter), lambda t: F.length(t) >= min_chars)


def remove_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    """Drop listed tokens, whatever their case; repeats of the others stay."""
    low = [w.lower() for w in stopwords]
    return F.filter(tokens, lambda t: ~F.lower(t).isin(low))


def word_counts(df: DataFrame, tokens: Column, name: str = "word") -> DataFrame:
    return df.select(F.explode(tokens).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def _running_totals(lists: pa.Array) -> pa.Array:
    """The sums of every row's numbers up to each place."""
    values, n = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), compute.fill_null(compute.list_value_length(lists), 0)
    begins = np.concatenate([[0], np.cumsum(n.to_numpy(zero_copy_only=False), dtype=np.int64)])
    sums = np.concatenate([[0], np.cumsum(values)])
    own = sums[1:] - np.repeat(sums[begins[:-1]], np.diff(begins))
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(own), mask=lists.is_null())


def match_rows(df: DataFrame, keys: list[str], col: str, pattern: str) -> DataFrame:
    """One row per pattern match: ``keys, match_no, match, start, end`` (character offsets).

    Offsets are added up inside a row, in Arrow, before its matches are exploded: nothing is shuffled.
    """
    found = df.select(*keys, pc.matches_with_gaps(F.col(col), pattern).alias("m"))
    lengths = F.transform("m", lambda m: F.length(m["gap"]) + F.length(m["match"]))
    ends = F.arrow_udf(_running_totals, "array<bigint>")(lengths)
    zipped = found.select(*keys, F.arrays_zip(F.col("m.match").alias("match"), ends.alias("end")).alias("m"))
    return zipped.select(*keys, F.posexplode("m").alias("match_no", "m")).select(
        *keys,
        F.col("match_no").cast("bigint").alias("match_no"),
        F.col("m.match").alias("match"),
        (F.col("m.end") - F.length("m.match")).alias("start"),
        F.col("m.end").alias("end"),
    )


def word_rows(df: DataFrame, doc_id: str = "doc_id", col: str = "text") -> DataFrame:
    """One row per word with its number and character offsets."""
    return match_rows(df, [doc_id], col, pc.WORD).withColumnsRenamed({"match_no": "word_no", "match": "word"})


#: Bytes of a dictionary that a task may hold whole; a larger one meets the words by a shuffle.
HELD_BYTES = 8 << 20


def route_words(words: DataFrame, dictionary: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Add ``language`` to word rows; ``dictionary`` has one lower-case ``entry`` per row.

    The dictionary is measured first: up to ``HELD_BYTES`` it goes to the words, which then stay where they are.
    """
    known = dictionary.select(F.col("entry").alias("low"), F.lit(True).alias("known"))
    lowered = words.withColumn("low", F.lower("word"))
    size = dictionary.agg(F.sum(F.octet_length("entry") + 32)).first()[0] or 0
    if size <= HELD_BYTES:
        joined = lowered.join(F.broadcast(known), "low", "left")
    else:
        joined = salted_join(lowered, known, "low", [doc_id, "word_no"], "left")
    return joined.withColumn("language", pc.route(F.col("word"), F.coalesce("known", F.lit(False)))).drop("low", "known")


def piece_rows(routed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per sub-word piece of routed words, with offsets; ``piece_no`` orders them inside a word."""
    parts = pc.routed_pieces(F.col("word"), F.col("language"))
    source = F.when(F.col("language") == "eng", "sub").otherwise(F.col("language"))
    exploded = routed.withColumn("parts", parts).select(
        doc_id, "word_no", "language", "start", "parts", F.posexplode("parts").alias("piece_no", "piece")
    )
    before = F.aggregate(
        F.slice("parts", F.lit(1), F.col("piece_no")), F.lit(0), lambda n, p: n + F.length(p)
    )
    return exploded.withColumn("start", F.col("start") + before).select(
        doc_id,
        "word_no",
        F.col("piece_no").cast("bigint").alias("piece_no"),
        "piece",
        source.alias("source"),
        "language",
        "start",
        (F.col("start") + F.length("piece")).alias("end"),
    )


def _canvases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, first, last, canvas, gaps, lengths``: the pieces of a batch as one text a document.

    The canvas has blanks where the batch has no piece. ``gaps`` and ``lengths``
    tell the runs of pieces in it, so that pieces of other batches can come between.
    """
    for batch in batches:
        docs = compute.dictionary_encode(batch["doc"], null_encoding="encode")
        code = docs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, end = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
        order = np.lexsort((end, start, code))
        code, start, end, piece = code[order], start[order], end[order], batch["piece"].take(pa.array(order))
        opens = np.diff(code, prepend=-1) != 0
        gap = np.where(opens, 0, start - np.concatenate([[0], end[:-1]])) if len(code) else np.zeros(0, np.int64)
        spaced = compute.binary_join_element_wise(compute.binary_repeat(" ", pa.array(np.maximum(gap, 0))), piece, "")
        firsts = np.flatnonzero(opens)
        bounds = np.append(firsts, len(code))
        canvas = compute.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spaced), "")
        runs = np.flatnonzero(opens | (gap != 0))
        chars = np.concatenate([[0], np.cumsum(compute.utf8_length(piece).to_numpy(zero_copy_only=False), dtype=np.int64)])
        lengths = np.diff(chars[np.append(runs, len(code))])
        of_docs = pa.array(np.searchsorted(runs, bounds), pa.int32())
        listed = lambda x: pa.ListArray.from_arrays(of_docs, pa.array(x, pa.int32()))
        told = [docs.dictionary.take(pa.array(code[firsts])), pa.array(start[firsts]), pa.array(end[bounds[1:] - 1]), canvas, listed(gap[runs]), listed(lengths)]
        yield pa.RecordBatch.from_arrays(told, ["doc", "first", "last", "canvas", "gaps", "lengths"])


def _woven(canvases: list[dict] | None) -> str | None:
    """The text of canvases that reach into one another, run by run."""
    if canvases is None:
        return None
    runs = []
    for c in canvases:
        at, place = c["first"], 0
        for gap, length in zip(c["gaps"], c["lengths"]):
            at, place = at + gap, place + max(gap, 0)
            runs.append((at, at + length, c["canvas"][place : place + length]))
            at, place = at + length, place + length
    out, last = [], 0
    for start, end, text in sorted(runs):
        out.append(" " * (start - last) + text)
        last = end
    return "".join(out)


def decode_pieces(pieces: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rebuild the text of each document from its pieces; gaps become spaces.

    Pieces that lie together are put together before the shuffle, so that a text moves, not its pieces.
    """
    rows = pieces.select(F.col(doc_id).alias("doc"), "start", "end", "piece").filter("start IS NOT NULL AND piece IS NOT NULL")
    kind = pieces.schema[doc_id].dataType.simpleString()
    schema = f"doc {kind}, first bigint, last bigint, canvas string, gaps array<int>, lengths array<int>"
    found = rows.mapInArrow(_canvases, schema).groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "canvas", "gaps", "lengths"))).alias("cs")
    )
    last = lambda i: F.coalesce(F.get("cs", i - 1)["last"], F.lit(0))
    follows = F.forall(F.transform("cs", lambda c, i: c["first"] >= last(i)), lambda ok: ok)
    parts = F.transform("cs", lambda c, i: F.concat(F.repeat(F.lit(" "), (c["first"] - last(i)).cast("int")), c["canvas"]))
    woven = F.udf(_woven, "string", useArrow=True)(F.when(~follows, F.col("cs")))
    return found.select(F.col("doc").alias(doc_id), F.coalesce(F.when(follows, F.array_join(parts, "")), woven).alias("text"))


def language_words(routed: DataFrame, language: str, doc_id: str = "doc_id") -> DataFrame:
    """The words of each document routed to one language, in order."""
    return (
        routed.filter(F.col("language") == language)
        .groupBy(doc_id)
        .agg(F.array_sort(F.collect_list(F.struct("word_no", "word"))).alias("ws"))
        .select(doc_id, F.array_join(F.col("ws.word"), " ").alias("words"))
    )
