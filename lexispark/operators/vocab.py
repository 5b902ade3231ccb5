"""Vocabularies, id lookup, inverted index and merge learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import Column, DataFrame, functions as F

from lexispark.functions import pieces as pc
from lexispark.plans.checkpoints import cut_lineage
from lexispark.plans.numbering import number_rows
from lexispark.plans.skew import salted_join

# Special tokens, ids 0 to 4.
SPECIALS = ["<pad>", "<unk>", "<s>", "</s>", "<mask>"]
PAD, UNK, BOS, EOS, MASK = range(5)


def term_vocabulary(
    tokens: DataFrame, doc_id: str, token: str, min_df: int = 1, max_size: int | None = None
) -> DataFrame:
    """The terms in order of frequency: ``token, doc_freq, term_freq, id``; ties go by the term.

    Counting goes through (term, document) pairs, so no distinct set is built
    for a term that occurs everywhere. Numbering goes by ranges of that order.
    ``max_size`` keeps the most frequent terms only.
    """
    found = (
        tokens.groupBy(token, doc_id)
        .agg(F.count("*").alias("tf"))
        .groupBy(token)
        .agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("term_freq"))
        .filter(F.col("doc_freq") >= min_df)
    )
    numbered = number_rows(found, [], [F.desc("term_freq"), token], "id", start=0)
    return numbered if max_size is None else numbered.filter(F.col("id") < max_size)


def word_table(df: DataFrame, doc_id: str = "doc_id", col: str = "text") -> DataFrame:
    """Distinct words with their count and first place (document, word number)."""
    found = F.regexp_extract_all(F.col(col), F.lit(pc.WORD), F.lit(0))
    return (
        df.select(doc_id, F.posexplode(found).alias("word_no", "word"))
        .groupBy("word")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct(F.col(doc_id).alias("doc"), "word_no")).alias("first"),
        )
    )


def word_pieces(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``language`` and the ``pieces`` array to distinct words."""
    known = dictionary.select(F.col("entry").alias("low"), F.lit(True).alias("known"))
    return (
        words.withColumn("low", F.lower("word"))
        .join(known, "low", "left")
        .withColumn("language", pc.route(F.col("word"), F.coalesce("known", F.lit(False))))
        .withColumn("pieces", pc.routed_pieces(F.col("word"), F.col("language")))
        .drop("low", "known")
    )


def piece_vocabulary(pieces_of_words: DataFrame) -> DataFrame:
    """``id, token, source, language, frequency``: specials first, then pieces by first appearance."""
    spark = pieces_of_words.sparkSession
    seen = (
        pieces_of_words.select("n", "first", "language", F.posexplode("pieces").alias("p", "token"))
        .groupBy("token")
        .agg(
            F.sum("n").alias("frequency"),
            F.min(F.struct("first.doc", "first.word_no", "p", "language")).alias("f"),
        )
        .select("token", "frequency", "f.doc", "f.word_no", "f.p", "f.language")
        .filter(~F.col("token").isin(SPECIALS))
    )
    numbered = number_rows(seen, [], ["doc", "word_no", "p"], "id", start=len(SPECIALS))
    source = F.when(F.col("language") == "eng", "sub").otherwise(F.col("language"))
    specials = spark.createDataFrame(
        [(i, s, "pad", "pad", 1) for i, s in enumerate(SPECIALS)],
        "id bigint, token string, source string, language string, frequency bigint",
    )
    return specials.unionByName(numbered.select("id", "token", source.alias("source"), "language", "frequency"))


def prune_vocabulary(vocab: DataFrame, min_frequency: int) -> DataFrame:
    kept = vocab.filter((F.col("language") == "pad") | (F.col("frequency") >= min_frequency))
    return number_rows(kept.withColumnRenamed("id", "old_id"), [], ["old_id"], "id", start=0).drop("old_id")


def word_ids(pieces_of_words: DataFrame, vocab: DataFrame) -> DataFrame:
    """``word, ids``: the piece ids of every distinct word, unknown pieces as UNK."""
    entries = vocab.select(F.col("token").alias("piece"), "id")
    rows = pieces_of_words.select("word", F.posexplode("pieces").alias("p", "piece"))
    return (
        rows.join(entries, "piece", "left")
        .groupBy("word")
        .agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("id", F.lit(UNK)).alias("id")))).alias("x"))
        .select("word", F.col("x.id").alias("ids"))
    )


def encode(
    df: DataFrame, ids_of_words: DataFrame, doc_id: str = "doc_id", col: str = "text", docs_per_block: int = 1 << 10
) -> DataFrame:
    """``doc_id, ids``: documents as piece ids, looked up in blocks of ``docs_per_block`` document numbers.

    Only the distinct words of a block meet the table, and a block gets back the
    words that it has. So a word moves once per block, not once per occurrence,
    and a text moves once. A document without words, also one without text, has no ids.
    """
    block = F.floor(F.col(doc_id) / docs_per_block).alias("block")
    found = F.regexp_extract_all("text", F.lit(pc.WORD), F.lit(0))
    texts = df.select(block, F.col(doc_id).alias("doc"), F.col(col).alias("text"))
    entries = texts.select("block", F.explode(F.array_distinct(found)).alias("word")).distinct()
    named = entries.join(ids_of_words.select("word", F.col("ids").cast("array<bigint>").alias("ids")), "word")
    named = named.select(F.col("block").alias("of_block"), "word", "ids")
    # The words are taken out after the texts have moved.
    rows = texts.repartition("block").select("block", "doc", F.coalesce(found, F.array().cast("array<string>")).alias("words"))
    kind = df.schema[doc_id].dataType.simpleString()
    coded = rows.groupBy("block").cogroup(named.groupBy("of_block")).applyInArrow(_encode_block, f"doc {kind}, ids array<bigint>")
    return coded.withColumnRenamed("doc", doc_id)


def _encode_block(rows: pa.Table, named: pa.Table) -> pa.Table:
    """The words of a block's documents as ids; words that ``named`` lacks are UNK. Rows of one document become one."""
    docs, words = (_whole(rows[c]) for c in ("doc", "words"))
    ids = pa.concat_arrays([_whole(named["ids"]).cast(pa.list_(pa.int64())), pa.array([[UNK]], pa.list_(pa.int64()))])
    at = compute.fill_null(compute.index_in(words.flatten(), value_set=_whole(named["word"])), len(ids) - 1)
    ends = np.concatenate([[0], np.cumsum(compute.fill_null(compute.list_value_length(words), 0).to_numpy())])
    of_words = ids.take(at)
    if len(compute.unique(docs)) < len(docs):
        return _merged(docs, ends, of_words)
    begins = of_words.offsets.to_numpy()[ends]
    return pa.table({"doc": docs, "ids": pa.ListArray.from_arrays(pa.array(begins, pa.int32()), of_words.values)})


def _merged(docs: pa.Array, ends: np.ndarray, of_words: pa.ListArray) -> pa.Table:
    """Rows with the same document number as one, word by word."""
    numbered: dict = {}
    for r, doc in enumerate(docs.to_pylist()):
        pieces = of_words[ends[r] : ends[r + 1]].to_pylist()
        numbered.setdefault(doc, []).extend(enumerate(pieces))
    ids = [[i for _, pieces in sorted(found) for i in pieces] for found in numbered.values()]
    return pa.table({"doc": pa.array(list(numbered), docs.type), "ids": pa.array(ids, pa.list_(pa.int64()))})


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def lookup(
    rows: DataFrame, table: DataFrame, key: str, value: str, default: Column, salt_by: list[str]
) -> DataFrame:
    """Left lookup with a default for keys that the table lacks."""
    return salted_join(rows, table.select(key, value), key, salt_by, "left").withColumn(
        value, F.coalesce(F.col(value), default)
    )


def inverted_index(
    df: DataFrame, doc_id: str, tokens: str, min_df: int = 5, docs_per_segment: int = 1 << 16
) -> DataFrame:
    """``token, segment, doc_freq, docs``: sorted posting lists, cut into segments of the id range.

    A term found in every document would make one endless list; a segment holds
    ``docs_per_segment`` ids at most. Repeats inside a document go before the
    shuffle, and each document row counts once per token. Frequencies are counted
    apart, added up before their shuffle, and meet the segments salted, so the
    segments of a token never meet in one task.
    """
    single = df.select(F.explode(F.array_distinct(tokens)).alias("token"), F.col(doc_id).alias("doc"))
    frequent = single.groupBy("token").agg(F.count("*").alias("doc_freq")).filter(F.col("doc_freq") >= min_df)
    postings = single.groupBy("token", F.floor(F.col("doc") / docs_per_segment).alias("segment")).agg(
        F.sort_array(F.collect_list("doc")).alias("docs")
    )
    return salted_join(postings, frequent, "token", ["segment"])


def semi_join_vocabulary(vectors: DataFrame, vocab: DataFrame, key: str, token: str, prefix: int = 0) -> DataFrame:
    """Rows of a keyed table whose key (without a fixed-length prefix) is a token of ``vocab``; its repeats go first."""
    word = F.expr(f"substring({key}, {prefix + 1})")
    return vectors.withColumn(token, word).join(vocab.select(token).distinct(), token, "left_semi")


#: Merges learnt in one round at most, and ranked pairs that are looked at for them.
ROUND_MERGES, ROUND_RANKED = 64, 512


def independent_merges(
    ranked: list[tuple[str, str, int]], complete: bool, most: int = ROUND_MERGES
) -> list[tuple[str, str, int]]:
    """The first pairs of a ranking that one-by-one merging would take in this order.

    Two pairs get in each other's way only if one ends with the symbol that the
    other begins with. What a merge creates is at most as frequent as the pair
    that it destroys, which is such a pair. So all pairs more frequent than the
    first one in the way of an earlier one keep their counts and their order, and
    nothing new comes between. The first pair may always be taken.
    """
    lefts: set[str] = set()
    rights: set[str] = set()
    bound = 0 if complete else ranked[-1][2]
    taken = []
    for a, b, n in ranked:
        if a == b or a in rights or b in lefts:
            bound = n
            if not taken:
                taken.append((a, b, n))
            break
        if len(taken) == most:
            break
        taken.append((a, b, n))
        lefts.add(a)
        rights.add(b)
    return taken[:1] + [p for p in taken[1:] if p[2] > bound]


def learn_merges(
    words: DataFrame, merges: int | None = None, min_frequency: int = 5, checkpoint_every: int = 6
) -> list[tuple[str, str, int]]:
    """Most frequent adjacent pairs, as if merged one after another: ``[(left, right, count), ...]``.

    ``words`` holds distinct ``word, n``; ties go by the symbols. Without
    ``merges`` all pairs are learnt down to ``min_frequency``. A round counts
    pairs on the cluster, brings ``ROUND_RANKED`` of them to the driver, takes all
    that don't get in each other's way, and applies them to the words at once.
    Each symbol of a word stands between two blanks of its own, so a plain
    replacement from the left is a merge.
    """
    letters = F.filter(F.split("word", ""), lambda ch: ch != "")
    marked = F.array_join(F.transform(letters, lambda ch: F.concat(F.lit(" "), ch, F.lit(" "))), "")
    current = cut_lineage(words.select(marked.alias("symbols"), "n").filter("length(symbols) > 3"))
    learnt: list[tuple[str, str, int]] = []
    rounds = 0
    while merges is None or len(learnt) < merges:
        parts = F.split(F.substring("symbols", 2, 1 << 30), "  ?")
        pairs = F.transform(
            F.sequence(F.lit(1), F.size("parts") - 2),
            lambda i: F.struct(F.get("parts", i - 1).alias("a"), F.get("parts", i).alias("b")),
        )
        counts = (
            current.select(parts.alias("parts"), "n")
            .filter("size(parts) > 2")
            .select(F.inline(pairs), "n")
            .groupBy("a", "b")
            .agg(F.sum("n").alias("count"))
            .filter(F.col("count") >= min_frequency)
        )
        ranked = [tuple(r) for r in counts.orderBy(F.desc("count"), "a", "b").limit(ROUND_RANKED).collect()]
        if not ranked:
            break
        found = independent_merges(ranked, complete=len(ranked) < ROUND_RANKED)
        learnt += found
        steps = F.array(*[F.struct(F.lit(f" {a}  {b} ").alias("old"), F.lit(f" {a}{b} ").alias("new")) for a, b, _ in found])
        merged = F.aggregate(steps, F.col("symbols"), lambda text, x: F.replace(text, x["old"], x["new"]))
        # A word that is one symbol has no pair left.
        current = current.select(merged.alias("symbols"), "n").filter(F.instr("symbols", "  ") > 0)
        rounds += 1
        if rounds % checkpoint_every == 0:
            current = cut_lineage(current)
    return learnt if merges is None else learnt[:merges]
