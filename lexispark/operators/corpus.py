"""Corpus cleaning and deduplication.

Document tables have an integer id and a text column; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexispark.functions import text as tx


def filter_bad_rows(df: DataFrame, col: str = "text", min_chars: int = 80) -> DataFrame:
    c = F.col(col)
    return df.filter((F.length(c) >= min_chars) & ~F.contains(c, F.lit("\0")))


def filter_min_tokens(df: DataFrame, col: str = "text", min_tokens: int = 80) -> DataFrame:
    return df.filter(F.size(tx.single_space_tokens(F.col(col))) >= min_tokens)


def filter_charset(
    df: DataFrame, charset: str, col: str = "text", window: int = 80, require_space: bool = False
) -> DataFrame:
    return df.filter(tx.has_charset_throughout(F.col(col), charset, window, require_space))


def clean_lines(
    df: DataFrame,
    charset: str,
    col: str = "text",
    min_chars: int = 40,
    max_chars: int = 2048,
    window: int = 40,
) -> DataFrame:
    """Keep the good lines of each document; the document itself stays even if none is left."""
    good = F.filter(
        F.split(F.col(col), "\n+"),
        lambda line: F.length(line).between(min_chars, max_chars)
        & (tx.trim_ws(line) != "")
        & tx.has_charset_throughout(line, charset, window),
    )
    return df.withColumn(col, F.array_join(good, "\n"))


def clean_web_corpus(
    df: DataFrame, charset: str, doc_id: str = "doc_id", col: str = "text"
) -> DataFrame:
    """Length, duplicate, token-count, charset and line filters in one chain.

    Equal texts pass or fail together, so the duplicates can go first: finding
    them then costs a digest per document, and the optimizer runs the costlier
    filters once, before the texts are shuffled.
    """
    return (
        df.transform(filter_bad_rows, col)
        .transform(dedup_documents, doc_id, col)
        .transform(filter_min_tokens, col)
        .transform(filter_charset, charset, col)
        .transform(clean_lines, charset, col)
    )


def wiki_lines(df: DataFrame, col: str = "text", min_chars: int = 20) -> DataFrame:
    kept = F.filter(
        F.transform(F.split(F.col(col), "\n+"), tx.trim_ws),
        lambda s: (F.length(s) >= min_chars)
        & ~s.startswith("|")
        & ~s.startswith("{|")
        & ~F.contains(s, F.lit("wikitable")),
    )
    return df.withColumn("line", F.explode(kept)).drop(col)


def dedup_documents(df: DataFrame, doc_id: str = "doc_id", col: str = "text") -> DataFrame:
    """Of every group of equal texts keep the row with the smallest id.

    Only digests and ids are grouped, with a map-side combine, so a text copied
    a billion times costs one row per task. Texts move once, to meet the kept ids.
    """
    kept = df.groupBy(tx.digest(F.col(col)).alias("digest")).agg(F.min(doc_id).alias(doc_id))
    return df.join(kept.select(doc_id), doc_id, "left_semi")


def distinct_texts(*frames: DataFrame, col: str = "text") -> DataFrame:
    """Union of several corpora without repeated texts."""
    merged = frames[0].select(col)
    for other in frames[1:]:
        merged = merged.unionByName(other.select(col))
    return merged.distinct()


def dedup_paragraphs(
    df: DataFrame, doc_id: str = "doc_id", col: str = "text", keep_empty: bool = False
) -> DataFrame:
    """Keep one occurrence of every paragraph corpus-wide and rebuild the documents.

    The kept occurrence is the first line of the smallest document id. Repeats
    inside a document fall to ``array_distinct`` before any shuffle, so a digest
    has one place per document, and the owner of a digest is found by
    ``min(doc_id)`` with ``min_by(place)``: fixed-width rows and buffers, combined
    on the map side, so a paragraph copied a billion times costs one row per
    task. Texts are shuffled once, by document id, where the kept places meet
    them. Documents left with nothing disappear.
    """
    parts = F.array_distinct(tx.paragraphs(F.col(col), keep_empty))
    kept = (
        df.select(doc_id, F.posexplode(parts).alias("place", "part"))
        .groupBy(tx.digest(F.col("part")).alias("digest"))
        .agg(F.min_by("place", doc_id).alias("place"), F.min(doc_id).alias(doc_id))
        .groupBy(doc_id)
        .agg(F.sort_array(F.collect_list("place")).alias("places"))
    )
    text = F.array_join(F.transform("places", lambda i: F.get("parts", i)), "\n")
    return df.select(doc_id, parts.alias("parts")).join(kept, doc_id).select(doc_id, text.alias(col))


def dedup_funnel(df: DataFrame, doc_id: str = "doc_id", col: str = "text") -> DataFrame:
    """One row per stage: how many documents and paragraphs each step leaves."""
    unique = dedup_documents(df.select(doc_id, col), doc_id, col)
    rebuilt = dedup_paragraphs(unique, doc_id, col)

    def stages(source: DataFrame, **counts) -> DataFrame:
        row = source.agg(*[F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in counts.items()])
        pairs = F.array(*[F.struct(F.lit(k).alias("stage"), F.col(k).alias("n")) for k in counts])
        return row.select(F.inline(pairs))

    lines = F.size(F.split(F.col(col), "\n"))
    good = (F.length(col) >= 80) & ~F.contains(F.col(col), F.lit("\0"))
    return (
        stages(df, input_documents=F.count("*"))
        .unionByName(
            stages(
                unique,
                unique_documents=F.count("*"),
                input_paragraphs=F.sum(F.size(tx.paragraphs(F.col(col)))),
            )
        )
        .unionByName(
            stages(
                rebuilt,
                output_paragraphs=F.sum(lines),
                output_documents=F.count("*"),
                good_documents=F.count_if(good),
            )
        )
    )


def lines_to_documents(
    df: DataFrame, file: str = "file", line_no: str = "line_no", line: str = "line", block_lines: int = 100_000
) -> DataFrame:
    """Rows of lines, with blank lines between documents, to one row per document."""
    from lexispark.plans.blocked import running_sum

    blank = (tx.trim_ws(F.col(line)) == "").cast("bigint")
    numbered = running_sum(
        df, [file], [line_no], F.floor(F.col(line_no) / block_lines), blank, "doc_no"
    )
    return (
        numbered.filter(tx.trim_ws(F.col(line)) != "")
        .groupBy(file, "doc_no")
        .agg(F.array_sort(F.collect_list(F.struct(line_no, line))).alias("rows"))
        .select(file, "doc_no", F.array_join(F.col(f"rows.{line}"), "\n").alias("text"))
    )


def pair_lines(df: DataFrame, key: str, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """Even line = label, following odd line = input; a label without an input is dropped."""
    side = F.pmod(F.col(line_no), F.lit(2))
    return (
        df.groupBy(key, F.floor(F.col(line_no) / 2).alias("pair_no"))
        .agg(
            F.max(F.when(side == 0, F.col(line))).alias("y"),
            F.max(F.when(side == 1, F.col(line))).alias("x"),
        )
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def filter_articles(df: DataFrame, col: str = "content", min_chars: int = 500) -> DataFrame:
    c = F.col(col)
    clean = F.length(c) >= min_chars
    for mark in ("div", "class=", "script", "\0"):
        clean = clean & ~F.contains(c, F.lit(mark))
    return df.filter(clean)


def filter_length_range(df: DataFrame, tokens: str, low: int, high: int) -> DataFrame:
    return df.filter(F.size(tokens).between(low, high))


def filter_keywords(df: DataFrame, tokens: str, keywords: list[str], low: int, high: int) -> DataFrame:
    wanted = F.array(*[F.lit(k) for k in keywords])
    return df.filter(F.size(tokens).between(low, high) & F.arrays_overlap(tokens, wanted))


def filter_lexicon_syllables(df: DataFrame, col: str = "word", max_chars: int = 7) -> DataFrame:
    """Single short syllables with no marked letter and no foreign consonant."""
    from lexispark.functions.alphabets import FOREIGN_CONSONANTS, VIETNAMESE_MARKED

    c = F.col(col)
    return df.filter(
        (F.length(c) <= max_chars)
        & ~c.rlike(tx.WS)
        & ~c.rlike(f"[{VIETNAMESE_MARKED}]")
        & ~c.rlike(f"[{FOREIGN_CONSONANTS}]")
        & (F.length(c) > 0)
    )


def hash_split(df: DataFrame, key: str, test_share: float, seed: int = 0, name: str = "split") -> DataFrame:
    """Train/test by a draw on the key: stable under any repartitioning or retry."""
    from lexispark.functions.draws import MODULUS, draw

    limit = int(test_share * MODULUS)
    is_test = draw(seed, F.col(key)) < limit
    return df.withColumn(name, F.when(is_test, "test").otherwise("train"))


def corpus_stats(df: DataFrame, col: str = "text") -> DataFrame:
    return df.agg(
        F.count("*").alias("n_documents"),
        F.coalesce(F.sum(F.size(tx.single_space_tokens(F.col(col)))), F.lit(0)).alias("n_tokens"),
    )
