"""Benchmark decontamination with spaced seeds: overlaps that tolerate substituted words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexispark.llm.registry import let, query, table

#: Places that a mask looks at; what lies between is ignored. Any overlap of WINDOW words with at most
#: ``spare(WINDOW)`` substitutions has a seed of some mask without a substitution (tested over all patterns).
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9))
#: Words of an overlap; a shorter item must be met whole. Items below LEAST_WORDS words are not looked for.
WINDOW, LEAST_WORDS = 16, 10
#: Most seeds of benchmarks that are broadcast (40 bytes each); beyond it, the seeds are joined by a shuffle.
BROADCAST_SEEDS = 1_000_000
_SALTS = 16


def spare(words: int) -> int:
    """Substitutions allowed in an overlap of so many words."""
    return 3 * words // 16


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(words: Column) -> Column:
    """Structs (seed, at) of all masks at all places where they fit."""
    def of_mask(number: int, mask: tuple[int, ...]) -> Column:
        last = F.size(words) - 1 - mask[-1]
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        seed = lambda i: F.xxhash64(F.lit(number), *[F.get(words, i + p) for p in mask])
        return F.transform(places, lambda i: F.struct(seed(i).alias("seed"), i.alias("at")))

    return F.concat(*[of_mask(n, m) for n, m in enumerate(MASKS)])


def overlaps(docs: DataFrame, items: DataFrame, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``content`` (md5 of a document's text), item and best overlap of every contaminated text.

    Seeds of texts meet seeds of items; a meeting gives a text, an item and the
    shift between them, which is then verified word by word: some window of
    WINDOW words of the item (the whole item if it is shorter) stands in the
    text with at most ``spare`` words replaced. Null ids of items stay, null
    texts match nothing, repeated items count as one each id.

    Texts are named by content, so copies of a text are looked at once.
    """
    bench = (
        items.select(F.struct(F.col(item_id)).alias("item"), words_of(F.col(item_text)).alias("item_words"))
        .filter(F.size("item_words") >= LEAST_WORDS)
        .distinct()
    )
    wanted = (
        bench.select("item", "item_words", F.explode(let(F.col("item_words"), _seeds)).alias("s"))
        .select("s.seed", "item", "item_words", F.col("s.at").alias("item_at"))
    )
    found = wanted.select("seed", F.xxhash64("item_words").alias("words_hash"), "item", "item_at")
    if found.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        found = F.broadcast(found)
    content = F.md5(F.col(doc_text))
    texts = docs.select(content.alias("content"), F.col(doc_text).alias("t")).filter(F.col("t").isNotNull())
    hits = (
        texts.select("content", F.explode(let(words_of(F.col("t")), _seeds)).alias("s"))
        .select("content", "s.seed", "s.at")
        .join(found, "seed")
        .select("content", "item", "words_hash", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    # Copies of a text that many rows hold meet in several tasks, each of which passes on one.
    salt = F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("salt")
    salted = hits.select("content").distinct().select("content", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    hit_texts = (
        texts.select("content", "t", salt)
        .join(salted, ["content", "salt"], "left_semi")
        .select("content", "t")
        .dropDuplicates(["content"])
    )
    lines = (
        hits.join(hit_texts, "content")
        .join(bench.withColumn("words_hash", F.xxhash64("item_words")), ["item", "words_hash"])
        .select("content", "item", "shift", words_of(F.col("t")).alias("w"), "item_words")
        .withColumn("best", _best_window())
        .select("content", "item", F.col("shift") + F.col("best.at"), "best.matched", "best.size")
        .toDF("content", "item", "begin", "matched", "size")
    )
    allowed = F.floor(3 * F.col("size") / 16)
    return (
        lines.filter(F.col("size") - F.col("matched") <= allowed)
        .groupBy("content", "item")
        .agg(F.max_by(F.struct("begin", "matched", "size"), F.struct(F.col("matched"), -F.col("begin"))).alias("o"))
        .select("content", F.col("item")[item_id].alias(item_id), "o.begin", "o.matched", "o.size")
    )


def _best_window() -> Column:
    """The item's window (place, words matched, size) that stands best in the text at this shift."""
    w, item, shift = F.col("w"), F.col("item_words"), F.col("shift")

    def windows(equal: Column) -> Column:
        size = F.least(F.lit(WINDOW), F.size(item))
        places = F.sequence(F.lit(0), F.size(item) - size)
        count = lambda i: F.aggregate(F.slice(equal, i + 1, size), F.lit(0), lambda s, x: s + x)
        found = F.transform(
            places, lambda i: F.struct(count(i).alias("matched"), (-i).alias("order"), i.alias("at"), size.alias("size"))
        )
        return F.array_max(found)

    def both(words: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(item) - 1)
        same = lambda j: F.coalesce((F.get(words, shift + j) == F.get(item, j)).cast("int"), F.lit(0))
        return let(F.transform(places, same), windows)

    return let(w, both)


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per contaminated document and item: ``doc_id``, ``item_id``, first word, words matched, overlap size."""
    told = overlaps(docs, items, text)
    keyed = docs.select(doc_id, F.md5(F.col(text)).alias("content"))
    return keyed.join(told, "content").drop("content")


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents; null and empty texts stay."""
    told = overlaps(docs, items, text).select("content").distinct()
    keyed = docs.withColumn("__content", F.md5(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(told, keyed["__content"] == told["content"], "left_anti").select(*docs.columns)


@query("op4_spaced_seeds")
def spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
