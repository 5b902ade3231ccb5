"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexispark.llm import bpe_trie, jaccard_join, pu_quality, site_lines, spaced_seeds
from lexispark.plans.checkpoints import scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows among them.

    All columns stay as they are, whatever their names. Null and empty texts are
    scored like texts without words; repeated rows are judged each.
    """
    model = pu_quality.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(pu_quality.score_column(F.col("text"), model) >= 0.3)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str, max_ratio: float = 0.01) -> DataFrame:
    """All documents, without lines that over ``max_ratio`` of their source's documents hold, and at least four.

    Copies and near copies count as one document here: the next stage keeps one of them, which needs its lines.

    A source holds far more than a site: ordinary lines stand in one document or a few, repeated ones in some
    hundredths of it.
    """
    cleaned = site_lines.drop_boilerplate(docs, F.col("source"), max_ratio=max_ratio, by_content=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return spaced_seeds.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents (little-endian unsigned 32-bit) and a digest of the text decoded from them."""
    coded = bpe_trie.encode_decode(docs.select("doc_id", "lang", "source", "text"), bpe_trie.default_tokenizer())
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", "lang", "source", n, "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_site_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: SQL expresses neither the classifier nor the tokenizer; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
