"""Article feed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexispark.operators.corpus import filter_articles

SCHEMA = "url string, content string, date timestamp"


def from_files(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def from_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Articles keyed by url, from the earliest offset; needs the Kafka connector on the class path."""
    source = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return source.select(
        F.col("key").cast("string").alias("url"), F.col("value").cast("string").alias("content"), F.col("timestamp").alias("date")
    )


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish articles with the url as key; needs the Kafka connector on the class path."""
    return (
        df.select(F.col("url").alias("key"), F.col("content").alias("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def good_articles(stream: DataFrame) -> DataFrame:
    return stream.transform(filter_articles, "content")


def novel_articles(stream: DataFrame, lifetime: str | None = None) -> DataFrame:
    """First article of every url, over the whole stream and its restarts.

    The urls seen are keyed state in the checkpoint, dealt over all tasks by url.
    Without ``lifetime`` they are kept for good and no row is ever too late; at
    that size use the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), which holds state on disk.
    With a ``lifetime`` a url is forgotten that long after its date, and rows that
    are later than that are dropped.
    """
    if lifetime is None:
        return stream.dropDuplicates(["url"])
    return stream.withWatermark("date", lifetime).dropDuplicatesWithinWatermark(["url"])


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()
