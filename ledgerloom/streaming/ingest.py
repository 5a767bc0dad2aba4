"""Incremental ingestion: documents once each, and alerts over new claims, with triggers that take what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts
from ..sources import writers


def ingest_documents(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> int:
    """Append the documents of source that target lacks, by (source_id, content_hash); the number of rows stored after it.

    Each batch is compared with what is stored, so that state doesn't grow and late copies are found whenever they come.
    """
    def batch(df: DataFrame, _: int) -> None:
        writers.append_new(df.withColumn("content_hash", F.sha2("text", 256)), target, ["source_id", "content_hash"])
    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).count()


def dedup_stream(stream: DataFrame, *, late: str = "10 days", at: str = "retrieved_at") -> DataFrame:
    """Documents of a stream once each while state is held for copies that are at most so late."""
    return stream.withColumn("content_hash", F.sha2("text", 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["source_id", "content_hash"])


def alert_stream(claims: DataFrame, entities: DataFrame, watches: DataFrame, target: str, checkpoint: str, predicate: str = "OWNS") -> None:
    """Fire the rules over new claims against static watches; each watch and key is stored once."""
    def batch(df: DataFrame, _: int) -> None:
        fired = alerts.stake_threshold(df, entities, watches, predicate).unionByName(alerts.new_claim(df, entities, watches))
        writers.append_new(fired.groupBy("watch_id", "dedup_key").agg(F.min("message").alias("message")), target, ["watch_id", "dedup_key"])
    claims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_counts(stream: DataFrame, *, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Claims by predicate and day of assertion, closed once the watermark has passed."""
    return stream.withWatermark("asserted_at", late).groupBy(F.window("asserted_at", window).alias("w"), "predicate").agg(F.count(F.lit(1)).alias("n")).select("w.start", "predicate", "n")
