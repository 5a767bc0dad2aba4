"""Sinks: the append-only ledger as snapshots with transitions, raw texts, graph exports, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSITION = "claim_id long, kind string, value string, at timestamp_ntz"


def append(df: DataFrame, path: str, *, by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key isn't stored; how many."""
    spark = df.sparkSession
    once = df.dropDuplicates(keys)
    if _exists(spark, path):
        once = once.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    before = spark.read.parquet(path).count() if _exists(spark, path) else 0
    append(once, path)
    return spark.read.parquet(path).count() - before


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def current_claims(base: DataFrame, transitions: DataFrame) -> DataFrame:
    """base with its transitions folded in: the first retraction, the last successor and the last end of validity."""
    t = transitions.groupBy("claim_id").agg(
        F.min(F.when(F.col("kind") == "retract", F.col("at"))).alias("_r"), F.max_by("value", F.when(F.col("kind") == "supersede", F.col("at"))).alias("_s"), F.max_by("value", F.when(F.col("kind") == "close", F.col("at"))).alias("_c")
    )
    rows = base.join(t, base["id"] == t["claim_id"], "left")
    return rows.withColumn("retracted_at", F.coalesce("retracted_at", "_r")).withColumn("superseded_by", F.coalesce(F.col("_s").cast("long"), "superseded_by")).withColumn("valid_to", F.coalesce(F.col("_c").cast("date"), "valid_to")).drop("claim_id", "_r", "_s", "_c")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
