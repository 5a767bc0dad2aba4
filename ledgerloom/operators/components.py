"""Connected components of an undirected graph by alternating large-star and small-star rounds."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: set[str] = set()

#: Edges whose components are taken at once within a task.
TOGETHER = 1 << 19


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one the context was given; where both are unset, one under the warehouse in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.shared")
        where = sc._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def _delete(folder: str) -> None:
    jvm = SparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    sc = SparkContext._active_spark_context
    conf = sc._jsc.hadoopConfiguration() if sc is not None and sc._jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
    path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so that lineage ends at files that outlive executors.

    What drop_cut doesn't delete, because a result still reads it, is deleted when the driver's process ends.
    """
    path = f"{checkpoint_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _written.add(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(*frames: DataFrame) -> None:
    """Delete what cut wrote; only for frames that no later plan reads."""
    for df in frames:
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/cut-" in folder:
                _delete(folder)
                name = folder.rsplit("/", 1)[1]
                _written.difference_update([x for x in _written if x.endswith(name)])


@atexit.register
def _drop_rest() -> None:
    for folder in list(_written):
        try:
            _delete(folder)
        except Exception:  # the JVM is gone; its folder is the cluster's to clear
            return
        _written.discard(folder)


def _hung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For runs of edges (u, v) each node but the least of its component in the run, with that one: as many edges as nodes at most, and the same components."""
    held, rows = [], 0

    def star() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        both = pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        names = both.dictionary.take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[both.indices.to_numpy()]
        a, b = at[: t.num_rows], at[t.num_rows :]
        label = np.arange(len(order))
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            a, b = a[apart], b[apart]  # ends that met stay together
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.record_batch([names.take(pa.array(far)), names.take(pa.array(label[far]))], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield star()
            held, rows = [], 0
    if rows:
        yield star()


def connected_components(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node that each node of the edges reaches. Self-loops keep their node; null ends are dropped.

    Each round hangs the larger neighbours of a node on its least neighbour, then the smaller ones, until nothing changes, which takes
    a number of rounds that grows with the logarithm of the longest chain. Only minima are aggregated, never neighbour lists.
    Before the first round each task replaces runs of its edges by stars, which leaves few of a dense graph.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    loops = pairs.filter("a = b").select(F.col("a").alias("node")).distinct()
    pairs = pairs.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if pairs.schema["u"].dataType.simpleString() in ("string", "bigint", "int"):
        pairs = pairs.repartition("v").mapInArrow(_hung, pairs.schema)
    now = cut(pairs.distinct())
    state = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = cut(small)
        drop_cut(now)
        now = after
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.join(hung.unionByName(roots), "node", "left_anti").select("node", F.col("node").alias("component"))
    return hung.unionByName(roots).unionByName(alone)
