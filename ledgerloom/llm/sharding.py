"""Best-fit-decreasing bin packing of indivisible groups into shards of fixed capacity.

Groups enter by size, the largest first, each into the bin with the least remaining capacity that holds it. Groups of one size are
interchangeable, and so are bins with one remaining capacity; so what is packed are the counts of a histogram of sizes, and what is
kept, in a balanced search tree, are classes of bins by remaining capacity. A bin that takes a group of a size is again the
tightest for the next while it holds one more, so a class of bins takes a run of groups at once. The outcome is that of entering groups one
by one, for work that depends on the number of distinct sizes and not of groups. Groups learn their bins by their rank within their size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

CAPACITY = 8 << 20


class Tree:
    """AVL tree from remaining capacities to lists of runs of bins (first, number)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(n) -> int:
        return n[4] if n else 0

    def _fix(self, n):
        n[4] = 1 + max(self._height(n[2]), self._height(n[3]))
        tilt = self._height(n[2]) - self._height(n[3])
        if tilt > 1:
            if self._height(n[2][2]) < self._height(n[2][3]):
                n[2] = self._turn(n[2], 3)
            return self._turn(n, 2)
        if tilt < -1:
            if self._height(n[3][3]) < self._height(n[3][2]):
                n[3] = self._turn(n[3], 2)
            return self._turn(n, 3)
        return n

    def _turn(self, n, side: int):
        """Rotate: the child on side becomes the root."""
        c = n[side]
        n[side], c[5 - side] = c[5 - side], n
        n[4] = 1 + max(self._height(n[2]), self._height(n[3]))
        c[4] = 1 + max(self._height(c[2]), self._height(c[3]))
        return c

    def add(self, key: int, runs: list) -> None:
        self.root = self._add(self.root, key, runs)

    def _add(self, n, key, runs):
        if n is None:
            return [key, list(runs), None, None, 1]
        if key == n[0]:
            n[1].extend(runs)
            return n
        side = 2 if key < n[0] else 3
        n[side] = self._add(n[side], key, runs)
        return self._fix(n)

    def ceiling(self, key: int):
        """The least key that is at least key, or None."""
        n, best = self.root, None
        while n:
            if n[0] >= key:
                best, n = n[0], n[2]
            else:
                n = n[3]
        return best

    def pop(self, key: int) -> list:
        self.root, runs = self._pop(self.root, key)
        return runs

    def _pop(self, n, key):
        if key != n[0]:
            side = 2 if key < n[0] else 3
            n[side], runs = self._pop(n[side], key)
            return self._fix(n), runs
        runs = n[1]
        if n[2] and n[3]:
            m = n[3]
            while m[2]:
                m = m[2]
            n[0], n[1] = m[0], m[1]
            n[3], _ = self._pop(n[3], m[0])
            return self._fix(n), runs
        return n[2] or n[3], runs


def pack(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Runs (size, rank, n, bin, per_bin): groups of that size with ranks rank .. rank + n go to bin, bin + 1, ..., per_bin to each.

    Within a class, bins are filled by number. A size above capacity gets a bin of its own for each group. Sizes of 0 go to bin 0.
    """
    tree, bins, out = Tree(), 0, []
    for i in np.argsort(-sizes, kind="stable"):
        s, left, rank = int(sizes[i]), int(counts[i]), 0
        if not left:
            continue
        if s == 0:
            out.append((0, 0, left, 0, left))
            bins = max(bins, 1)
            continue
        if s > capacity:
            out.append((s, 0, left, bins, 1))
            bins += left
            continue
        while left:
            r = tree.ceiling(s)
            if r is None:
                each = capacity // s
                need = -(-left // each)
                runs, r = [(bins, need)], capacity
                bins += need
            else:
                each, runs = r // s, sorted(tree.pop(r))
            rest = []
            for b, k in runs:
                full = min(k, left // each)
                if full:
                    out.append((s, rank, full * each, b, each))
                    rank, left = rank + full * each, left - full * each
                    tree.add(r - each * s, [(b, full)])
                    b, k = b + full, k - full
                if k and 0 < left < each:
                    out.append((s, rank, left, b, each))
                    tree.add(r - left * s, [(b, 1)])
                    left = 0
                    b, k = b + 1, k - 1
                if k:
                    rest.append((b, k))
            if rest:
                tree.add(r, rest)
    return pd.DataFrame(out, columns=["size", "rank", "n", "bin", "per_bin"]).astype("int64")


def _ranked(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, size, part, rank) with its rank among groups of its size, by group, and (size, part, before, n): the pieces of each size.

    Sorted by range and group, so that no size has to fit one task.
    """
    placed = materialize(groups.repartitionByRange("size", "group").sortWithinPartitions("size", "group").select("group", "size", F.spark_partition_id().alias("part")))
    counts = placed.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
    pieces = materialize(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    inner = placed.withColumn("inner", F.row_number().over(Window.partitionBy("size", "part").orderBy("group")) - 1)
    return inner.join(pieces.drop("n"), ["size", "part"]).select("group", "size", "part", (F.col("before") + F.col("inner")).alias("rank")), pieces


def assign(groups: DataFrame, *, group_col: str = "group", size_col: str = "size", capacity: int = CAPACITY) -> DataFrame:
    """(group, size, shard) for each group.

    Sizes are whole numbers; a null or negative size counts as 0. Rows that repeat a group are one, of their summed size; a null group is a
    group. Groups of one size enter by group. A group above capacity has a shard of its own; groups of size 0 go to shard 0. Other columns, whatever
    their names, are dropped. An empty table gives an empty result. The driver holds the histogram, whose length is the
    number of distinct sizes (at most capacity, besides those above it).
    """
    spark = groups.sparkSession
    sums = materialize(groups.select(F.col(group_col).alias("group"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size")).groupBy("group").agg(F.sum("size").alias("size")))
    # a size above capacity never shares a bin: only how many there are matters
    clipped = sums.withColumn("size", F.least("size", F.lit(capacity + 1)).cast("long"))
    histogram = clipped.groupBy("size").agg(F.count(F.lit(1)).alias("n")).toPandas()
    runs = pack(histogram["size"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), capacity)
    plan = spark.createDataFrame(runs, "size long, rank long, n long, bin long, per_bin long") if len(runs) else spark.createDataFrame([], "size long, rank long, n long, bin long, per_bin long")
    # runs start at their ranks; a group's is the last that starts at or before its own. Each piece of a size gets the runs that reach into it
    ranked, pieces = _ranked(clipped)
    none = F.lit(None).cast(sums.schema["group"].dataType)
    starts = plan.join(pieces.withColumnRenamed("n", "m"), "size").filter((F.col("rank") < F.col("before") + F.col("m")) & (F.col("rank") + F.col("n") > F.col("before")))
    starts = starts.select("size", "part", F.greatest("rank", "before").alias("rank"), F.struct("rank", "bin", "per_bin").alias("run"), none.alias("group"), F.lit(0).alias("role"))
    both = ranked.select("size", "part", "rank", F.lit(None).cast(starts.schema["run"].dataType).alias("run"), "group", F.lit(1).alias("role")).unionByName(starts)
    last = F.last("run", ignorenulls=True).over(Window.partitionBy("size", "part").orderBy("rank", "role").rowsBetween(Window.unboundedPreceding, 0))
    shard = both.withColumn("last", last).filter("role = 1").select("group", (F.col("last.bin") + F.floor((F.col("rank") - F.col("last.rank")) / F.col("last.per_bin"))).alias("shard"))
    out = sums.join(shard, sums["group"].eqNullSafe(shard["group"])).select(sums["group"].alias(group_col), sums["size"].alias(size_col), "shard")
    return out


def op2_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents into shards of CAPACITY bytes; copies of one text are a group, named by its least doc_id, and stay together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("h"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("bytes"))
    groups = materialize(docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_docs")))
    shards = assign(groups, group_col="doc_id", size_col="bytes")
    return shards.join(groups.select("doc_id", "n_docs"), "doc_id")
