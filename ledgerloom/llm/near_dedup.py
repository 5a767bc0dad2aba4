"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts makes each text's word shingles, their fingerprint, a signature of minima and one key for each band.
   Texts with one and the same set of shingles are represented by the least id.
2. Of each bucket (band and key) the least id leads; the others are its candidates. Signatures are compared batch by batch, and
   a pair goes once the posterior probability that its similarity reaches the threshold, given the matches so far
   and a uniform prior, is below the miss probability. Survivors are verified on their whole sets of shingles.
3. Where a bucket is in several components, the least of each of its largest components is put to the bucket's other components; this, too, is
   linear in the bucket. Components are taken anew.
4. What then is still in two components of a bucket is compared in blocks of signatures, all of it: a task gets two blocks of rows, not their pairs, and
   gives out those that survive. Blocks within one component never meet. So the groups are those that comparing every pair of every bucket
   would give, yet a bucket of n copies costs n comparisons and not n squared, and no bucket is in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components, cut, drop_cut
from ..functions.text import numbered
from .common import Words, as_string, mix, slices, table, word_hashes, words

SHINGLE, BANDS, ROWS, THRESHOLD, MISS, BATCH = 3, 40, 4, 0.5, 0.01, 32
#: Components of a bucket that have a leader in the second pass, and rows of a block in the third.
LEADERS, BLOCK = 8, 2048
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»¿¡…“”„‚‘’–—"
PER_LEADER = 2000
_R = np.random.default_rng(5)
_A = _R.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _R.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_P = np.array([mix(np.array([i + 1], np.uint64))[0] | np.uint64(1) for i in range(SHINGLE)])


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of SHINGLE words, lower-cased and without marks at their ends, and offsets by row.

    A row of fewer words has one shingle of all of them; a row without words has none.
    """
    w = words(as_string(col), lower=True)
    vocab = pc.utf8_trim(w.vocab, MARKS)
    full = pc.not_equal(vocab, "").to_numpy(zero_copy_only=False)[w.codes] if len(w.vocab) else np.zeros(0, bool)
    off = np.concatenate([[0], np.cumsum(full)])[w.offsets]
    h = word_hashes(vocab)[w.codes[full]] if len(w.vocab) else np.zeros(0, np.uint64)
    n = np.diff(off)
    roll = h * _P[0]
    for i in range(1, SHINGLE):
        roll[:-i] += h[i:] * _P[i]
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    at = np.arange(int(count.sum())) + np.repeat(off[:-1] - (np.cumsum(count) - count), count)
    out = mix(roll[at])
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)):  # too short: its words alone, whatever follows in the chunk
        v = (h[off[r] : off[r + 1]] * _P[: n[r]]).sum(dtype=np.uint64, keepdims=True)
        out[int(count[:r].sum())] = mix(v ^ n[r : r + 1].astype(np.uint64))[0]
    return out, np.concatenate([[0], np.cumsum(count)])


def fingerprint(s: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """Sixteen bytes for each row's set of shingles; none for an empty one."""
    out: list[bytes | None] = []
    for i, j in zip(off, off[1:]):
        if i == j:
            out.append(None)
            continue
        u = np.unique(s[i:j])
        out.append(np.array([u.sum(dtype=np.uint64), mix(u + np.uint64(0xA5A5)).sum(dtype=np.uint64)], np.uint64).tobytes())
    return out


def signatures(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minima, 32 bits each, of the rows, none of which may be empty."""
    out = np.empty((len(off) - 1, BANDS * ROWS), np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(off) - 1:  # blocks of rows whose shingles fit a cache
        j = max(i + 1, int(np.searchsorted(off, off[i] + 32768, side="right")) - 1)
        part, cut_ = h[off[i] : off[j]], (off[i:j] - off[i]).astype(np.int64)
        buf = np.empty_like(part)
        for k in range(BANDS * ROWS):
            np.multiply(part, _A[k], out=buf)
            np.add(buf, _B[k], out=buf)
            out[i:j, k] = np.minimum.reduceat(buf, cut_)
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    x = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    k = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + x[:, :, r])
    return mix(k + np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def least_matches(threshold: float = THRESHOLD, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches below which a pair goes).

    With a uniform prior, m matches of n give Beta(m + 1, n - m + 1); P(similarity >= t) = P(Binomial(n + 1, t) <= m). A pair is looked at
    several times; each look has its share of the miss probability, which is so that of all together at most.
    """
    out = []
    miss /= BANDS * ROWS // BATCH
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        m = total = 0
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, off = shingles(b.column("text"))
            full = np.diff(off) > 0
            sig = signatures(s, np.concatenate([[0], np.cumsum(np.diff(off)[full])]))
            keys = band_keys(sig)
            n = int(full.sum())
            low = np.ascontiguousarray(sig.astype(np.uint16))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").filter(pa.array(full)),
                    pa.array([x for x in fingerprint(s, off) if x], pa.binary()),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * low.shape[1] * 2).astype(np.int32).tobytes()), pa.py_buffer(low.tobytes())]),
                    pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * BANDS).astype(np.int32)), pa.array(keys.ravel())),
                ],
                ["id", "fp", "sig", "bands"],
            )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    return picked.mapInArrow(run, f"id {kind}, fp binary, sig binary, bands array<bigint>")


def _prune(pairs: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) that signatures don't rule out."""
    steps = least_matches(threshold, miss)
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            alive, hits, done = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            for n, m in steps:
                hits = hits + (x[alive, done:n] == y[alive, done:n]).sum(1)
                ok = hits >= m
                alive, hits, done = alive[ok], hits[ok], n
            yield b.select(["a", "b"]).take(pa.array(alive))

    left, right = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least that Jaccard similarity. Texts go to the leader a, whose own comes first."""
    kind = pairs.schema["a"].dataType.simpleString()
    parts = pairs.groupBy("a").agg(F.floor(F.count(F.lit(1)) / PER_LEADER).cast("int").alias("last"))
    members = pairs.join(parts, "a").select(F.col("b").alias("id"), "a", F.when(F.col("last") > 0, F.pmod(F.hash("b"), F.col("last") + 1)).otherwise(0).alias("part"), F.lit(1).alias("role"))
    leaders = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"), F.lit(0).alias("role"))
    wanted = members.unionByName(leaders).groupBy("id").agg(F.collect_list(F.struct("a", "part", "role")).alias("to"))
    rows = docs.join(wanted.join(reps, "id"), "id").select("id", "fp", "text", F.explode("to").alias("t")).select("t.*", "id", "fp", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, None
        for b in slices(batches, "text"):
            s, off = shingles(b.column("text"))
            fps = fingerprint(s, off)
            out_a, out_b = [], []
            for r, (a, part, role, i, fp) in enumerate(zip(*(b.column(c).to_pylist() for c in ("a", "part", "role", "id", "fp")))):
                if fps[r] != fp:
                    continue  # another text under the same id, which doesn't stand for it
                u = np.unique(s[off[r] : off[r + 1]])
                if role == 0:
                    now, lead = (a, part), u
                elif now == (a, part):
                    both = len(np.intersect1d(lead, u, assume_unique=True))
                    if both >= threshold * (len(lead) + len(u) - both):
                        out_a.append(a)
                        out_b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, b.schema.field("a").type), pa.array(out_b, b.schema.field("id").type)], ["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _split(live: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, id, c) of the buckets that are in several components."""
    named = live.join(comp, live["id"] == comp["node"], "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    several = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    return cut(named.join(several, "key"))


def _second(live: DataFrame, first: DataFrame, sigs: DataFrame, edges: DataFrame, comp: DataFrame, source: DataFrame, reps: DataFrame, threshold: float, miss: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The open buckets, components and edges after the leaders of each bucket's largest components have met the others."""
    open_ = _split(live, comp)
    parts = open_.groupBy("key", "c").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"))
    pairs = open_.join(_largest(cut(parts)), "key").filter("c <> lc").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = cut(_prune(cut(pairs), sigs, threshold, miss))
    if more.isEmpty():
        return open_, comp, edges
    edges = cut(edges.unionByName(_verify(more, source, reps, threshold)))
    comp = cut(connected_components(edges, src="a", dst="b"))
    return _split(open_.select("key", "id"), comp), comp, edges


def _largest(parts: DataFrame) -> DataFrame:
    """(key, lc, a): the leaders of LEADERS components of each key. Spark cuts each key's ranks off before its rows are shuffled, so no task holds all of a key."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.desc("a"), F.desc("c")))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= LEADERS).select("key", F.col("c").alias("lc"), "a")


def _blocks(open_: DataFrame, sigs: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b), a < b, of the pairs of a bucket in two components that signatures don't rule out; blocks meet in tasks of their own."""
    kind = open_.schema["id"].dataType.simpleString()
    steps = least_matches(threshold, miss)
    # a place of each row in its bucket, the components one after the other
    order = ["key", "c", "id"]
    rows = numbered(open_, order, "at")
    begin = rows.groupBy("key").agg(F.min("at").alias("begin"))
    rows = cut(rows.join(begin, "key").withColumn("block", F.floor((F.col("at") - F.col("begin")) / BLOCK).cast("int")).select("key", "id", "c", "block"))
    spans = rows.groupBy("key", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    most = spans.groupBy("key").agg((F.max("block") + 1).alias("blocks"), F.min("lo").alias("first"))
    left = spans.join(most, "key").select("key", F.col("block").alias("x"), "lo", "hi", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"))
    right = spans.select("key", F.col("block").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = left.join(right, ["key", "y"]).filter("lo <> hi2 or hi <> lo2").select("key", "x", "y")
    ends = meet.select("key", "x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).unionByName(meet.filter("x <> y").select("key", "x", "y", F.col("y").alias("block"), F.lit(1).alias("side")))
    held = rows.join(sigs.select("id", "sig"), "id").join(ends, ["key", "block"]).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side").select("key", "x", "y", "side", "id", "c", "sig")

    def compare(p: pa.Table, q: pa.Table) -> tuple[pa.Array, pa.Array]:
        s, t = (np.frombuffer(b"".join(v.column("sig").to_pylist()), np.uint16).reshape(v.num_rows, -1) for v in (p, q))
        both = pa.chunked_array([*p.column("c").chunks, *q.column("c").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        cp, cq = both[: p.num_rows], both[p.num_rows :]
        found_i, found_j = [], []
        for i in range(0, p.num_rows, 256):
            hits, (n, m) = np.zeros((len(s[i : i + 256]), len(t)), np.uint8), steps[0]
            for k in range(n):
                hits += s[i : i + 256, k, None] == t[None, :, k]
            u, v = np.nonzero((hits >= m) & (cp[i : i + 256, None] != cq[None, :]))
            hits = hits[u, v].astype(np.int64)
            for (before, _), (n, m) in zip(steps, steps[1:]):
                hits += (s[i + u, before:n] == t[v, before:n]).sum(1)
                ok = hits >= m
                u, v, hits = u[ok], v[ok], hits[ok]
            found_i.append(i + u), found_j.append(v)
        pick = lambda w, f: w.column("id").combine_chunks().take(pa.array(np.concatenate(f)))
        return pick(p, found_i), pick(q, found_j)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def answer() -> Iterator[pa.RecordBatch]:
            if sides[0]:
                p = pa.Table.from_batches(sides[0])
                a, b = compare(p, pa.Table.from_batches(sides[1]) if sides[1] else p)
                yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for b in batches:
            keys = np.stack([b.column(n).to_numpy().astype(np.int64) for n in ("key", "x", "y", "side")], 1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j == i:
                    continue
                k = tuple(keys[i, :3])
                if k != now:
                    yield from answer()
                    now, sides = k, ([], [])
                sides[keys[i, 3]].append(b.slice(i, j - i))
        yield from answer()

    pairs = held.mapInArrow(run, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(id, group_id, group_size) of the ids that are in a group of two or more; group_id is the least id of the group.

    Groups are the components of pairs whose Jaccard similarity of word shingles is at least threshold, among pairs that share a
    band. Rows with a null id or text and texts without words are in no group. Rows that repeat an id count once; if their
    texts differ, the one with the least fingerprint stands for the id. Other columns, whatever their names, are dropped. An empty table gives an
    empty result. Texts are whole whatever their length, and buckets have no cap.
    """
    sketch = cut(_sketch(docs, id_col, text_col))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    one = cut(sketch.groupBy("id").agg(F.min("fp").alias("fp")))
    reps = cut(one.groupBy("fp").agg(F.min("id").alias("id")))
    mine = sketch.join(reps, ["id", "fp"], "left_semi")
    sigs = cut(mine.dropDuplicates(["id"]))
    drop_cut(sketch)
    bands = sigs.select("id", F.explode("bands").alias("key"))
    leads = bands.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    live = cut(bands.join(leads, "key"))
    first = cut(live.filter("id <> a").select("a", F.col("id").alias("b")).distinct())
    edges = cut(_verify(cut(_prune(first, sigs, threshold, miss)), source, reps, threshold))
    comp = cut(connected_components(edges, src="a", dst="b"))
    open_, comp, edges = _second(live, first, sigs, edges, comp, source, reps, threshold, miss)
    left = cut(_blocks(open_, sigs, threshold, miss).join(first, ["a", "b"], "left_anti"))
    if not left.isEmpty():
        edges = edges.unionByName(_verify(left, source, reps, threshold))
        comp = cut(connected_components(edges, src="a", dst="b"))
    group = one.join(reps.select("fp", F.col("id").alias("rep")), "fp").join(comp, F.col("rep") == F.col("node"), "left").select("id", F.coalesce("component", "rep").alias("group_id"))
    size = group.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return group.join(size, "group_id").select(F.col("id").alias(id_col), "group_id", "group_size")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """The rows of docs, all columns, but for the ids that are in a group and not its least id.

    Rows with a null id or text, and texts without words, stay; so do all rows that repeat the id of a document that stays. Equal texts are one
    group whatever their number. Extra columns, whatever their names, are kept as they are; an empty table stays empty.
    """
    gone = near_duplicates(docs, id_col=id_col, **kw).filter(F.col(id_col) != F.col("group_id")).select(F.col(id_col).alias("gone_id"))
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
