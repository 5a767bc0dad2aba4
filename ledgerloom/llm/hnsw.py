"""Embedding near-duplicates by hierarchical navigable small-world graphs.

Vectors are spread over shards by a hash of their id; each shard gets a graph, and every vector queries every shard. A query whose whole
beam is above the threshold has its beam doubled, and past WIDEST the shard is scanned for it, so that no number of partners is cut off.
Each task audits its own recall against brute force, and doubles all beams until it passes: of the pairs of a sample of its queries, their
own vectors left out, and of those of probes, which are made at just the threshold's cosine from vectors of the shard, so that
there is something to miss however few pairs a table has. What is found
is verified by its cosine; a task sends a spanning forest of its pairs, and components are united over all.
Insertion and search advance many vectors in step, in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import discard, materialize, table

THRESHOLD, M, EF_BUILD, EF, WIDEST, AUDIT, RECALL = 0.9, 16, 48, 16, 256, 256, 0.98
#: Bytes of a shard's vectors and links at most; the rows from which on there are more shards than one, one for each core at most; queries of a task.
SHARD_BYTES, SHARD, QUERIES = 128 << 20, 32_000, 500_000
BATCH, STEP, SEEN = 512, 4, 64 << 20
#: So many nearest vectors are audited where a share of them is asked for.
NEAREST = 10


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in descending order."""
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (sorted, -1: none): those nearer to the base than to one already chosen, then the rest in order."""
    rows, c = ids.shape
    valid = ids >= 0
    v = x[np.maximum(ids, 0)]
    near = v @ v.transpose(0, 2, 1)
    chosen = np.zeros((rows, c), bool)
    count = np.zeros(rows, np.int64)
    for j in range(c):
        worst = np.where(chosen, near[:, j, :], -2.0).max(1)
        ok = valid[:, j] & (count < m) & (worst < sims[:, j])
        chosen[:, j] = ok
        count += ok
    place = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, place, 1)
    if out.shape[1] < m:
        out = np.concatenate([out, np.full((rows, m - out.shape[1]), -1, out.dtype)], 1)
    return out


@dataclass
class Graph:
    """links[l][i]: neighbours of node i on level l, -1 where there are fewer; entry: a node of the highest level."""

    x: np.ndarray
    links: list[np.ndarray]
    entry: int

    def search(self, q: np.ndarray, ef: int, level: int = 0, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beams (ids, sims) of the queries on a level, best first; from the entry, descending, unless start is given."""
        if len(q) > 1 and len(q) * len(self.x) > SEEN:  # what has been seen is held for each pair
            at = np.array_split(np.arange(len(q)), -(-len(q) * len(self.x) // SEEN))
            done_ = [self.search(q[i], ef, level, None if start is None else start[i]) for i in at if len(i)]
            return np.concatenate([i for i, _ in done_]), np.concatenate([s for _, s in done_])
        if start is None:
            start = np.full((len(q), 1), self.entry, np.int32)
            for upper in range(len(self.links) - 1, level, -1):
                start = self.search(q, 2, upper, start)[0][:, :1]
        x, links, n = self.x, self.links[level], len(q)
        ids, sims = np.full((n, ef), -1, np.int32), np.full((n, ef), -2.0, np.float32)
        done = np.ones((n, ef), bool)
        seen = np.zeros((n, len(x)), bool)
        k = min(start.shape[1], ef)
        ids[:, :k] = start[:, :k]
        real = start[:, :k] >= 0
        sims[:, :k] = np.where(real, np.einsum("nkd,nd->nk", x[np.maximum(start[:, :k], 0)], q), -2.0)
        done[:, :k] = ~real
        seen[np.arange(n)[:, None], np.maximum(start[:, :k], 0)] = True
        live = np.arange(n)
        while len(live):
            step = min(STEP, ef)
            open_ = np.where(done[live], -3.0, sims[live])
            best = _top(open_, step)
            good = np.take_along_axis(open_, best, 1) > -3
            some = good.any(1)
            live, best, good = live[some], best[some], good[some]
            if not len(live):
                break
            done[live[:, None], best] |= good
            near = links[np.maximum(np.take_along_axis(ids[live], best, 1), 0)]
            near = np.where(good[:, :, None], near, -1).reshape(len(live), -1)
            r, c = np.nonzero((near >= 0) & ~seen[live[:, None], np.maximum(near, 0)])
            # a node that two of the expanded ones share counts once
            key = live[r] * len(x) + near[r, c]
            _, once = np.unique(key, return_index=True)
            r, c = r[once], c[once]
            seen.ravel()[key[once]] = True
            count = np.bincount(r, minlength=len(live))
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            packed = np.full((len(live), int(count.max()) if len(count) else 0), -1, near.dtype)
            packed[r, place] = near[r, c]
            s = np.full(packed.shape, -2.0, np.float32)
            s[r, place] = np.einsum("ij,ij->i", x[packed[r, place]], q[live[r]])
            near, fresh = packed, packed >= 0
            all_ids = np.concatenate([ids[live], near], 1)
            all_sims = np.concatenate([sims[live], s], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            top = _top(all_sims, ef)
            ids[live], sims[live], done[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
            ids[live] = np.where(sims[live] > -2, ids[live], -1)
        return ids, sims


def build(x: np.ndarray, *, m: int = M, ef: int = EF_BUILD, seed: int = 3) -> Graph:
    """Insert the rows of x, of unit length, in batches; those of higher levels first."""
    n = len(x)
    level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(m)).astype(int), 6)
    order = np.argsort(-level, kind="stable")
    g = Graph(x, [np.full((n, 2 * m if i == 0 else m), -1, np.int32) for i in range(int(level.max()) + 1 if n else 1)], int(order[0]) if n else 0)
    at = 0
    while at < n:
        own = level[order[at]]
        end = at + min(BATCH, max(1, at))
        new = order[at : min(end, int(np.searchsorted(-level[order], -own, side="right")))]
        q = x[new]
        inner = q @ q.T
        np.fill_diagonal(inner, -2)
        start = None
        for lev in range(len(g.links) - 1, -1, -1):
            if at == 0:
                ids, sims = np.full((len(new), 1), -1, np.int32), np.full((len(new), 1), -2.0, np.float32)
            else:
                here = start if start is not None else np.full((len(new), 1), g.entry, np.int32)
                ids, sims = g.search(q, 2 if lev > own else ef, lev, here)
                start = ids
            if lev > own:
                continue
            mates = _top(inner, min(ef // 2, len(new)))
            ms = np.take_along_axis(inner, mates, 1)
            ids = np.concatenate([ids, np.where(ms > -2, new[mates], -1).astype(np.int32)], 1)
            sims = np.concatenate([sims, ms], 1)
            best = _top(sims, ef)
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            chosen = _select(x, ids, sims, m)
            g.links[lev][new, :m] = chosen
            _link_back(g, lev, new, chosen)
        at += len(new)
    return g


def _link_back(g: Graph, lev: int, new: np.ndarray, chosen: np.ndarray) -> None:
    """Each chosen neighbour links to the node that chose it; lists that overflow are selected anew."""
    links, x = g.links[lev], g.x
    cap = links.shape[1]
    r, c = np.nonzero(chosen >= 0)
    to, frm = chosen[r, c], new[r]
    order = np.lexsort((-np.einsum("ij,ij->i", x[to], x[frm]), to))
    to, frm = to[order], frm[order].astype(np.int32)
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    rank = np.arange(len(to)) - np.repeat(first, count)
    ok = rank < cap
    extra = np.full((len(nodes), min(cap, int(count.max()) if len(count) else 1)), -1, np.int32)
    extra[np.repeat(np.arange(len(nodes)), count)[ok], rank[ok]] = frm[ok]
    both = np.concatenate([links[nodes], extra], 1)
    both[:, cap:] = np.where((both[:, cap:, None] == both[:, None, :cap]).any(2), -1, both[:, cap:])
    size = (both >= 0).sum(1)
    easy = size <= cap
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
    links[nodes[easy]] = packed[easy, :cap]
    hard = np.flatnonzero(~easy)
    for i in range(0, len(hard), 512):
        h = hard[i : i + 512]
        ids = packed[h]
        sims = np.where(ids >= 0, np.einsum("nkd,nd->nk", x[np.maximum(ids, 0)], x[nodes[h]]), -2.0).astype(np.float32)
        top = _top(sims, ids.shape[1])
        links[nodes[h]] = _select(x, np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), cap)


def probes(x: np.ndarray, threshold: float, count: int, rng: np.random.Generator) -> np.ndarray:
    """Vectors of unit length whose cosine with one of x, each with another, is threshold."""
    v = x[rng.permutation(len(x))[:count]].astype(np.float64)
    z = rng.standard_normal(v.shape)
    z -= np.einsum("ij,ij->i", z, v)[:, None] * v
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return (threshold * v + np.sqrt(max(0.0, 1 - threshold * threshold)) * z).astype(np.float32)


def partners(g: Graph, q: np.ndarray, threshold: float, *, ef: int = EF, widest: int = WIDEST, audit: int = AUDIT, recall: float = RECALL, nearest: float = 0.0, seed: int = 0, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(query, node) of the pairs with cosine >= threshold, and the beam at which the audit passed. own: each query's own node, -1 where it is elsewhere.

    recall: of the sought pairs, those of picked queries and those of probes; nearest: of the picks' NEAREST nearest, where the index has to give these too.
    """
    n = len(g.x)
    low = threshold - 1e-4
    rng = np.random.default_rng(seed)
    picks = rng.permutation(len(q))[:audit]
    sims = q[picks] @ g.x.T
    mine = np.full(len(picks), -1) if own is None else own[picks]
    sims[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -2.0
    truth = sims >= low
    want = int(truth.sum())
    k = min(NEAREST, n - 1) if nearest else 0
    least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k] - 1e-6 if k > 0 else None
    del sims
    probe = probes(g.x, threshold, audit, rng)
    near = probe @ g.x.T >= low

    def narrow(width: int) -> bool:
        """Whether beams of that width miss too many of the probes' pairs or of the picks' nearest."""
        ids, s = g.search(probe, width)
        # of a full beam's pairs the rest is found by wider ones
        if np.minimum((s >= low).sum(1), near.sum(1)).sum() < recall * np.minimum(near.sum(1), width).sum():
            return True
        if k < 1 or not len(picks):
            return False
        ids, s = g.search(q[picks], width)
        return np.minimum(((s >= least) & (ids != mine[:, None]) & (ids >= 0)).sum(1), k).sum() < nearest * k * len(picks)

    while True:
        if ef >= n or ef > widest:  # no beam will do: every query scans the shard
            a, b = _scan(g.x, q, np.arange(len(q)), low)
            break
        if narrow(ef):
            ef *= 2
            continue
        pa_, pb, todo, width = [], [], np.arange(len(q)), ef
        while len(todo):
            if width > widest or width >= n:
                a, b = _scan(g.x, q, todo, low)
                pa_.append(a), pb.append(b)
                break
            wider = []
            for i in range(0, len(todo), BATCH):
                t = todo[i : i + BATCH]
                ids, sims = g.search(q[t], width)
                full = sims[:, -1] >= low
                r, c = np.nonzero((sims >= low) & ~full[:, None])
                pa_.append(t[r]), pb.append(ids[r, c])
                wider.append(t[full])
            todo, width = np.concatenate(wider), 2 * width
        a, b = np.concatenate(pa_), np.concatenate(pb)
        place = np.full(len(q), -1)
        place[picks] = np.arange(len(picks))
        seen = place[a] >= 0
        if truth[place[a[seen]], b[seen]].sum() >= recall * want:
            break
        ef *= 2
    cos = np.einsum("ij,ij->i", q[a].astype(np.float64), g.x[b].astype(np.float64))
    ok = cos >= threshold - 1e-7
    return a[ok], b[ok], ef


def _scan(x: np.ndarray, q: np.ndarray, rows: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    out = [np.zeros((2, 0), np.int64)]
    for i in range(0, len(rows), BATCH):
        r, c = np.nonzero(q[rows[i : i + BATCH]] @ x.T >= low)
        out.append(np.stack([rows[i + r], c]))
    a = np.concatenate(out, 1)
    return a[0], a[1]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) join two trees, taken one after the other."""
    up: dict = {}

    def root(v):
        while (p := up.get(v, v)) != v:
            up[v] = up.get(p, p)
            v = p
        return v

    keep = np.zeros(len(a), bool)
    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        ru, rv = root(u), root(v)
        if ru != rv:
            up[ru] = rv
            keep[i] = True
    return keep


def spread(n: int, dim: int, cores: int, shard_size: int | None = None) -> tuple[int, int]:
    """(shards, parts): as few graphs as memory and the cores allow, since each vector queries all of them, and tasks for each graph.

    A graph has at most SHARD_BYTES; below that, SHARD rows at least before there is another. A task has at most QUERIES queries.
    """
    most = max(1, SHARD_BYTES // (4 * (dim + 2 * M + 4))) if shard_size is None else shard_size
    shards = max(1, -(-n // most), min(cores, -(-n // SHARD)))
    return shards, max(1, -(-cores // shards), -(-n // QUERIES))


def near_embeddings(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, shard_size: int | None = None, ef: int = EF, recall: float = RECALL) -> DataFrame:
    """(id, group_id, group_size) of the ids that are in a group of two or more; group_id is the least id of the group.

    Groups are the components of pairs whose cosine is at least threshold. Rows with a null id, and vectors that are null, have a null
    or NaN, are all zero or not of the commonest length (of several, the greatest), are in no group. Rows that repeat an id are one, of the least vector. Equal
    vectors are in one group, whatever their number. Other columns, whatever their names, are dropped. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    sound = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).dropna().filter("exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x) or abs(x) = cast('inf' as float))")
    size = sound.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = size["d"] if size else 0
    one = materialize(sound.filter(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")))
    reps = materialize(one.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    n = reps.count()
    shards, parts = spread(n, dim, spark.sparkContext.defaultParallelism, shard_size)

    def pack(v: pa.ListArray) -> np.ndarray:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    def build_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        of = t.column("shard").to_numpy()
        for s in np.unique(of):
            mine = t.filter(pa.array(of == s)).sort_by("id").combine_chunks()
            g = build(pack(mine.column("v").combine_chunks()))
            blob = pickle.dumps((mine.column("id").to_pylist(), g.x, g.links, g.entry), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([blob], pa.binary())], ["shard", "body"])

    spread_ = reps.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = materialize(spread_.select("shard", "id", "v").repartitionById(shards, "shard").mapInArrow(build_all, "shard int, body binary"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = F.lit(None)
    rows = graphs.select("shard", every(parts).alias("part"), F.lit(0).alias("role"), none.cast(kind).alias("id"), "body", none.cast("array<float>").alias("v")).unionByName(
        reps.select(every(shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "id", none.cast("binary").alias("body"), "v")
    )
    rows = rows.repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("shard", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graph, ids, queries = None, None, None, []

        def answer() -> pa.RecordBatch | None:
            if graph is None or not queries:
                return None
            qid = pa.concat_arrays([i for i, _ in queries])
            a, b, _ = partners(graph, np.concatenate([x for _, x in queries]), threshold, ef=ef, recall=recall, own=pc.index_in(qid, ids).fill_null(-1).to_numpy(zero_copy_only=False))
            left, right = qid.take(pa.array(a)), ids.take(pa.array(b))
            names = pa.concat_arrays([left, right]).dictionary_encode().indices.to_numpy()
            ok = forest(names[: len(a)], names[len(a) :])
            return pa.RecordBatch.from_arrays([left.filter(pa.array(ok)), right.filter(pa.array(ok))], ["a", "b"])

        for batch in batches:
            key = batch.column("shard").to_numpy().astype(np.int64) * parts + batch.column("part").to_numpy()
            role = batch.column("role").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(role) != 0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j == i:
                    continue
                if key[i] != now:
                    if (out := answer()) is not None:
                        yield out
                    now, graph, ids, queries = key[i], None, None, []
                b = batch.slice(i, j - i)
                if role[i] == 0:
                    names, x, links, entry = pickle.loads(b.column("body")[0].as_py())
                    graph, ids = Graph(x, links, entry), pa.array(names, b.schema.field("id").type)
                else:
                    queries.append((b.column("id"), pack(b.column("v"))))
        if (out := answer()) is not None:
            yield out

    edges = materialize(rows.mapInArrow(run, f"a {kind}, b {kind}"))
    discard(graphs)
    comp = connected_components(edges, src="a", dst="b")
    named = reps.join(comp, reps["id"] == comp["node"], "left").select(F.col("id").alias("rep"), "v", F.coalesce("component", "id").alias("group_id"))
    group = one.join(named, "v").select("id", "group_id")
    big = group.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return group.join(big, "group_id").select(F.col("id").alias(id_col), "group_id", "group_size")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


COPY = 1_000_000_000


def with_copies(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): vectors, a copy within the threshold of each third of them, and one outside of it of each fifth."""
    def copy(every: int, offset: int, much: float) -> DataFrame:
        noisy = F.transform(F.col("embedding"), lambda x, i: (x.cast("double") * (F.lit(1.0) + F.lit(much) * ((F.col("vec_id") + i) % 3 - 1))).cast("float"))
        return vectors.filter(F.col("vec_id") % every == 0).withColumn("embedding", noisy).select((F.col("vec_id") + offset).alias("vec_id"), "embedding")

    return vectors.select("vec_id", "embedding").unionByName(copy(3, COPY, 0.2)).unionByName(copy(5, 2 * COPY, 0.9))


def embedding_dedup_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 where there is something to find at every size: small tables hold no near copies of their own."""
    return near_embeddings(with_copies(table(spark, sf_dir, "embeddings")))


def embeddings_sql(source: str = "embeddings") -> str:
    """Components of all pairs by brute force."""
    return f"""with recursive v as materialized (select vec_id, cast(embedding as double[]) as e from {source} where vec_id is not null and embedding is not null),
pair as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id < b.vec_id and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
link as materialized (select a, b from pair union all select b, a from pair),
reach as (select a as id, a as other from link union select r.id, l.b from reach r join link l on l.a = r.other),
grp as materialized (select id as vec_id, min(other) as group_id from reach group by 1)
select vec_id, group_id, count(*) over (partition by group_id) as group_size from grp"""


_NOISY = "select vec_id + {offset} as vec_id, list_transform(embedding, lambda x, i: cast(cast(x as double) * (1.0::double + {much}::double * ((vec_id + i - 1) % 3 - 1)) as float)) as embedding from embeddings where vec_id % {every} = 0"
SQL = {
    "op5_embedding_dedup": embeddings_sql(),
    "embedding_dedup_with_copies": embeddings_sql(f"(select vec_id, embedding from embeddings union all {_NOISY.format(offset=COPY, much=0.2, every=3)} union all {_NOISY.format(offset=2 * COPY, much=0.9, every=5)})"),
}
