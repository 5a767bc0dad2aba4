"""The ownership graph: projection from claims, neighbourhoods, centrality, communities, interlocks."""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ledger
from .components import connected_components, cut, drop_cut

#: Edges of a graph that is given to each task, and rows of searches that are under way at once.
SMALL_EDGES, SEARCHED = 200_000, 50_000_000


def project(claims: DataFrame, entities: DataFrame, evidence: DataFrame | None = None, *, as_of=None, on=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): entities that valid claims name, and the claims that have an object."""
    c = ledger.claims_asof(claims, as_of=as_of, on=on)
    ids = c.select(F.explode(F.array("subject_id", "object_id")).alias("id")).dropna().distinct()
    nodes = entities.join(ids, "id", "left_semi").select("id", F.coalesce("canonical_name", "id").alias("label"), "type", F.expr("external_ids['cik']").alias("cik"))
    edges = c.filter("object_id is not null").select(F.col("id").alias("claim_id"), F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "predicate", "stake_pct", "valid_from", "valid_to", "confidence")
    if evidence is not None:
        n = evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence_count"))
        edges = edges.join(n, "claim_id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    return nodes, edges


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): in and out with multiplicity; a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def to_json(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One JSON text for each node, with its degree, and each edge."""
    n = nodes.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    e = edges.withColumn("id", F.concat_ws("-", "src", "dst", "claim_id"))
    return n.select("id", F.to_json(F.struct(*n.columns)).alias("json")), e.select("id", F.to_json(F.struct("id", *edges.columns)).alias("json"))


def ego(edges: DataFrame, center: str, radius: int = 1) -> DataFrame:
    """The edges among the nodes within radius of center, directions ignored; none for an unknown center."""
    edges = cut(edges)  # read for each step and at the end
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    near = both.filter(F.col("a") == center).select(F.col("a").alias("id")).distinct()
    for _ in range(radius):
        near = near.unionByName(both.join(near, both["a"] == near["id"], "left_semi").select(F.col("b").alias("id"))).distinct()
    return edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")


def pagerank(edges: DataFrame, *, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, score) over distinct edges, self-loops included; what dangling nodes hold is spread evenly.

    Ends once the ranks change by less than tolerance times the number of nodes in all, or after rounds; each round is cut by files.
    """
    e = cut(edges.select("src", "dst").distinct())
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    links = cut(e.join(out, "src"))
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(out.withColumnRenamed("src", "id"), "id", "left")
    nodes = cut(nodes)
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    rank = cut(nodes.withColumn("score", F.lit(1.0 / n)))
    for _ in range(rounds):
        loose = rank.filter("out is null").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        got = links.join(rank.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        after = cut(rank.withColumnRenamed("score", "was").join(got, "id", "left").withColumn("score", F.lit((1 - damping) / n + damping * loose / n) + damping * F.coalesce("got", F.lit(0.0))))
        moved = after.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] if tolerance is not None else None
        drop_cut(rank)
        rank = after.drop("was", "got")
        if moved is not None and moved < n * tolerance:
            break
    return rank.select("id", "score")


def _searched(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, part): what the sources' searches add to each node, level by level over files, all sources at once."""
    levels = [cut(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))]
    while True:
        seen = levels[0].select("s", "v")
        for level in levels[1:]:
            seen = seen.unionByName(level.select("s", "v"))
        step = levels[-1].join(e, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        after = cut(step.join(seen, ["s", "v"], "left_anti"))
        if after.isEmpty():
            drop_cut(after)
            break
        levels.append(after)
    back, backs = None, []
    for up, down in reversed(list(zip(levels[1:], levels[2:]))):
        more = F.lit(0.0) if back is None else F.coalesce("back", F.lit(0.0))
        share = (down if back is None else down.join(back, ["s", "v"], "left")).select("s", F.col("v").alias("dst"), ((1 + more) / F.col("paths")).alias("share"))
        back = cut(up.join(e, F.col("v") == F.col("src")).join(share, ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("paths") * F.col("share")).alias("back")))
        backs.append(back)
    if not backs:
        backs = [levels[0].filter("false").select("s", "v", F.col("paths").alias("back"))]
    every = backs[0]
    for x in backs[1:]:
        every = every.unionByName(x)
    out = cut(every.groupBy(F.col("v").alias("id")).agg(F.sum("back").alias("part")))
    drop_cut(*levels, *(backs if len(levels) > 2 else ()))
    return out


def betweenness(edges: DataFrame) -> DataFrame:
    """(id, score): shares of shortest directed paths through a node, over (n - 1)(n - 2).

    Only what has edges in and out lies on a path, and only sources with an edge to such a node are searched from. A small graph is given to each
    task; in a larger one the searches go level by level through files, of as many sources at a time as SEARCHED allows. All of it takes nodes times edges.
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    inner = e.select(F.col("dst").alias("id")).join(e.select(F.col("src").alias("id")), "id", "left_semi").distinct()
    sources = cut(e.join(inner.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct())
    n, many = nodes.count(), sources.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    if not many:
        parts = nodes.filter("false").select("id", F.lit(0.0).alias("part"))
    elif e.count() <= SMALL_EDGES:
        parts = _in_tasks(e, sources)
    else:
        runs = -(-many * n // SEARCHED)
        found = [_searched(e, sources.filter(F.pmod(F.xxhash64("id"), F.lit(runs)) == i)) for i in range(runs)]
        parts = found[0]
        for x in found[1:]:
            parts = parts.unionByName(x)
        parts = parts.groupBy("id").agg(F.sum("part").alias("part"))
    return nodes.join(parts, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("score"))


def _in_tasks(e: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, part): the same with the whole graph in each task, sources in parallel."""
    adj: dict = defaultdict(list)
    for r in e.toPandas().sort_values(["src", "dst"]).itertuples(index=False):
        adj[r.src].append(r.dst)
    sc = e.sparkSession.sparkContext
    shared = sc.broadcast(dict(adj))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adj = shared.value
        total: dict = defaultdict(float)
        for frame in frames:
            for s in frame["id"]:
                order, before, paths, far = [], defaultdict(list), defaultdict(float), {s: 0}
                paths[s] = 1.0
                todo = deque([s])
                while todo:
                    v = todo.popleft()
                    order.append(v)
                    for w in adj.get(v, ()):
                        if w not in far:
                            far[w] = far[v] + 1
                            todo.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                back: dict = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        back[v] += paths[v] / paths[w] * (1 + back[w])
                    if w != s:
                        total[w] += back[w]
        if total:
            yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    return sources.repartition(sc.defaultParallelism).mapInPandas(run, f"id {sources.schema['id'].dataType.simpleString()}, part double").groupBy("id").agg(F.sum("part").alias("part"))


def _greedy(pairs: list[tuple], m: float) -> dict:
    """Communities of one component: the merge with the greatest gain in modularity, the least pair of equals, until none gains.

    Gains are whole numbers, 2 m² times the modularity's. The heap has for each community the best pair of its links; a merge enters the new
    one's alone, as it covers all pairs that changed. An entry whose other end has changed since was a bound at least, and is taken anew.
    """
    names = sorted({v for p in pairs for v in p})
    index = {v: i for i, v in enumerate(names)}
    a, b = (np.fromiter((index[p[k]] for p in pairs), np.int32, len(pairs)) for k in (0, 1))
    return {v: names[c] for v, c in zip(names, _merged(a, b, len(names), m).tolist())}


def _merged(a: np.ndarray, b: np.ndarray, n: int, m: float) -> np.ndarray:
    """The same of edges between the places of n ordered nodes: the place of the least node of each one's community."""
    twice = 2 * int(m)
    weight = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    apart = a != b
    ends, others = np.concatenate([a[apart], b[apart]]), np.concatenate([b[apart], a[apart]])
    order = np.lexsort((others, ends))
    cuts = np.searchsorted(ends[order], np.arange(n + 1))
    others = others[order]
    del ends, order
    links = [(others[i:j], np.ones(j - i, np.int32)) for i, j in zip(cuts, cuts[1:])]
    # a community is named by its least member; of: each node's community; changed: how often each has grown, -1 once it is in another
    of, members, changed = np.arange(n), [[i] for i in range(n)], np.zeros(n, np.int64)
    heap: list[tuple] = []

    def enter(x: int) -> None:
        near, w = links[x]
        near = of[near]
        if len(near):
            order = np.argsort(near, kind="stable")
            near = near[order]
            first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
            near, w = near[first], np.add.reduceat(w[order], first)
            near, w = near[near != x], w[near != x]
        links[x] = near, w
        if len(near):
            gain = twice * w.astype(np.int64) - weight[x] * weight[near]
            k = int(np.argmax(gain))  # near ascends: the first of equals is the least pair
            if gain[k] > 0:
                y = int(near[k])
                heapq.heappush(heap, (-int(gain[k]), min(x, y), max(x, y), x, int(changed[x]), int(changed[y])))

    for x in range(n):
        enter(x)
    while heap:
        _, x, y, row, was, other = heapq.heappop(heap)
        if changed[row] != was:
            continue
        if changed[x + y - row] != other:
            enter(row)
            continue
        links[x] = tuple(map(np.concatenate, zip(links[x], links[y])))
        links[y] = None
        weight[x] += weight[y]
        of[members[y]] = x
        members[x] += members[y]
        members[y] = None
        changed[x] += 1
        changed[y] = -1
        enter(x)
    return of


def communities(edges: DataFrame) -> DataFrame:
    """(id, community, size): greedy modularity on the simple undirected graph; communities from 0 on by size, of equals by least member.

    A merge's gain depends on its own component and the number of all edges, so components are treated apart, in parallel.
    """
    e = cut(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    m = float(e.count())
    from ..functions.text import numbered

    # tasks get numbers, in the order of the nodes, not names
    ids = cut(numbered(connected_components(e, src="a", dst="b"), ["node"], "n"))
    least = ids.groupBy("component").agg(F.min("n").alias("c"))
    ids = cut(ids.join(least, "component").select("node", "n", "c"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        places, nodes = pd.factorize(np.concatenate([frame["a"].to_numpy(), frame["b"].to_numpy()]), sort=True)
        places = places.astype(np.int32)
        of = _merged(places[: len(frame)], places[len(frame) :], len(nodes), m)
        return pd.DataFrame({"n": nodes, "name": nodes[of]})

    ends = e.join(ids.select(F.col("node").alias("a"), F.col("n").alias("na"), "c"), "a").join(ids.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    found = cut(ends.select("c", F.col("na").alias("a"), F.col("nb").alias("b")).groupBy("c").applyInPandas(run, "n long, name long"))
    named = cut(found.join(ids.select("n", F.col("node").alias("id")), "n").join(ids.select(F.col("n").alias("name"), F.col("node").alias("_name")), "name").select("id", F.col("_name").alias("name")))
    sizes = numbered(named.groupBy("name").agg((-F.count(F.lit(1))).alias("order")), ["order", "name"], "rank")
    return named.join(sizes, "name").select("id", (F.col("rank") - 1).alias("community"), (-F.col("order")).alias("size"))


def interlocks(edges: DataFrame, *, min_targets: int = 2, limit: int | None = 50, shown: int = 25) -> DataFrame:
    """(id, n_targets, targets): sources of at least min_targets distinct targets, the most first; targets are the first few by name."""
    out = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_targets"), F.slice(F.array_sort(F.collect_list("dst")), 1, shown).alias("targets")).filter(F.col("n_targets") >= min_targets)
    return out if limit is None else out.orderBy(F.desc("n_targets"), "id").limit(limit)


def components(edges: DataFrame) -> DataFrame:
    return connected_components(edges)


def summary(nodes: DataFrame, edges: DataFrame, *, interlock_limit: int = 50) -> DataFrame:
    """(nodes, edges, components, communities, interlocks); isolated nodes are components and communities of their own."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    alone = nodes.join(ends, "id", "left_anti").agg(F.count(F.lit(1)).alias("alone"))
    return (
        nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(alone)
        .crossJoin(connected_components(edges).agg(F.countDistinct("component").alias("c"))).crossJoin(communities(edges).agg(F.countDistinct("community").alias("k")))
        .crossJoin(interlocks(edges, limit=interlock_limit).agg(F.count(F.lit(1)).alias("interlocks")))
        .select("nodes", "edges", (F.col("c") + F.col("alone")).alias("components"), (F.col("k") + F.col("alone")).alias("communities"), "interlocks")
    )
