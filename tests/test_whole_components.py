"""What a task leaves of its edges: the same components, of a dense graph a fraction."""

import random

import pyarrow as pa
import pytest

from ledgerloom.operators import components, graph


def closed(edges):
    up = {v: v for e in edges for v in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    return up


@pytest.mark.parametrize("seed", range(10))
def test_stars_keep_components(seed, monkeypatch):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(r.choice([10, 25, 200]))]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    monkeypatch.setattr(components, "TOGETHER", r.choice([7, 1000]))
    batches = [pa.record_batch([pa.array(x) for x in zip(*edges[i : i + 5])], names=["u", "v"]) for i in range(0, len(edges), 5)]
    left = [(x["u"], x["v"]) for b in components._hung(iter(batches)) for x in b.to_pylist()]
    assert closed(left) == closed(edges) and all(u > v for u, v in left)
    if components.TOGETHER == 1000:
        assert len(left) < 40


def test_communities_by_numbers(spark):
    r = random.Random(1)
    pairs = sorted({tuple(sorted((f"n{r.randrange(9)}", f"n{r.randrange(9)}"))) for _ in range(14)} | {("x1", "x2")})
    of = graph._greedy(pairs, float(len(pairs)))
    got = {}
    for row in graph.communities(spark.createDataFrame(pairs, "src string, dst string")).collect():
        got.setdefault(row.community, set()).add(row.id)
    want = {}
    for v, c in of.items():
        want.setdefault(c, set()).add(v)
    assert [got[i] for i in sorted(got)] == sorted(want.values(), key=lambda s: (-len(s), min(s)))
