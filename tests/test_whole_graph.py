"""Registered graph queries over the whole graph, and its measures against brute force."""

import os
import random

import pytest

from ledgerloom import registry
from ledgerloom.operators import graph
from ledgerloom.plans import views

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def trade(spark):
    return [(r.src, r.dst) for r in views.trade_edges(spark, DATA).collect()]


@tables
def test_registered_over_the_whole_graph(spark, trade):
    nodes = {v for e in trade for v in e}
    q = registry.queries()
    score = {r.id: r.score for r in q["betweenness"](spark, DATA).collect()}
    assert set(score) == nodes and set(score.values()) == {0.0}  # no supplier buys, so no path goes through a node
    found = {r.id: r.community for r in q["communities"](spark, DATA).collect()}
    assert set(found) == nodes
    s = q["graph_summary"](spark, DATA).first()
    assert (s.nodes, s.edges, s.communities) == (len(nodes), len(trade), len(set(found.values())))


def brute(pairs, m):
    """Every pair of communities is looked at before each merge."""
    of = {v: v for p in pairs for v in p}
    degree = {v: sum((a == v) + (b == v) for a, b in pairs) for v in of}
    while True:
        names, best = sorted(set(of.values())), (0,)
        total = {c: sum(degree[v] for v in of if of[v] == c) for c in names}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                gain = 2 * m * sum({of[x], of[y]} == {a, b} for x, y in pairs) - total[a] * total[b]
                if gain > best[0]:
                    best = (gain, a, b)
        if len(best) == 1:
            return of
        of = {v: best[1] if c == best[2] else c for v, c in of.items()}


@pytest.mark.parametrize("seed", range(20))
def test_greedy_merges(seed):
    r = random.Random(seed)
    n = r.randint(2, 12)
    pairs = sorted({tuple(sorted((f"n{r.randrange(n)}", f"n{r.randrange(n)}"))) for _ in range(r.randint(1, 30))})
    m = len(pairs) + r.choice([0, 7])
    assert graph._greedy(pairs, float(m)) == brute(pairs, m)
