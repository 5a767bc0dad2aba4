"""The registered PageRank against power iteration to convergence."""

import os

import numpy as np
import pytest

from ledgerloom import registry
from ledgerloom.plans import views

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_pagerank_converges(spark):
    edges = [(r.src, r.dst) for r in views.trade_edges(spark, DATA).collect()]
    names = sorted({v for e in edges for v in e})
    at = {v: i for i, v in enumerate(names)}
    n, s, t = len(names), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges])
    out = np.bincount(s, minlength=n)
    want = np.full(n, 1 / n)
    for _ in range(500):
        want = 0.15 / n + 0.85 * (want[out == 0].sum() / n + np.bincount(t, want[s] / out[s], n))
    got = {r.id: r.score for r in registry.queries()["pagerank"](spark, DATA).collect()}
    assert set(got) == set(names) and sum(abs(got[v] - want[at[v]]) for v in names) < 10 * n * 1e-6
