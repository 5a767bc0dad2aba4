import numpy as np

from ledgerloom.llm import hnsw


def test_audit_without_pairs_widens_a_beam_that_is_too_narrow():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(x)
    g.links[0][:, 6:] = -1  # a graph that a narrow beam doesn't get through
    own = np.arange(len(x))
    q = x[:600]
    *_, ef = hnsw.partners(g, q, 0.9, ef=4, own=own[:600], nearest=0.9)
    sims = q @ x.T
    sims[np.arange(600), own[:600]] = -2
    best = np.argsort(-sims, 1)[:, : hnsw.NEAREST]
    ids, _ = g.search(q, ef)
    assert ef > 4 and np.mean([len(set(i) & set(b)) / hnsw.NEAREST for i, b in zip(ids.tolist(), best.tolist())]) >= 0.85


def test_probes_widen_a_beam_that_misses_pairs():
    """Without a single pair in the table the audit still sees what a narrow beam would lose."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(x)
    g.links[0][:, 8:] = -1
    fresh = hnsw.probes(x, 0.9, 500, np.random.default_rng(99))
    assert np.allclose((fresh @ x.T).max(1), 0.9, atol=1e-4)
    found = lambda ef: (g.search(fresh, ef)[1].max(1) >= 0.9 - 1e-4).mean()
    *_, ef = hnsw.partners(g, x[:600], 0.9, ef=2, own=np.arange(600))
    assert found(2) < 0.95 and ef > 2 and found(ef) >= 0.95


def test_sparse_pairs_across_shards():
    """Pairs of near copies, of which each task's picks hold next to none."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6000, 48))
    x = np.concatenate([base, base[:60] + rng.normal(0, 0.3, (60, 48))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = got = 0
    for s in range(3):
        nodes = np.arange(s, len(x), 3)
        place = np.full(len(x), -1)
        place[nodes] = np.arange(len(nodes))
        a, b, _ = hnsw.partners(hnsw.build(x[nodes]), x, 0.9, own=place)
        b = nodes[b]
        got += int((a != b).sum())
        want += int((x @ x[nodes].T >= 0.9).sum()) - len(nodes)
    assert want >= 60 and got >= 0.98 * want
