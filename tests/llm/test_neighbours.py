import itertools
import re

import numpy as np
import pytest
from util import MID, empty, have_tables, messy

from ledgerloom.llm import hnsw, near_dedup


def groups(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    size = {}
    for i in ids:
        size[root(i)] = size.get(root(i), 0) + 1
    return {i: root(i) for i in ids if size[root(i)] > 1}


def shingle_set(text):
    w = [x for x in (p.strip(near_dedup.MARKS) for p in text.lower().split()) if x]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


@pytest.mark.skipif(not have_tables, reason="no tables")
def test_minhash_against_all_pairs(spark):
    df = spark.read.parquet(f"{MID}/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in df.select("doc_id", "text").collect()}
    index, pairs = {}, set()
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    for v in index.values():
        pairs.update(itertools.combinations(sorted(v), 2))
    edges = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= near_dedup.THRESHOLD * len(sets[a] | sets[b])]
    want = groups([i for i, s in sets.items() if s], edges)
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(df).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(want[i] == want[g] for i, g in got.items())
    kept = near_dedup.keep_one(df)
    assert kept.count() == len(sets) - sum(g != i for i, g in got.items())


def test_posterior_bounds():
    steps = near_dedup.least_matches(0.5, 0.01)
    assert [n for n, _ in steps] == list(range(32, 161, 32)) and all(0 < m < n / 2 for n, m in steps)


def test_minhash_edges(spark):
    d = messy(spark)
    got = {r.doc_id: (r.group_id, r.group_size) for r in near_dedup.near_duplicates(d).collect()}
    assert set(got) <= {1, 2} and all(g == 1 for g, _ in got.values())
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns and {None, 3, 4, 5, 7, 9} <= {r.doc_id for r in kept.collect()}
    assert near_dedup.near_duplicates(empty(spark)).count() == 0 and near_dedup.keep_one(empty(spark)).count() == 0
    words = [f"w{i}" for i in range(40)]
    near = messy(spark, [(i, " ".join(words[:i % 5] + ["zz"] + words[i % 5 + 1 :])) for i in range(10)])
    assert {r.group_id for r in near_dedup.near_duplicates(near).collect()} == {0}


def test_one_bucket_of_two_large_components(spark):
    """50,000 rows of one bucket in two components that have nothing else in common, and a link between two of them that no leader is an end of."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    n, width = 50_000, near_dedup.BANDS * near_dedup.ROWS
    half = rng.integers(0, 1 << 16, (2, width), dtype=np.uint16)
    sig = half[np.arange(n) % 2]
    noise = rng.random(sig.shape) < 0.1
    sig = np.where(noise, rng.integers(0, 1 << 16, sig.shape, dtype=np.uint16), sig)
    sig[:, :4] = 7  # the band that all share
    sig[30_001] = sig[20_000]
    t = pa.table({"id": np.arange(n), "sig": pa.array([x.tobytes() for x in sig], pa.binary())})
    sigs = spark.createDataFrame(t)
    open_ = spark.createDataFrame(pa.table({"key": np.zeros(n, np.int64), "id": np.arange(n), "c": np.arange(n) % 2}))
    got = {(r.a, r.b) for r in near_dedup._blocks(open_, sigs, 0.5, 0.01).collect()}
    # rows of component 1 that are like the row that crossed over, and the other way about
    assert (20_000, 30_001) in got and all(30_001 in p for p in got) and len(got) >= 24_000


def test_leaders_and_blocks_find_what_all_pairs_would(spark, monkeypatch):
    rng = np.random.default_rng(9)
    texts, words = [], [f"w{i}" for i in range(400)]
    for g in range(12):
        base = rng.choice(words, 60).tolist()
        for _ in range(14):  # each a little further from the one before, so that ends of a chain aren't alike
            for k in rng.integers(0, 60, 4):
                base[int(k)] = str(rng.choice(words))
            texts.append(" ".join(base))
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    got = {r.doc_id: r.group_id for r in near_dedup.near_duplicates(messy(spark, rows)).collect()}
    sets = [shingle_set(t) for t in texts]
    import pyarrow as pa

    s, off = near_dedup.shingles(pa.array(texts))
    bands = near_dedup.band_keys(near_dedup.signatures(s, off))
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if (bands[i] == bands[j]).any() and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])]
    assert got == groups(range(len(rows)), edges)


def test_graph_recall():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(1500, 32))
    x = np.concatenate([base, base[rng.integers(0, 40, 700)] + rng.normal(0, 0.03, (700, 32))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.build(x)
    truth = x @ x.T >= 0.9
    a, b, _ = hnsw.partners(g, x, 0.9, ef=16)
    assert truth[a, b].sum() >= 0.98 * truth.sum()
    ids, _ = g.search(x[:300], 64)
    best = np.argsort(-(x[:300] @ x.T), 1)[:, :10]
    assert np.mean([len(set(p[:10]) & set(q)) / 10 for p, q in zip(ids.tolist(), best.tolist())]) >= 0.9


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(300 + j, (base[j % 7] + rng.normal(0, 0.02, 16)).tolist()) for j in range(120)]
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0] * 3), (None, [1.0] * 16), (903, [float("nan")] * 16), (5, rows[5][1]), (904, rows[9][1]), (905, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as shard", "4 as group_id")
    x = dict(rows) | {904: rows[9][1]}
    ids = sorted(x)
    m = np.array([x[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(m @ m.T >= 0.9)) if a < b])
    assert {r.vec_id: r.group_id for r in hnsw.near_embeddings(df, shard_size=100).collect()} == want
    assert hnsw.near_embeddings(df.limit(0)).count() == 0


def test_no_import_of_the_subpackage_elsewhere():
    import pathlib

    root = pathlib.Path(near_dedup.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
