import duckdb
import numpy as np
import pytest
from util import MID, empty, have_tables, messy

from ledgerloom.llm import mixing, sharding


def one_by_one(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= s] if s <= capacity else []
        if fits:
            bins[min(fits, key=lambda i: (bins[i], i))] -= s
        elif s:
            bins.append(max(capacity - s, 0))
    return len(bins), sorted(bins)


@pytest.mark.parametrize("seed", range(60))
def test_packing_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    sizes = rng.integers(1, capacity + 3, int(rng.integers(0, 90)))
    u, n = np.unique(sizes, return_counts=True)
    fill, given = {}, {}
    for r in sharding.pack(u, n, capacity).itertuples(index=False):
        for j in range(r.n):
            b = r.bin + j // r.per_bin
            fill[b] = fill.get(b, 0) + r.size
            given[r.size] = given.get(r.size, 0) + 1
    assert given == dict(zip(u.tolist(), n.tolist()))
    assert (len(fill), sorted(max(capacity - v, 0) for v in fill.values())) == one_by_one(sizes.tolist(), capacity)


def test_tree_stays_balanced():
    t = sharding.Tree()
    keys = np.random.default_rng(1).permutation(3000).tolist()
    for k in keys:
        t.add(k, [(k, 1)])
    assert t.root[4] <= 17
    for k in keys[:1500]:
        assert t.pop(k) == [(k, 1)]
    left = sorted(keys[1500:])
    for q in range(0, 3000, 37):
        assert t.ceiling(q) == next((k for k in left if k >= q), None)


def test_assign(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(s)) for i, s in enumerate(rng.integers(1, 40, 400))]
    got = sharding.assign(spark.createDataFrame(rows, "group long, size long"), capacity=50).toPandas()
    assert sorted(got["group"]) == list(range(400)) and got.groupby("shard")["size"].sum().max() <= 50
    assert got["shard"].nunique() == one_by_one([s for _, s in rows], 50)[0]
    odd = spark.createDataFrame([(1, 5), (1, 5), (None, 3), (2, None), (3, -4), (4, 99), (5, 99)], "group long, size long").selectExpr("*", "1 as rank", "2 as run", "3 as shard")
    out = {r["group"]: (r["size"], r["shard"]) for r in sharding.assign(odd, capacity=50).collect()}
    assert out[1][0] == 10 and out[2] == (0, 0) and out[3] == (0, 0) and out[4][1] != out[5][1] and out[None][0] == 3
    assert sharding.assign(odd.limit(0), capacity=50).count() == 0


@pytest.mark.skipif(not have_tables, reason="no tables")
def test_mixing_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{MID}/documents.parquet'")
    key = lambda df: sorted(map(tuple, df[["doc_id", "source", "lang", "topic", "n_tokens", "probability"]].itertuples(index=False)))
    assert key(mixing.op6_mixing(spark, MID).toPandas()) == key(con.execute(mixing.mixing_sql()).df())
    assert key(mixing.mix(spark.read.parquet(f"{MID}/documents.parquet"), max_local=2).toPandas()) == key(mixing.op6_mixing(spark, MID).toPandas())


def test_rake_meets_targets():
    rng = np.random.default_rng(0)
    codes = [np.repeat(np.arange(5), 12), np.tile(np.repeat(np.arange(4), 3), 5), np.tile(np.arange(3), 20)]
    tokens = rng.integers(1000, 2000, 60).astype(float)
    targets = [np.array([0.25, 0.2, 0.2, 0.2, 0.15]), np.full(4, 0.25), np.array([0.3, 0.3, 0.4])]
    w = mixing.rake(tokens, codes, targets, budget=0.4, rounds=30)
    for c, t in zip(codes, targets):
        assert np.allclose(np.bincount(c, weights=w) / w.sum(), t, atol=1e-6)
    assert w.sum() == pytest.approx(0.4 * tokens.sum()) and (w <= tokens).all()


def test_mixing_edges(spark):
    d = messy(spark)
    got = mixing.mix(d, budget=1.0).collect()
    assert {r.lang for r in got} <= {"", "en"} and all(0 <= r.probability <= 1 for r in got)
    kept = mixing.keep_sampled(d)
    assert kept.columns == d.columns and kept.count() == mixing.mix(d).count()
    assert mixing.mix(empty(spark)).count() == 0 and mixing.keep_sampled(empty(spark)).count() == 0
    assert {r.source for r in mixing.mix(d, targets={"source": {"s": 1.0}}, budget=1.0).collect() if r.n_tokens} <= {"s"}


@pytest.mark.skipif(not have_tables, reason="no tables")
def test_shards_of_documents_one_by_one(spark):
    """The query against groups by text, packed one after the other."""
    small = "/root/testdata/sf0.001"
    groups = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = {min(ids): (len((t).encode()) * len(ids), len(ids)) for t, ids in groups.items()}
    got = {r.doc_id: r for r in sharding.op2_bin_packing(spark, small).collect()}
    assert {i: (r.bytes, r.n_docs) for i, r in got.items()} == want
    fill = {}
    for r in got.values():
        fill[r.shard] = fill.get(r.shard, 0) + r.bytes
    bins, left = one_by_one([s for s, _ in want.values()], sharding.CAPACITY)
    assert (len(fill), sorted(max(sharding.CAPACITY - v, 0) for v in fill.values())) == (bins, left)


def test_one_size_in_many_pieces(spark):
    """Every group has one size; it is ranked, and finds its bins, range by range."""
    rows = spark.range(1000).selectExpr("id as group", "7 as size").unionByName(spark.createDataFrame([(5000 + i, 3) for i in range(40)], "group long, size int"))
    got = sharding.assign(rows.repartition(16), capacity=50).toPandas()
    assert got.groupby("shard")["size"].sum().max() <= 50 and len(got) == 1040
    assert got["shard"].nunique() == one_by_one([7] * 1000 + [3] * 40, 50)[0]
    assert got[got["size"] == 7].sort_values("group")["shard"].is_monotonic_increasing


def test_default_rounds_meet_the_targets(spark):
    """What is sampled of each value is its target, but for values that are kept whole."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    rows = mixing.probabilities(mixing._marked(docs, "doc_id", "text", "source", "lang", None)).select(*mixing.DIMS, "n_tokens", "probability").toPandas()
    goal = mixing.BUDGET * rows.n_tokens.sum()
    rows["kept"] = rows.n_tokens * rows.probability
    for d in mixing.DIMS:
        t = rows.groupby(d)[["n_tokens", "kept"]].sum()
        want = t.n_tokens**mixing.FLATTEN / (t.n_tokens**mixing.FLATTEN).sum() * goal
        free = t.kept < 0.98 * t.n_tokens
        assert (abs(t.kept - want) / want)[free].max() < 0.08, d
