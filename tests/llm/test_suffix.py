import tempfile
from collections import defaultdict

import numpy as np
import pytest
from util import MID, empty, have_tables, messy

from ledgerloom.llm import induced_sort, suffix_dedup


def common(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@pytest.mark.parametrize("seed", range(40))
def test_sort_with_spills(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(induced_sort, "RANGE", int(rng.integers(2, 40)))
    monkeypatch.setattr(induced_sort, "BLOCK", int(rng.integers(2, 60)))
    text = induced_sort.dense(rng.integers(0, rng.integers(1, 7), int(rng.integers(1, 150))))
    with tempfile.TemporaryDirectory() as folder:
        blocks = list(induced_sort.sort(text, folder=folder, memory=64))
    pos = np.concatenate([p for p, _ in blocks])
    lcp = np.concatenate([v for _, v in blocks])
    t = text.tolist()
    assert pos.tolist() == sorted(range(len(t)), key=lambda i: t[i:], reverse=True)[:-1]
    assert lcp[1:].tolist() == [common(t[a:], t[b:]) for a, b in zip(pos, pos[1:])]


def test_memory_is_bounded_whatever_the_shard(tmp_path, monkeypatch):
    """A shard of some 3 million words, 12 times the bound for it, whose arrays would take hundreds of MB; files hold them, and are gone afterwards."""
    import os
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(induced_sort, "BLOCK", 1 << 15)
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 63, 5000, dtype=np.uint64)
    n, size, passage = 40_000, 75, base[rng.integers(0, 5000, 75)]

    def batches():
        for i in range(0, n, 2000):
            w = base[rng.integers(0, 5000, (2000, size))]
            w[::500] = passage  # the same in fragments that are far apart
            yield pa.record_batch([pa.array(np.full(2000, 1)), pa.array(np.arange(i, i + 2000)), pa.array(np.arange(i, i + 2000)), pa.array(np.zeros(2000, np.int32)), pa.array(np.zeros(2000, bool)), pa.array([x.tobytes() for x in w], pa.binary())], ["g", "c", "id", "lo", "more", "words"])

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    memory, spilled = 1 << 20, induced_sort._induce.spilled
    run = suffix_dedup._sort_shards(Frame(), "bigint", 50, str(tmp_path), memory)
    made = list(batches())
    tracemalloc.start()
    out = pa.Table.from_batches(list(run(iter(made)))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {r["c"] for r in out} == set(range(0, n, 500)) and all((r["o1"], r["o2"], r["first_id"]) == (0, 25, 0) for r in out)
    assert 4 * n * (size + 1) > 8 * memory and peak < 24 << 20, peak
    assert induced_sort._induce.spilled > spilled and os.listdir(tmp_path) == []


def brute(rows, n):
    seen, spans = defaultdict(set), defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            w = t.split()
            for p in range(len(w) - n + 1):
                seen[tuple(w[p : p + n])].add((i, p))
    for v in seen.values():
        if len(v) > 1:
            for k, (i, p) in enumerate(sorted(v)):
                spans[i, k == 0].add(p)
    out = set()
    for (i, first), ps in spans.items():
        cur = None
        for p in sorted(ps):
            if cur and p <= cur[1]:
                cur[1] = p + n
            else:
                if cur:
                    out.add((i, *cur, first))
                cur = [p, p + n]
        out.add((i, *cur, first))
    return out


def spans(df, **kw):
    return {(r.id, r.start, r.end, r.original) for r in suffix_dedup.repeated_spans(df, **kw).collect()}


@pytest.mark.skipif(not have_tables, reason="no tables")
def test_spans_on_tables(spark):
    df = spark.read.parquet(f"{MID}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert spans(df) == brute(rows, suffix_dedup.MIN_WORDS)
    cut = suffix_dedup.cut_repeats(df)
    assert cut.columns == df.columns and spans(cut) == set()
    assert all(r.n_chars == len(r.text) for r in cut.collect())


def test_spans_of_random_words(spark):
    rng = np.random.default_rng(4)
    base = " ".join(rng.choice(list("abcdefghij"), 300))
    rows = [(int(i), " ".join(rng.choice(list("abc"), 60)) + " " + base[2 * a : 2 * a + 140] + " tail " * int(rng.integers(0, 3))) for i, a in enumerate(rng.integers(0, 200, 40))]
    rows += [(100, "r s t " * 60), (101, "r s t " * 40)]
    assert spans(messy(spark, rows), min_words=20, shard_words=500, memory=1 << 12) == brute(rows, 20)


def test_edges(spark):
    d = messy(spark)
    got = spans(d)
    assert {i for i, *_ in got} == {7}  # only the long text has as many words, and it repeats itself
    cut = suffix_dedup.cut_repeats(d)
    assert cut.columns == d.columns and cut.count() == d.count()
    assert cut.filter("doc_id = 7").first()["text"].split() == ["lorem", "ipsum", "dolor"]
    copy = messy(spark, [(1, "w1 " + " ".join(f"v{i}" for i in range(60))), (2, " ".join(f"v{i}" for i in range(60))), (None, " ".join(f"v{i}" for i in range(60)))])
    assert sorted(str(r.doc_id) for r in suffix_dedup.cut_repeats(copy).collect()) == ["1", "None"]
    assert suffix_dedup.find_repeats(empty(spark)).count() == 0 and suffix_dedup.cut_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(d, min_words=5)
