"""Grounding and claims over whole texts."""

import os
import random

import pandas as pd
import pytest

from ledgerloom import registry
from ledgerloom.functions import similarity

DATA = "/root/testdata/sf0.001"


def brute(t, q, low=85.0):
    """(start, end, snippet) by one window after the other."""
    q, best, top = (q or "").strip(), None, low
    for at in range(0, max(1, len(t or "") - len(q) + 1), max(1, len(q) // 4)) if t and q else ():
        r = similarity.indel_ratio(q, t[at : at + len(q)])
        if r > top:
            top, best = r, at
    return None if best is None else (best, min(best + len(q), len(t)), t[best : best + len(q)])


def test_fuzzy_windows_against_one_by_one():
    r = random.Random(5)
    texts, quotes = [None, "", "a", "short", "é😀 b"], ["x", "x", " ", "short text", "é😀 c"]
    for _ in range(150):
        t = "".join(r.choices("ab é😀", k=r.randint(1, 700)))
        n = r.choice([1, 3, 40, 63, 64, 65, 128, 200])
        i = r.randrange(len(t))
        q = list(t[i : i + n])
        for _ in range(len(q) // 12):
            q[r.randrange(len(q))] = r.choice("abz")
        texts.append(t), quotes.append("".join(q))
    got = similarity._fuzzy(pd.Series(texts), pd.Series(quotes), pd.Series([85.0] * len(texts)))
    assert [None if pd.isna(a) else (int(a), int(b), s) for a, b, s in got.itertuples(index=False)] == [brute(t, q) for t, q in zip(texts, quotes)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_fuzzy_over_the_documents(spark):
    want = {}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        k = len(r.text) * 2 // 3
        want[r.doc_id] = brute(r.text, r.text[k : k + 20] + "x" + r.text[k + 21 : k + 61])
    got = {r.id: None if r.start is None else (r.start, r.end, r.snippet) for r in registry.queries()["ground_fuzzy"](spark, DATA).collect()}
    assert got == want and any(v and v[0] > 400 for v in got.values())
