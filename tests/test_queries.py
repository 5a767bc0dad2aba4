"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def flat(df):
    df = df[sorted(df.columns)]
    text = lambda x: "" if pd.api.types.is_scalar(x) and pd.isna(x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql())))
def test_against_sql(spark, duck, name):
    ours, theirs = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert flat(ours) == flat(theirs)


def test_resolution_is_its_clusters(spark):
    """An entity for each key of the clusters: the cik, else type and core of the name."""
    from ledgerloom.operators import resolve
    from ledgerloom.plans import views

    n = views.names(spark, DATA).toPandas()
    c = resolve.clusters(views.names(spark, DATA)).toPandas().set_index("rid")["cluster"]
    got = registry.queries()["resolution"](spark, DATA).toPandas()
    names = resolve.canonical(views.names(spark, DATA), spark.createDataFrame(c.reset_index())).toPandas().set_index("cluster")
    core = {r["rid"]: r["core"] for r in resolve.keyed(views.names(spark, DATA)).collect()}
    first = n.set_index("name")["rid"]
    key = {k: f"cik:{r.cik}" if r.cik is not None else core[first[r.canonical_name]] for k, r in names.iterrows()}
    n["key"] = n["rid"].map(c).map(key)
    want = n.groupby("key")["rid"].agg(["size", "min"])
    assert sorted(zip(got["n"], got["first"])) == sorted(zip(want["size"], want["min"]))


def test_mentions_are_what_the_rules_find(spark):
    """Every surface is at its place, matches its rule from end to end, and none that a plain search finds is missing."""
    import regex

    from ledgerloom.functions import text
    from ledgerloom.operators import extract

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = {(r.document_id, r.char_start, r.char_end): (r.surface_text, r.ner_type) for r in registry.queries()["mentions_rule"](spark, DATA).collect()}
    want = {}
    for i, t in docs.items():
        for p, kind in [*extract.RULES, (extract.NAME_RUN, None)]:
            for m in regex.finditer(p, t):
                s = m.group()
                k = kind or ("Organization" if any(x in s.lower() for x in text.ORG_MARKS) else "Person")
                if k in ("Organization", "Person") and (s.lower().strip() in text.STOP or len(s.strip()) < 3):
                    continue
                want.setdefault((i, m.start(), m.end()), (s, k))
    assert got == want


def test_search_and_log(spark):
    from ledgerloom.operators import vectors
    from ledgerloom.plans import views

    e = views.entities(spark, DATA).select("id", "canonical_name").toPandas()
    model = vectors.hashed_embedder()
    x, q = model(e["canonical_name"].tolist()).astype("float64"), model(["Organization 3"])[0].astype("float64")
    score = (x @ q) / ((x * x).sum(1) ** 0.5 * (q @ q) ** 0.5)
    want = sorted(zip((-score).tolist(), e["id"]))[:5]
    got = registry.queries()["entity_search"](spark, DATA).collect()
    assert [r.id for r in got] == [i for _, i in want] and all(abs(r.score + s) < 1e-3 for r, (s, _) in zip(got, want))
    vec = {r["id"]: r["embedding"] for r in vectors.build_entity_vectors(views.entities(spark, DATA)).collect()}
    assert all(abs(sum(a * b for a, b in zip(vec[i], y)) - 1) < 1e-5 for i, y in zip(e["id"], x.tolist()))
    half = views.entities(spark, DATA).withColumn("embedding", F.expr("case when type = 'Person' then array(1f) end"))
    assert {r["id"][:3] for r in vectors.build_entity_vectors(half).collect()} == {"ORG"}
    log = {r.stage: (r.status, r.counts) for r in registry.queries()["pipeline_log"](spark, DATA).collect()}
    assert {s for s, _ in log.values()} == {"ok"} and log["claims"][1] == "claims=400,rejected=0" and log["science"][1] == "claims=1200,documents=200,rejected=0"


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:3] == ["id", "holder", "issuer"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
