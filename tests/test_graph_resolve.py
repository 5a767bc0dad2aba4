import json

import numpy as np
import pytest

from ledgerloom.operators import graph, ingest, resolve, vectors
from ledgerloom.operators.components import connected_components
from ledgerloom.sources import readers, writers


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([("F1", "I1", "OWNS"), ("F1", "I2", "OWNS"), ("F2", "I2", "OWNS")], "src string, dst string, predicate string")


def test_toy_graph(spark, toy):
    assert [(r.id, r.n_targets) for r in graph.interlocks(toy).collect()] == [("F1", 2)]
    rank = {r.id: r.score for r in graph.pagerank(toy, rounds=12).collect()}
    assert rank["I2"] > rank["I1"] and sum(rank.values()) == pytest.approx(1)
    c = graph.communities(toy).collect()
    assert len(c) == 4 and len({r.community for r in c}) <= 2
    nodes = spark.createDataFrame([("F1",), ("F2",), ("I1",), ("I2",), ("X",)], "id string")
    s = graph.summary(nodes, toy).first()
    assert (s.nodes, s.edges, s.components, s.interlocks) == (5, 3, 2, 1)
    assert {r.id: r.degree for r in graph.degree(toy).collect()} == {"F1": 2, "F2": 1, "I1": 1, "I2": 2}
    assert graph.ego(toy, "I1", 1).count() == 1 and graph.ego(toy, "I1", 2).count() == 2 and graph.ego(toy, "?", 2).count() == 0


def test_betweenness_of_a_path(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert {r.id: round(r.score, 4) for r in graph.betweenness(p).collect()} == {"a": 0.0, "b": 0.3333, "c": 0.3333, "d": 0.0}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    for n, m in ((30, 20), (60, 90), (50, 49)):
        e = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))] if m != 49 else [(i, i + 1) for i in range(49)]
        up = list(range(n))
        def root(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in e:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        want = {x: root(x) for ab in e for x in ab}
        got = {r.node: r.component for r in connected_components(spark.createDataFrame([*e, (None, 1)] if 1 in want else e, "src long, dst long")).collect()}
        assert got == want


REC = "rid long, name string, entity_type string, cik string"


def test_resolution(spark):
    r = spark.createDataFrame([(0, "Acme Robotics Inc.", "Organization", "1"), (1, "ACME Robotics, Inc", "Organization", None), (2, "Other Name LLC", "Organization", "1"), (3, "Acme Robotics Inc.", "Organization", "2"), (4, "Zed", "Person", None)], REC)
    got = {x.rid: x.cluster for x in resolve.clusters(r).collect()}
    assert got[0] == got[1] == got[2] and got[4] == 4
    apart = spark.createDataFrame([("acme robotics", "acme robotics", "must_not_link"), ("acme robotics", "other name", "must_not_link")], "key_a string, key_b string, decision string")
    assert len({x.cluster for x in resolve.clusters(r, apart).collect()}) == 5
    link = spark.createDataFrame([("quux", "zyx", "must_link")], "key_a string, key_b string, decision string")
    two = spark.createDataFrame([(0, "Quux", "Person", None), (1, "Zyx", "Person", None), (2, "Zyx", "Organization", None)], REC)
    assert {x.rid: x.cluster for x in resolve.clusters(two, link).collect()} == {0: 0, 1: 0, 2: 2}
    none = spark.createDataFrame([("ORG_000007", "Organization", "Old", ["Acme Robotics"], {"cik": "9"})], "id string, type string, canonical_name string, aliases array<string>, external_ids map<string,string>")
    out = {x.rid: x.entity_id for x in resolve.resolve(r, none).collect()}
    assert out[0] == out[2] and out[4].startswith("PER_")


def test_review(spark):
    r = spark.createDataFrame([(0, "Northfield Dynamics", "Organization", None), (1, "Northfeild Dynamo", "Organization", None)], REC)
    s = resolve.suggestions(r.withColumn("name", r.name))
    n = s.count()
    seen = s.select("entity_b", "entity_a").toDF("entity_a", "entity_b")
    assert resolve.suggestions(r, known=seen).count() == 0 and n <= 1
    counts = spark.createDataFrame([("E1", 3)], "entity_id string, n long")
    pairs = spark.createDataFrame([("E1", "E2"), ("E3", "E4")], "entity_a string, entity_b string")
    assert {tuple(x) for x in resolve.choose_kept(pairs, counts).collect()} == {("E1", "E2"), ("E4", "E3")}
    old = spark.createDataFrame([("a", "b", "must_link")], "key_a string, key_b string, decision string")
    new = spark.createDataFrame([("b", "a", "must_not_link")], "key_a string, key_b string, decision string")
    assert [tuple(x) for x in resolve.record_decisions(old, new).collect()] == [("a", "b", "must_not_link")]
    m, u = resolve.fit_weights(r)
    assert abs(sum(m) - 1) < 1e-9 and abs(sum(u) - 1) < 1e-9


def test_merge(spark):
    e = spark.createDataFrame([("A", "Person", "Ann", ["X"], {"cik": "1"}), ("B", "Person", "Anne", ["Ann", "Y"], {"cik": "2", "lei": "L"}), ("C", "Organization", "Co", [], {})], "id string, type string, canonical_name string, aliases array<string>, external_ids map<string,string>")
    out = {r.id: r for r in resolve.merge_entities(e, spark.createDataFrame([("A", "B"), ("A", "C")], "keep string, drop string")).collect()}
    assert set(out) == {"A", "C"} and out["A"].aliases == ["Anne", "X", "Y"] and out["A"].external_ids == {"cik": "1", "lei": "L"}
    assert resolve.find_by_external_id(e, "lei", "L").first()["id"] == "B"


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", None)], "id string, embedding array<float>")
    assert [tuple(r) for r in vectors.search(v, [1.0, 0.0], 5).collect()] == [("a", 1.0), ("b", 0.6)]


def test_sources(spark, tmp_path):
    party = [{"name": "P", "cik": "00042", "irs_number": None, "sic": None, "state_of_incorporation": None}]
    rows = [{"external_id": "1", "form": "SC 13D", "text": "x" * 60, "filers": party}, {"external_id": "2", "form": "SC 13D", "text": "  short  "}, {"external_id": "3", "form": "SC 13G", "text": "x" * 60}]
    (tmp_path / "f.json").write_text("\n".join(map(json.dumps, rows)))
    f = readers.filings(spark, str(tmp_path / "f.json")).collect()
    assert [(r.external_id, r.meta.filers[0].cik) for r in f] == [("1", "42")]
    (tmp_path / "g.json").write_text(json.dumps({"dataset": "d", "pairs": [{"a": "x", "b": "y", "label": "same"}]}))
    assert tuple(readers.er_pairs(spark, str(tmp_path / "g.json")).first()) == ("x", "y", True)
    (tmp_path / "p.pdf").write_bytes(b"one|two")
    assert readers.pdf_texts(spark, str(tmp_path), lambda: lambda b: b.decode().split("|")).first()["text"] == "one\ftwo"
    def fetch(part, parts):
        yield from ((i,) for i in range(part, 10, parts))
    assert sorted(r.i for r in readers.connect(spark, fetch, "i int", parts=3).collect()) == list(range(10))
    d = spark.createDataFrame([(1, "s", "h"), (2, "s", "h")], "id long, source_id string, content_hash string")
    assert writers.append_new(d, str(tmp_path / "t"), ["source_id", "content_hash"]) == 1 and writers.append_new(d, str(tmp_path / "t"), ["source_id", "content_hash"]) == 0
    assert tuple(ingest.ingest_target(d, 1, 4).first()) == (1, 0)
