"""The chain over a stored ledger, and what reviewers and writers do to it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import alerts, evaluate, ledger, resolve, write
from ledgerloom.operators.components import connected_components
from ledgerloom.plans import pipeline
from ledgerloom.plans.facade import Ledger
from ledgerloom.sources.store import SCHEMAS, Store

COVER = "SCHEDULE 13D\n\nAcme Robotics Corp\n(Name of Issuer)\n\nJune 3, 2023\n\nPercent of Class Represented by Amount in Row (11): {}%\nHolder Fund Group signed.\n"
AT, DAY = "2024-01-01 00:00:00", "2024-02-01"


def filings(spark, rows):
    party = lambda n, c: {"name": n, "cik": c}
    data = [(i, "s", str(i), COVER.format(p), "SC 13D", {"filers": [party("Holder Fund Group", "7")], "subject_companies": [party("Acme Robotics Corp", "9")]}) for i, p in rows]
    return spark.createDataFrame(data, SCHEMAS["document"])


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "ledger"))
    s.append("document", filings(spark, [(1, "5.2"), (2, "7.8")]))
    return s


def stages(log):
    return {r.stage: r for r in log.collect()}


def test_chain_writes_the_ledger(spark, store):
    log = stages(pipeline.run_chain(store, pack="a", on=DAY, at=AT))
    assert all(r.status == "ok" for r in log.values()), [r.error for r in log.values()]
    claims, entities = store.read("claim").collect(), {r.id: r for r in store.read("entity").collect()}
    assert sorted(c.stake_pct for c in claims) == [5.2, 7.8]
    assert {entities[c.subject_id].external_ids["cik"] for c in claims} == {"7"} and {entities[c.object_id].external_ids["cik"] for c in claims} == {"9"}
    assert {c.valid_from for c in claims} == {dt.date(2023, 6, 3)}
    bad = ledger.verify_evidence(store.read("evidence"), store.read("document")).filter("not ok")
    assert bad.count() == 0 and store.read("evidence").count() == 2
    resolved = [m for m in store.read("mention").collect() if m.ner_type in ("Organization", "Person")]
    assert resolved and all(m.resolved_to in entities and m.resolution_confidence > 0 for m in resolved)
    assert store.read("contradiction").count() == 1 and store.read("vector").count() == len(entities)
    n = {t: store.read(t).count() for t in ("mention", "claim", "evidence", "contradiction", "vector", "entity")}
    again = stages(pipeline.run_chain(store, pack="a", on=DAY, at=AT))
    assert n == {t: store.read(t).count() for t in n} and again["claims"].counts == {"claims": 0, "rejected": 0}
    store.append("document", filings(spark, [(3, "9.1")]))  # only what is new is read
    assert stages(pipeline.run_chain(store, pack="a", on=DAY, at=AT))["claims"].counts["claims"] == 1
    log = store.read("run_log")
    assert log.count() == 3 * 7 and log.filter("started_at is null").count() == 0
    assert sorted(v.vid for v in store.read("vector").collect()) == sorted({v.vid for v in store.read("vector").collect()})


def test_a_stage_that_fails_does_not_stop_the_others(spark, store):
    def broken():
        raise RuntimeError("no model")

    log = stages(pipeline.run_chain(store, pack="a", on=DAY, at=AT, embedder=broken))
    assert list(log) == ["mentions", "resolve", "claims", "supersede", "contradictions", "vectors", "graph"]
    assert log["vectors"].status == "error" and "no model" in log["vectors"].error and all(r.status == "ok" for s, r in log.items() if s != "vectors")


def test_mentions_are_verified_and_once(spark, store):
    found = spark.createDataFrame([(1, "SCHEDULE", 0, 8, "Organization"), (1, "SCHEDULE", 1, 9, "Organization"), (8, "x", 0, 1, "Person"), (1, "SCHEDULE", 0, 8, "Organization")], "document_id long, surface_text string, char_start int, char_end int, ner_type string")
    assert pipeline.write_mentions(store, found) == {"mentions": 1, "rejected": 2}
    assert pipeline.write_mentions(store, found)["mentions"] == 0


E = "id string, type string, canonical_name string, aliases array<string>, external_ids map<string,string>"


def test_link_or_create(spark):
    e = spark.createDataFrame([("ORG_000004", "Organization", "Acme Robotics Inc.", [], {"cik": "1"}), ("PER_000009", "Person", "Jane Roe", [], {})], E)
    s = spark.createDataFrame([("ACME", "Organization", "1"), ("jane roe", "Person", None), ("Newco LLC", "Organization", None), ("NEWCO, L.L.C.", "Organization", "5"), ("Newco Holdings", "Organization", None)], "surface string, type string, cik string")
    links, after = write.link_or_create(s, e)
    to = {r.surface: r.entity_id for r in links.collect()}
    after = {r.id: r for r in after.collect()}
    assert to["ACME"] == "ORG_000004" and after["ORG_000004"].aliases == ["ACME"] and to["jane roe"] == "PER_000009"
    # the one with a cik comes first; the others have its core
    assert to["Newco LLC"] == to["Newco Holdings"] == to["NEWCO, L.L.C."] and len(after) == 3 and after[to["Newco LLC"]].external_ids == {"cik": "5"}
    links, after = write.link_or_create(s.filter("cik is null"), e)
    to = {r.surface: r.entity_id for r in links.collect()}
    assert to["Newco LLC"] == to["Newco Holdings"] == "ORG_000010" and after.count() == 3


def test_merges(spark):
    e = spark.createDataFrame([("A", "Person", "Ann", [], {}), ("B", "Person", "Anne", [], {}), ("C", "Organization", "Co", [], {}), ("D", "Person", "Ana", [], {})], E)
    m = spark.createDataFrame([("A", "A"), ("A", "Z"), ("A", "C"), ("A", "B"), ("B", "D")], "keep string, drop string")
    sound, bad = write.judged_merges(m, e)
    assert [tuple(r) for r in sound.collect()] == [("A", "B")]
    assert {r["drop"]: r.reason for r in bad.collect()} == {"A": "into itself", "Z": "not found", "C": "type mismatch", "D": "keeper is dropped too"}
    with pytest.raises(write.MergeError):
        write.judged_merges(m, e, strict=True)
    claims = spark.createDataFrame([(1, "B", "B"), (2, "A", "B"), (3, "A", "C")], "id long, subject_id string, object_id string")
    mentions = spark.createDataFrame([(1, "B"), (2, None)], "id long, resolved_to string")
    assert tuple(write.merge_log(sound, e, claims, mentions).first()) == ("A", "B", "Anne", 3, 1)


def test_reviews(spark, store):
    names = [("ORG_000001", "Northfield Dynamics"), ("ORG_000002", "Northfield Dynamo"), ("ORG_000003", "Southgate Minerals"), ("ORG_000004", "Southgate Mining")]
    store.append("entity", spark.createDataFrame([(i, "Organization", n, [], {}) for i, n in names], E))
    store.append("claim", spark.createDataFrame([(1, "ORG_000003", "OWNS", "ORG_000001"), (2, "ORG_000003", "OWNS", "ORG_000004")], "id long, subject_id string, predicate string, object_id string"))
    n = pipeline.suggest_merges(store)
    pairs = {(s.entity_a, s.entity_b): s.id for s in store.read("merge_suggestion").collect()}
    assert n == len(pairs) >= 1 and pipeline.suggest_merges(store) == 0
    done = pipeline.accept_suggestion(store, pairs["ORG_000003", "ORG_000004"])
    assert done == {"claims_repointed": 1, "mentions_repointed": 0}
    assert {e.id for e in store.read("entity").collect()} == {"ORG_000001", "ORG_000002", "ORG_000003"} and {c.object_id for c in store.read("claim").collect()} == {"ORG_000001", "ORG_000003"}
    assert [tuple(d) for d in store.read("er_decision").collect()] == [("southgate minerals", "southgate mining", "must_link")]
    store.append("merge_suggestion", spark.createDataFrame([(50, "ORG_000001", "ORG_000002", 0.9, "r", "open")], "id long, entity_a string, entity_b string, score double, reason string, status string"))
    pipeline.reject_suggestion(store, 50)
    assert {d.decision for d in store.read("er_decision").collect()} == {"must_link", "must_not_link"} and pipeline.suggest_merges(store) == 0
    assert store.read("merge_suggestion").filter("status = 'accepted' and decided_at is not null").count() == 1
    with pytest.raises(ValueError):
        pipeline.accept_suggestion(store, 99)


def test_reviewers_decisions_reach_the_clusters(spark):
    r = spark.createDataFrame([(0, "Quux Alpha", "Organization", None), (1, "Quux Alpho", "Organization", None), (2, "Zyx", "Organization", None)], "rid long, name string, entity_type string, cik string")
    d = spark.createDataFrame([("quux alpha", "quux alpho", "must_not_link"), ("quux alpha", "zyx", "must_link")], "key_a string, key_b string, decision string")
    assert {x.rid: x.cluster for x in resolve.clusters(r).collect()} == {0: 0, 1: 0, 2: 2}
    assert {x.rid: x.cluster for x in resolve.clusters(r, d).collect()} == {0: 0, 1: 1, 2: 0}
    e, links = resolve.materialize(r, spark.createDataFrame([], E), d)
    to = {x.rid: x.entity_id for x in links.collect()}
    assert to[0] == to[2] != to[1] and {x.id for x in e.collect()} == set(to.values())


def test_backends(spark):
    gold = spark.createDataFrame([("Acme Robotics Inc.", "ACME ROBOTICS INC", True), ("Acme Robotic Inc", "Acme Robotics Inc", True), ("Borealis Foods", "Zephyr Tools", False)], "a string, b string, same boolean")
    rows = {r.backend: r for r in evaluate.compare_backends(gold).collect()}
    assert rows["default"].accuracy == 1.0 and rows["probabilistic"].accuracy == pytest.approx(0.6667) and rows["default"].recommended and not rows["probabilistic"].recommended
    out = {r.eval: r.metrics for r in evaluate.evaluate_all(er=evaluate.isolated_pairs(gold), er_backends=evaluate.compare_backends(gold)).collect()}
    assert set(out) == {"er", "er_backend_default", "er_backend_probabilistic"} and out["er"]["accuracy"] == 1.0
    r = spark.createDataFrame([(0, "Quux", "Person", "1"), (1, "Other", "Person", "1"), (2, "Quux", "Person", None)], "rid long, name string, entity_type string, cik string")
    got = {x.rid: (x.cluster, x.confidence) for x in resolve.probabilistic_clusters(r).collect()}
    assert got == {0: (0, 1.0), 1: (0, 1.0), 2: (0, 1.0)}
    many = spark.range(600).selectExpr("id as rid", "md5(cast(id % 300 as string)) as name", "'Person' as entity_type", "cast(null as string) as cik")
    assert resolve.probabilistic_clusters(many).select("cluster").distinct().count() == 300  # fitted weights


def test_signature_is_of_the_top_level(spark):
    rows = ['{"stake_pct": 7}', '{"stake_pct": 7.0, "x": 1}', '{"inner": {"stake_pct": 7}}', '{"stake_pct": "7"}', '{"stake_pct": null}', "{}", None, "no json", '{"shares": 3, "stake_pct": 1}']
    got = [r.s for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, q string").orderBy("i").select(ledger.value_signature(F.col("q")).alias("s")).collect()]
    assert got[0] == got[1] != "" and got[2] == got[5] == got[6] == got[7] == "" and len({got[0], got[3], got[4], got[5], got[8]}) == 5


def test_alerts_join_on_targets(spark):
    c = spark.createDataFrame([(1, "P", "OWNS", "O", 12.0, None), (2, "O", "OWNS", "O", 9.0, None), (3, None, "OWNS", "Q", 50.0, None)], "id long, subject_id string, predicate string, object_id string, stake_pct double, retracted_at timestamp_ntz")
    e = spark.createDataFrame([("P", "Pat"), ("O", "Org")], "id string, canonical_name string")
    w = spark.createDataFrame([(1, "stake_threshold", "O", 10.0), (2, "stake_threshold", None, 11.0), (3, "new_claim", "O", None), (4, "new_claim", None, None), (5, "contradiction", "P", None)], "id long, kind string, target string, threshold double")
    stored = spark.createDataFrame([(7, 1, 2, "value_conflict", "open"), (8, 2, 3, "value_conflict", "open"), (9, 1, 2, "value_conflict", "resolved")], "id long, claim_a long, claim_b long, type string, status string")
    fired = alerts.run_alerts(c, e, stored, w, spark.createDataFrame([(4, "claim:3")], "watch_id long, dedup_key string"))
    assert {(r.watch_id, r.dedup_key) for r in fired.collect()} == {(1, "claim:1"), (2, "claim:1"), (2, "claim:3"), (3, "claim:1"), (3, "claim:2"), (4, "claim:1"), (4, "claim:2"), (5, "contradiction:7")}
    plan = fired._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_facade(spark, store):
    pipeline.run_chain(store, pack="a", on=DAY, at=AT)
    w = spark.createDataFrame([], SCHEMAS["watch"])
    log = store.read("run_log")
    a = Ledger(store.read("claim"), store.read("entity"), store.read("evidence"), store.read("document"), store.read("contradiction"), spark.createDataFrame([(1, "x", "y", 0.9, "r", "open", None)], SCHEMAS["merge_suggestion"]), w, store.read("alert"), log)
    ident = store.read("claim").first()["subject_id"]
    assert tuple(a.health().first())[0] == 2 and a.metrics(3).count() == 3
    assert a.entity(ident).count() == 2 and a.claims_asof().count() == 2 and a.timeline(ident).count() == 2
    assert a.search("Acme Robotics", 1).first()["canonical_name"].startswith("Acme")
    nodes, edges = a.graph()
    assert nodes.count() == 2 and edges.count() == 2 and a.graph(center=ident, radius=1)[1].count() == 2
    assert a.open_contradictions().count() == 1 and a.central().count() == 2 and a.central("pagerank").count() == 2 and a.central("betweenness").count() == 2
    assert a.communities().count() == 2 and a.interlocks(1).count() == 1 and a.summary().first()["edges"] == 2 and a.merge_suggestions().count() == 1
    more = a.add_watch("new_claim", ident)
    assert [r.id for r in more.collect()] == [1]
    with pytest.raises(ValueError):
        a.add_watch("nonsense")
    fired = Ledger(a.claims, a.entities, a.evidence, contradictions=a.contradictions, watches=more, fired=a.fired).run_alerts()
    assert fired.count() == 2 and a.document(1).count() == 1
    assert connected_components(edges).select("component").distinct().count() == 1
