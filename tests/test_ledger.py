import datetime as dt

import pytest

from ledgerloom.operators import alerts, ledger

T = dt.datetime
D = dt.date
SCHEMA = "id long, subject_id string, predicate string, object_id string, object_literal string, stake_pct double, qualifiers string, valid_from date, valid_to date, asserted_at timestamp_ntz, retracted_at timestamp_ntz, superseded_by long, polarity string"


def claim(i, stake, start, end=None, *, pol="asserted", at=None, gone=None, subject="PER_1", q=None):
    return (i, subject, "OWNS", "ORG_1", None, stake, q or f'{{"stake_pct": {stake}}}', start, end, at or T(2024, 1, 1), gone, None, pol)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def chain(spark):
    return frame(spark, claim(1, 4.5, D(2024, 2, 1)), claim(2, 6.25, D(2024, 5, 1)), claim(3, 8.5, D(2024, 8, 1)))


def test_chain(spark):
    out = {r.id: r for r in ledger.reconcile(chain(spark)).collect()}
    assert (out[1].superseded_by, out[1].valid_to) == (2, D(2024, 5, 1))
    assert (out[2].superseded_by, out[2].valid_to) == (3, D(2024, 8, 1))
    assert (out[3].superseded_by, out[3].valid_to) == (None, None)
    again = ledger.reconcile(ledger.reconcile(chain(spark)))
    assert {r.id: r for r in again.collect()} == out
    on = lambda day: [r.id for r in ledger.claims_asof(ledger.reconcile(chain(spark)), on=day).orderBy("id").collect()]
    assert on("2024-06-01") == [2] and on("2024-12-01") == [3] and on("2024-05-01") == [1, 2]
    assert [r.id for r in ledger.timeline(chain(spark), "PER_1", "OWNS").collect()] == [1, 2, 3]
    assert ledger.supersession_summary(chain(spark)).first().asDict() == {"chains": 1, "claims_superseded": 2}


def test_equal_dates_stay_open_and_conflict_once(spark):
    rows = frame(spark, claim(1, 5.0, D(2024, 1, 1)), claim(2, 9.0, D(2024, 1, 1)), claim(3, 9.5, D(2024, 2, 1)))
    out = {r.id: r.superseded_by for r in ledger.reconcile(rows).collect()}
    assert out == {1: None, 2: 3, 3: None}
    found = ledger.contradictions(frame(spark, claim(1, 5.0, D(2024, 1, 1)), claim(2, 9.0, D(2024, 1, 1))))
    assert [tuple(r) for r in found.collect()] == [(1, 2, "value_conflict")]
    stored = spark.createDataFrame([(2, 1)], "claim_a long, claim_b long")
    assert ledger.new_contradictions(found, stored).count() == 0


def test_contradictions(spark):
    rows = frame(
        spark, claim(1, 5.0, D(2024, 1, 1), D(2024, 12, 31)), claim(2, 5.0, D(2024, 6, 1), pol="negated"), claim(3, 7.0, D(2024, 12, 31)), claim(4, 7.0, D(2024, 3, 1), D(2024, 4, 1), q='{"stake_pct": "5"}'), claim(5, 5.0, D(2024, 3, 1), gone=T(2024, 2, 1)),
        claim(6, 5.0, D(2024, 3, 1), D(2024, 5, 1), q='{"stake_pct": 5, "note": "x, y"}'),
    )
    got = {(r.claim_a, r.claim_b): r.type for r in ledger.contradictions(rows).collect()}
    assert got == {(1, 2): "polarity_conflict", (2, 3): "polarity_conflict", (1, 4): "value_conflict", (4, 6): "value_conflict"}


def test_signature_tells_absent_from_null(spark):
    rows = spark.createDataFrame([("{}",), ('{"stake_pct": null}',), ('{"stake_pct": 5}',), ('{"stake_pct": 5.0}',), ('{"shares": 5}',), (None,)], "q string")
    a = [r[0] for r in rows.select(ledger.value_signature(rows.q)).collect()]
    assert a[2] == a[3] and len({a[0], a[1], a[2], a[4]}) == 4 and a[5] == a[0]


def test_times(spark):
    rows = frame(spark, claim(1, 5.0, D(2024, 1, 1), at=T(2024, 1, 1), gone=T(2024, 1, 10)), claim(2, 6.0, None, at=T(2024, 1, 5)))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(ledger.claims_asof(rows)) == [2]
    assert ids(ledger.claims_asof(rows, as_of="2024-01-09 23:59:59")) == [1, 2]
    assert ids(ledger.claims_asof(rows, as_of="2024-01-10 00:00:00")) == [2]
    diff = {(r.id, r.change) for r in ledger.knowledge_diff(rows, "2024-01-05 00:00:00", "2024-01-10 00:00:00").collect()}
    assert diff == {(2, "asserted"), (1, "retracted")}
    req = spark.createDataFrame([(2, T(2024, 2, 2)), (2, T(2024, 2, 1)), (1, T(2024, 3, 1))], "claim_id long, when timestamp_ntz")
    assert {r.id: r.retracted_at for r in ledger.retract(rows, req).collect()} == {1: T(2024, 1, 10), 2: T(2024, 2, 1)}
    p = spark.createDataFrame([(2, 9, T(2024, 2, 2))], "old_id long, new_id long, at timestamp_ntz")
    assert [(r.superseded_by, r.retracted_at) for r in ledger.supersede(rows, p).filter("id = 2").collect()] == [(9, T(2024, 2, 2))]


def test_writes_need_evidence(spark):
    docs = spark.createDataFrame([(1, "A née B 😀 C"), (2, None)], "id long, text string")
    c = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "x"), (5, "x")], "id long, extractor string")
    e = spark.createDataFrame([(1, 1, 8, 11, "😀 C"), (2, 1, 0, 1, "B"), (3, 1, 0, 1, "A"), (4, 2, 0, 1, "A")], "claim_id long, document_id long, char_start int, char_end int, snippet string")
    good, bad = ledger.write_claims(c, e, docs)
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reason for r in bad.collect()} == {2: "snippet differs", 3: "no extractor", 4: "no text", 5: "no evidence"}
    with pytest.raises(ledger.LedgerError):
        ledger.write_claims(c, e, docs, strict=True)


def test_alerts_fire_once(spark):
    c = frame(spark, claim(1, 12.5, D(2024, 1, 1)), claim(2, 3.0, D(2024, 2, 1)))
    ent = spark.createDataFrame([("PER_1", "Ann")], "id string, canonical_name string")
    w = spark.createDataFrame([(1, "stake_threshold", "ORG_1", 10.0), (2, "other", None, None)], "id long, kind string, target string, threshold double")
    none = spark.createDataFrame([], "id long, claim_a long, claim_b long, type string, status string")
    first = alerts.run_alerts(c, ent, none, w, spark.createDataFrame([], "watch_id long, dedup_key string"))
    assert [tuple(r) for r in first.collect()] == [(1, "claim:1", "Ann holds 12.5% of ORG_1 (>= 10.0%)")]
    assert alerts.run_alerts(c, ent, none, w, first).count() == 0
