"""Records that share a name are compared once, whatever their number."""

from ledgerloom.operators import resolve

REC = "rid long, name string, entity_type string, cik string"


def test_alike_records_are_one(spark, monkeypatch):
    seen = []
    match = resolve.match_edges
    monkeypatch.setattr(resolve, "match_edges", lambda r, d=None: seen.append(match(r, d).count()) or match(r, d))
    rows = [(i, ["Acme Robotics Inc.", "ACME Robotics, Inc"][i % 2], "Organization", None) for i in range(200)] + [(200 + i, "Acme Robotics Inc", "Organization", str(i)) for i in range(50)] + [(300, None, "Person", None), (301, None, "Person", None)]
    got = {x.rid: x.cluster for x in resolve.clusters(spark.createDataFrame(rows, REC)).collect()}
    assert got == {r[0]: 0 if r[0] < 300 else r[0] for r in rows}
    assert seen == [50]  # not 30,000
