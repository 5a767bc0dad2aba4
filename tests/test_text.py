import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import similarity, text
from ledgerloom.operators import evaluate, extract


def one(spark, col, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(col.alias("x")).first()["x"]


def test_names(spark):
    f = lambda fn, s: one(spark, fn(F.col("c0")), s)
    assert f(text.normalized, " Orange  Inc. ") == "orange inc"
    assert f(text.core, "QX Capital Management, L.P.") == "qx"
    assert f(text.core, "The Trust Co") == "the trust co"
    assert f(text.block_key, "Horizontal Aviation Ltd.") == "horizo"
    assert f(text.guess_type, "Ralph Doe") == "Organization" and f(text.guess_type, "Ann Doe") == "Person"


def test_cusip(spark):
    ok = lambda s: one(spark, text.valid_cusip(F.col("c0")), s)
    assert ok("594918104") and ok("17275R102") and not ok("594918105") and not ok("1234") and not ok("59491810?")
    got = one(spark, text.extract_cusip(F.col("c0")), "\n17275R 10 2\n(CUSIP Number)\n")
    assert (got["cusip"], got["valid"]) == ("17275R102", True)
    assert one(spark, text.extract_cusip(F.col("c0")), "none here") is None


def test_spans_and_dates(spark):
    s = "😀 é 5% and 12.5 % x"
    got = one(spark, text.spans(F.col("c0"), text.PERCENT), s)
    assert [(r["start"], r["end"], r["surface"]) for r in got] == [(s.index("5%"), s.index("5%") + 2, "5%"), (s.index("12.5"), s.index("12.5") + 6, "12.5 %")]
    assert one(spark, text.spans(F.col("c0"), text.PERCENT), "") == []
    assert str(one(spark, text.parsed_date(F.col("c0")), "March 5, 2024")) == "2024-03-05" and one(spark, text.parsed_date(F.col("c0")), "5/3/24") is None
    assert one(spark, text.iso_date(F.col("c0")), "2024-1") is None and str(one(spark, text.iso_date(F.col("c0")), "2024-01-05")) == "2024-01-05"


def test_percent_of_interest_is_rejected(spark):
    t = "The notes bear interest at a prime rate of 7.25%.\n" + " " * 120 + "\nPercent of Class Represented by Amount in Row (11)\n19.5%\n"
    best = one(spark, text.best_percent(text.percent_candidates(F.col("c0"))), t)
    assert best["value"] == 19.5 and t[best["start"] : best["end"]] == "19.5%"
    assert one(spark, text.best_percent(text.percent_candidates(F.col("c0"))), "at a coupon rate of 3%") is None


def test_grounding(spark):
    g = lambda fn, t, q: one(spark, fn(F.col("c0"), F.col("c1")), t, q)
    assert tuple(g(text.ground_exact, "one two three", " two ")) == (4, 7, "two")
    assert g(text.ground_exact, "one", "four") is None and g(text.ground_exact, "one", " ") is None
    assert tuple(g(text.ground_flexible, "a (b)\n  c d", "(b) c")) == (2, 9, "(b)\n  c")
    hit = g(similarity.ground_fuzzy, "xxxxx " + "the quick brown fox jumps" + " yy", "the quick brown fax jumps")
    assert hit is not None and "quick brown" in hit["snippet"]
    assert g(similarity.ground_fuzzy, "nothing alike", "the quick brown fax jumps") is None


def test_similarities():
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler("", "a") == 0 and similarity.jaro_winkler("", "") == 1
    assert similarity.indel_ratio("abcd", "abxd") == pytest.approx(75.0) and similarity.indel_ratio("", "") == 100


def test_work(spark):
    w = spark.createDataFrame(
        [("https://x/W1", "https://doi.test/10.1/a", "T", None, {"b": [1], "a": [0, 2]}, [(("https://x/A1", "Ann", None), [("https://x/I1", "Inst", None)])], ["https://x/W2"], [("https://x/C1", "Logic")])],
        "id string, doi string, title string, publication_date date, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<id:string,display_name:string,ror:string>>>>, referenced_works array<string>, concepts array<struct<id:string,display_name:string>>",
    )
    r = extract.render_works(w)
    assert r.first()["text"] == "TITLE: T\n\nABSTRACT: a b a\n\nAUTHORS: Ann\nAFFILIATIONS: Ann — Inst\nCONCEPTS: Logic\nREFERENCES: W2" and r.first()["meta"]["doi"] == "10.1/a"
    assert {(x.subject, x.predicate, x.object) for x in extract.work_claims(r).collect()} == {("A1", "AUTHORED", "W1"), ("A1", "AFFILIATED_WITH", "I1"), ("W1", "MENTIONS_CONCEPT", "C1"), ("W1", "CITES", "W2")}


def test_chunks_and_models(spark):
    d = spark.createDataFrame([(1, "x" * 2500), (2, ""), (3, None), (4, "Ann Lee of Acme Corp paid $5,000 on May 1, 2024")], "id long, text string")
    assert [(r.id, r.start, len(r.chunk)) for r in extract.chunks(d).orderBy("id", "start").collect()] == [(1, 0, 1200), (1, 1050, 1200), (1, 2100, 400), (4, 0, 47)]
    m = {(r.surface_text, r.ner_type) for r in extract.rule_mentions(d).collect()}
    assert {("Ann Lee", "Person"), ("Acme Corp", "Organization"), ("$5,000", "MONEY"), ("May 1, 2024", "DATE")} <= m
    fake = lambda: lambda chunk: [(chunk.index("Acme"), chunk.index("Acme") + 9, "organization", 0.9)] if "Acme" in chunk else []
    assert [(r.document_id, r.surface_text, r.char_start) for r in extract.model_mentions(d, fake, labels={"organization": "Organization"}).collect()] == [(4, "Acme Corp", 11)]
    said = lambda: lambda t: [{"subject_surface": "Ann", "predicate": "OWNS", "object_surface": "Acme", "evidence_quote": "Ann Lee"}, {"predicate": "OWNS"}] if "Ann" in t else []
    assert extract.grounded(extract.model_claims(d, said), d).select("span.start").first()["start"] == 0


def test_metrics(spark):
    r = spark.range(1).select(evaluate.prf(F.lit(3), F.lit(1), F.lit(1)).alias("a"), evaluate.prf(F.lit(0), F.lit(0), F.lit(0)).alias("b")).first()
    assert tuple(r.a) == (0.75, 0.75, 0.75) and tuple(r.b) == (0.0, 0.0, 0.0)
    gold = spark.createDataFrame([("a", "b", True), ("c", "d", True), ("e", "f", False)], "a string, b string, same boolean")
    p = spark.createDataFrame([("b", "a"), ("f", "e")], "a string, b string")
    assert evaluate.pairwise(p, gold).first().asDict() == {"false_merge_rate": 1.0, "missed_merge_rate": 0.5, "accuracy": 0.3333, "n": 3}
    assert evaluate.preferred_backend((0.9, 0.0), (0.9, 0.0)) == "default" and evaluate.preferred_backend((0.8, 0.0), (0.9, 0.1)) == "probabilistic"
