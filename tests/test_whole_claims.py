"""Claims of a model over whole texts, with quotes that differ by a letter."""

from ledgerloom.operators import extract

LINE = "The Northfield Fund holds nineteen percent of the common stock of Acme."


def said(quote):
    return lambda: lambda t: [{"subject_surface": "Northfield", "predicate": "OWNS", "object_surface": "Acme", "evidence_quote": quote}] if "Acme" in t else []


def test_misquoted_claim_is_grounded(spark):
    d = spark.createDataFrame([(1, LINE + " More of it."), (2, "Acme is elsewhere.")], "id long, text string")
    got = extract.grounded(extract.model_claims(d, said(LINE.replace("nineteen", "ninetean"))), d).collect()
    assert [(r.document_id, r.span.start, r.span.end, r.span.snippet) for r in got] == [(1, 0, len(LINE), LINE)]
    exact = extract.grounded(extract.model_claims(d, said("common  stock")), d).collect()
    assert [(r.document_id, r.span.snippet) for r in exact] == [(1, "common stock")]
