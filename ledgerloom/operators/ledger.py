"""The bitemporal ledger: as-of filters, timelines, supersession, contradictions and the write path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUE_KEYS = ("stake_pct", "shares", "voting_power")
CHAIN = ("subject_id", "predicate", "object_id")


class LedgerError(ValueError):
    """A write that the ledger's rules forbid, in strict mode."""


def _time(value) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else F.lit(value)


def believed(as_of=None) -> Column:
    """Held to be true at as_of, the instant of retraction excluded; without it, never retracted."""
    if as_of is None:
        return F.col("retracted_at").isNull()
    at = _time(as_of)
    return (F.col("asserted_at") <= at) & (F.col("retracted_at").isNull() | (F.col("retracted_at") > at))


def valid_on(day) -> Column:
    """Both ends of the interval count, so that on a day of change the old and the new claim hold."""
    d = F.lit(day).cast("date")
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d))


def claims_asof(claims: DataFrame, *, as_of=None, on=None, obj: str | None = None, predicate: str | None = None, subject: str | None = None) -> DataFrame:
    out = claims.filter(believed(as_of))
    if on is not None:
        out = out.filter(valid_on(on))
    for name, value in (("subject_id", subject), ("predicate", predicate), ("object_id", obj)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def knowledge_diff(claims: DataFrame, since, until=None) -> DataFrame:
    """claims with change: asserted or retracted within the window, both ends included."""
    def within(name: str) -> Column:
        return (F.col(name) >= _time(since)) & (F.lit(True) if until is None else F.col(name) <= _time(until))
    return claims.filter(within("asserted_at")).withColumn("change", F.lit("asserted")).unionByName(claims.filter(within("retracted_at")).withColumn("change", F.lit("retracted")))


def timeline(claims: DataFrame, subject: str, predicate: str, obj: str | None = None, as_of=None) -> DataFrame:
    """Superseded claims included, by start of validity, open starts last."""
    return claims_asof(claims, as_of=as_of, subject=subject, predicate=predicate, obj=obj).orderBy(F.asc_nulls_last("valid_from"), "asserted_at", "id")


def supersession_links(claims: DataFrame) -> DataFrame:
    """(id, next_id, next_from): each claim and its successor within (subject, predicate, object), where that starts later.

    Only neighbours count: of two claims with one date the earlier stays open, whatever follows. One shuffle by the chain's key.
    """
    w = Window.partitionBy(*CHAIN).orderBy("valid_from", "asserted_at", "id")
    base = claims.filter("retracted_at is null and valid_from is not null")
    return base.select("id", *CHAIN, "valid_from", F.lead("id").over(w).alias("next_id"), F.lead("valid_from").over(w).alias("next_from")).filter("next_from > valid_from")


def reconcile(claims: DataFrame) -> DataFrame:
    """claims with superseded_by and valid_to of what is superseded; other rows keep theirs. A second run changes nothing.

    One window over the rows themselves: those that take no part sort into partitions of their own kind, so no join is needed.
    """
    part = F.col("retracted_at").isNull() & F.col("valid_from").isNotNull()
    w = Window.partitionBy(*CHAIN, part).orderBy("valid_from", "asserted_at", "id")
    rows = claims.withColumn("_id", F.when(part, F.lead("id").over(w))).withColumn("_from", F.when(part, F.lead("valid_from").over(w)))
    linked = F.coalesce(F.col("_from") > F.col("valid_from"), F.lit(False))
    return rows.withColumn("superseded_by", F.when(linked, F.col("_id")).otherwise(F.col("superseded_by"))).withColumn(
        "valid_to", F.when(linked & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_from"))), F.col("_from")).otherwise(F.col("valid_to"))
    ).drop("_id", "_from")


def supersession_summary(claims: DataFrame) -> DataFrame:
    """(chains, claims_superseded)"""
    links = supersession_links(claims)
    return links.groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("chains"), F.coalesce(F.sum("n"), F.lit(0)).alias("claims_superseded"))


def value_signature(qualifiers: Column) -> Column:
    """The value qualifiers that are present at the top level, in order; absent, null and a value differ, 5 is 5.0 and not '5'. No JSON: none is present."""
    top = F.try_parse_json(qualifiers)

    def one(key: str) -> Column:
        x = F.try_variant_get(top, f"$.{key}", "variant")
        number = F.try_variant_get(x, "$", "double")
        kind = F.when(F.is_variant_null(x), "null").when(F.schema_of_variant(x) == "STRING", F.concat(F.lit("s"), F.to_json(x))).when(number.isNotNull(), F.concat(F.lit("n"), number.cast("string"))).otherwise(F.concat(F.lit("o"), F.to_json(x)))
        return F.when(x.isNotNull(), F.concat(F.lit(f"{key}="), kind))
    return F.concat_ws(";", *map(one, VALUE_KEYS))


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Half-open intervals, open where null."""
    return ~(F.coalesce(a_to <= b_from, F.lit(False)) | F.coalesce(b_to <= a_from, F.lit(False)))


def contradictions(claims: DataFrame, *, as_of=None, include_superseded: bool = False) -> DataFrame:
    """(claim_a, claim_b, type) with claim_a < claim_b: overlapping claims of one subject, predicate, object and literal that differ.

    Groups are joined with themselves on their key; within the join only pairs that differ in polarity or values survive.
    """
    base = claims.filter(believed(as_of))
    if not include_superseded:
        base = base.filter("superseded_by is null")
    base = base.select("id", "subject_id", "predicate", "object_id", "object_literal", "valid_from", "valid_to", "polarity", value_signature(F.col("qualifiers")).alias("sig"))
    a, b = base.alias("a"), base.alias("b")
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("subject_id", "predicate", "object_id", "object_literal")]
    differ = (F.col("a.polarity") != F.col("b.polarity")) | (F.col("a.sig") != F.col("b.sig"))
    pairs = a.join(b, [*keys, F.col("a.id") < F.col("b.id"), differ, overlap(F.col("a.valid_from"), F.col("a.valid_to"), F.col("b.valid_from"), F.col("b.valid_to"))])
    return pairs.select(F.col("a.id").alias("claim_a"), F.col("b.id").alias("claim_b"), F.when(F.col("a.polarity") != F.col("b.polarity"), "polarity_conflict").otherwise("value_conflict").alias("type"))


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b))


def new_contradictions(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Those whose unordered pair isn't stored, in whatever status."""
    return unordered(found, "claim_a", "claim_b").join(unordered(stored, "claim_a", "claim_b").select("_lo", "_hi").distinct(), ["_lo", "_hi"], "left_anti").drop("_lo", "_hi")


def retract(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (claim_id, when): the first retraction stays, later ones change nothing."""
    r = requests.groupBy("claim_id").agg(F.min("when").alias("_when"))
    return claims.join(r, claims["id"] == r["claim_id"], "left").withColumn("retracted_at", F.coalesce("retracted_at", "_when")).drop("claim_id", "_when")


def supersede(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (old_id, new_id, at): the old claim points to the new one and is retracted at that time, unless it was before."""
    p = pairs.groupBy("old_id").agg(F.max(F.struct("at", "new_id")).alias("_p"))
    out = claims.join(p, claims["id"] == p["old_id"], "left")
    return out.withColumn("superseded_by", F.coalesce("_p.new_id", "superseded_by")).withColumn("retracted_at", F.coalesce("retracted_at", "_p.at")).drop("old_id", "_p")


def verify_evidence(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """evidence with ok and reason: the snippet is what the document has from char_start to char_end. Ends past the text are cut."""
    d = documents.select(F.col("id").alias("document_id"), "text")
    out = evidence.join(d, "document_id", "left")
    span = F.substr("text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    reason = F.when((F.col("char_start") < 0) | (F.col("char_end") < F.col("char_start")), "bad span").when(F.col("text").isNull(), "no text").when(span != F.col("snippet"), "snippet differs")
    return out.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("text")


def write_claims(claims: DataFrame, evidence: DataFrame, documents: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): a claim needs evidence, an extractor where it has such a column, and spans that all hold."""
    by = verify_evidence(evidence, documents).groupBy("claim_id").agg(F.count(F.lit(1)).alias("_n"), F.min("reason").alias("_why"))
    rows = claims.join(by, claims["id"] == by["claim_id"], "left")
    lacks = F.col("extractor").isNull() if "extractor" in claims.columns else F.lit(False)
    rows = rows.withColumn("reason", F.when(F.col("_n").isNull(), "no evidence").when(lacks, "no extractor").otherwise(F.col("_why"))).drop("claim_id", "_n", "_why")
    if strict and (bad := rows.filter("reason is not null").first()):
        raise LedgerError(f"claim {bad['id']}: {bad['reason']}")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def claim_dict(claims: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims with the names of subject and object and the evidence as an array by place."""
    name = entities.select("id", "canonical_name")
    s, o = name.toDF("subject_id", "subject_name"), name.toDF("object_id", "object_name")
    e = evidence.groupBy(F.col("claim_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("document_id", "char_start", "char_end", "snippet"))).alias("evidence"))
    return claims.join(s, "subject_id", "left").join(o, "object_id", "left").join(e, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(e.schema["evidence"].dataType)))


def claim_counts(claims: DataFrame) -> DataFrame:
    """(entity_id, n): claims as subject plus claims as object."""
    return claims.select(F.explode(F.array("subject_id", "object_id")).alias("entity_id")).dropna().groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


def claim_version_asof(events: DataFrame, claims: DataFrame) -> DataFrame:
    """As-of join: for each event (key columns of the chain, day) the claim valid then with the latest start."""
    rows = events.join(claims.select("id", *CHAIN, "valid_from", "valid_to"), list(CHAIN)).filter("valid_from <= day and (valid_to is null or valid_to >= day)")
    return rows.groupBy(*events.columns).agg(F.max_by("id", F.struct("valid_from", "id")).alias("claim_id"))
