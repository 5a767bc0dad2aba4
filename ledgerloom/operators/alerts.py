"""Alert rules over the ledger: each watch and key fires once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("stake_threshold", "new_claim", "contradiction")


def _named(claims: DataFrame, entities: DataFrame) -> DataFrame:
    n = entities.select("id", "canonical_name")
    s, o = n.toDF("subject_id", "_s"), n.toDF("object_id", "_o")
    called = lambda name, ident: F.coalesce(name, ident, F.lit("?"))
    return claims.join(s, "subject_id", "left").join(o, "object_id", "left").withColumn("subject_name", called("_s", "subject_id")).withColumn("object_name", called("_o", "object_id")).drop("_s", "_o")


#: Watches without a target that are put to rows at once; how many there may be.
TOGETHER, FREE = 500, 50_000


def _watched(rows: DataFrame, watches: DataFrame, *ends: str) -> DataFrame:
    """rows with each watch whose target is one of their ends, by an equal join, and with each that has no target.

    Those without a target see every row by their nature; they are few, which is checked, and go out as literals.
    """
    targeted = watches.filter("target is not null")
    out = rows.withColumn("target", F.explode(F.array_distinct(F.array(*ends)))).join(targeted, "target").select(*rows.columns, *watches.columns)
    free = watches.filter("target is null").limit(FREE + 1).collect()
    if len(free) > FREE:
        raise ValueError(f"more than {FREE} watches without a target")
    for i in range(0, len(free), TOGETHER):
        each = F.array(*(F.struct(*(F.lit(w[c]).cast(watches.schema[c].dataType).alias(c) for c in watches.columns)) for w in free[i : i + TOGETHER]))
        out = out.unionByName(rows.withColumn("_w", F.explode(each)).select(*rows.columns, "_w.*"))
    return out


def _of(watches: DataFrame, kind: str) -> DataFrame:
    return watches.filter(F.col("kind") == kind).select(F.col("id").alias("watch_id"), "target", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def stake_threshold(claims: DataFrame, entities: DataFrame, watches: DataFrame, predicate: str = "OWNS") -> DataFrame:
    """Claims never retracted, superseded ones included, whose stake reaches the threshold."""
    rows = claims.filter((F.col("predicate") == predicate) & F.col("retracted_at").isNull() & F.col("stake_pct").isNotNull())
    rows = _watched(rows, _of(watches, "stake_threshold"), "object_id").filter("stake_pct >= threshold")
    said = F.concat("subject_name", F.lit(" holds "), F.col("stake_pct").cast("string"), F.lit("% of "), "object_name", F.lit(" (>= "), F.col("threshold").cast("string"), F.lit("%)"))
    return _named(rows, entities).select("watch_id", F.concat(F.lit("claim:"), "id").alias("dedup_key"), said.alias("message"))


def new_claim(claims: DataFrame, entities: DataFrame, watches: DataFrame) -> DataFrame:
    rows = _watched(claims.filter("retracted_at is null"), _of(watches, "new_claim"), "subject_id", "object_id")
    return _named(rows, entities).select("watch_id", F.concat(F.lit("claim:"), "id").alias("dedup_key"), F.concat_ws(" ", "subject_name", "predicate", "object_name").alias("message"))


def contradiction(stored: DataFrame, claims: DataFrame, watches: DataFrame) -> DataFrame:
    """stored: (id, claim_a, claim_b, type, status); only open ones, one of whose four ends is the target."""
    ends = claims.select("id", "subject_id", "object_id")
    a, b = ends.toDF("claim_a", "sa", "oa"), ends.toDF("claim_b", "sb", "ob")
    rows = _watched(stored.filter("status = 'open'").join(a, "claim_a", "left").join(b, "claim_b", "left"), _of(watches, "contradiction"), "sa", "oa", "sb", "ob")
    return rows.select("watch_id", F.concat(F.lit("contradiction:"), "id").alias("dedup_key"), F.concat("type", F.lit(" between claims "), "claim_a", F.lit(" and "), "claim_b").alias("message"))


def unseen(fired: DataFrame, stored: DataFrame) -> DataFrame:
    """One alert for each watch and key, none that is stored."""
    once = fired.groupBy("watch_id", "dedup_key").agg(F.min("message").alias("message"))
    return once.join(stored.select("watch_id", "dedup_key"), ["watch_id", "dedup_key"], "left_anti")


def run_alerts(claims: DataFrame, entities: DataFrame, contradictions: DataFrame, watches: DataFrame, stored: DataFrame, predicate: str = "OWNS") -> DataFrame:
    """All rules; a watch of another kind fires nothing."""
    fired = stake_threshold(claims, entities, watches, predicate).unionByName(new_claim(claims, entities, watches)).unionByName(contradiction(contradictions, claims, watches))
    return unseen(fired, stored)
