"""Evaluation of resolution, extraction, citations and works against gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import jw
from . import ledger
from .resolve import MERGE, clusters, probabilistic_clusters


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    """(precision, recall, f1), 0 where there is nothing to divide by, to four places."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return F.struct(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def pairwise(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """predicted (a, b), gold (a, b, same): false merges among the different, misses among the same, accuracy over all."""
    key = lambda d: d.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    rows = key(gold).join(key(predicted).select("x", "y", F.lit(True).alias("hit")).distinct(), ["x", "y"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return rates(rows)


def rates(rows: DataFrame) -> DataFrame:
    """rows (same, hit) as (false_merge_rate, missed_merge_rate, accuracy, n)."""
    n = lambda c: F.count_if(c)
    s, h = F.col("same"), F.col("hit")
    return rows.agg(
        F.round(n(~s & h) / F.greatest(n(~s), F.lit(1)), 4).alias("false_merge_rate"), F.round(n(s & ~h) / F.greatest(n(s), F.lit(1)), 4).alias("missed_merge_rate"),
        F.round(n(s == h) / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"),
    )


def isolated_pairs(gold: DataFrame, threshold: float = MERGE) -> DataFrame:
    """gold (a, b, same) of names, each pair resolved alone: one block and similar enough."""
    hit = (text.block_key(F.col("a")) == text.block_key(F.col("b"))) & (jw(text.normalized(F.col("a")), text.normalized(F.col("b"))) >= threshold)
    return rates(gold.withColumn("hit", hit))


def extraction(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """gold (filer_cik, subject_cik, predicate): found where any claim has all three; nothing counts as a false positive."""
    found = claims.select("filer_cik", "subject_cik", "predicate", F.lit(1).alias("hit")).distinct()
    rows = gold.join(found, ["filer_cik", "subject_cik", "predicate"], "left").agg(F.count("hit").alias("tp"), F.count_if(F.col("hit").isNull()).alias("fn"))
    return rows.select("tp", F.lit(0).alias("fp"), "fn", prf(F.col("tp"), F.lit(0), F.col("fn")).alias("m")).select("tp", "fp", "fn", "m.*")


def supports(snippet: Column, stake: Column) -> Column:
    """A number in the snippet is the stake; without a stake there is nothing to support."""
    return stake.isNull() | F.exists(F.regexp_extract_all(snippet, F.lit(r"(\d+\.?\d*)"), F.lit(1)), lambda x: x.cast("double") == stake)


def citation(claims: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Of claims with evidence, how many of the first spans are what their document says there, and how many support the stake."""
    first = evidence.groupBy("claim_id").agg(F.min(F.struct("document_id", "char_start", "char_end", "snippet")).alias("e")).select("claim_id", "e.*")
    rows = ledger.verify_evidence(first, documents).join(claims.select(F.col("id").alias("claim_id"), "stake_pct"), "claim_id").withColumn("supported", supports(F.col("snippet"), F.col("stake_pct")))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("checked"), F.round(ratio(F.count_if("ok"), n), 4).alias("round_trip"), F.round(ratio(F.count_if("supported"), n), 4).alias("supported"))


def science(gold: DataFrame, claims: DataFrame) -> DataFrame:
    """gold (work, expect_author, min_citations) against claims (subject, predicate, object): author found, enough citations."""
    author = claims.filter("predicate = 'AUTHORED'").select(F.col("object").alias("work"), F.col("subject").alias("expect_author"), F.lit(True).alias("has")).distinct()
    cites = claims.filter("predicate = 'CITES'").groupBy(F.col("subject").alias("work")).agg(F.count(F.lit(1)).alias("n_cites"))
    rows = gold.join(author, ["work", "expect_author"], "left").join(cites, "work", "left")
    return rows.select("work", F.coalesce("has", F.lit(False)).alias("author_found"), F.coalesce("n_cites", F.lit(0)).alias("n_cites"), (F.coalesce("n_cites", F.lit(0)) >= F.col("min_citations")).alias("enough"))


def preferred_backend(default: tuple[float, float], other: tuple[float, float]) -> str:
    """(accuracy, false merge rate) of each; the other only if strictly better, first by accuracy."""
    return "probabilistic" if (other[0], -other[1]) > (default[0], -default[1]) else "default"


def joint_rates(gold: DataFrame, backend: str = "default") -> DataFrame:
    """rates of gold (a, b, same) whose names are all resolved together by a backend."""
    pairs = text.numbered(gold.distinct(), ["a", "b", "same"], "n").select((F.col("n") * 2).cast("long").alias("ra"), (F.col("n") * 2 + 1).cast("long").alias("rb"), "a", "b", "same")
    side = lambda r, n: pairs.select(F.col(r).alias("rid"), F.col(n).alias("name"), F.lit("Organization").alias("entity_type"), F.lit(None).cast("string").alias("cik"))
    records = side("ra", "a").unionByName(side("rb", "b"))
    members = (probabilistic_clusters(records, train=False) if backend == "probabilistic" else clusters(records)).select("rid", "cluster")
    rows = pairs.join(members.toDF("ra", "ca"), "ra").join(members.toDF("rb", "cb"), "rb")
    return rates(rows.select("same", (F.col("ca") == F.col("cb")).alias("hit")))


def compare_backends(gold: DataFrame) -> DataFrame:
    """(backend, accuracy, false_merge_rate, missed_merge_rate, recommended); a backend that fails has -1 and is never recommended."""
    found: dict[str, tuple] = {}
    for backend in ("default", "probabilistic"):
        try:
            r = joint_rates(gold, backend).first()
            found[backend] = (r["accuracy"], r["false_merge_rate"], r["missed_merge_rate"])
        except Exception:  # the comparison goes on without it
            found[backend] = (-1.0, 1.0, 1.0)
    best = preferred_backend(found["default"][:2], found["probabilistic"][:2])
    return gold.sparkSession.createDataFrame([(b, *map(float, v), b == best) for b, v in found.items()], "backend string, accuracy double, false_merge_rate double, missed_merge_rate double, recommended boolean")


def evaluate_all(**parts: DataFrame) -> DataFrame:
    """(eval, metrics) of the evaluations that are given as frames of one row, by name, and of er_backends as one metric for each backend's rate."""
    out = None
    for name, df in parts.items():
        if name == "er_backends":
            rows = df.select(F.concat(F.lit("er_backend_"), "backend").alias("eval"), F.create_map(*(x for c in ("accuracy", "false_merge_rate", "missed_merge_rate") for x in (F.lit(c), F.col(c))), F.lit("recommended"), F.col("recommended").cast("double")).alias("metrics"))
        else:
            rows = df.limit(1).select(F.lit(name).alias("eval"), F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(c).cast("double")))).alias("metrics"))
        out = rows if out is None else out.unionByName(rows)
    return out
