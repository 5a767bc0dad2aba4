"""What changes the ledger: verified mentions and claims, entities that claims name, merges, reviews, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import ledger, resolve
from .components import cut


class MergeError(ValueError):
    """A merge of an entity into itself, of one that there isn't, or of two types."""


def verified_mentions(mentions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): the surface is what the document has at its offsets."""
    rows = ledger.verify_evidence(mentions.withColumnRenamed("surface_text", "snippet"), documents).withColumnRenamed("snippet", "surface_text").drop("ok")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def unseen_mentions(mentions: DataFrame, stored: DataFrame) -> DataFrame:
    """Those whose place and kind aren't stored, once each."""
    key = ["document_id", "char_start", "char_end", "ner_type"]
    return mentions.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def next_id(stored: DataFrame, column: str = "id") -> int:
    return (stored.agg(F.max(column)).first()[0] or 0) + 1


def link_or_create(surfaces: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """surfaces (surface, type, cik) as (surface, type, cik, entity_id), and the entities after it.

    A surface with a cik is the entity of that cik, which gains it as an alias or is created; another is the first entity of its type that
    has its core as a name; what is left is created, one entity for each type and core.
    """
    s = cut(surfaces.select("surface", "type", "cik").distinct())
    anchored = s.filter("cik is not null")
    incoming = anchored.select("type", F.col("surface").alias("canonical_name"), F.array("surface").alias("aliases"), F.create_map().cast("map<string,string>").alias("external_ids"), F.lit("cik").alias("namespace"), F.col("cik").alias("value"))
    after = cut(resolve.upsert_entities(entities, incoming))
    by_cik = after.filter("external_ids['cik'] is not null").groupBy(F.expr("external_ids['cik']").alias("cik")).agg(F.min("id").alias("entity_id"))
    bare = s.filter("cik is null").withColumn("core", text.core(F.col("surface")))
    known = cut(bare.join(resolve.name_index(after), ["type", "core"], "left"))
    new = known.filter("by_name is null").groupBy("type", "core").agg(F.min("surface").alias("canonical_name"), F.collect_set("surface").alias("all"))
    top = after.agg(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long"))).first()[0] or 0
    made = cut(text.numbered(new, ["type", "core"], "n").withColumn("id", resolve.entity_id(F.col("type"), F.col("n") + top)))
    rows = made.select("id", "type", "canonical_name", F.array_sort(F.array_remove("all", F.col("canonical_name"))).alias("aliases"), F.create_map().cast("map<string,string>").alias("external_ids"))
    cols = ["surface", "type", "cik", "entity_id"]
    links = anchored.join(by_cik, "cik").select(*cols)
    links = links.unionByName(known.filter("by_name is not null").select("surface", "type", "cik", F.col("by_name").alias("entity_id")))
    links = links.unionByName(known.filter("by_name is null").join(made.select("type", "core", F.col("id").alias("entity_id")), ["type", "core"]).select(*cols))
    return links, after.unionByName(rows)


def named_claims(grounded: DataFrame, ciks: DataFrame) -> DataFrame:
    """grounded claims with the kinds of their ends and the ciks that the header (id, name, cik) gives their surfaces."""
    side = lambda name: ciks.select(F.col("id").alias("document_id"), F.col("name").alias(f"{name}_surface"), F.col("cik").alias(f"{name}_cik"))
    rows = grounded.join(side("subject"), ["document_id", "subject_surface"], "left").join(side("object"), ["document_id", "object_surface"], "left")
    return rows.withColumn("subject_type", text.guess_type(F.col("subject_surface"))).withColumn("object_type", F.when(F.col("object_surface").isNotNull(), "Organization"))


def surfaces(named: DataFrame) -> DataFrame:
    side = lambda name: named.select(F.col(f"{name}_surface").alias("surface"), F.col(f"{name}_type").alias("type"), F.col(f"{name}_cik").alias("cik")).filter("surface is not null")
    return side("subject").unionByName(side("object"))


def linked(named: DataFrame, links: DataFrame) -> DataFrame:
    """named claims with subject_id and object_id."""
    for name in ("subject", "object"):
        side = links.select(F.col("surface").alias("_s"), F.col("type").alias("_t"), F.col("cik").alias("_c"), F.col("entity_id").alias(f"{name}_id"))
        named = named.join(side, (named[f"{name}_surface"] == side["_s"]) & (named[f"{name}_type"] == side["_t"]) & named[f"{name}_cik"].eqNullSafe(side["_c"]), "left").drop("_s", "_t", "_c")
    return named


def as_claims(rows: DataFrame, first: int, *, extractor: str, method: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """rows (document_id, subject_id, predicate, object_id, stake_pct, valid_from, confidence, span) as claims and evidence; ids from first on."""
    n = cut(text.numbered(rows, ["document_id", "predicate", "subject_id", "object_id", "span.start"], "_n").withColumn("id", F.col("_n").cast("long") + (first - 1)))
    stake = F.when(F.col("stake_pct").isNotNull(), F.to_json(F.struct("stake_pct"))).otherwise(F.lit("{}"))
    claims = n.select("id", "subject_id", "predicate", "object_id", F.lit(None).cast("string").alias("object_literal"), "stake_pct", stake.alias("qualifiers"), "valid_from", F.lit(None).cast("date").alias("valid_to"), at.alias("asserted_at"), F.lit(None).cast("timestamp_ntz").alias("retracted_at"), F.lit(None).cast("long").alias("superseded_by"), F.lit("asserted").alias("polarity"), "confidence", F.lit(extractor).alias("extractor"))
    return claims, n.select(F.col("id").alias("claim_id"), "document_id", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"), F.col("span.snippet").alias("snippet"), F.lit(method).alias("method"), F.lit(extractor).alias("extractor"))


def judged_merges(merges: DataFrame, entities: DataFrame, *, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sound, unsound with reason) of merges (keep, drop). A dropped entity goes to one keeper, and neither is dropped or kept by the other way about."""
    e = entities.select("id", "type")
    rows = merges.dropDuplicates(["drop"]).join(e.toDF("keep", "_k"), "keep", "left").join(e.toDF("drop", "_d"), "drop", "left")
    chain = merges.filter("keep <> drop").select(F.col("drop").alias("keep"), F.lit(True).alias("_chain")).distinct()
    rows = rows.join(chain, "keep", "left")
    reason = F.when(F.col("keep") == F.col("drop"), "into itself").when(F.col("_k").isNull() | F.col("_d").isNull(), "not found").when(F.col("_k") != F.col("_d"), "type mismatch").when(F.col("_chain"), "keeper is dropped too")
    rows = rows.select("keep", "drop", reason.alias("reason"))
    if strict and (bad := rows.filter("reason is not null").first()):
        raise MergeError(f"{bad['drop']} into {bad['keep']}: {bad['reason']}")
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def merge_log(sound: DataFrame, entities: DataFrame, claims: DataFrame, mentions: DataFrame) -> DataFrame:
    """(kept_id, dropped_id, dropped_name, claims_repointed, mentions_repointed): an end of a claim counts once each."""
    ends = claims.select(F.explode(F.array("subject_id", "object_id")).alias("drop")).groupBy("drop").agg(F.count(F.lit(1)).alias("c"))
    seen = mentions.groupBy(F.col("resolved_to").alias("drop")).agg(F.count(F.lit(1)).alias("m"))
    rows = sound.join(entities.select(F.col("id").alias("drop"), "canonical_name"), "drop").join(ends, "drop", "left").join(seen, "drop", "left")
    return rows.select(F.col("keep").alias("kept_id"), F.col("drop").alias("dropped_id"), F.col("canonical_name").alias("dropped_name"), F.coalesce("c", F.lit(0)).alias("claims_repointed"), F.coalesce("m", F.lit(0)).alias("mentions_repointed"))


def decision_of(suggested: DataFrame, entities: DataFrame, decision: str) -> DataFrame:
    """(key_a, key_b, decision) for the cores of a suggestion's names."""
    n = entities.select("id", text.core(F.col("canonical_name")).alias("core"))
    rows = suggested.join(n.toDF("entity_a", "a"), "entity_a").join(n.toDF("entity_b", "b"), "entity_b")
    return rows.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"), F.lit(decision).alias("decision")).distinct()


def decided(suggestions: DataFrame, idents: list[int], status: str, at: Column) -> DataFrame:
    hit = F.col("id").isin(idents)
    return suggestions.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("decided_at", F.when(hit, at).otherwise(F.col("decided_at")))


def upsert_vectors(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(id, vid, text, embedding): of an id the new row stands; vid is the number that the id always has."""
    from .vectors import stable_id

    rows = new.dropDuplicates(["id"]).select("id", stable_id(F.col("id")).alias("vid"), "text", "embedding")
    return stored.select("id", "vid", "text", "embedding").join(rows.select("id"), "id", "left_anti").unionByName(rows)
