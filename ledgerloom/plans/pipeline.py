"""The processing chain over the stored ledger: each stage writes what it makes and is logged, and none that fails stops the others."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract, graph, ingest, ledger, resolve, vectors, write
from ..operators.components import cut
from ..sources.store import Store

LOG = "stage string, status string, counts map<string,long>, duration_ms long, error string"
RULES, WORKS = "rules@1", "works@1"


def code_version() -> str | None:
    """The commit of the engine's own files, where they are in a repository."""
    try:
        return subprocess.run(["git", "-C", os.path.dirname(os.path.abspath(__file__)), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5).stdout.strip() or None
    except OSError:
        return None


def record(log: list, stage: str, run: Callable[[], dict[str, int]]) -> None:
    began = time.monotonic()
    try:
        counts, status, error = run(), "ok", None
    except Exception as e:  # a stage may fail in any way; the log says how
        counts, status, error = {}, "error", f"{type(e).__name__}: {e}"[:2000]
    log.append((stage, status, {k: int(v) for k, v in counts.items()}, int((time.monotonic() - began) * 1000), error))


def write_mentions(store: Store, found: DataFrame) -> dict[str, int]:
    """Append the mentions that hold and aren't stored."""
    stored, found = store.read("mention"), cut(found)
    good, bad = write.verified_mentions(found, store.read("document"))
    first = write.next_id(stored)
    new = cut(text.numbered(write.unseen_mentions(good, stored), ["document_id", "char_start", "char_end", "ner_type"], "_n").withColumn("id", F.col("_n").cast("long") + (first - 1)))
    store.append("mention", new)
    return {"mentions": new.count(), "rejected": bad.count()}


def run_mentions(store: Store, *, limit: int | None = None, find: Callable[[DataFrame], DataFrame] = extract.rule_mentions) -> dict[str, int]:
    """Mentions of the filings that have none yet."""
    filings = store.read("document").filter("doc_type <> 'work'")
    return write_mentions(store, find(ingest.unprocessed(filings, store.read("mention"), limit=limit)))


def run_resolution(store: Store, *, backend: str = "default") -> dict[str, int]:
    """Entities of all records, and mentions filled back with their entity; what was filled in before is overwritten."""
    mentions, entities = store.read("mention"), store.read("entity")
    rec = resolve.header_records(store.read("document").filter("doc_type <> 'work'"), mentions)
    rec = cut(text.numbered(rec, ["rank", "doc", "pos", "name", "mention_id"], "rid"))
    after, links = resolve.materialize(rec, entities, store.read("er_decision"), backend=backend)
    links = cut(links.join(rec.select("rid", "mention_id"), "rid"))
    filled = links.filter("mention_id is not null").select(F.col("mention_id").alias("id"), F.col("entity_id").alias("_to"), F.col("confidence").alias("_sure"))
    store.replace("entity", cut(after))
    store.replace("mention", mentions.join(filled, "id", "left").withColumn("resolved_to", F.coalesce("_to", "resolved_to")).withColumn("resolution_confidence", F.coalesce("_sure", "resolution_confidence")))
    n = links.agg(F.count(F.lit(1)), F.countDistinct("entity_id"), F.count("mention_id")).first()
    return {"records": n[0], "entities": n[1], "mentions_resolved": n[2]}


def write_extracted(store: Store, claims: DataFrame, *, extractor: str, method: str, at: str) -> dict[str, int]:
    """Ground, link and append extracted claims; those whose predicate, quote or offsets don't hold are left out."""
    docs = store.read("document")
    good = cut(extract.grounded(claims, docs))
    named = cut(write.named_claims(good, resolve.header_cik_lookup(docs.filter("meta is not null"))))
    links, after = write.link_or_create(write.surfaces(named), store.read("entity"))
    rows = write.linked(named, cut(links))
    new, evidence = write.as_claims(rows, write.next_id(store.read("claim")), extractor=extractor, method=method, at=F.lit(at).cast("timestamp_ntz"))
    accepted, rejected = ledger.write_claims(new, evidence, docs)
    store.replace("entity", cut(after))
    accepted = cut(accepted)
    store.append("claim", accepted)
    store.append("evidence", evidence.join(accepted.select(F.col("id").alias("claim_id")), "claim_id", "left_semi"))
    return {"claims": accepted.count(), "rejected": rejected.count()}


def run_claims(store: Store, *, at: str, limit: int | None = None, model: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Claims by rules, and by a model where one is given, of the filings without evidence by that extractor."""
    out: dict[str, int] = {}
    for name, make in (("rules", lambda d: extract.rule_claims(extract.parse_filing(d))), ("model", model)):
        if make is not None:
            extractor = RULES if name == "rules" else "model@1"
            done = store.read("evidence").filter(F.col("extractor") == extractor)
            found = make(ingest.unprocessed(store.read("document").filter("doc_type <> 'work'"), done, limit=limit))
            for c, kind in (("stake_pct", "double"), ("valid_from", "date")):
                found = found if c in found.columns else found.withColumn(c, F.lit(None).cast(kind))
            for k, v in write_extracted(store, found, extractor=extractor, method=name, at=at).items():
                out[k] = out.get(k, 0) + v
    return out


def run_science(store: Store, works: DataFrame, *, at: str) -> dict[str, int]:
    """Claims of the works that have no evidence yet, which become documents; their ends are entities of the ids that works give them."""
    rendered = cut(extract.render_works(works))
    known = store.read("document").filter("doc_type = 'work'").select(F.col("source_id").alias("work"))
    fresh = rendered.join(known, rendered["id"] == known["work"], "left_anti")
    docs = cut(text.numbered(fresh, ["id"], "_n").withColumn("doc", F.col("_n").cast("long") + (write.next_id(store.read("document")) - 1)))
    store.append("document", docs.select(F.col("doc").alias("id"), F.col("id").alias("source_id"), F.sha2("text", 256).alias("content_hash"), "text", F.lit("work").alias("doc_type")))
    said = cut(extract.work_claims(docs.drop("_n", "doc")).join(docs.select(F.col("id").alias("document_id"), "doc"), "document_id"))
    kinds = {"AUTHORED": ("Author", "Paper"), "AFFILIATED_WITH": ("Author", "Institution"), "MENTIONS_CONCEPT": ("Paper", "Concept"), "CITES": ("Paper", "Paper")}
    ends = None
    for predicate, pair in kinds.items():
        for column, kind in zip(("subject", "object"), pair):
            part = said.filter(F.col("predicate") == predicate).select(F.col(column).alias("value"), F.lit(kind).alias("type"))
            ends = part if ends is None else ends.unionByName(part)
    empty = F.array().cast("array<string>")
    incoming = ends.distinct().select("type", F.col("value").alias("canonical_name"), empty.alias("aliases"), F.create_map().cast("map<string,string>").alias("external_ids"), F.lit("work_id").alias("namespace"), "value")
    after = cut(resolve.upsert_entities(store.read("entity"), incoming))
    anchor = after.filter("external_ids['work_id'] is not null").groupBy(F.expr("external_ids['work_id']").alias("value")).agg(F.min("id").alias("id"))
    rows = said.join(anchor.toDF("subject", "subject_id"), "subject").join(anchor.toDF("object", "object_id"), "object")
    rows = rows.select(F.col("doc").alias("document_id"), "subject_id", "predicate", "object_id", F.lit(None).cast("double").alias("stake_pct"), "valid_from", F.lit(1.0).alias("confidence"), F.struct("start", "end", F.col("quote").alias("snippet")).alias("span"))
    new, evidence = write.as_claims(rows, write.next_id(store.read("claim")), extractor=WORKS, method="structured", at=F.lit(at).cast("timestamp_ntz"))
    accepted, rejected = ledger.write_claims(new, evidence, store.read("document"))
    accepted = cut(accepted)
    store.replace("entity", after)
    store.append("claim", accepted)
    store.append("evidence", evidence.join(accepted.select(F.col("id").alias("claim_id")), "claim_id", "left_semi"))
    return {"documents": docs.count(), "claims": accepted.count(), "rejected": rejected.count()}


def run_supersession(store: Store) -> dict[str, int]:
    claims = store.read("claim")
    n = ledger.supersession_summary(claims).first()
    store.replace("claim", ledger.reconcile(claims))
    return {"chains": n["chains"], "claims_superseded": n["claims_superseded"]}


def run_contradictions(store: Store) -> dict[str, int]:
    """Append the pairs that aren't stored in any status, as open."""
    stored = store.read("contradiction")
    new = text.numbered(ledger.new_contradictions(ledger.contradictions(store.read("claim")), stored), ["claim_a", "claim_b"], "_n")
    new = cut(new.withColumn("id", F.col("_n").cast("long") + (write.next_id(stored) - 1)).withColumn("status", F.lit("open")))
    store.append("contradiction", new)
    inserted = new.count()
    return {"inserted": inserted, "total_open_pairs": store.read("contradiction").count()}


def run_vectors(store: Store, make=vectors.hashed_embedder, *, only_missing: bool = True) -> dict[str, int]:
    stored, entities = store.read("vector"), store.read("entity")
    todo = entities.join(stored.select("id"), "id", "left_anti") if only_missing else entities
    new = cut(vectors.build_entity_vectors(todo, make, only_missing=False))
    store.replace("vector", write.upsert_vectors(stored, new))
    return {"vectors": new.count()}


def run_graph(store: Store, *, on: str) -> dict[str, int]:
    nodes, edges = graph.project(store.read("claim"), store.read("entity"), store.read("evidence"), on=on)
    return {"nodes": nodes.count(), "edges": edges.count()}


def run_chain(store: Store, *, pack: str = "all", on: str, at: str, works: DataFrame | None = None, backend: str = "default", embedder=vectors.hashed_embedder) -> DataFrame:
    """The log of the stages, which is appended to run_log too. pack: a for filings, b for works, or all; on: the day of the graph; at: when claims are asserted.

    A second run over the same documents adds no mention, claim, contradiction or vector.
    """
    log: list = []
    if pack in ("a", "all"):
        record(log, "mentions", lambda: run_mentions(store))
        record(log, "resolve", lambda: run_resolution(store, backend=backend))
        record(log, "claims", lambda: run_claims(store, at=at))
    if pack in ("b", "all") and works is not None:
        record(log, "science", lambda: run_science(store, works, at=at))
    record(log, "supersede", lambda: run_supersession(store))
    record(log, "contradictions", lambda: run_contradictions(store))
    record(log, "vectors", lambda: run_vectors(store, embedder))
    record(log, "graph", lambda: run_graph(store, on=on))
    rows = store.spark.createDataFrame(log, LOG)
    store.append("run_log", rows.withColumn("code_version", F.lit(code_version())).withColumn("started_at", F.localtimestamp()))
    return rows


def accept_suggestion(store: Store, ident: int) -> dict[str, int]:
    """Merge a suggestion's entities, the one with more claims staying, and remember that they are one."""
    suggestions, entities, claims, mentions = (store.read(n) for n in ("merge_suggestion", "entity", "claim", "mention"))
    one = suggestions.filter(F.col("id") == ident)
    if one.isEmpty():
        raise ValueError(f"no suggestion {ident}")
    sound, _ = write.judged_merges(resolve.choose_kept(one, ledger.claim_counts(claims)), entities, strict=True)
    sound = cut(sound)
    log = cut(write.merge_log(sound, entities, claims, mentions))
    keys = cut(resolve.record_decisions(store.read("er_decision"), write.decision_of(one, entities, "must_link")))
    store.replace("claim", resolve.repoint(claims, sound, "subject_id", "object_id"))
    store.replace("mention", resolve.repoint(mentions, sound, "resolved_to"))
    store.replace("entity", resolve.merge_entities(entities, sound))
    store.append("merge_log", log)
    store.replace("er_decision", keys)
    store.replace("merge_suggestion", write.decided(suggestions, [ident], "accepted", F.localtimestamp()))
    n = log.first()
    return {"claims_repointed": n["claims_repointed"], "mentions_repointed": n["mentions_repointed"]}


def reject_suggestion(store: Store, ident: int) -> None:
    """Remember that a suggestion's entities are two."""
    suggestions = store.read("merge_suggestion")
    one = suggestions.filter(F.col("id") == ident)
    if one.isEmpty():
        raise ValueError(f"no suggestion {ident}")
    store.replace("er_decision", cut(resolve.record_decisions(store.read("er_decision"), write.decision_of(one, store.read("entity"), "must_not_link"))))
    store.replace("merge_suggestion", write.decided(suggestions, [ident], "rejected", F.localtimestamp()))


def suggest_merges(store: Store, *, limit: int = 100) -> int:
    """Append grey pairs of entities that nobody decided and that aren't suggested yet; how many."""
    e = store.read("entity")
    rec = e.select(F.col("id").alias("rid"), F.col("canonical_name").alias("name"), F.col("type").alias("entity_type"), F.expr("external_ids['cik']").alias("cik"))
    stored = store.read("merge_suggestion")
    new = text.numbered(resolve.suggestions(rec, decisions=store.read("er_decision"), known=stored, limit=limit), ["entity_a", "entity_b"], "_n")
    new = cut(new.withColumn("id", F.col("_n").cast("long") + (write.next_id(stored) - 1)).withColumn("status", F.lit("open")))
    store.append("merge_suggestion", new)
    return new.count()
