"""Registered queries of the ledger, the alerts, the write path and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts, extract, ingest, ledger
from ..operators.components import cut
from . import views as V

AS_OF, DAY = "2024-01-15 00:00:00", "2024-01-20"
COLS = "id, subject_id, predicate, object_id, stake_pct, valid_from, valid_to, asserted_at, retracted_at, polarity"
_COLS = COLS.split(", ")


def _with(*parts: str) -> str:
    return "with " + ",\n".join(parts)


def current_stake_after_supersession(spark, d):
    """Who holds what on DAY once supersession is reconciled, with names."""
    c = ledger.claims_asof(ledger.reconcile(V.claims(spark, d)), on=DAY)
    n = V.entities(spark, d).select("id", "canonical_name")
    return c.join(n.toDF("subject_id", "holder"), "subject_id").join(n.toDF("object_id", "issuer"), "object_id").select("id", "holder", "issuer", "predicate", "stake_pct", "valid_from", "valid_to")


VALID = f"(valid_from is null or valid_from <= date '{DAY}') and (valid_to is null or valid_to >= date '{DAY}')"
BELIEVED = f"asserted_at <= timestamp '{AS_OF}' and (retracted_at is null or retracted_at > timestamp '{AS_OF}')"


def retractions(spark, d):
    return V.claims(spark, d).filter("id % 5 = 0").select(F.col("id").alias("claim_id"), (F.col("asserted_at") + F.expr("interval 1 day")).alias("when"))


def successions(spark, d):
    return V.claims(spark, d).filter("id % 11 = 0").select(F.col("id").alias("old_id"), (F.col("id") + 1).alias("new_id"), (F.col("asserted_at") + F.expr("interval 2 days")).alias("at"))


def stored_contradictions(spark, d):
    """(id, claim_a, claim_b, type, status) after reconciling; every third is resolved."""
    c = ledger.contradictions(ledger.reconcile(V.claims(spark, d)))
    return c.select((F.col("claim_a") * 1000000 + F.col("claim_b")).alias("id"), "claim_a", "claim_b", "type", F.when((F.col("claim_a") + F.col("claim_b")) % 3 == 0, "resolved").otherwise("open").alias("status"))


def _contra(source: str, extra: str = "true") -> str:
    return f"""contra as (select a.id as claim_a, b.id as claim_b, case when a.polarity <> b.polarity then 'polarity_conflict' else 'value_conflict' end as type
from {source} a join {source} b on a.subject_id = b.subject_id and a.predicate = b.predicate and a.object_id = b.object_id and a.id < b.id
where a.retracted_at is null and b.retracted_at is null and a.superseded_by is null and b.superseded_by is null and (a.polarity <> b.polarity or a.stake_pct is distinct from b.stake_pct)
and not (coalesce(a.valid_to <= b.valid_from, false) or coalesce(b.valid_to <= a.valid_from, false)) and {extra})"""


STORED = "stored as (select claim_a * 1000000 + claim_b as id, claim_a, claim_b, type, case when (claim_a + claim_b) % 3 = 0 then 'resolved' else 'open' end as status from contra)"


def claim_dict(spark, d):
    c, e = V.claims(spark, d), V.evidence(spark, d)
    out = ledger.claim_dict(c, V.entities(spark, d), e)
    return out.select("id", "subject_name", "predicate", "object_name", F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["document_id"], x["char_start"], x["char_end"])), ",").alias("evidence"))


def entity_profile(spark, d):
    e = V.entities(spark, d)
    n = ledger.claim_counts(V.claims(spark, d))
    return e.join(n, e["id"] == n["entity_id"], "left").select("id", "type", "canonical_name", F.coalesce("n", F.lit(0)).alias("n_claims"))


def version_asof(spark, d):
    c = ledger.reconcile(V.claims(spark, d))
    ev = c.select(*ledger.CHAIN, F.date_add("valid_from", 3).alias("day")).distinct()
    return ledger.claim_version_asof(ev, c.filter("retracted_at is null"))


def _writes(spark, d):
    c = V.documents(spark, d).select("id", F.lit("OWNS").alias("predicate"), F.when(F.col("id") % 5 != 0, "rule@1").alias("extractor"))
    return ledger.write_claims(c, V.evidence(spark, d).filter("claim_id % 11 <> 0"), V.documents(spark, d))


def unprocessed_documents(spark, d):
    done = V.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    return ingest.unprocessed(V.documents(spark, d), done, doc_type="text").select("id", "source_id")


def fired(spark, d):
    cut_claims = V.claims(spark, d)
    return alerts.run_alerts(cut_claims, V.entities(spark, d), stored_contradictions(spark, d), V.watches(spark), spark.createDataFrame([], "watch_id long, dedup_key string"), predicate="click")


def alerts_dedupe(spark, d):
    """A second run over what the first stored, but for its claims with an even last digit."""
    a = cut(fired(spark, d))
    return alerts.unseen(a, a.filter("not dedup_key rlike '[02468]$'"))


NAMED = "coalesce(e.canonical_name, {0}, '?')"
ALERT = """stake as (select w.id as watch_id, 'claim:' || c.id as dedup_key, coalesce(s.canonical_name, c.subject_id, '?') || ' holds ' || c.stake_pct || '% of ' || coalesce(o.canonical_name, c.object_id, '?') || ' (>= ' || w.threshold || '%)' as message
  from claim c join watch w on w.kind = 'stake_threshold' and (w.target is null or w.target = c.object_id) and c.stake_pct >= w.threshold left join entity s on s.id = c.subject_id left join entity o on o.id = c.object_id where c.retracted_at is null and c.predicate = 'click'),
fresh as (select w.id as watch_id, 'claim:' || c.id as dedup_key, coalesce(s.canonical_name, c.subject_id, '?') || ' ' || c.predicate || ' ' || coalesce(o.canonical_name, c.object_id, '?') as message
  from claim c join watch w on w.kind = 'new_claim' and (w.target is null or w.target in (c.subject_id, c.object_id)) left join entity s on s.id = c.subject_id left join entity o on o.id = c.object_id where c.retracted_at is null),
clash as (select w.id as watch_id, 'contradiction:' || t.id as dedup_key, t.type || ' between claims ' || t.claim_a || ' and ' || t.claim_b as message
  from stored t join claim a on a.id = t.claim_a join claim b on b.id = t.claim_b join watch w on w.kind = 'contradiction' and (w.target is null or w.target in (a.subject_id, a.object_id, b.subject_id, b.object_id)) where t.status = 'open')"""


def document_dedupe(spark, d):
    return ingest.first_of_each(V.documents(spark, d)).select("id", "source_id", "content_hash")


def top_suggestions(spark, d):
    c = stored_contradictions(spark, d)
    return c.filter("status = 'open'").orderBy(F.desc("id")).limit(100)


def evidence_verify(spark, d):
    return ledger.verify_evidence(V.evidence(spark, d), V.documents(spark, d)).select("claim_id", "char_start", "char_end", "snippet", "ok")


VERIFY = """verified as (select e.*, case when e.char_start < 0 or e.char_end < e.char_start then 'bad span' when d.text is null then 'no text' when substr(d.text, e.char_start + 1, e.char_end - e.char_start) <> e.snippet then 'snippet differs' end as reason
  from evidence e left join document d on d.id = e.document_id)"""
WRITES = V.EVIDENCE + ", " + VERIFY + """, by_claim as (select claim_id, count(*) as n, min(reason) as why from verified where claim_id % 11 <> 0 group by 1),
judged as (select d.id, case when b.n is null then 'no evidence' when d.id % 5 = 0 then 'no extractor' else b.why end as reason from document d left join by_claim b on b.claim_id = d.id)"""


def valid_vocabulary(spark, d):
    c = V.claims(spark, d).select(F.upper("predicate").alias("predicate")).unionByName(spark.createDataFrame([(p,) for p in ("OWNS", "CITES", "FILED")], "predicate string"))
    return c.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.col("predicate").isin(extract.PREDICATES))


Q = {
    "current_stake_after_supersession": (current_stake_after_supersession, f"{_with(V.CLAIMS, V.RECONCILED, V.ENTITIES)} select r.id, s.canonical_name as holder, o.canonical_name as issuer, r.predicate, r.stake_pct, r.valid_from, r.valid_to from reconciled r join entity s on s.id = r.subject_id join entity o on o.id = r.object_id where r.retracted_at is null and {VALID}"),
    "claims_asof_tx": (lambda s, d: ledger.claims_asof(V.claims(s, d), as_of=AS_OF).select(*_COLS), f"{_with(V.CLAIMS)} select {COLS} from claim where {BELIEVED}"),
    "claims_valid_on": (lambda s, d: ledger.claims_asof(ledger.reconcile(V.claims(s, d)), on=DAY).select(*_COLS), f"{_with(V.CLAIMS, V.RECONCILED)} select {COLS} from reconciled where retracted_at is null and {VALID}"),
    "claims_bitemporal": (lambda s, d: ledger.claims_asof(ledger.reconcile(V.claims(s, d)), as_of=AS_OF, on=DAY, predicate="click").select(*_COLS), f"{_with(V.CLAIMS, V.RECONCILED)} select {COLS} from reconciled where {BELIEVED} and {VALID} and predicate = 'click'"),
    "knowledge_diff": (lambda s, d: ledger.knowledge_diff(V.claims(s, d), "2024-01-10 00:00:00", AS_OF).select(*_COLS, "change"), f"{_with(V.CLAIMS)} select {COLS}, 'asserted' as change from claim where asserted_at between timestamp '2024-01-10' and timestamp '{AS_OF}' union all select {COLS}, 'retracted' from claim where retracted_at between timestamp '2024-01-10' and timestamp '{AS_OF}'"),
    "timeline_owns": (lambda s, d: ledger.timeline(V.claims(s, d), "PER_000008", "click").select(*_COLS), f"{_with(V.CLAIMS)} select {COLS} from claim where retracted_at is null and subject_id = 'PER_000008' and predicate = 'click' order by valid_from nulls last, asserted_at, id"),
    "supersession_links": (lambda s, d: ledger.supersession_links(V.claims(s, d)).select("id", "next_id", "next_from"), f"{_with(V.CLAIMS, V.RECONCILED)} select id, next_id, next_from from link"),
    "supersession_summary": (lambda s, d: ledger.supersession_summary(V.claims(s, d)), f"{_with(V.CLAIMS, V.RECONCILED)} select count(distinct (c.subject_id, c.predicate, c.object_id)) as chains, cast(count(*) as bigint) as claims_superseded from link join claim c using (id)"),
    "contradictions_raw": (lambda s, d: ledger.contradictions(V.claims(s, d)), f"{_with(V.CLAIMS, _contra('claim'))} select * from contra"),
    "contradictions_reconciled": (lambda s, d: ledger.contradictions(ledger.reconcile(V.claims(s, d))), f"{_with(V.CLAIMS, V.RECONCILED, _contra('reconciled'))} select * from contra"),
    "contradictions_materialize": (lambda s, d: ledger.new_contradictions(ledger.contradictions(ledger.reconcile(V.claims(s, d))), stored_contradictions(s, d).filter("status = 'resolved'").select(F.col("claim_b").alias("claim_a"), F.col("claim_a").alias("claim_b"))), f"{_with(V.CLAIMS, V.RECONCILED, _contra('reconciled'))} select * from contra where (claim_a + claim_b) % 3 <> 0"),
    "retract_claims": (lambda s, d: ledger.retract(V.claims(s, d), retractions(s, d)).select("id", "retracted_at"), f"{_with(V.CLAIMS)} select id, coalesce(retracted_at, case when id % 5 = 0 then asserted_at + interval 1 day end) as retracted_at from claim"),
    "supersede_claim": (lambda s, d: ledger.supersede(V.claims(s, d), successions(s, d)).select("id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"), "retracted_at"), f"{_with(V.CLAIMS)} select id, case when id % 11 = 0 then id + 1 else -1 end as superseded_by, coalesce(retracted_at, case when id % 11 = 0 then asserted_at + interval 2 day end) as retracted_at from claim"),
    "claim_version_asof": (version_asof, f"{_with(V.CLAIMS, V.RECONCILED)}, ev as (select distinct subject_id, predicate, object_id, cast(valid_from + interval 3 day as date) as day from reconciled) select ev.*, arg_max(r.id, (r.valid_from, r.id)) as claim_id from ev join reconciled r using (subject_id, predicate, object_id) where r.retracted_at is null and r.valid_from <= ev.day and (r.valid_to is null or r.valid_to >= ev.day) group by all"),
    "claim_dict": (claim_dict, f"{_with(V.CLAIMS, V.ENTITIES, V.EVIDENCE)} select c.id, s.canonical_name as subject_name, c.predicate, o.canonical_name as object_name, coalesce(e.document_id || ':' || e.char_start || ':' || e.char_end, '') as evidence from claim c left join entity s on s.id = c.subject_id left join entity o on o.id = c.object_id left join evidence e on e.claim_id = c.id"),
    "entity_profile": (entity_profile, f"{_with(V.CLAIMS, V.ENTITIES)}, n as (select id, count(*) as n from (select subject_id as id from claim union all select object_id from claim) group by 1) select id, type, canonical_name, coalesce(n, 0) as n_claims from entity left join n using (id)"),
    "health_counts": (lambda s, d: V.claims(s, d).agg(F.count(F.lit(1)).alias("claims")).crossJoin(V.entities(s, d).agg(F.count(F.lit(1)).alias("entities"))), f"{_with(V.CLAIMS, V.ENTITIES)} select (select count(*) from claim) as claims, (select count(*) from entity) as entities"),
    "document_dedupe": (document_dedupe, f"{_with(V.DOCUMENTS)} select min(id) as id, source_id, content_hash from document group by 2, 3"),
    "ingest_target": (lambda s, d: ingest.ingest_target(V.documents(s, d), 150), f"{_with(V.DOCUMENTS)}, r as (select id, row_number() over (partition by source_id, content_hash order by id) = 1 as new from (select * from document order by id limit 600)), m as (select count(*) as n, max(id) as last from (select id from r where new order by id limit 150)) select count(*) filter (where new) as ingested, count(*) filter (where not new) as skipped from r, m where n < 150 or id <= last"),
    "distinct_document_ids": (lambda s, d: V.evidence(s, d).select("document_id").distinct(), f"{_with(V.EVIDENCE)} select distinct document_id from evidence"),
    "new_sources": (lambda s, d: ingest.sources(s.createDataFrame([("src0",), ("src3",)], "name string"), V.documents(s, d).select(F.col("source_id").alias("name"))), f"{_with(V.DOCUMENTS)} select distinct source_id as name from document where source_id not in ('src0', 'src3')"),
    "evidence_verify": (evidence_verify, f"{_with(V.EVIDENCE, VERIFY)} select claim_id, char_start, char_end, snippet, reason is null as ok from verified"),
    "claims_accepted": (lambda s, d: _writes(s, d)[0].select("id", "predicate"), f"{_with(WRITES)} select id, 'OWNS' as predicate from judged where reason is null"),
    "claim_write_rejects": (lambda s, d: _writes(s, d)[1].select("id", "reason"), f"{_with(WRITES)} select id, reason from judged where reason is not null"),
    "unprocessed_documents": (unprocessed_documents, f"{_with(V.DOCUMENTS)} select id, source_id from document where id not in (select doc_id from labels)"),
    "predicate_vocabulary": (valid_vocabulary, f"{_with(V.CLAIMS)}, p as (select upper(predicate) as predicate from claim union all values ('OWNS'), ('CITES'), ('FILED')) select predicate, count(*) as n, predicate in ('OWNS', 'FILED') as known from p group by 1"),
    "alerts_stake": (lambda s, d: alerts.stake_threshold(V.claims(s, d), V.entities(s, d), V.watches(s), "click"), f"{_with(V.CLAIMS, V.RECONCILED, V.ENTITIES, V.WATCHES, _contra('reconciled'), STORED, ALERT)} select * from stake"),
    "alerts_new_claim": (lambda s, d: alerts.new_claim(V.claims(s, d), V.entities(s, d), V.watches(s)), f"{_with(V.CLAIMS, V.RECONCILED, V.ENTITIES, V.WATCHES, _contra('reconciled'), STORED, ALERT)} select * from fresh"),
    "alerts_contradiction": (lambda s, d: alerts.contradiction(stored_contradictions(s, d), V.claims(s, d), V.watches(s)), f"{_with(V.CLAIMS, V.RECONCILED, V.ENTITIES, V.WATCHES, _contra('reconciled'), STORED, ALERT)} select * from clash"),
    "alerts_all": (fired, f"{_with(V.CLAIMS, V.RECONCILED, V.ENTITIES, V.WATCHES, _contra('reconciled'), STORED, ALERT)} select watch_id, dedup_key, min(message) as message from (from stake union all from fresh union all from clash) group by 1, 2"),
    "alerts_dedupe": (alerts_dedupe, f"{_with(V.CLAIMS, V.RECONCILED, V.ENTITIES, V.WATCHES, _contra('reconciled'), STORED, ALERT)} select watch_id, dedup_key, min(message) as message from (from stake union all from fresh union all from clash) where right(dedup_key, 1) in ('0', '2', '4', '6', '8') group by 1, 2"),
    "open_contradictions_latest": (top_suggestions, f"{_with(V.CLAIMS, V.RECONCILED, _contra('reconciled'), STORED)} select * from stored where status = 'open' order by id desc limit 100"),
}
for _name, _days in {
    "current_stake_after_supersession": ("valid_from", "valid_to"), "claims_asof_tx": ("valid_from", "valid_to"), "claims_valid_on": ("valid_from", "valid_to"), "claims_bitemporal": ("valid_from", "valid_to"), "knowledge_diff": ("valid_from", "valid_to"),
    "timeline_owns": ("valid_from", "valid_to"), "supersession_links": ("next_from",), "claim_version_asof": ("day",),
}.items():
    Q[_name] = V.days_as_text(*Q[_name], *_days)
