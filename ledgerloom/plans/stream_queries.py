"""Registered queries of the streaming jobs and the chain, which run over files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import alerts
from ..operators.components import checkpoint_root, cut
from ..sources.store import Store
from ..streaming import ingest
from . import pipeline as chain
from . import text_queries, views as V
from .ledger_queries import ALERT, AS_OF, DAY, STORED, _contra, _with


def stream_ingest(spark, d):
    """Documents stored once each by a stream that takes all there is, as many as are distinct."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    V.documents(spark, d).drop("content_hash").write.parquet(f"{root}/in")
    ingest.ingest_documents(spark, f"{root}/in", "id long, source_id string, text string, doc_type string", f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def stream_alerts(spark, d):
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    c = V.claims(spark, d)
    c.write.parquet(f"{root}/in")
    ingest.alert_stream(spark.readStream.schema(c.schema).parquet(f"{root}/in"), V.entities(spark, d), V.watches(spark), f"{root}/out", f"{root}/state", "click")
    return spark.read.parquet(f"{root}/out")


_chained: dict[tuple[str, str], Store] = {}


def chain_store(spark, d) -> Store:
    """A ledger of filings without mentions or evidence, and of the events' claims and entities, after the chain has run; one for each application and folder."""
    key = spark.sparkContext.applicationId, d
    if key in _chained:
        return _chained[key]
    store = _chained[key] = Store(spark, f"{checkpoint_root(spark)}/ledger-{uuid.uuid4().hex}")
    store.append("document", text_queries.with_meta(spark, d).withColumn("doc_type", F.lit("SC 13D")).withColumn("source_id", F.lit("covers")).withColumn("content_hash", F.sha2("text", 256)))
    store.append("claim", V.claims(spark, d).withColumn("extractor", F.lit("events@1")))
    store.append("entity", V.entities(spark, d))
    chain.run_chain(store, works=V.works(spark, d), pack="all", on=DAY, at=AS_OF)
    return store


def chain_log(spark, d):
    log = chain_store(spark, d).read("run_log")
    return log.select("stage", "status", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


def ledger_after_chain(spark, d):
    """The claims that the rules wrote, by the ciks of their ends, with the evidence that pins them."""
    s = chain_store(spark, d)
    cik = s.read("entity").select("id", F.expr("external_ids['cik']").alias("cik"))
    c = s.read("claim").filter(F.col("extractor") == chain.RULES).join(s.read("evidence").select(F.col("claim_id").alias("id"), "document_id", "snippet"), "id")
    c = c.join(cik.toDF("subject_id", "subject_cik"), "subject_id").join(cik.toDF("object_id", "object_cik"), "object_id")
    return c.select("document_id", "subject_cik", "predicate", "object_cik", "stake_pct", F.col("valid_from").cast("string").alias("valid_from"), F.col("superseded_by").isNotNull().alias("superseded"), "snippet")


def science_after_chain(spark, d):
    """The claims that works wrote, by the ids that works give their ends."""
    s = chain_store(spark, d)
    name = s.read("entity").select("id", F.expr("external_ids['work_id']").alias("name"))
    c = s.read("claim").filter(F.col("extractor") == chain.WORKS)
    return c.join(name.toDF("subject_id", "subject"), "subject_id").join(name.toDF("object_id", "object"), "object_id").groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n"))


def alerts_stored(spark, d):
    """The latest of the alerts that a run stored, by the time of the claim that fired them."""
    fired_ = cut(alerts.stake_threshold(V.claims(spark, d), V.entities(spark, d), V.watches(spark), "click"))
    at = V.claims(spark, d).select(F.concat(F.lit("claim:"), "id").alias("dedup_key"), F.col("asserted_at").alias("fired_at"))
    return fired_.join(at, "dedup_key").orderBy(F.desc("fired_at"), F.desc("dedup_key")).limit(50).select("watch_id", "dedup_key", "fired_at")


def stream_counts(spark, d):
    """Claims by predicate and day from a stream; only days that the watermark has passed are closed, so a last late row closes them all."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    c = V.claims(spark, d).select("asserted_at", "predicate").withColumn("asserted_at", F.col("asserted_at").cast("timestamp"))
    c.coalesce(1).write.parquet(f"{root}/in")
    for day in ("2099-01-01 00:00:00", "2099-02-01 00:00:00"):
        spark.createDataFrame([(day, "end")], "at string, predicate string").select(F.col("at").cast("timestamp").alias("asserted_at"), "predicate").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    ingest.event_counts(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").filter("predicate <> 'end'").select(F.col("start").cast("date").cast("string").alias("day"), "predicate", "n")


def stream_dedup(spark, d):
    """Documents of a stream once each, by source."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    docs = V.documents(spark, d).select("id", "source_id", "text").withColumn("retrieved_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    docs.write.parquet(f"{root}/in")
    out = ingest.dedup_stream(spark.readStream.schema(docs.schema).parquet(f"{root}/in"))
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


RULED = f"""{text_queries.SCORED}, best as (select id, arg_max(value, (score, -start)) as value, arg_max(substr(text, start + 1, "end" - start), (score, -start)) as quote from scored where round(score, 4) > 0 group by 1),
said as (select c.id, f.cik, coalesce(b.value, null) as value, coalesce(b.quote, c.issuer_name) as quote, c.event_date from cover c left join best b using (id), lateral (select cast(c.id % 50 as varchar) as cik union all select cast(c.id % 70 as varchar)) f)"""


Q = {
    "stream_ingest_available_now": (stream_ingest, f"with {V.DOCUMENTS} select source_id, count(distinct content_hash) as n from document group by 1"),
    "stream_alerts": (stream_alerts, f"{_with(V.CLAIMS, V.RECONCILED, V.ENTITIES, V.WATCHES, _contra('reconciled'), STORED, ALERT)} from stake union all from fresh"),
    "pipeline_log": (chain_log, None),
    "ledger_after_chain": (ledger_after_chain, f"{_with(RULED)} select id as document_id, cik as subject_cik, 'OWNS' as predicate, cast(id as varchar) as object_cik, value as stake_pct, cast(event_date as varchar) as valid_from, false as superseded, quote as snippet from said"),
    "science_after_chain": (science_after_chain, f"{_with(text_queries.WORKS)} select subject, predicate, object, count(*) as n from said group by all"),
    "latest_alerts": (alerts_stored, f"{_with(V.CLAIMS, V.RECONCILED, V.ENTITIES, V.WATCHES, _contra('reconciled'), STORED, ALERT)} select watch_id, dedup_key, asserted_at as fired_at from stake join claim c on dedup_key = 'claim:' || c.id order by asserted_at desc, dedup_key desc limit 50"),
    "stream_event_counts": (stream_counts, f"{_with(V.CLAIMS)} select cast(cast(asserted_at as date) as varchar) as day, predicate, count(*) as n from claim group by all"),
    "stream_dedup": (stream_dedup, f"with {V.DOCUMENTS} select source_id, count(distinct content_hash) as n from document group by 1"),
}
