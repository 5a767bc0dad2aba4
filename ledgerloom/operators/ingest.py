"""Documents into the ledger: once each, up to a target, and what is still to be processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import first_by


def first_of_each(documents: DataFrame) -> DataFrame:
    """The row of the least id for each (source_id, content_hash)."""
    return first_by(documents, ["source_id", "content_hash"], ["id"])


def new_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return first_of_each(incoming).join(stored.select("source_id", "content_hash").distinct(), ["source_id", "content_hash"], "left_anti")


def ingest_target(incoming: DataFrame, target: int, fetch_cap: int | None = None) -> DataFrame:
    """(ingested, skipped): of the first fetch_cap rows by id (four times target by default), new ones until target, and duplicates before that point."""
    rows = incoming.orderBy("id").limit(4 * target if fetch_cap is None else fetch_cap)
    first = rows.groupBy("source_id", "content_hash").agg(F.min("id").alias("first"))
    marked = rows.join(first, ["source_id", "content_hash"]).withColumn("new", F.col("id") == F.col("first"))
    last = marked.filter("new").orderBy("id").limit(target).agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    upto = marked.crossJoin(F.broadcast(last)).filter((F.col("n") < target) | (F.col("id") <= F.col("last")))
    return upto.agg(F.count_if("new").alias("ingested"), F.count_if(~F.col("new")).alias("skipped"))


def sources(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Names that aren't sources yet."""
    return names.select("name").distinct().join(existing.select("name"), "name", "left_anti")


def unprocessed(documents: DataFrame, done: DataFrame, *, doc_type: str | None = None, limit: int | None = None) -> DataFrame:
    """documents whose id isn't in done (document_id). The limit comes first, as documents are taken in order and then skipped."""
    rows = documents if doc_type is None else documents.filter(F.col("doc_type") == doc_type)
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    return rows.join(done.select("document_id").distinct(), rows["id"] == F.col("document_id"), "left_anti")


def raw_file_name(external_id) -> F.Column:
    return F.concat(F.replace(external_id, F.lit("/"), F.lit("_")), F.lit(".txt"))
