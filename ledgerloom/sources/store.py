"""The ledger's tables as Parquet snapshots in one shared folder.

A table's rows are in its newest version that was written whole; appending adds files to it, replacing writes the next version, which may be made
from the one before. A writer that dies leaves no version that counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTIES = "struct<filers:array<struct<name:string,cik:string>>,subject_companies:array<struct<name:string,cik:string>>>"
CLAIM = "id long, subject_id string, predicate string, object_id string, object_literal string, stake_pct double, qualifiers string, valid_from date, valid_to date, asserted_at timestamp_ntz, retracted_at timestamp_ntz, superseded_by long, polarity string, confidence double, extractor string"
EVIDENCE = "claim_id long, document_id long, char_start int, char_end int, snippet string, method string, extractor string"
SCHEMAS = {
    "document": f"id long, source_id string, content_hash string, text string, doc_type string, meta {PARTIES}",
    "mention": "id long, document_id long, surface_text string, char_start int, char_end int, ner_type string, resolved_to string, resolution_confidence double",
    "entity": "id string, type string, canonical_name string, aliases array<string>, external_ids map<string,string>",
    "claim": CLAIM,
    "evidence": EVIDENCE,
    "contradiction": "id long, claim_a long, claim_b long, type string, status string",
    "merge_suggestion": "id long, entity_a string, entity_b string, score double, reason string, status string, decided_at timestamp_ntz",
    "er_decision": "key_a string, key_b string, decision string",
    "merge_log": "kept_id string, dropped_id string, dropped_name string, claims_repointed long, mentions_repointed long",
    "vector": "id string, vid long, text string, embedding array<float>",
    "watch": "id long, kind string, target string, threshold double",
    "alert": "watch_id long, dedup_key string, message string, fired_at timestamp_ntz",
    "run_log": "stage string, status string, counts map<string,long>, duration_ms long, error string, code_version string, started_at timestamp_ntz",
    "eval_run": "eval string, dataset string, metrics map<string,double>, code_version string, run_at timestamp_ntz",
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        found = (str(s.getPath().getName()) for s in fs.listStatus(p))
        return sorted(int(x[2:]) for x in found if x.startswith("v=") and fs.exists(self._fs(f"{self.root}/{name}/{x}/_SUCCESS")[1]))

    def read(self, name: str) -> DataFrame:
        v = self._versions(name)
        if not v:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v={v[-1]}")

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        """df with the table's columns and types; a column it lacks is null."""
        want = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.selectExpr(*(f"cast({f'`{f.name}`' if f.name in df.columns else 'null'} as {f.dataType.simpleString()}) as `{f.name}`" for f in want))

    def append(self, name: str, df: DataFrame) -> None:
        v = self._versions(name)
        self._shaped(name, df).write.mode("append").parquet(f"{self.root}/{name}/v={v[-1] if v else 1}")

    def replace(self, name: str, df: DataFrame) -> None:
        v = self._versions(name)
        now = (v[-1] if v else 0) + 1
        self._shaped(name, df).write.mode("overwrite").parquet(f"{self.root}/{name}/v={now}")
        for old in v[:-1]:  # the last one stays for readers that are at it
            fs, p = self._fs(f"{self.root}/{name}/v={old}")
            fs.delete(p, True)
