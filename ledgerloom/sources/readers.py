"""Readers of dumps of filings, works, PDF files and gold sets, and any generator as a data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTY = "array<struct<name:string,cik:string,irs_number:string,sic:string,state_of_incorporation:string>>"
FILING_SCHEMA = f"external_id string, form string, url string, retrieved_at timestamp, text string, filers {PARTY}, subject_companies {PARTY}, filing_date string, company string, cik string"
WORK_SCHEMA = (
    "id string, doi string, title string, publication_date date, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<id:string,display_name:string,ror:string>>>>, "
    "referenced_works array<string>, concepts array<struct<id:string,display_name:string>>"
)


def form_code(form: str) -> str:
    return f"SC {form}" if form in ("13D", "13G") else form


def bare_cik(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, "^0+", ""), F.lit(""))


def filings(spark: SparkSession, path: str, *, form: str = "13D", limit: int | None = None) -> DataFrame:
    """Filings of a form from JSON lines, in order of their id, without those whose text has less than 50 characters."""
    clean = lambda c: F.transform(F.coalesce(c, F.array().cast(PARTY)), lambda p: p.withField("cik", bare_cik(p["cik"])))
    rows = spark.read.schema(FILING_SCHEMA).json(path).filter((F.col("form") == form_code(form)) & (F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) >= 50))
    rows = rows.select("external_id", F.col("form").alias("doc_type"), "url", "retrieved_at", "text", F.sha2("text", 256).alias("content_hash"), F.struct(clean(F.col("filers")).alias("filers"), clean(F.col("subject_companies")).alias("subject_companies"), "filing_date", "company", "cik").alias("meta"))
    return rows if limit is None else rows.orderBy("external_id").limit(limit)


def works(spark: SparkSession, path: str, *, concept: str | None = None, search: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Works from JSON lines; those without an id are skipped, filters reach the scan."""
    rows = spark.read.schema(WORK_SCHEMA).json(path).filter("id <> ''")
    if concept is not None:
        rows = rows.filter(F.exists("concepts", lambda c: c["id"].endswith(concept)))
    if search is not None:
        rows = rows.filter(F.contains(F.lower("title"), F.lit(search.lower())))
    if since is not None:
        rows = rows.filter(F.col("publication_date") >= F.lit(since).cast("date"))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def pdf_texts(spark: SparkSession, path: str, make: Callable[[], Callable[[bytes], list[str]]]) -> DataFrame:
    """(path, text) of PDF files, pages parted by form feeds; make is called once for each task and returns the parser."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make()
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": ["\f".join(parse(bytes(b))) for b in f["content"]]})
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(run, "path string, text string")


def er_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, same) of a gold set of names."""
    return spark.read.option("multiLine", True).schema("dataset string, pairs array<struct<a:string,b:string,label:string>>").json(path).select(F.explode("pairs").alias("p")).select("p.a", "p.b", (F.col("p.label") == "same").alias("same"))


def gold(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of a list within a JSON document."""
    return spark.read.option("multiLine", True).schema(f"{field} array<struct<{schema}>>").json(path).select(F.explode(field).alias("g")).select("g.*")


class _Part(InputPartition):
    def __init__(self, number: int):
        self.number = number


class GeneratorSource(DataSource):
    """Rows of fetch(part, parts), a generator of tuples: what a connector to a service is written as."""

    @classmethod
    def name(cls) -> str:
        return "ledger_connector"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.parts = options["fetch"], int(options.get("parts", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Part(i) for i in range(self.parts)]

    def read(self, partition: InputPartition):
        yield from cloudpickle.loads(bytes.fromhex(self.fetch))(partition.number, self.parts)


def connect(spark: SparkSession, fetch: Callable[[int, int], Iterator[tuple]], schema: str, *, parts: int = 1) -> DataFrame:
    spark.dataSource.register(GeneratorSource)
    return spark.read.format("ledger_connector").option("schema", schema).option("fetch", cloudpickle.dumps(fetch).hex()).option("parts", str(parts)).load()
