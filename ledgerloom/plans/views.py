"""The ledger's tables derived from the star schema, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows of a small file in four tasks for each core: as one task reads them, it would do alone what is made of them."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each event: a person, a predicate, one of ten organisations, a stake, and both time axes."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 10
    return e.select(
        F.col("event_id").alias("id"),
        F.format_string("PER_%06d", "user_id").alias("subject_id"),
        F.col("event_type").alias("predicate"),
        F.format_string("ORG_%06d", k).alias("object_id"),
        F.lit(None).cast("string").alias("object_literal"),
        F.col("value").alias("stake_pct"),
        F.concat(F.lit('{"stake_pct": '), F.col("value").cast("string"), F.lit("}")).alias("qualifiers"),
        F.col("ts").cast("date").alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to"),
        F.col("ts").alias("asserted_at"),
        F.when(F.col("event_id") % 13 == 0, F.col("ts") + F.expr("interval 3 days")).alias("retracted_at"),
        F.lit(None).cast("long").alias("superseded_by"),
        F.when(F.col("event_id") % 17 == 0, "negated").otherwise("asserted").alias("polarity"),
        F.lit(1.0).alias("confidence"),
    )


CLAIMS = """claim as (select event_id as id, concat('PER_', lpad(cast(user_id as varchar), 6, '0')) as subject_id, event_type as predicate,
  concat('ORG_', lpad(cast(cast(regexp_extract(props, '[0-9]+', 0) as int) % 10 as varchar), 6, '0')) as object_id, value as stake_pct,
  cast(ts as date) as valid_from, cast(null as date) as valid_to, ts as asserted_at,
  case when event_id % 13 = 0 then ts + interval 3 day end as retracted_at, cast(null as bigint) as superseded_by,
  case when event_id % 17 = 0 then 'negated' else 'asserted' end as polarity from events)"""

RECONCILED = """linked as (select id, lead(id) over w as next_id, lead(valid_from) over w as next_from, valid_from from claim where retracted_at is null and valid_from is not null
  window w as (partition by subject_id, predicate, object_id order by valid_from, asserted_at, id)),
link as (select id, next_id, next_from from linked where next_from > valid_from),
reconciled as (select c.* replace (case when l.id is not null and (c.valid_to is null or c.valid_to > l.next_from) then l.next_from else c.valid_to end as valid_to, coalesce(l.next_id, c.superseded_by) as superseded_by)
  from claim c left join link l on c.id = l.id)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons from the events' users, of whom those with an even number have a cik; ten organisations."""
    people = table(spark, sf_dir, "events").select("user_id").distinct()
    person = people.select(
        F.format_string("PER_%06d", "user_id").alias("id"), F.lit("Person").alias("type"), F.format_string("Person %d", "user_id").alias("canonical_name"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).alias("cik")
    )
    orgs = spark.range(10).select(F.format_string("ORG_%06d", "id").alias("id"), F.lit("Organization").alias("type"), F.format_string("Organization %d", "id").alias("canonical_name"), F.lit(None).cast("string").alias("cik"))
    both = person.unionByName(orgs)
    ids = F.when(F.col("cik").isNotNull(), F.create_map(F.lit("cik"), F.col("cik"))).otherwise(F.create_map().cast("map<string,string>"))
    return both.select("id", "type", "canonical_name", F.array().cast("array<string>").alias("aliases"), ids.alias("external_ids"))


ENTITIES = """entity as (select concat('PER_', lpad(cast(user_id as varchar), 6, '0')) as id, 'Person' as type, 'Person ' || user_id as canonical_name, case when user_id % 2 = 0 then cast(user_id as varchar) end as cik
  from (select distinct user_id from events) union all select concat('ORG_', lpad(cast(range as varchar), 6, '0')), 'Organization', 'Organization ' || range, null from range(10))"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, name): distinct company names made of part names and four suffixes, numbered by name."""
    p = table(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substring(p_name, 2)")), suffix)
    rows = p.select(name.alias("name")).distinct()
    # ids need one order over all; names are few against the rows they come from
    return text.numbered(rows, ["name"], "rid").select("rid", "name", F.lit("Organization").alias("entity_type"), F.when(F.col("rid") % 7 == 0, (F.col("rid") % 21).cast("string")).alias("cik"))


SUFFIXES = [" Inc.", " LLC", ", L.P.", " Holdings"]
NAMES = """name0 as (select distinct upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) || (case p_partkey % 4 when 0 then ' Inc.' when 1 then ' LLC' when 2 then ', L.P.' else ' Holdings' end) as name from part),
names as (select rid, name, 'Organization' as entity_type, case when rid % 7 = 0 then cast(rid % 21 as varchar) end as cik from (select row_number() over (order by name) as rid, name from name0))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.sha2("text", 256).alias("content_hash"), "text", F.lit("text").alias("doc_type"))


DOCUMENTS = "document as (select doc_id as id, source as source_id, sha256(text) as content_hash, text, 'text' as doc_type from documents)"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the place of its first word; every seventh is off by one."""
    d = documents(spark, sf_dir)
    first = F.regexp_extract("text", r"[^ \n\t]+", 0)
    start = (F.instr("text", first) - 1).cast("int")
    return d.select(F.col("id").alias("claim_id"), F.col("id").alias("document_id"), (start + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("char_start"), (start + F.length(first) + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).cast("int").alias("char_end"), first.alias("snippet"))


EVIDENCE = DOCUMENTS + """, ev0 as (select id, regexp_extract(text, '[^ \\n\\t]+', 0) as snippet, text from document),
evidence as (select id as claim_id, id as document_id, cast(instr(text, snippet) - 1 + case when id % 7 = 0 then 1 else 0 end as int) as char_start,
  cast(instr(text, snippet) - 1 + length(snippet) + case when id % 7 = 0 then 1 else 0 end as int) as char_end, snippet from ev0)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, predicate): who bought from whom, each pair once."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = o.join(i, o["o_orderkey"] == i["l_orderkey"]).select("o_custkey", "l_suppkey").distinct()
    return pairs.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"), F.lit("BOUGHT_FROM").alias("predicate"))


TRADE = "edge as (select distinct 'C' || o_custkey as src, 'S' || l_suppkey as dst, 'BOUGHT_FROM' as predicate from orders join lineitem on o_orderkey = l_orderkey)"


def watches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "stake_threshold", "ORG_000003", 113.0), (2, "new_claim", "PER_000008", None), (3, "contradiction", None, None)], "id long, kind string, target string, threshold double")


WATCHES = "watch as (select * from (values (1::bigint, 'stake_threshold', 'ORG_000003', 113.0::double), (2, 'new_claim', 'PER_000008', null), (3, 'contradiction', null, null)) t(id, kind, target, threshold))"


def covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing cover pages written from parts and customers: one for each part."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    digits = F.lpad((F.col("p_partkey") * 7919 % 100000000).cast("string"), 8, "0")
    pct = F.concat((F.col("p_partkey") % 40).cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit("%"))
    body = F.concat(
        F.lit("SCHEDULE 13D\n\n"), F.initcap("p_name"), F.lit(" Corp\n(Name of Issuer)\n\nCommon Stock\n(Title of Class)\n\n"), digits, text.cusip_check_digit(digits).cast("string"), F.lit("\n(CUSIP Number)\n\n"),
        F.element_at(F.array(*map(F.lit, ["January", "March", "June", "December"])), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit(" "), (F.col("p_partkey") % 28 + 1).cast("string"), F.lit(", 2023\n(Date of Event)\n\nNotes bear interest at a rate of 6.5% per annum.\n"),
        F.lit("Percent of Class Represented by Amount in Row (11): "), pct, F.lit("\n"),
    )
    return p.select(F.col("p_partkey").alias("id"), body.alias("text"), F.concat(F.initcap("p_name"), F.lit(" Corp")).alias("issuer_name"), F.concat(F.lit("Holder "), (F.col("p_partkey") % 50).cast("string"), F.lit(" LLC")).alias("filer_name"))


_INITCAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_DIGITS = "lpad(cast(p_partkey * 7919 % 100000000 as varchar), 8, '0')"
_CHECK = f"cast((10 - list_sum(list_transform(range(1, 9), lambda i: (cast({_DIGITS}[i] as int) * (case when i % 2 = 0 then 2 else 1 end)) // 10 + (cast({_DIGITS}[i] as int) * (case when i % 2 = 0 then 2 else 1 end)) % 10)) % 10) % 10 as int)"
COVERS = f"""cover as (select p_partkey as id, {_INITCAP} || ' Corp' as issuer_name, 'Holder ' || (p_partkey % 50) || ' LLC' as filer_name, {_DIGITS} || {_CHECK} as cusip,
  cast(p_partkey % 40 as varchar) || '.' || (p_partkey % 10) || '%' as pct, make_date(2023, case p_partkey % 4 when 0 then 1 when 1 then 3 when 2 then 6 else 12 end, cast(p_partkey % 28 + 1 as int)) as event_date,
  'SCHEDULE 13D' || chr(10) || chr(10) || {_INITCAP} || ' Corp' || chr(10) || '(Name of Issuer)' || chr(10) || chr(10) || 'Common Stock' || chr(10) || '(Title of Class)' || chr(10) || chr(10) || {_DIGITS} || {_CHECK} || chr(10) || '(CUSIP Number)' || chr(10) || chr(10) ||
  (case p_partkey % 4 when 0 then 'January' when 1 then 'March' when 2 then 'June' else 'December' end) || ' ' || (p_partkey % 28 + 1) || ', 2023' || chr(10) || '(Date of Event)' || chr(10) || chr(10) || 'Notes bear interest at a rate of 6.5% per annum.' || chr(10) ||
  'Percent of Class Represented by Amount in Row (11): ' || cast(p_partkey % 40 as varchar) || '.' || (p_partkey % 10) || '%' || chr(10) as text from part)"""


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scholarly works written from parts, with suppliers as authors and nations as institutions."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    n = F.col("p_partkey")
    words = F.split("p_name", " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("k"), F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()).alias("v"))))
    person = lambda k: F.struct(F.struct(F.concat(F.lit("https://works.test/A"), k.cast("string")).alias("id"), F.concat(F.lit("Author "), k.cast("string")).alias("display_name")).alias("author"), F.array(F.struct(F.concat(F.lit("https://works.test/I"), (k % 25).cast("string")).alias("id"), F.concat(F.lit("Institute "), (k % 25).cast("string")).alias("display_name"))).alias("institutions"))
    return p.select(
        F.concat(F.lit("https://works.test/W"), n.cast("string")).alias("id"), F.concat(F.lit("https://doi.test/10.1/"), n.cast("string")).alias("doi"), F.initcap("p_name").alias("title"), F.date_add(F.lit("2020-01-01").cast("date"), (n % 900).cast("int")).alias("publication_date"),
        index.alias("abstract_inverted_index"), F.array(person(n % 97), person(n % 89 + 100)).alias("authorships"), F.array(F.concat(F.lit("https://works.test/W"), (n % 50 + 1).cast("string"))).alias("referenced_works"), F.array(F.struct(F.concat(F.lit("https://works.test/C"), (n % 11).cast("string")).alias("id"), F.col("p_type").alias("display_name"))).alias("concepts"),
    )


def days_as_text(query, sql: str, *columns: str):
    """A registered pair whose dates are text, which every client prints alike."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: F.col(c).cast("string") for c in columns})
    return run, f"select * replace ({', '.join(f'cast({c} as varchar) as {c}' for c in columns)}) from ({sql})"
