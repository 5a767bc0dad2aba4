"""Registered queries of names, filings, works and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import evaluate, extract, resolve
from . import views as V

_SUFFIX = ", ".join(f"'{w}'" for w in text.SUFFIX_WORDS)
NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[-.,/&()''\"]', ' ', 'g'), '\\s+', ' ', 'g'))"
KEYED = V.NAMES + f""", norm as (select *, {NORM.format('name')} as norm from names),
keyed as (select *, case when len(list_filter(string_split(norm, ' '), lambda t: t not in ({_SUFFIX}) and length(t) > 1)) > 0 then array_to_string(list_filter(string_split(norm, ' '), lambda t: t not in ({_SUFFIX}) and length(t) > 1), ' ') else norm end as core from norm),
blocked as (select *, substr(string_split(core, ' ')[1], 1, 6) as block from keyed)"""
PAIRS = KEYED + """, pair as (select a.rid as rid_a, b.rid as rid_b, a.core as core_a, b.core as core_b, jaro_winkler_similarity(a.norm, b.norm) as score from blocked a join blocked b on a.block = b.block and a.entity_type = b.entity_type and a.rid < b.rid where coalesce(a.cik = b.cik, true))"""
EDGES = PAIRS + """, star as (select f.rid as rid_a, b.rid as rid_b from blocked b join (select cik, min(rid) as rid from blocked where cik is not null group by 1) f on b.cik = f.cik and b.rid <> f.rid),
edges as (select rid_a, rid_b from pair where score >= 0.92 union select rid_a, rid_b from star)"""
CLUSTERS = EDGES + """, both_ways as (select rid_a as a, rid_b as b from edges union select rid_b, rid_a from edges),
reach as (select rid as a, rid as b from blocked union select r.a, e.b from reach r join both_ways e on r.b = e.a),
cluster as (select a as rid, min(b) as cluster from reach group by 1), member as (select b.*, cluster from blocked b join cluster using (rid))"""


def names(spark, d):
    return V.names(spark, d)


def normalize_names(spark, d):
    return resolve.keyed(names(spark, d)).select("rid", "name", "norm", "core", "block")


def decisions(spark, d):
    """What reviewers said about grey pairs: of every fifth, alternately."""
    p = resolve.candidates(names(spark, d), resolve.GREY, resolve.MERGE).filter("(rid_a + rid_b) % 5 = 0")
    return p.select(F.col("core_a").alias("key_a"), F.col("core_b").alias("key_b"), F.when((F.col("rid_a") + F.col("rid_b")) % 2 == 0, "must_link").otherwise("must_not_link").alias("decision")).groupBy(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).agg(F.max("decision").alias("decision"))


DECIDED = PAIRS + """, decision as (select least(core_a, core_b) as key_a, greatest(core_a, core_b) as key_b, max(case when (rid_a + rid_b) % 2 = 0 then 'must_link' else 'must_not_link' end) as decision from pair where score >= 0.85 and score < 0.92 and (rid_a + rid_b) % 5 = 0 group by 1, 2)"""


def canonical(spark, d):
    n = names(spark, d)
    c = resolve.canonical(n, resolve.clusters(n))
    return c.withColumn("aliases", F.array_join("aliases", "|"))


def confidence(spark, d):
    n = names(spark, d)
    return resolve.confidence(n, resolve.clusters(n))


def _gold(spark, d):
    """Names in pairs of neighbours; the same where their part names are."""
    n = names(spark, d).select("rid", "name")
    return n.toDF("ra", "a").join(n.toDF("rb", "b"), F.col("rb") == F.col("ra") + 1).select("a", "b", (F.split("a", "[ ,]")[0] == F.split("b", "[ ,]")[0]).alias("same"))


GOLD = "gold as (select x.name as a, y.name as b, regexp_extract(x.name, '^[^ ,]*', 0) = regexp_extract(y.name, '^[^ ,]*', 0) as same from names x join names y on y.rid = x.rid + 1)"


def predicted_pairs(spark, d):
    n = names(spark, d)
    e = resolve.candidates(n, resolve.MERGE)
    i = n.select("rid", "name")
    return e.join(i.toDF("rid_a", "a"), "rid_a").join(i.toDF("rid_b", "b"), "rid_b").select("a", "b")


def guess_type(spark, d):
    c = V.table(spark, d, "customer").select(F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " Trust").otherwise(" Ralph")).alias("name"))
    s = V.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return c.unionByName(s).select("name", text.guess_type(F.col("name")).alias("type"))


_MARKS = "|".join(m.replace(".", "[.]") for m in text.ORG_MARKS)


def with_meta(spark, d):
    """Covers with the parties of their headers."""
    party = lambda name, cik: F.struct(name.alias("name"), cik.cast("string").alias("cik"))
    c = V.covers(spark, d)
    return c.select("id", "text", F.struct(F.array(party(F.col("filer_name"), F.col("id") % 50), party(F.concat(F.lit("Partner of "), "filer_name"), F.col("id") % 70)).alias("filers"), F.array(party(F.col("issuer_name"), F.col("id"))).alias("subject_companies")).alias("meta"))


def parsed(spark, d):
    return extract.parse_filing(with_meta(spark, d))


def filing_cover(spark, d):
    return parsed(spark, d).select("id", F.col("issuer.surface").alias("issuer"), F.col("issuer.start").alias("start"), F.col("cusip.cusip").alias("cusip"), F.col("cusip.valid").alias("valid"), F.col("event_date.surface").alias("event_date"), text.parsed_date(F.col("event_date.surface")).cast("string").alias("day"))


def percent_candidates(spark, d):
    return text.pinned(parsed(spark, d), candidates=F.col("candidates")).select("id", F.explode("candidates").alias("c")).select("id", "c.value", "c.start", "c.end", "c.score")


SCORED = V.COVERS + """, scored as (select id, text, 6.5::double as value, instr(text, '6.5%') - 1 as start, instr(text, '6.5%') + 3 as "end", 0.8 - 1.0 + case when regexp_matches(substr(text, greatest(instr(text, '6.5%') - 80, 1), instr(text, '6.5%') - greatest(instr(text, '6.5%') - 80, 1) + 44), '(?i)aggregate amount|beneficial|percent of class|represent|row [(]11[)]|shares outstanding') then 1.0 else 0.0 end as score from cover
union all select id, text, cast(rtrim(pct, '%') as double), length(text) - 1 - length(pct), length(text) - 1, 1.0 + 0.8 - case when cast(rtrim(pct, '%') as double) = 0 then 1.0 else 0.0 end - case when regexp_matches(substr(text, length(text) - 1 - length(pct) - 79, 80 + 40), '(?i)at least|coupon|discount|equal to|exceed|greater than|interest|premium|prime|rate|tax') then 1.0 else 0.0 end from cover)"""


def cusip_check(spark, d):
    code = F.concat(F.lpad((F.col("p_partkey") * 31337 % 10000000).cast("string"), 7, "0"), F.element_at(F.array(*map(F.lit, ["A", "Z", "*", "7", "#", "@", "?"])), (F.col("p_partkey") % 7 + 1).cast("int")), (F.col("p_partkey") % 10).cast("string"))
    return V.table(spark, d, "part").select(code.alias("code")).select("code", F.coalesce(text.cusip_check_digit(F.substring("code", 1, 8)), F.lit(-1)).alias("digit"), text.valid_cusip(F.col("code")).alias("valid"))


CUSIP = """code as (select lpad(cast(p_partkey * 31337 % 10000000 as varchar), 7, '0') || (['A', 'Z', '*', '7', '#', '@', '?'])[p_partkey % 7 + 1] || (p_partkey % 10) as code from part),
val as (select code, list_transform(range(1, 9), lambda i: (case when code[i] between '0' and '9' then ord(code[i]) - 48 when code[i] between 'A' and 'Z' then ord(code[i]) - 55 when code[i] = '*' then 36 when code[i] = '@' then 37 when code[i] = '#' then 38 end) * (case when i % 2 = 0 then 2 else 1 end)) as v from code),
dig as (select code, case when list_contains(list_transform(v, lambda x: x is null), true) then null else cast((10 - list_sum(list_transform(v, lambda x: x // 10 + x % 10)) % 10) % 10 as int) end as digit from val)"""


def rule_claims(spark, d):
    return extract.rule_claims(parsed(spark, d)).withColumn("valid_from", F.col("valid_from").cast("string"))


def _quotes(spark, d):
    docs = V.documents(spark, d).select("id", "text")
    q = F.substring("text", 5, 40)
    return docs.select("id", "text", F.concat(F.lit(" "), q, F.lit("\n")).alias("quote"), F.regexp_replace(q, " ", "  ").alias("wide"))


def ground_exact(spark, d):
    return _quotes(spark, d).withColumn("g", text.ground_exact(F.col("text"), F.col("quote"))).select("id", "g.start", "g.end", "g.snippet")


def ground_flexible(spark, d):
    """The whole quote, written with double blanks."""
    return _quotes(spark, d).withColumn("g", text.ground_flexible(F.col("text"), F.col("wide"))).select("id", "g.start", "g.end", "g.snippet")


def ground_quote(spark, d):
    """The three steps together: of each three documents one quote as it is, one with double blanks, and one whose predicate nobody knows."""
    q = _quotes(spark, d)
    claims = q.select(F.col("id").alias("document_id"), F.when(F.col("id") % 3 == 2, "LIKES").otherwise("OWNS").alias("predicate"), F.when(F.col("id") % 3 == 1, F.col("wide")).otherwise(F.col("quote")).alias("evidence_quote"))
    return extract.grounded(claims, q.select("id", "text")).select(F.col("document_id").alias("id"), "span.start", "span.end", "span.snippet")


def ground_fuzzy(spark, d):
    """Quotes from two thirds into the documents, one letter of them another."""
    q = F.expr("concat(substring(text, length(text) * 2 div 3 + 1, 20), 'x', substring(text, length(text) * 2 div 3 + 22, 40))")
    return V.documents(spark, d).select("id", similarity.ground_fuzzy(F.col("text"), q).alias("g")).select("id", "g.start", "g.end", "g.snippet")


_WIDE = """q as (select id, text, regexp_replace(substr(text, 5, 40), '^\\s+|\\s+$', '', 'g') as q from document),
h as (select id, text, q, case when q = '' then '' else regexp_extract(text, array_to_string(list_transform(regexp_split_to_array(q, '\\s+'), lambda w: regexp_escape(w)), '\\s+'), 0) end as hit from q)"""


def work_render(spark, d):
    return extract.render_works(V.works(spark, d)).select("id", "text")


def abstract_rebuild(spark, d):
    return V.works(spark, d).select(text.short_id(F.col("id")).alias("id"), text.abstract(F.col("abstract_inverted_index")).alias("abstract"))


def science_claims(spark, d):
    return extract.work_claims(extract.render_works(V.works(spark, d))).withColumn("valid_from", F.col("valid_from").cast("string"))


_A1, _A2 = "(p_partkey % 97)", "(p_partkey % 89 + 100)"
WORKS = f"""work as (select p_partkey, 'W' || p_partkey as id, {V._INITCAP} as title, p_name as abstract, 'Author ' || {_A1} as n1, 'A' || {_A1} as a1, 'Author ' || {_A2} as n2, 'A' || {_A2} as a2, 'Institute ' || ({_A1} % 25) as in1, 'I' || ({_A1} % 25) as i1, 'Institute ' || ({_A2} % 25) as in2, 'I' || ({_A2} % 25) as i2,
  'W' || (p_partkey % 50 + 1) as ref, 'C' || (p_partkey % 11) as cid, p_type as concept, cast(date '2020-01-01' + cast(p_partkey % 900 as int) as varchar) as valid_from from part),
rendered as (select *, 'TITLE: ' || title || chr(10) || chr(10) || 'ABSTRACT: ' || abstract || chr(10) || chr(10) || 'AUTHORS: ' || n1 || '; ' || n2 || chr(10) || 'AFFILIATIONS: ' || n1 || ' — ' || in1 || '; ' || n2 || ' — ' || in2 || chr(10) || 'CONCEPTS: ' || concept || chr(10) || 'REFERENCES: ' || ref as text from work),
said as (select id as document_id, text, valid_from, a1 as subject, 'AUTHORED' as predicate, id as object, n1 as quote from rendered union all select id, text, valid_from, a2, 'AUTHORED', id, n2 from rendered
  union all select id, text, valid_from, a1, 'AFFILIATED_WITH', i1, n1 || ' — ' || in1 from rendered union all select id, text, valid_from, a2, 'AFFILIATED_WITH', i2, n2 || ' — ' || in2 from rendered
  union all select id, text, valid_from, id, 'MENTIONS_CONCEPT', cid, concept from rendered union all select id, text, valid_from, id, 'CITES', ref, ref from rendered)"""


def mention_chunks(spark, d):
    return extract.chunks(V.documents(spark, d)).select("id", "start", F.md5(F.col("chunk").cast("binary")).alias("h"))


def header_lookup(spark, d):
    return resolve.header_cik_lookup(with_meta(spark, d))


def eval_extraction(spark, d):
    """Gold says that each cover's first filer owns its issuer; every fourth claim is missing."""
    c = with_meta(spark, d).select("id", F.col("meta.filers")[0]["cik"].alias("filer_cik"), F.col("meta.subject_companies")[0]["cik"].alias("subject_cik"), F.lit("OWNS").alias("predicate"))
    return evaluate.extraction(c.drop("id"), c.filter("id % 4 <> 0").drop("id"))


def eval_citation(spark, d):
    c = V.documents(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.lit(5.0)).alias("stake_pct"))
    return evaluate.citation(c, V.evidence(spark, d), V.documents(spark, d))


def eval_science(spark, d):
    gold = V.table(spark, d, "part").select(F.concat(F.lit("W"), "p_partkey").alias("work"), F.concat(F.lit("A"), (F.col("p_partkey") % 50)).alias("expect_author"), F.lit(1).alias("min_citations"))
    return evaluate.science(gold, extract.work_claims(extract.render_works(V.works(spark, d))))


def eval_prf(spark, d):
    t = V.table(spark, d, "labels").agg(F.count_if(F.expr("toxic = 1 and quality = 1")).alias("tp"), F.count_if(F.expr("toxic = 1 and quality = 0")).alias("fp"), F.count_if(F.expr("toxic = 0 and quality = 1")).alias("fn"))
    return t.select("tp", "fp", "fn", evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn")).alias("m")).select("tp", "fp", "fn", "m.*")


def upsert(spark, d):
    """Suppliers come in for entities that customers' nations made; half of them are known by their number."""
    arr, mp = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    old = V.table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.format_string("ORG_%06d", "s_suppkey").alias("id"), F.lit("Organization").alias("type"), F.col("s_name").alias("canonical_name"), arr.alias("aliases"), F.create_map(F.lit("cik"), F.col("s_suppkey").cast("string")).alias("external_ids"))
    inc = V.table(spark, d, "supplier").select(F.lit("Organization").alias("type"), F.concat(F.lit("New "), "s_name").alias("canonical_name"), F.array(F.lit("Alias B"), F.lit("Alias A")).alias("aliases"), F.create_map(F.lit("lei"), F.concat(F.lit("L"), "s_suppkey")).alias("external_ids"), F.lit("cik").alias("namespace"), F.col("s_suppkey").cast("string").alias("value"))
    out = resolve.upsert_entities(old, inc)
    return out.select("id", "type", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.col("external_ids")["cik"].alias("cik"), F.col("external_ids")["lei"].alias("lei"))


def merge_apply(spark, d):
    """Each odd person is merged into the even one before."""
    e = V.entities(spark, d)
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    m = e.filter((F.col("type") == "Person") & (n % 2 == 1)).select(F.format_string("PER_%06d", n - 1).alias("keep"), F.col("id").alias("drop"))
    m = m.join(e.select(F.col("id").alias("keep")), "keep", "left_semi")
    return resolve.merge_entities(e, m).select("id", "type", "canonical_name", F.array_join("aliases", "|").alias("aliases"), F.col("external_ids")["cik"].alias("cik"))


def merge_repoint(spark, d):
    n = F.regexp_extract("subject_id", "([0-9]+)", 1).cast("int")
    c = V.claims(spark, d).select("id", "subject_id", "object_id")
    m = c.select("subject_id").distinct().filter(n % 2 == 1).select(F.format_string("PER_%06d", n - 1).alias("keep"), F.col("subject_id").alias("drop"))
    return resolve.repoint(c, m, "subject_id", "object_id")


def resolved(spark, d):
    n = names(spark, d)
    none = spark.createDataFrame([], "id string, type string, canonical_name string, aliases array<string>, external_ids map<string,string>")
    return resolve.resolve(n, none)


def _w(*parts):
    return "with " + ",\n".join(parts)


Q = {
    "normalize_names": (normalize_names, f"{_w(KEYED)} select rid, name, norm, core, block from blocked"),
    "block_keys": (lambda s, d: normalize_names(s, d).groupBy("block").agg(F.count(F.lit(1)).alias("n")), f"{_w(KEYED)} select block, count(*) as n from blocked group by 1"),
    "jw_candidates": (lambda s, d: resolve.candidates(names(s, d), resolve.GREY).select("rid_a", "rid_b", F.round("score", 4).alias("score")), f"{_w(PAIRS)} select rid_a, rid_b, round(score, 4) as score from pair where score >= 0.85"),
    "er_clusters": (lambda s, d: resolve.clusters(names(s, d)), f"with recursive {CLUSTERS} select * from cluster"),
    "er_canonical": (canonical, f"with recursive {CLUSTERS}, best as (select cluster, arg_max(name, (n, length(name), -first)) as canonical_name, list_sort(list(name)) as names from (select cluster, name, count(*) as n, min(rid) as first from member group by 1, 2) group by 1) select cluster, canonical_name, array_to_string(list_filter(names, lambda x: x <> canonical_name), '|') as aliases, cik, size from best join (select cluster, min(cik) as cik, count(*) as size from member group by 1) using (cluster)"),
    "er_confidence": (confidence, f"with recursive {CLUSTERS} select m.cluster, case when m.has or m.n = 1 then 1.0 else round(coalesce(low, 1.0), 3) end as confidence from (select cluster, max(cik) is not null as has, count(*) as n from member group by 1) m left join (select a.cluster, min(jaro_winkler_similarity(a.norm, b.norm)) as low from member a join member b on a.cluster = b.cluster and a.norm < b.norm group by 1) using (cluster)"),
    "er_splink_fixed": (lambda s, d: resolve.probabilistic_pairs(names(s, d), link=0.01).select("rid_a", "rid_b", F.round("probability", 6).alias("probability")), f"{_w(KEYED)}, p as (select a.rid as rid_a, b.rid as rid_b, a.norm as na, b.norm as nb, jaro_winkler_similarity(a.norm, b.norm) as s from blocked a join blocked b on a.rid < b.rid and (substr(a.norm, 1, 4) = substr(b.norm, 1, 4) or a.cik = b.cik) where coalesce(a.cik = b.cik, true)), o as (select *, (case when na = nb then 7000.0 when s >= 0.92 then 200.0 when s >= 0.85 then 3.5 else 0.03 / 0.979 end) * (0.01 / 0.99) as odds from p) select rid_a, rid_b, round(odds / (1 + odds), 6) as probability from o where odds / (1 + odds) >= 0.01"),
    "merge_suggestions": (lambda s, d: resolve.suggestions(names(s, d), decisions=decisions(s, d)).drop("reason"), f"{_w(DECIDED)} select rid_a as entity_a, rid_b as entity_b, round(score, 4) as score from pair where score >= 0.85 and score < 0.92 and (least(core_a, core_b), greatest(core_a, core_b)) not in (select (key_a, key_b) from decision)"),
    "er_decisions": (decisions, f"{_w(DECIDED)} select * from decision"),
    "merge_apply": (merge_apply, f"{_w(V.ENTITIES)}, p as (select id, canonical_name, cik, type, cast(regexp_extract(id, '[0-9]+', 0) as int) as n from entity), m as (select k.id as keep, x.id as drop_id, x.canonical_name as name, x.cik from p x join p k on x.type = 'Person' and k.type = 'Person' and x.n % 2 = 1 and k.n = x.n - 1) select e.id, e.type, e.canonical_name, coalesce(m.name, '') as aliases, coalesce(e.cik, m.cik) as cik from entity e left join m on m.keep = e.id where e.id not in (select drop_id from m)"),
    "merge_repoint": (merge_repoint, f"{_w(V.CLAIMS)} select id, 'PER_' || lpad(cast(cast(substr(subject_id, 5) as int) // 2 * 2 as varchar), 6, '0') as subject_id, object_id from claim"),
    "entity_upsert": (upsert, """with s as (select *, row_number() over (partition by s_suppkey % 2 order by cast(s_suppkey as varchar)) as n from supplier), top as (select max(s_suppkey) as top from supplier where s_suppkey % 2 = 0)
select 'ORG_' || lpad(cast(case when s_suppkey % 2 = 0 then s_suppkey else top + n end as varchar), 6, '0') as id, 'Organization' as type, case when s_suppkey % 2 = 0 then s_name else 'New ' || s_name end as canonical_name, 'Alias A|Alias B' as aliases, cast(s_suppkey as varchar) as cik, 'L' || s_suppkey as lei from s, top"""),
    "entity_ids": (lambda s, d: text.numbered(V.table(s, d, "customer").select(F.col("c_name").alias("name"), text.guess_type(F.col("c_name")).alias("type")), ["type", "name"], "n").select(resolve.entity_id(F.col("type"), F.col("n")).alias("id"), "name"), f"select (case when regexp_matches(lower(c_name), '{_MARKS}') then 'ORG_' else 'PER_' end) || lpad(cast(row_number() over (order by case when regexp_matches(lower(c_name), '{_MARKS}') then 'Organization' else 'Person' end, c_name) as varchar), 6, '0') as id, c_name as name from customer"),
    "resolution": (lambda s, d: resolved(s, d).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first")), None),
    "guess_type": (guess_type, f"with n as (select c_name || case when c_custkey % 3 = 0 then ' Trust' else ' Ralph' end as name from customer union all select s_name from supplier) select name, case when regexp_matches(lower(name), '{_MARKS}') then 'Organization' else 'Person' end as type from n"),
    "header_cik_lookup": (header_lookup, f"{_w(V.COVERS)} select id, filer_name as name, cast(id % 50 as varchar) as cik from cover union all select id, 'Partner of ' || filer_name, cast(id % 70 as varchar) from cover union all select id, issuer_name, cast(id as varchar) from cover"),
    "filing_cover": (filing_cover, f"{_w(V.COVERS)} select id, issuer_name as issuer, 14 as start, cusip, true as valid, strftime(event_date, '%B ') || cast(day(event_date) as varchar) || strftime(event_date, ', %Y') as event_date, cast(event_date as varchar) as day from cover"),
    "percent_candidates": (percent_candidates, f"{_w(SCORED)} select id, value, start, \"end\", round(score, 4) as score from scored"),
    "best_percent": (lambda s, d: text.pinned(parsed(s, d), best=F.col("best")).filter("best is not null").select("id", "best.value", "best.start"), f"{_w(SCORED)} select id, arg_max(value, (score, -start)) as value, arg_max(start, (score, -start)) as start from scored where round(score, 4) > 0 group by 1"),
    "cusip_check": (cusip_check, f"{_w(CUSIP)} select code, coalesce(digit, -1) as digit, coalesce(code[9] = cast(digit as varchar), false) as valid from dig"),
    "cusip_extract": (lambda s, d: parsed(s, d).select("id", "cusip.cusip", "cusip.valid"), f"{_w(V.COVERS)} select id, cusip, true as valid from cover"),
    "rule_claims": (rule_claims, f"{_w(SCORED)}, best as (select id, arg_max(value, (score, -start)) as value, arg_max(substr(text, start + 1, \"end\" - start), (score, -start)) as quote from scored where round(score, 4) > 0 group by 1), f as (select id, filer_name as f from cover union all select id, 'Partner of ' || filer_name from cover) select id as document_id, f as subject_surface, 'OWNS' as predicate, issuer_name as object_surface, value as stake_pct, strftime(event_date, '%B ') || cast(day(event_date) as varchar) || strftime(event_date, ', %Y') as event_date, cusip, cast(event_date as varchar) as valid_from, case when value is null then 0.6 else 0.9 end as confidence, coalesce(quote, issuer_name) as evidence_quote from f join cover using (id) left join best using (id)"),
    "ground_exact": (ground_exact, f"{_w(V.DOCUMENTS)}, q as (select id, text, regexp_replace(substr(text, 5, 40), '^\\s+|\\s+$', '', 'g') as q from document) select id, case when instr(text, q) > 0 and q <> '' then instr(text, q) - 1 end as start, case when instr(text, q) > 0 and q <> '' then instr(text, q) - 1 + length(q) end as \"end\", case when instr(text, q) > 0 and q <> '' then q end as snippet from q"),
    "ground_whitespace": (ground_flexible, f"{_w(V.DOCUMENTS, _WIDE)} select id, case when hit <> '' then instr(text, hit) - 1 end as start, case when hit <> '' then instr(text, hit) - 1 + length(hit) end as \"end\", nullif(hit, '') as snippet from h"),
    "ground_quote": (ground_quote, f"{_w(V.DOCUMENTS, _WIDE)}, g as (select id, text, case when id % 3 = 0 then q else hit end as hit from h where id % 3 < 2) select id, instr(text, hit) - 1 as start, instr(text, hit) - 1 + length(hit) as \"end\", hit as snippet from g where hit <> '' and instr(text, hit) > 0"),
    "ground_fuzzy": (ground_fuzzy, None),
    "work_render": (work_render, f"{_w(WORKS)} select id, text from rendered"),
    "abstract_rebuild": (abstract_rebuild, f"{_w(WORKS)} select id, abstract from work"),
    "science_claims": (science_claims, f"{_w(WORKS)} select document_id, subject, predicate, object, quote, instr(text, quote) - 1 as start, instr(text, quote) - 1 + length(quote) as \"end\", valid_from from said"),
    "mention_chunks": (mention_chunks, f"{_w(V.DOCUMENTS)}, c as (select id, text, unnest(range(0, greatest(cast(ceil((length(text) - 1200) / 1050.0) as bigint), 0) + 1)) * 1050 as start from document where length(text) > 0) select id, start, md5(substr(text, start + 1, 1200)) as h from c"),
    "mentions_rule": (lambda s, d: extract.rule_mentions(V.documents(s, d)), None),
    "eval_er_pairs": (lambda s, d: evaluate.isolated_pairs(_gold(s, d)), f"{_w(KEYED, GOLD)}, r as (select g.same, x.block = y.block and jaro_winkler_similarity(x.norm, y.norm) >= 0.92 as hit from gold g join blocked x on x.name = g.a join blocked y on y.name = g.b) select round(count(*) filter (where not same and hit) / greatest(count(*) filter (where not same), 1), 4) as false_merge_rate, round(count(*) filter (where same and not hit) / greatest(count(*) filter (where same), 1), 4) as missed_merge_rate, round(count(*) filter (where same = hit) / greatest(count(*), 1), 4) as accuracy, count(*) as n from r"),
    "eval_er_joint": (lambda s, d: evaluate.pairwise(predicted_pairs(s, d), _gold(s, d)), f"{_w(PAIRS, GOLD)}, r as (select g.same, p.rid_a is not null as hit from gold g join names x on x.name = g.a join names y on y.name = g.b left join pair p on p.rid_a = least(x.rid, y.rid) and p.rid_b = greatest(x.rid, y.rid) and p.score >= 0.92) select round(count(*) filter (where not same and hit) / greatest(count(*) filter (where not same), 1), 4) as false_merge_rate, round(count(*) filter (where same and not hit) / greatest(count(*) filter (where same), 1), 4) as missed_merge_rate, round(count(*) filter (where same = hit) / greatest(count(*), 1), 4) as accuracy, count(*) as n from r"),
    "eval_prf": (eval_prf, "with t as (select count(*) filter (where toxic = 1 and quality = 1) as tp, count(*) filter (where toxic = 1 and quality = 0) as fp, count(*) filter (where toxic = 0 and quality = 1) as fn from labels), p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from t) select tp, fp, fn, round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) as f1 from p"),
    "eval_citation": (eval_citation, f"{_w(V.EVIDENCE)}, r as (select substr(d.text, e.char_start + 1, e.char_end - e.char_start) = e.snippet as ok, d.id % 3 <> 0 or list_contains(list_transform(regexp_extract_all(e.snippet, '[0-9]+[.]?[0-9]*'), lambda x: cast(x as double)), 5.0) as supported from evidence e join document d on d.id = e.document_id) select count(*) as checked, round(count(*) filter (where ok) / count(*), 4) as round_trip, round(count(*) filter (where supported) / count(*), 4) as supported from r"),
    "eval_extraction": (eval_extraction, "with g as (select p_partkey % 50 as f, p_partkey as s, p_partkey % 4 <> 0 as hit from part) select count(*) filter (where hit) as tp, 0 as fp, count(*) filter (where not hit) as fn, 1.0 as precision, round(count(*) filter (where hit) / count(*), 4) as recall, round(2 * (count(*) filter (where hit) / count(*)) / (1 + count(*) filter (where hit) / count(*)), 4) as f1 from g"),
    "eval_science": (eval_science, f"{_w(WORKS)} select w.id as work, ('A' || (p_partkey % 50)) in (a1, a2) as author_found, cast(1 as bigint) as n_cites, true as enough from work w"),
}
