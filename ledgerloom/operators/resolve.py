"""Entity resolution: candidates by block, closure, canonical names, merges and the decisions of reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import jw
from .components import connected_components, cut

MERGE, GREY = 0.92, 0.85
M_WEIGHTS, U_WEIGHTS, PRIOR, LINK = (0.7, 0.2, 0.07, 0.03), (0.0001, 0.001, 0.02, 0.979), 0.01, 0.9


def keyed(records: DataFrame) -> DataFrame:
    """records (rid, name, entity_type, cik) with norm, core and block."""
    return records.withColumn("norm", text.normalized(F.col("name"))).withColumn("core", text.core(F.col("name"))).withColumn("block", text.block_key(F.col("name")))


def _pairs(k: DataFrame, keys: list[str]) -> DataFrame:
    a, b = k.alias("a"), k.alias("b")
    return a.join(b, [*(F.col(f"a.{x}") == F.col(f"b.{x}") for x in keys), F.col("a.rid") < F.col("b.rid")])


def compatible(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(True))


def candidates(records: DataFrame, least: float, most: float | None = None) -> DataFrame:
    """(rid_a, rid_b, score) of pairs in one type and block, whose ciks don't differ, with a Jaro-Winkler similarity from least to below most.

    The similarity is taken once for each pair of distinct normalised names, not for each pair of records.
    """
    k = cut(keyed(records))
    n = k.select("entity_type", "block", "norm").distinct()
    near = n.toDF("entity_type", "block", "x").join(n.toDF("entity_type", "block", "y"), ["entity_type", "block"]).filter("x <= y")
    near = near.repartition("entity_type", "block", "x").withColumn("score", jw(F.col("x"), F.col("y")))
    hit = F.col("score") >= least
    if most is not None:
        hit &= F.col("score") < most
    side = lambda r, v: k.select("entity_type", "block", F.col("norm").alias(v), F.col("rid").alias(f"r{r}"), F.col("core").alias(f"c{r}"), F.col("cik").alias(f"k{r}"))
    left, right = cut(near.filter(hit)).join(side("a", "x"), ["entity_type", "block", "x"]), side("b", "y")
    # ciks that don't differ, by three equal joins: a name with many ciks is not joined with itself
    keys = ["entity_type", "block", "y"]
    rows = left.join(right.withColumnRenamed("kb", "ka"), [*keys, "ka"]).select(*left.columns, "rb", "cb")
    rows = rows.unionByName(left.join(right.filter("kb is null").drop("kb"), keys).select(*left.columns, "rb", "cb"))
    rows = rows.unionByName(left.filter("ka is null").join(right.filter("kb is not null").drop("kb"), keys).select(*left.columns, "rb", "cb"))
    rows = rows.filter((F.col("ra") != F.col("rb")) & ((F.col("x") != F.col("y")) | (F.col("ra") < F.col("rb"))))
    swap = F.col("ra") > F.col("rb")
    pick = lambda a, b, name: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)
    return rows.select(pick("ra", "rb", "rid_a"), pick("rb", "ra", "rid_b"), "score", pick("ca", "cb", "core_a"), pick("cb", "ca", "core_b"))


def _decided(pairs: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """pairs without those whose unordered pair of cores is among the decisions (key_a, key_b)."""
    if decisions is None:
        return pairs
    d = decisions.select(F.least("key_a", "key_b").alias("_x"), F.greatest("key_a", "key_b").alias("_y")).distinct()
    return pairs.withColumn("_x", F.least("core_a", "core_b")).withColumn("_y", F.greatest("core_a", "core_b")).join(d, ["_x", "_y"], "left_anti").drop("_x", "_y")


def match_edges(records: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(rid_a, rid_b): the star of each cik, similar names, and what reviewers linked; what they parted is left out pair by pair."""
    k = keyed(records)
    apart = decisions.filter("decision = 'must_not_link'") if decisions is not None else None
    first = k.filter("cik is not null").groupBy("cik").agg(F.min(F.struct("rid", "core")).alias("f"))
    star = k.join(first, "cik").filter(F.col("rid") != F.col("f.rid")).select(F.col("f.rid").alias("rid_a"), F.col("rid").alias("rid_b"), F.col("f.core").alias("core_a"), F.col("core").alias("core_b"))
    edges = _decided(star.unionByName(candidates(records, MERGE).drop("score")), apart).select("rid_a", "rid_b")
    if decisions is not None:
        links = decisions.filter("decision = 'must_link'").select(F.least("key_a", "key_b").alias("x"), F.greatest("key_a", "key_b").alias("y")).distinct()
        links = _decided(links.select(F.col("x").alias("core_a"), F.col("y").alias("core_b")), apart)
        a, b = k.select(F.col("rid").alias("ra"), F.col("core").alias("core_a"), F.col("entity_type").alias("ta")), k.select(F.col("rid").alias("rb"), F.col("core").alias("core_b"), F.col("entity_type").alias("tb"))
        both = links.join(a, "core_a").join(b, "core_b").filter("ta = tb and ra <> rb")
        edges = edges.unionByName(both.select(F.least("ra", "rb").alias("rid_a"), F.greatest("ra", "rb").alias("rid_b")))
    return edges.distinct()


def clusters(records: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(rid, cluster): cluster is the least rid of the transitive closure.

    Records of one type, normalised name and cik are linked with each other and with the same others, so that only the first of them is compared,
    but where reviewers parted a core from itself, each is.
    """
    k = records.select("rid", "name", "entity_type", "cik").withColumn("norm", text.normalized(F.col("name")))
    alone = F.col("norm").isNull() | F.col("entity_type").isNull()
    if decisions is not None:
        apart = decisions.filter("decision = 'must_not_link' and key_a = key_b").select(F.col("key_a").alias("core"), F.lit(True).alias("_apart")).distinct()
        k = k.withColumn("core", text.core(F.col("name"))).join(apart, "core", "left")
        alone |= F.col("_apart").isNotNull()
    k = cut(k.withColumn("own", F.when(alone, F.col("rid"))).select("rid", "name", "entity_type", "cik", "norm", "own"))
    key = ["entity_type", "norm", "cik", "own"]
    firsts = cut(k.groupBy(*key).agg(F.min_by(F.struct("rid", "name"), "rid").alias("f")).select("f.*", *key))
    comp = connected_components(match_edges(firsts.select("rid", "name", "entity_type", "cik"), decisions), src="rid_a", dst="rid_b")
    placed = firsts.join(comp, F.col("rid") == F.col("node"), "left").select(*(F.col(c).alias(f"_{c}") for c in key), F.coalesce("component", "rid").alias("cluster"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return k.join(placed, same).select("rid", "cluster")


def canonical(records: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, canonical_name, aliases, cik, size): the commonest name, of equals the longest, then that of the least rid."""
    rows = records.join(members, "rid")
    names = rows.groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first"))
    best = names.groupBy("cluster").agg(F.max_by("name", F.struct("n", F.length("name"), -F.col("first"))).alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("all"))
    whole = rows.groupBy("cluster").agg(F.min("cik").alias("cik"), F.count(F.lit(1)).alias("size"))
    return best.join(whole, "cluster").select("cluster", "canonical_name", F.array_remove("all", F.col("canonical_name")).alias("aliases"), "cik", "size")


def confidence(records: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, confidence): 1 with a cik or a single member, else the least similarity within, to three places."""
    rows = keyed(records).join(members, "rid").select("rid", "cluster", "norm", "cik")
    sure = rows.groupBy("cluster").agg(F.max("cik").isNotNull().alias("has"), F.count(F.lit(1)).alias("n"))
    distinct = rows.select("cluster", "norm").distinct()
    pairs = distinct.alias("a").join(distinct.alias("b"), [F.col("a.cluster") == F.col("b.cluster"), F.col("a.norm") < F.col("b.norm")])
    low = pairs.select(F.col("a.cluster").alias("cluster"), jw(F.col("a.norm"), F.col("b.norm")).alias("s")).groupBy("cluster").agg(F.min("s").alias("low"))
    return sure.join(low, "cluster", "left").select("cluster", F.when(F.col("has") | (F.col("n") == 1), 1.0).otherwise(F.round(F.coalesce("low", F.lit(1.0)), 3)).alias("confidence"))


def match_probability(a: Column, b: Column, m: tuple = M_WEIGHTS, u: tuple = U_WEIGHTS, prior: float = PRIOR) -> Column:
    """Posterior of a match by the level of agreement: equal, similar, less so, else."""
    s = jw(a, b)
    bayes = F.when(a == b, m[0] / u[0]).when(s >= MERGE, m[1] / u[1]).when(s >= GREY, m[2] / u[2]).otherwise(m[3] / u[3])
    odds = bayes * (prior / (1 - prior))
    return odds / (1 + odds)


def probabilistic_pairs(records: DataFrame, m: tuple = M_WEIGHTS, u: tuple = U_WEIGHTS, link: float = LINK) -> DataFrame:
    """(rid_a, rid_b, probability) over pairs that share the first four characters or a cik, of those that link."""
    k = keyed(records).withColumn("four", F.substring("norm", 1, 4))
    cols = lambda p: p.select(F.col("a.rid").alias("rid_a"), F.col("b.rid").alias("rid_b"), F.col("a.norm").alias("na"), F.col("b.norm").alias("nb"), F.col("a.cik").alias("ca"), F.col("b.cik").alias("cb"))
    pairs = cols(_pairs(k, ["four"])).unionByName(cols(_pairs(k, ["cik"]))).distinct()
    return pairs.withColumn("probability", match_probability(F.col("na"), F.col("nb"), m, u)).filter((F.col("probability") >= link) & compatible(F.col("ca"), F.col("cb"))).select("rid_a", "rid_b", "probability")


def fit_weights(records: DataFrame, rounds: int = 5) -> tuple[tuple, tuple]:
    """m by expectation maximisation over the pairs of a block, from one aggregation of their levels' counts.

    u is how often records that don't match agree; within a block nearly all do, so it stays what it is among all pairs.
    """
    k = keyed(records).withColumn("four", F.substring("norm", 1, 4))
    s = jw(F.col("a.norm"), F.col("b.norm"))
    level = F.when(F.col("a.norm") == F.col("b.norm"), 0).when(s >= MERGE, 1).when(s >= GREY, 2).otherwise(3)
    n = [0.0] * 4
    for r in _pairs(k, ["four"]).select(level.alias("level")).groupBy("level").count().collect():
        n[r["level"]] = float(r["count"])
    m, u, prior = list(M_WEIGHTS), [x / sum(U_WEIGHTS) for x in U_WEIGHTS], PRIOR
    if not sum(n):
        return M_WEIGHTS, tuple(u)
    for _ in range(rounds):
        p = [prior * a / (prior * a + (1 - prior) * b) for a, b in zip(m, u)]
        hit = [x * q for x, q in zip(n, p)]
        m = [(x + 1e-6) / (sum(hit) + 4e-6) for x in hit]
        prior = min(max(sum(hit) / sum(n), 1e-6), 0.5)
    return tuple(m), tuple(u)


def suggestions(records: DataFrame, *, decisions: DataFrame | None = None, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(entity_a, entity_b, score, reason) of pairs in the grey zone that nobody decided and that aren't suggested yet."""
    p = _decided(candidates(records, GREY, MERGE), decisions)
    if known is not None:
        seen = known.select(F.least("entity_a", "entity_b").alias("rid_a"), F.greatest("entity_a", "entity_b").alias("rid_b")).distinct()
        p = p.join(seen, ["rid_a", "rid_b"], "left_anti")
    out = p.select(F.col("rid_a").alias("entity_a"), F.col("rid_b").alias("entity_b"), F.round("score", 4).alias("score"), F.format_string("similarity %.3f", "score").alias("reason"))
    return out if limit is None else out.orderBy("entity_a", "entity_b").limit(limit)


def merge_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """entities after merges (keep, drop) of one type each: aliases united with the dropped name, external ids of the kept one win."""
    d = merges.join(entities, merges["drop"] == entities["id"]).select(F.col("keep").alias("id"), F.struct(F.col("drop"), "canonical_name", "aliases", F.array_sort(F.map_entries("external_ids")).alias("entries")).alias("d"), F.col("type").alias("dtype"))
    d = d.join(entities.select("id", F.col("type").alias("ktype")), "id").filter("dtype = ktype").groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("d"))
    gone = d.select(F.explode("d.drop").alias("id"))
    rows = entities.join(gone, "id", "left_anti").join(d, "id", "left")
    more = F.coalesce(F.flatten(F.transform("d", lambda x: F.concat(x["aliases"], F.array(x["canonical_name"])))), F.array().cast("array<string>"))
    aliases = F.array_sort(F.array_remove(F.array_distinct(F.concat("aliases", more)), F.col("canonical_name")))
    entries = F.coalesce(F.flatten(F.transform("d", lambda x: x["entries"])), F.array().cast("array<struct<key:string,value:string>>"))
    theirs = F.filter(entries, lambda e: ~F.map_contains_key("external_ids", e["key"]))
    first = F.map_from_entries(F.transform(F.array_distinct(F.transform(theirs, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(theirs, lambda e: e["key"] == k), 1)["value"].alias("value"))))
    return rows.withColumn("aliases", aliases).withColumn("external_ids", F.map_concat("external_ids", first)).drop("d")


def repoint(rows: DataFrame, merges: DataFrame, *columns: str) -> DataFrame:
    """rows whose columns name dropped entities, naming the kept ones."""
    for c in columns:
        m = merges.groupBy(F.col("drop").alias("_drop")).agg(F.min("keep").alias("_keep"))
        rows = rows.join(m, rows[c] == m["_drop"], "left").withColumn(c, F.coalesce("_keep", c)).drop("_drop", "_keep")
    return rows


def choose_kept(suggested: DataFrame, counts: DataFrame) -> DataFrame:
    """suggested (entity_a, entity_b) as (keep, drop): more claims stay, of equals the larger id."""
    n = lambda side: counts.select(F.col("entity_id").alias(side), F.col("n").alias(f"n_{side}"))
    rows = suggested.join(n("entity_a"), "entity_a", "left").join(n("entity_b"), "entity_b", "left")
    a, b = F.struct(F.coalesce("n_entity_a", F.lit(0)).alias("n"), F.col("entity_a").alias("id")), F.struct(F.coalesce("n_entity_b", F.lit(0)).alias("n"), F.col("entity_b").alias("id"))
    return rows.select(F.when(a >= b, F.col("entity_a")).otherwise(F.col("entity_b")).alias("keep"), F.when(a >= b, F.col("entity_b")).otherwise(F.col("entity_a")).alias("drop"))


def record_decisions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(key_a, key_b, decision) by sorted pair; new ones replace stored ones."""
    key = lambda d: d.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "decision")
    return key(stored).join(key(new), ["key_a", "key_b"], "left_anti").unionByName(key(new))


def upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing (id, type, canonical_name, aliases, external_ids) with incoming (type, canonical_name, aliases, external_ids, namespace, value).

    An incoming row whose anchor is known adds its aliases and external ids, its own winning; others are created, one for each anchor, by
    order of type, namespace and value, with ids after the greatest there is.
    """
    inc = incoming.groupBy("namespace", "value").agg(F.min_by(F.struct("type", "canonical_name", "external_ids"), F.struct("type", "canonical_name")).alias("x"), F.flatten(F.collect_list("aliases")).alias("more"))
    anchors = existing.select("id", F.explode("external_ids").alias("namespace", "value")).groupBy("namespace", "value").agg(F.min("id").alias("id"))
    found = inc.join(anchors, ["namespace", "value"])
    hit = found.groupBy("id").agg(F.flatten(F.collect_list("more")).alias("_more"), F.flatten(F.collect_list(F.map_entries("x.external_ids"))).alias("_ids"))
    old = existing.join(hit, "id", "left")
    more, ids = F.coalesce("_more", F.array().cast("array<string>")), F.coalesce("_ids", F.array().cast("array<struct<key:string,value:string>>"))
    keep = F.map_filter("external_ids", lambda k, v: ~F.exists(ids, lambda e: e["key"] == k))
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(ids, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(ids, lambda e: e["key"] == k), -1)["value"].alias("value"))))
    old = old.withColumn("aliases", F.array_sort(F.array_remove(F.array_distinct(F.concat("aliases", more)), F.col("canonical_name")))).withColumn("external_ids", F.map_concat(keep, last)).drop("_more", "_ids")
    top = existing.agg(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long"))).first()[0] or 0
    new = text.numbered(inc.join(anchors, ["namespace", "value"], "left_anti").select("x.*", "namespace", "value", "more"), ["type", "namespace", "value"], "n")
    anchor = F.create_map("namespace", "value")
    made = new.select(entity_id(F.col("type"), F.col("n") + top).alias("id"), "type", "canonical_name", F.array_sort(F.array_remove(F.array_distinct("more"), F.col("canonical_name"))).alias("aliases"), F.map_concat("external_ids", F.map_filter(anchor, lambda k, v: ~F.map_contains_key("external_ids", k))).alias("external_ids"))
    return old.unionByName(made)


def entity_id(kind: Column, n: Column) -> Column:
    prefix = F.when(kind == "Organization", "ORG").when(kind == "Person", "PER").when(kind == "Security", "SEC").when(kind == "Paper", "PAP").when(kind == "Author", "AUT").when(kind == "Institution", "INS").when(kind == "Concept", "CON").otherwise("ENT")
    return F.format_string("%s_%06d", prefix, n)


def find_by_external_id(entities: DataFrame, namespace: str, value: str) -> DataFrame:
    return entities.filter(F.col("external_ids")[namespace] == value).orderBy("id").limit(1)


def header_records(filings: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, entity_type, cik, mention_id, rank, doc, pos): mentions of organisations and persons, then filers, then subject companies."""
    m = mentions.filter(F.col("ner_type").isin("Organization", "Person")).select(F.col("surface_text").alias("name"), F.col("ner_type").alias("entity_type"), F.lit(None).cast("string").alias("cik"), F.col("id").alias("mention_id"), F.lit(0).alias("rank"), F.col("document_id").alias("doc"), F.lit(0).alias("pos"))
    def side(field: str, rank: int, kind) -> DataFrame:
        return filings.select("id", F.posexplode(f"meta.{field}").alias("pos", "p")).select(F.col("p.name").alias("name"), kind.alias("entity_type"), F.col("p.cik").alias("cik"), F.lit(None).cast("long").alias("mention_id"), F.lit(rank).alias("rank"), F.col("id").alias("doc"), "pos")
    return m.unionByName(side("filers", 1, text.guess_type(F.col("p.name")))).unionByName(side("subject_companies", 2, F.lit("Organization"))).filter("name is not null")


def name_index(entities: DataFrame) -> DataFrame:
    """(type, core, by_name): the least id of the entities that have a core among their names."""
    named = entities.select("type", "id", F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("n"))
    return named.select("type", text.core(F.col("n")).alias("core"), "id").groupBy("type", "core").agg(F.min("id").alias("by_name"))


def placed(records: DataFrame, existing: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, entity_id, known, type, canonical_name, aliases, cik): clusters matched to existing entities by cik, then by type and core of the
    canonical name or an alias; clusters of one type and core, and those of one cik, share a new id."""
    names = canonical(records, members).join(records.join(members, "rid").groupBy("cluster").agg(F.min_by("entity_type", "rid").alias("type")), "cluster")
    by_cik = existing.filter("external_ids['cik'] is not null").groupBy(F.expr("external_ids['cik']").alias("cik")).agg(F.min("id").alias("by_cik"))
    probe = names.select("cluster", "type", F.posexplode(F.concat(F.array("canonical_name"), "aliases")).alias("pos", "n")).withColumn("core", text.core(F.col("n"))).join(name_index(existing), ["type", "core"])
    probe = probe.groupBy("cluster").agg(F.min_by("by_name", "pos").alias("by_name"))
    rows = cut(names.join(by_cik, "cik", "left").join(probe, "cluster", "left").withColumn("known", F.coalesce("by_cik", F.when(F.col("cik").isNull(), F.col("by_name")))).withColumn("key", F.coalesce(F.concat(F.lit("cik:"), "cik"), F.concat(F.col("type"), F.lit(":"), text.core(F.col("canonical_name"))))))
    new = rows.filter("known is null").groupBy("key").agg(F.min_by("type", "cluster").alias("type"), F.min("cluster").alias("first"))
    top = existing.agg(F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long"))).first()[0] or 0
    new = text.numbered(new, ["first"], "n").select("key", entity_id(F.col("type"), F.col("n") + top).alias("made"))
    return rows.join(new, "key", "left").select("cluster", F.coalesce("known", "made").alias("entity_id"), F.col("known").isNotNull().alias("known"), "type", "canonical_name", "aliases", "cik")


def resolve(records: DataFrame, existing: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(rid, entity_id, confidence) by placed."""
    members = cut(clusters(records, decisions))
    return members.join(placed(records, existing, members).select("cluster", "entity_id"), "cluster").join(confidence(records, members), "cluster").select("rid", "entity_id", "confidence")


def materialize(records: DataFrame, existing: DataFrame, decisions: DataFrame | None = None, *, backend: str = "default") -> tuple[DataFrame, DataFrame]:
    """(entities, links): existing entities with the aliases that their clusters add, and those of the clusters without one; links as resolve gives them."""
    if backend == "probabilistic":
        sure = cut(probabilistic_clusters(records))
        members, sure = sure.select("rid", "cluster"), sure.select("cluster", "confidence").distinct()
    else:
        members = cut(clusters(records, decisions))
        sure = confidence(records, members)
    p = cut(placed(records, existing, members))
    links = members.join(p.select("cluster", "entity_id"), "cluster").join(sure, "cluster").select("rid", "entity_id", "confidence")
    grown = p.filter("known").groupBy(F.col("entity_id").alias("id")).agg(F.flatten(F.collect_list("aliases")).alias("_more"))
    old = existing.join(grown, "id", "left")
    old = old.withColumn("aliases", F.array_sort(F.array_remove(F.array_distinct(F.concat("aliases", F.coalesce("_more", F.array().cast("array<string>")))), F.col("canonical_name")))).drop("_more")
    made = p.filter("not known").groupBy(F.col("entity_id").alias("id")).agg(F.min_by("type", "cluster").alias("type"), F.min_by("canonical_name", "cluster").alias("canonical_name"), F.flatten(F.collect_list(F.concat("aliases", F.array("canonical_name")))).alias("all"), F.min("cik").alias("cik"))
    ids = F.when(F.col("cik").isNotNull(), F.create_map(F.lit("cik"), F.col("cik"))).otherwise(F.create_map().cast("map<string,string>"))
    new = made.select("id", "type", "canonical_name", F.array_sort(F.array_remove(F.array_distinct("all"), F.col("canonical_name"))).alias("aliases"), ids.alias("external_ids"))
    return old.select(*new.columns).unionByName(new), links


TRAIN_FROM = 500


def probabilistic_clusters(records: DataFrame, *, train: bool | None = None) -> DataFrame:
    """(rid, cluster, confidence): closure of the pairs that probably match and the star of each cik; the weights are fitted from TRAIN_FROM records on.

    Reviewers' decisions don't count here. Confidence is 1 with a cik or a single member, else 0.9.
    """
    if train is None:
        train = records.limit(TRAIN_FROM).count() >= TRAIN_FROM
    m, u = fit_weights(records) if train else (M_WEIGHTS, U_WEIGHTS)
    first = records.filter("cik is not null").groupBy("cik").agg(F.min("rid").alias("rid_a"))
    star = records.join(first, "cik").filter("rid <> rid_a").select("rid_a", F.col("rid").alias("rid_b"))
    comp = connected_components(probabilistic_pairs(records, m, u).select("rid_a", "rid_b").unionByName(star), src="rid_a", dst="rid_b")
    rows = records.select("rid", "cik").join(comp, F.col("rid") == F.col("node"), "left").select("rid", "cik", F.coalesce("component", "rid").alias("cluster"))
    sure = rows.groupBy("cluster").agg(F.when(F.max("cik").isNotNull() | (F.count(F.lit(1)) == 1), 1.0).otherwise(0.9).alias("confidence"))
    return rows.join(sure, "cluster").select("rid", "cluster", "confidence")


def header_cik_lookup(filings: DataFrame) -> DataFrame:
    """(id, name, cik) of a filing's header; of a name that occurs again the last cik counts."""
    parties = filings.select("id", F.posexplode(F.concat("meta.filers", "meta.subject_companies")).alias("pos", "p")).filter("p.name is not null and p.cik is not null")
    return parties.groupBy("id", F.col("p.name").alias("name")).agg(F.max_by("p.cik", "pos").alias("cik"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
