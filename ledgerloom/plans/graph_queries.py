"""Registered queries of the graph and the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, vectors
from ..operators.components import cut
from . import views as V
from .ledger_queries import DAY, VALID, _with

ROUNDS = 5


def claim_graph(spark, d):
    from ..operators import ledger

    return graph.project(ledger.reconcile(V.claims(spark, d)), V.entities(spark, d), V.evidence(spark, d), on=DAY)


PROJECTED = f"valid as (select * from reconciled where retracted_at is null and {VALID}), ends as (select subject_id as id from valid union all select object_id from valid)"
CG = _with(V.CLAIMS, V.RECONCILED, V.ENTITIES, PROJECTED)


def pagerank_sql() -> str:
    parts = [V.TRADE, "deg as materialized (select src, count(*) as o from edge group by 1)", "node as materialized (select distinct id from (select src as id from edge union all select dst from edge))", "cnt as materialized (select count(*) as n from node)", "r0 as materialized (select id, 1.0 / n as score from node, cnt)"]
    for i in range(ROUNDS):
        parts.append(f"r{i + 1} as materialized (select r.id, 0.15 / n + 0.85 * loose / n + 0.85 * coalesce(got, 0) as score from r{i} r cross join cnt cross join (select coalesce(sum(score), 0) as loose from r{i} where id not in (select src from deg)) left join (select e.dst as id, sum(r.score / o) as got from edge e join deg d using (src) join r{i} r on r.id = e.src group by 1) using (id))")
    return f"with {', '.join(parts)} select id, round(score, 10) as score from r{ROUNDS}"


def vector_knn(spark, d):
    e = V.table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").first()["embedding"]
    return vectors.search(e, q, 10, id_col="vec_id")


def entity_text(spark, d):
    p = V.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), vectors.entity_text(F.col("p_name"), F.array(F.col("p_brand"), F.col("p_name"), F.lit(""), F.col("p_type"))).alias("text"))


def entity_vectors(spark, d):
    return vectors.build_entity_vectors(V.entities(spark, d)).select("id", "text", F.size("embedding").alias("dim"))


def search(spark, d):
    return vectors.search_entities(vectors.build_entity_vectors(V.entities(spark, d)), "Organization 3", 5)


def central(spark, d):
    return graph.degree(V.trade_edges(spark, d)).orderBy(F.desc("degree"), "id").limit(20)


def summary(spark, d):
    e = cut(V.trade_edges(spark, d))
    return graph.summary(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)


COMPONENTS = V.TRADE + """, u as (select src as a, dst as b from edge union select dst, src from edge), reach as (select a as id, a as label from u union select u.b, r.label from reach r join u on u.a = r.id where r.label < u.b)"""


Q = {
    "graph_nodes": (lambda s, d: claim_graph(s, d)[0], f"{CG} select id, canonical_name as label, type, cik from entity where id in (select id from ends)"),
    "graph_edges": (lambda s, d: claim_graph(s, d)[1].select("claim_id", "src", "dst", "predicate", "stake_pct", "evidence_count"), f"{CG}, {V.EVIDENCE} select v.id as claim_id, subject_id as src, object_id as dst, predicate, stake_pct, cast(e.claim_id is not null as bigint) as evidence_count from valid v left join evidence e on e.claim_id = v.id"),
    "graph_degree": (lambda s, d: graph.degree(claim_graph(s, d)[1]), f"{CG} select id, count(*) as degree from ends group by 1"),
    "graph_json": (lambda s, d: graph.to_json(*claim_graph(s, d))[0].select("id", F.get_json_object("json", "$.label").alias("label"), F.get_json_object("json", "$.degree").cast("long").alias("degree")), f"{CG} select id, canonical_name as label, n as degree from entity join (select id, count(*) as n from ends group by 1) using (id)"),
    "ego_graph_r1": (lambda s, d: graph.ego(V.trade_edges(s, d), "C7", 1), f"{_with(V.TRADE)} select * from edge where src = 'C7'"),
    "ego_graph_r2": (lambda s, d: graph.ego(V.trade_edges(s, d), "C7", 2), f"{_with(V.TRADE)}, sup as (select dst from edge where src = 'C7'), cus as (select distinct src from edge where dst in (select dst from sup)) select * from edge where src in (select src from cus) and dst in (select dst from sup)"),
    "centrality_top": (central, f"{_with(V.TRADE)} select id, count(*) as degree from (select src as id from edge union all select dst from edge) group by 1 order by 2 desc, 1 limit 20"),
    "pagerank_fixed_iter": (lambda s, d: graph.pagerank(V.trade_edges(s, d), rounds=ROUNDS, tolerance=None).select("id", F.round("score", 10).alias("score")), pagerank_sql()),
    "pagerank": (lambda s, d: graph.pagerank(V.trade_edges(s, d)), None),
    "betweenness": (lambda s, d: graph.betweenness(cut(V.trade_edges(s, d))), None),
    "communities": (lambda s, d: graph.communities(V.trade_edges(s, d)), None),
    "interlocks": (lambda s, d: graph.interlocks(V.trade_edges(s, d)).withColumn("targets", F.array_join("targets", ",")), f"{_with(V.TRADE)} select src as id, count(*) as n_targets, array_to_string(list_sort(list(dst))[1:25], ',') as targets from edge group by 1 having count(*) >= 2 order by 2 desc, 1 limit 50"),
    "components": (lambda s, d: graph.components(V.trade_edges(s, d)), f"with recursive {V.TRADE}, u as materialized (select src as a, dst as b from edge union select dst, src from edge), hub as (select min(a) as m from u), reach as (select m as id from hub union select u.b from reach join u on u.a = reach.id) select a as node, m as component from (select distinct a from u) join hub on true where a in (select id from reach)"),
    "graph_summary": (summary, None),
    "vector_knn": (vector_knn, "with q as (select embedding as v from embeddings where vec_id = 0) select vec_id as id, round(list_cosine_similarity(cast(embedding as double[]), cast(v as double[])), 4) as score from embeddings, q order by list_cosine_similarity(cast(embedding as double[]), cast(v as double[])) desc, vec_id limit 10"),
    "entity_text": (entity_text, "select p_partkey as id, concat_ws(' | ', p_name, case when p_brand <> p_name then p_brand end, case when p_type not in (p_name, p_brand) then p_type end) as text from part"),
    "stable_vector_id": (lambda s, d: V.table(s, d, "part").select("p_name", vectors.stable_id(F.col("p_name")).alias("vid")), "select p_name, cast('0x' || substr(sha1(p_name), 1, 15) as bigint) as vid from part"),
    "entity_vectors": (entity_vectors, f"{_with(V.ENTITIES)} select id, canonical_name as text, 64 as dim from entity"),
    "entity_search": (search, None),
}
