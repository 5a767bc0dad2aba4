"""Mixing sources to target weights: iterative proportional fitting, then sampling by the calibrated probabilities.

Tokens are summed by cell (source, language, topic). A round rakes the cells' weights to each marginal's target in turn and then holds
each at the tokens the cell has, since nothing is sampled twice. What is left of a cell's tokens is the probability of its documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table, uniform

FLATTEN, BUDGET, ROUNDS, MAX_LOCAL = 0.85, 0.7, 10, 200_000
DIMS = ("d_source", "d_lang", "d_topic")


def token_count(text: Column) -> Column:
    """Parts between blanks; none for a null or empty text."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


def lexical_topic(text: Column) -> Column:
    """legal, web, code or prose, by the first that its marks say."""
    has = lambda *marks: reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks))
    return F.when(has("icense", "opyright"), "legal").when(has("://", "@"), "web").when(has("{", "="), "code").otherwise("prose")


def _targets(values: np.ndarray, codes: np.ndarray, names: list, given: dict | None, flatten: float) -> np.ndarray:
    share = np.bincount(codes, weights=values, minlength=len(names))
    t = np.array([float(given.get(x, 0.0)) for x in names]) if given is not None else np.where(share > 0, np.maximum(share, 1e-300) ** flatten, 0.0)
    return t / t.sum() if t.sum() > 0 else t


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], *, budget: float = BUDGET, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the cells; codes and targets (shares) by marginal. A marginal without weight stays without."""
    w = tokens.astype(np.float64)
    goal = budget * w.sum()
    for _ in range(rounds):
        for c, t in zip(codes, targets):
            s = np.bincount(c, weights=w, minlength=len(t))
            w = w * np.divide(t * goal, s, out=np.zeros(len(t)), where=s > 0)[c]
        w = np.minimum(w, tokens)
    return w


def _rake_frame(cells: DataFrame, given: list[dict | None], flatten: float, budget: float, rounds: int) -> DataFrame:
    """The same over more cells than the driver should hold; each round ends in files."""
    spark = cells.sparkSession
    goal = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    targets = []
    for dim, g in zip(DIMS, given):
        t = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(flatten)).alias("t")) if g is None else spark.createDataFrame([(k, float(v)) for k, v in g.items()], f"{dim} string, t double").join(cells.select(dim).distinct(), dim, "left_semi")  # as _targets, over the values that there are
        targets.append(materialize(t.withColumn("t", F.col("t") / (t.agg(F.sum("t")).first()[0] or 1.0))))
    now = materialize(cells.withColumn("w", F.col("tokens").cast("double")))
    for _ in range(rounds):
        w = now
        for dim, t in zip(DIMS, targets):
            w = w.join(w.groupBy(dim).agg(F.sum("w").alias("s")), dim).join(t, dim, "left")
            w = w.withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.coalesce("t", F.lit(0.0)) * goal / F.col("s")).otherwise(0.0)).select(*DIMS, "tokens", "w")
        after = materialize(w.withColumn("w", F.least("w", F.col("tokens").cast("double"))))
        discard(now)
        now = after
    return now


def probabilities(docs: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, flatten: float = FLATTEN, budget: float = BUDGET, rounds: int = ROUNDS, max_local: int = MAX_LOCAL) -> DataFrame:
    """docs, which has the columns of DIMS and n_tokens, with the column probability."""
    cells = docs.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    given = [(targets or {}).get(d.removeprefix("d_")) for d in DIMS]
    rows = cells.limit(max_local + 1).toPandas()  # more cells than that are raked where they are
    if len(rows) <= max_local:
        rows = rows.sort_values(list(DIMS), ignore_index=True)
        tokens = rows["tokens"].to_numpy().astype(np.float64)
        codes, goals = [], []
        for dim, g in zip(DIMS, given):
            names, c = np.unique(rows[dim].to_numpy(dtype=object), return_inverse=True)
            codes.append(c)
            goals.append(_targets(tokens, c, list(names), g, flatten))
        w = rake(tokens, codes, goals, budget=budget, rounds=rounds)
        rows["probability"] = np.divide(w, tokens, out=np.ones(len(w)), where=tokens > 0)
        raked = docs.sparkSession.createDataFrame(rows[[*DIMS, "probability"]], ", ".join(f"{d} string" for d in DIMS) + ", probability double")
        return docs.join(F.broadcast(raked), list(DIMS))
    raked = _rake_frame(materialize(cells), given, flatten, budget, rounds)
    return docs.join(raked.select(*DIMS, F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0).alias("probability")), list(DIMS))


def _marked(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), name(source_col).alias("d_source"), name(lang_col).alias("d_lang"), F.coalesce(lexical_topic(F.col(text_col)) if topic is None else topic.cast("string"), F.lit("")).alias("d_topic"), token_count(F.col(text_col)).alias("n_tokens")
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, **kw) -> DataFrame:
    """(id, source, lang, topic, n_tokens, probability) of the documents that are sampled: those whose id's hash, in [0, 1), is below probability.

    targets: shares for 'source', 'lang' and 'topic', each by value; a marginal without any gets its own shares to the power
    flatten, so that large ones shrink. The sample's expected tokens are budget times all, and its marginals the targets,
    except where a value has fewer tokens than its target: it is then kept whole. Null values are the value ''. A null text has no tokens and
    the topic prose; a cell without tokens is kept. Rows that repeat an id share their fate; rows with a null id have the hash of ''. Other columns,
    whatever their names, are dropped. An empty table gives an empty result.
    """
    chosen = probabilities(_marked(docs, id_col, text_col, source_col, lang_col, topic), **kw).filter(uniform(F.coalesce(F.col("id").cast("string"), F.lit(""))) < F.col("probability"))
    return chosen.select(F.col("id").alias(id_col), F.col("d_source").alias("source"), F.col("d_lang").alias("lang"), F.col("d_topic").alias("topic"), "n_tokens", F.round("probability", 6).alias("probability"))


def keep_sampled(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **kw) -> DataFrame:
    """The rows of docs, all columns, that mix samples.

    Nulls in any column count as there. Rows that repeat an id stay or go together, each as its own text's cell says; extra columns, whatever their
    names, are kept as they are; an empty table stays empty.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    flat = packed.select("row", F.col(f"row.`{id_col}`").alias("id"), F.coalesce(F.col(f"row.`{source_col}`").cast("string"), F.lit("")).alias("d_source"), F.coalesce(F.col(f"row.`{lang_col}`").cast("string"), F.lit("")).alias("d_lang"), F.coalesce(lexical_topic(F.col(f"row.`{text_col}`")), F.lit("")).alias("d_topic"), token_count(F.col(f"row.`{text_col}`")).alias("n_tokens"))
    return probabilities(flat, **kw).filter(uniform(F.coalesce(F.col("id").cast("string"), F.lit(""))) < F.col("probability")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_sql(source: str = "documents", *, columns: str | None = None) -> str:
    """DuckDB SQL of mix over the table or subquery source; columns: what to select of the sampled rows instead."""
    w = [
        f"""marked as materialized (select *, coalesce(cast(source as varchar), '') as d_source, coalesce(cast(lang as varchar), '') as d_lang,
  case when contains(text, 'icense') or contains(text, 'opyright') then 'legal' when contains(text, '://') or contains(text, '@') then 'web'
    when contains(text, '{{') or contains(text, '=') then 'code' else 'prose' end as d_topic,
  case when length(text) > 0 then length(text) - length(replace(text, ' ', '')) + 1 else 0 end as n_tokens from {source})""",
        "w0 as materialized (select d_source, d_lang, d_topic, sum(n_tokens)::double as tokens, sum(n_tokens)::double as w from marked group by all)",
        f"goal as materialized (select {BUDGET} * sum(tokens) as goal from w0)",
    ]
    for d in DIMS:
        w.append(f"t_{d} as materialized (select {d}, case when s > 0 then pow(s, {FLATTEN}) else 0 end / sum(case when s > 0 then pow(s, {FLATTEN}) else 0 end) over () as t from (select {d}, sum(tokens) as s from w0 group by 1))")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            new = f"case when sum(w) over (partition by {d}) > 0 then w * (t * goal / sum(w) over (partition by {d})) else 0 end"
            if d == DIMS[-1]:
                new = f"least({new}, tokens)"
            w.append(f"w{n + 1} as materialized (select d_source, d_lang, d_topic, tokens, {new} as w from w{n} join t_{d} using ({d}), goal)")
            n += 1
    return f"""with {', '.join(w)}, sampled as (
  select m.*, case when tokens > 0 then w / tokens else 1 end as probability from marked m join w{n} using (d_source, d_lang, d_topic)
  where cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) / 4294967296.0 < case when tokens > 0 then w / tokens else 1 end)
select {columns or 'doc_id, d_source as source, d_lang as lang, d_topic as topic, n_tokens, round(probability, 6) as probability'} from sampled"""
