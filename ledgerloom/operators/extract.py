"""Claims and mentions out of texts: rules, windows of text, works' structure, and models that are passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text

PREDICATES = ["OWNS", "CONTROLS", "BENEFICIAL_OWNER_OF", "PARENT_OF", "SUBSIDIARY_OF", "OFFICER_OF", "BOARD_MEMBER_OF", "AFFILIATE_OF", "FILED", "ACQUIRED"]
ENTITY_TYPES = ["Person", "Organization", "Security"]
WORK_PREDICATES = ["CITES", "AUTHORED", "MENTIONS_CONCEPT", "AFFILIATED_WITH"]
WORK_TYPES = ["Concept", "Institution", "Author", "Paper"]
CHUNK, OVERLAP, PROMPT = 1200, 150, 18_000


def parse_filing(filings: DataFrame) -> DataFrame:
    """filings (id, text) with issuer, cusip, event_date, candidates and best."""
    t = F.col("text")
    out = text.pinned(filings, text=t).withColumn("issuer", text.line_before(t, "(Name of Issuer)")).withColumn("cusip", text.extract_cusip(t)).withColumn("event_date", text.first_long_date(t)).withColumn("candidates", text.percent_candidates(t))
    return out.withColumn("best", text.best_percent(F.col("candidates")))


def rule_claims(parsed: DataFrame) -> DataFrame:
    """(document_id, subject_surface, predicate, object_surface, stake_pct, event_date, cusip, valid_from, confidence, evidence_quote): each
    filer owns of each subject company, by the best percentage, or with less confidence by the issuer's name; without either, nothing."""
    quote = F.when(F.col("best").isNotNull(), F.substr("text", F.col("best.start") + 1, F.col("best.end") - F.col("best.start"))).otherwise(F.col("issuer.surface"))
    rows = text.pinned(text.pinned(parsed, best=F.col("best")), quote=quote).filter("quote is not null").select("*", F.explode("meta.subject_companies").alias("s")).select("*", F.explode("meta.filers").alias("f")).filter("s.name <> '' and f.name <> ''")
    return rows.select(
        F.col("id").alias("document_id"), F.col("f.name").alias("subject_surface"), F.lit("OWNS").alias("predicate"), F.col("s.name").alias("object_surface"), F.col("best.value").alias("stake_pct"), F.col("event_date.surface").alias("event_date"), F.col("cusip.cusip").alias("cusip"),
        text.parsed_date(F.col("event_date.surface")).alias("valid_from"), F.when(F.col("best").isNotNull(), 0.9).otherwise(0.6).alias("confidence"), F.col("quote").alias("evidence_quote"),
    )


def chunks(documents: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, start, chunk): windows of size characters, overlap shared with the one before; the last ends with the text."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - size) / step), F.lit(0)).cast("int")
    return documents.filter(F.length("text") > 0).select("id", "text", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).alias("start")).select("id", "start", F.substr("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


NAME_RUN = r"\p{Lu}[\p{L}\d&.'-]*(?:[ ]\p{Lu}[\p{L}\d&.'-]*)+"
MONEY = r"[$€£]\s?\d[\d,.]*\d|[$€£]\s?\d"
RULES = [("PERCENT", text.PERCENT), ("MONEY", MONEY), ("DATE", text.LONG_DATE)]


def rule_mentions(documents: DataFrame) -> DataFrame:
    """(document_id, surface_text, char_start, char_end, ner_type): runs of capitalised words, percentages, sums and dates, with exact offsets.

    Stands in where no model is given; a surface that names nothing is dropped, and of equal spans the first kind stays.
    """
    def found(pattern: str, kind) -> Column:
        return F.transform(text.spans(F.col("text"), pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["surface"].alias("surface"), kind(s["surface"]).alias("kind")))

    kinds = [found(p, lambda _, k=k: F.lit(k)) for k, p in RULES]
    named = found(NAME_RUN, text.guess_type)
    rows = text.pinned(documents.select("id", "text"), all=F.concat(*kinds, named)).select(F.col("id").alias("document_id"), F.posexplode("all").alias("pos", "m")).select("document_id", "pos", "m.*")
    once = rows.groupBy("document_id", "start", "end").agg(F.min_by(F.struct("surface", "kind"), "pos").alias("m"))
    out = once.select("document_id", F.col("m.surface").alias("surface_text"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.col("m.kind").alias("ner_type"))
    return out.filter(~text.is_noise(F.col("surface_text"), F.col("ner_type")))


def model_mentions(documents: DataFrame, make: Callable[[], Callable[[str], list[tuple[int, int, str, float]]]], *, labels: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """Mentions by a model, made once for each task, over chunks; offsets rebased, those that drift from the text dropped."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            rows = []
            for ident, start, chunk in zip(f["id"], f["start"], f["chunk"]):
                for a, b, label, score in model(chunk):
                    if score >= threshold and label in labels and 0 <= a < b <= len(chunk):
                        rows.append((ident, chunk[a:b], int(start) + a, int(start) + b, labels[label], float(score)))
            yield pd.DataFrame(rows, columns=["document_id", "surface_text", "char_start", "char_end", "ner_type", "score"])
    kind = documents.schema["id"].dataType.simpleString()
    rows = chunks(documents).mapInPandas(run, f"document_id {kind}, surface_text string, char_start int, char_end int, ner_type string, score double")
    rows = rows.groupBy("document_id", "char_start", "char_end").agg(F.max_by(F.struct("surface_text", "ner_type", "score"), "score").alias("m")).select("document_id", "m.surface_text", "char_start", "char_end", "m.ner_type", "m.score")
    return rows.filter(~text.is_noise(F.col("surface_text"), F.col("ner_type")))


def model_claims(documents: DataFrame, make: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Claims by a language model that is passed in, over the head of each text that its window holds; rows that fail its schema are dropped."""
    names = ["subject_surface", "predicate", "object_surface", "evidence_quote"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            rows = []
            for ident, t in zip(f["id"], f["text"]):
                for c in model((t or "")[:PROMPT]):
                    conf = c.get("confidence", 0.8)
                    if c.get("subject_surface") and c.get("predicate") and c.get("evidence_quote") and 0 <= conf <= 1:
                        rows.append((ident, *(c.get(n) for n in names), float(conf)))
            yield pd.DataFrame(rows, columns=["document_id", *names, "confidence"])
    kind = documents.schema["id"].dataType.simpleString()
    return documents.select("id", "text").mapInPandas(run, f"document_id {kind}, " + ", ".join(f"{n} string" for n in names) + ", confidence double")


def grounded(claims: DataFrame, documents: DataFrame, *, predicates: list[str] = PREDICATES) -> DataFrame:
    """claims whose predicate is known and whose quote is in the text, exactly, but for white space, or else nearly (similarity.ground_fuzzy), with its span."""
    rows = claims.filter(F.col("predicate").isin(predicates)).join(documents.select(F.col("id").alias("document_id"), "text"), "document_id")
    span = F.coalesce(text.ground_exact(F.col("text"), F.col("evidence_quote")), text.ground_flexible(F.col("text"), F.col("evidence_quote")))
    rows = rows.withColumn("span", span)
    # a null text is not searched: Python functions run for every row of a coalesce
    near = similarity.ground_fuzzy(F.when(F.col("span").isNull(), F.col("text")), F.col("evidence_quote"))
    near = F.when(near.isNotNull(), F.struct(near["start"].alias("start"), near["end"].alias("end"), near["snippet"].alias("snippet")))
    return rows.withColumn("span", F.coalesce("span", near)).filter("span is not null").drop("text")


def render_works(works: DataFrame) -> DataFrame:
    """(id, text, meta): a work as text, sections that are empty left out, and the structure that its claims come from."""
    short = text.short_id
    title = F.coalesce("title", F.lit(""))
    body = text.abstract(F.col("abstract_inverted_index"))
    authors = F.transform("authorships", lambda a: F.struct(short(a["author"]["id"]).alias("id"), F.coalesce(a["author"]["display_name"], F.lit("")).alias("name"), F.transform(a["institutions"], lambda i: F.struct(short(i["id"]).alias("id"), i["display_name"].alias("name"))).alias("institutions")))
    refs = F.transform("referenced_works", short)
    concepts = F.transform(F.slice("concepts", 1, 8), lambda c: F.struct(short(c["id"]).alias("id"), c["display_name"].alias("name")))
    rows = works.select("id", title.alias("t"), F.coalesce(body, F.lit("")).alias("b"), F.coalesce(authors, F.array().cast("array<struct<id:string,name:string,institutions:array<struct<id:string,name:string>>>>")).alias("a"), F.coalesce(refs, F.array().cast("array<string>")).alias("r"), F.coalesce(concepts, F.array().cast("array<struct<id:string,name:string>>")).alias("c"), "doi", "publication_date")
    joined = lambda xs: F.array_join(F.filter(xs, lambda x: x != ""), "; ")
    pairs = F.flatten(F.transform("a", lambda a: F.transform(F.filter(a["institutions"], lambda i: (a["name"] != "") & (i["name"] != "")), lambda i: F.concat_ws(" — ", a["name"], i["name"]))))
    lines = F.array(
        F.concat(F.lit("TITLE: "), "t", F.lit("\n")), F.when(F.col("b") != "", F.concat(F.lit("ABSTRACT: "), "b", F.lit("\n"))), F.concat(F.lit("AUTHORS: "), joined(F.transform("a", lambda a: a["name"]))), F.when(F.size(pairs) > 0, F.concat(F.lit("AFFILIATIONS: "), F.array_join(pairs, "; "))),
        F.when(F.size("c") > 0, F.concat(F.lit("CONCEPTS: "), joined(F.transform("c", lambda c: c["name"])))), F.when(F.size("r") > 0, F.concat(F.lit("REFERENCES: "), F.array_join("r", "; "))),
    )
    doi = F.regexp_replace("doi", r"^https?://[^/]+/", "")
    return rows.select(short(F.col("id")).alias("id"), F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("text"), F.struct(short(F.col("id")).alias("work"), doi.alias("doi"), F.col("t").alias("title"), "publication_date", F.col("a").alias("authors"), F.col("r").alias("references"), F.col("c").alias("concepts")).alias("meta"))


def work_claims(rendered: DataFrame) -> DataFrame:
    """(document_id, subject, predicate, object, quote, start, end, valid_from): who wrote what where, concepts and citations, each with its place in the text."""
    d = rendered.select(F.col("id").alias("document_id"), "text", "meta", F.col("meta.publication_date").cast("date").alias("valid_from"))
    a = d.select("*", F.explode("meta.authors").alias("a")).filter("a.name <> ''")
    author = F.coalesce("a.id", "a.name")
    row = lambda df, s, p, o, q: df.select("document_id", "text", "valid_from", s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), q.alias("quote"))
    i = a.select("*", F.explode("a.institutions").alias("i")).filter("i.name <> ''")
    c = d.select("*", F.explode("meta.concepts").alias("c")).filter("c.name <> '' and c.id <> ''")
    r = d.select("*", F.explode("meta.references").alias("r")).filter("r <> ''")
    work = F.col("meta.work")
    out = row(a, author, "AUTHORED", work, F.col("a.name")).unionByName(row(i, author, "AFFILIATED_WITH", F.coalesce("i.id", "i.name"), F.concat_ws(" — ", "a.name", "i.name"))).unionByName(row(c, work, "MENTIONS_CONCEPT", F.col("c.id"), F.col("c.name"))).unionByName(row(r, work, "CITES", F.col("r"), F.col("r")))
    return out.withColumn("g", text.ground_exact(F.col("text"), F.col("quote"))).filter("g is not null").select("document_id", "subject", "predicate", "object", "quote", F.col("g.start").alias("start"), F.col("g.end").alias("end"), "valid_from")
