"""Text as columns: names, check digits, spans with offsets, dates. All of it runs in the JVM.

Offsets count code points from 0, ends excluded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import cut

SUFFIX_WORDS = "ag and capital co company corp corporation fund gmbh group holdings inc incorporated limited llc llp lp ltd management nv partners plc sa the trust".split()
ORG_MARKS = "capital company corp fund group holdings inc l.p. llc lp ltd management partners plc trust".split()
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
LONG_DATE = "(?:" + "|".join(MONTHS) + r")\s+[0-9]{1,2},\s+[0-9]{4}"
PERCENT = r"[0-9]{1,3}(?:[.][0-9]{1,3})?\s*%"


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with numbers from 1 on in a total order, without one task that holds them all: ranges are sorted and written, counted, then numbered from their counts.

    The ranges are written once, as their bounds are sampled and another reading of rows could part them elsewhere.
    """
    at = F.monotonically_increasing_id()  # the partition from bit 33 on, the place within it below
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", 33)
    before = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inner + 1).drop("_part", "_at", "_before")


def pinned(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are worked out once for each row: what reads or filters them later is not given their expressions to repeat, as it is with withColumn."""
    return rows.select(*(c for c in rows.columns if c not in columns), F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized(name: Column) -> Column:
    """Lower case, marks as blanks, one blank between words."""
    return stripped(F.regexp_replace(F.regexp_replace(F.lower(name), r"""[.,/&()'"\-]""", " "), r"(?U)\s+", " "))


def core(name: Column) -> Column:
    """The words that aren't legal suffixes or single characters; where none is left, all of them."""
    n = normalized(name)
    kept = F.filter(F.split(n, " "), lambda t: (~t.isin(SUFFIX_WORDS)) & (F.length(t) > 1))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(n)


def block_key(name: Column) -> Column:
    return F.substring(F.element_at(F.split(core(name), " "), 1), 1, 6)


def guess_type(name: Column) -> Column:
    """Organization where a mark of one occurs anywhere in the name, inside words too; else Person."""
    return F.when(F.lower(name).rlike("|".join(m.replace(".", r"\.") for m in ORG_MARKS)), "Organization").otherwise("Person")


#: Surfaces that name no entity.
STOP = """common stock|d.c.|filing person|filing persons|issuer|company|ordinary shares|reporting person|reporting persons|schedule 13d|schedule 13g|sec
securities & exchange commission|securities and exchange commission|the commission|the company|the issuer|the reporting person|the reporting persons|the securities|the shares|united states|washington""".replace("\n", "|").split("|")


def is_noise(surface: Column, kind: Column, stop: list[str] = STOP) -> Column:
    s = F.lower(stripped(surface))
    return kind.isin("Organization", "Person") & (s.isin(stop) | (F.length(s) < 3))


def cusip_check_digit(base: Column) -> Column:
    """Of eight characters; null where one has no value."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55).when(c == "*", 36).when(c == "@", 37).when(c == "#", 38)
    digits = lambda b: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: let(F.substr(b, i, F.lit(1)), value) * F.when(i % 2 == 0, 2).otherwise(1))
    total = lambda b: F.aggregate(digits(b), F.lit(0), lambda a, v: a + F.floor(v / 10).cast("int") + v % 10)
    return let(base, lambda b: F.when(F.length(b) == 8, (10 - total(b) % 10) % 10))


def valid_cusip(c: Column) -> Column:
    return F.coalesce((F.length(c) == 9) & (F.substring(c, 9, 1) == cusip_check_digit(F.substring(c, 1, 8)).cast("string")), F.lit(False))


def spans(text: Column, pattern: str) -> Column:
    """Every match of a pattern as an array of (start, end, surface)."""
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + pair["gap"]
        end = at + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end"), pair["hit"].alias("surface")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,surface:string>>").alias("out"))
    pairs = F.transform(hits, lambda h, i: F.struct(F.get(gaps, i).alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def line_before(text: Column, label: str, reach: int = 200) -> Column:
    """(start, end, surface) of the last non-empty line within reach before the first label; null without one."""
    def placed(w: Column, line: Column) -> Column:
        # the last place of the line: the first of its mirror image
        start = w["lo"] + F.length(w["text"]) - (F.instr(F.reverse(w["text"]), F.reverse(line)) - 1) - F.length(line)
        return F.when(line.isNotNull(), F.struct(start.cast("int").alias("start"), (start + F.length(line)).cast("int").alias("end"), line.alias("surface")))

    def window(at: Column) -> Column:
        lo = F.greatest(at - 1 - reach, F.lit(0))
        return F.struct(lo.alias("lo"), F.when(at > 0, F.substr(text, lo + 1, at - 1 - lo)).alias("text"))

    lines = lambda w: F.filter(F.transform(F.split(w["text"], r"\R"), stripped), lambda x: x != "")
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    return let(let(F.locate(label, text), window), lambda w: let(let(lines(w), last), lambda line: placed(w, line)))


def first_long_date(text: Column) -> Column:
    found = lambda d, start: F.when(d != "", F.struct(start.alias("start"), (start + F.length(d)).alias("end"), d.alias("surface")))
    return let(F.regexp_extract(text, f"({LONG_DATE})", 1), lambda d: found(d, F.instr(text, d) - 1))


def parsed_date(surface: Column) -> Column:
    """A long-form or abbreviated month, day and year; null for others."""
    s = F.regexp_replace(surface, r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(s, F.lit("MMMM d, yyyy")), F.try_to_timestamp(s, F.lit("MMM d, yyyy"))).cast("date")


def iso_date(x: Column) -> Column:
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x.try_cast("date"))


POSITIVE = r"(?i)aggregate amount|beneficial|of the (?:issue[dr]|outstanding)|percent of class|represent|row [(]11[)]|shares outstanding"
NEGATIVE = r"(?i)at least|coupon|discount|equal to|exceed|greater than|interest|premium|prime|rate|tax"
CLASS_LABEL = r"Row [(]1[13][)]|Percent of Class"


def percent_candidates(text: Column) -> Column:
    """Array of (value, start, end, score): how much each percentage looks like a share of a class."""
    def scored(s: Column, labels: Column) -> Column:
        lo = F.greatest(s["start"] - 80, F.lit(0))
        known = F.struct(F.substr(text, lo + 1, s["end"] + 40 - lo).alias("around"), F.regexp_extract(s["surface"], r"([0-9.]+)", 1).cast("double").alias("value"))
        return let(known, lambda k: judged(s, labels, k["around"], k["value"]))

    def judged(s: Column, labels: Column, around: Column, value: Column) -> Column:
        lo3 = F.greatest(s["start"] - 30, F.lit(0))
        blank = F.regexp_replace(F.substr(text, lo3 + 1, s["start"] - lo3), r"(?U)\s", "") == ""
        after = F.substr(text, s["end"] + 1, F.lit(8))
        score = (
            F.when(around.rlike(POSITIVE), 1.0).otherwise(0.0) - F.when(around.rlike(NEGATIVE), 1.0).otherwise(0.0) + F.when(F.exists(labels, lambda p: F.abs(s["start"] - p) <= 400), 0.8).otherwise(0.0)
            + F.when(blank & after.rlike(r"^\s*(?:[(][0-9]+[)]\s*)?$"), 0.7).otherwise(0.0) - F.when((value > 100) | (value == 0), 1.0).otherwise(0.0)
        )
        return F.struct(value.alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.round(score, 4).alias("score"))
    labels = F.transform(spans(text, CLASS_LABEL), lambda x: x["start"])
    return let(labels, lambda ls: F.transform(spans(text, PERCENT), lambda s: scored(s, ls)))


def best_percent(candidates: Column) -> Column:
    """The candidate with the highest score above 0, the first of equals; null without one."""
    good = F.filter(candidates, lambda c: c["score"] > 0)
    top = F.array_max(F.transform(good, lambda c: F.struct(c["score"].alias("score"), (-c["start"]).alias("back"), c.alias("c"))))
    return top["c"]


CUSIP_BEFORE = r"([a-zA-Z0-9][a-zA-Z0-9 ]{6,14}?)\s*[(]\s*CUSIP\s*(?:No[.]?|Number)?\s*[)]"


def extract_cusip(text: Column) -> Column:
    """(cusip, valid) of the first candidate before its label that checks, else of the first of nine characters; null without one."""
    c = F.transform(F.regexp_extract_all(text, F.lit(CUSIP_BEFORE), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    c = F.filter(c, lambda x: F.length(x) == 9)
    best = lambda c: F.struct(F.get(F.filter(c, valid_cusip), F.lit(0)).alias("good"), F.get(c, F.lit(0)).alias("first"))
    pick = lambda b: F.coalesce(b["good"], b["first"])
    return let(let(c, best), lambda b: F.when(pick(b).isNotNull(), F.struct(pick(b).alias("cusip"), b["good"].isNotNull().alias("valid"))))


def ground_exact(text: Column, quote: Column) -> Column:
    """(start, end, snippet) of a trimmed quote's first place; null where it isn't or is empty."""
    q = stripped(quote)
    at = F.instr(text, q)
    return F.when((at > 0) & (F.length(q) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(q)).alias("end"), q.alias("snippet")))


def ground_flexible(text: Column, quote: Column) -> Column:
    """The same where white space may differ in kind and length."""
    words = F.transform(F.split(stripped(quote), r"(?U)\s+"), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.array_join(words, r"(?U:\s+)")
    hit = F.regexp_substr(text, pattern)
    at = F.instr(text, hit)
    return F.when(hit.isNotNull() & (F.length(stripped(quote)) > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(hit)).alias("end"), hit.alias("snippet")))


def short_id(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def abstract(index: Column) -> Column:
    """Words of an inverted index in order; equal places by word."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " ")
