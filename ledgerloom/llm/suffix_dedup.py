"""Repeated passages by suffix arrays, which external induced sorting makes shard by shard.

1. Each window of min_words words is assigned to its least run of K words (the leftmost, by hash): its anchor. Windows with the same
   words have the same anchor at the same place, so a window's repeats are all among the fragments (stretches of windows of
   one anchor) of that anchor, and hashing anchors to shards loses none.
2. Fragments with equal words are one, with its least place and whether it has another. Anchors with a single occurrence hold no repeat.
3. A shard's fragments are written to files and sorted as one text (induced_sort: queues of suffix tuples with common prefixes, and all that is as long as
   the text, in files beyond a bound of memory). Neighbours that share min_words words are occurrences of one window; the least (id, place) is the original.
4. What a fragment has, each of its occurrences has; windows side by side join to spans.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import induced_sort
from .common import discard, materialize, mix, ragged, shared_dir, slices, table, word_hashes, words

MIN_WORDS, K, SHARD_WORDS, MEMORY = 50, 16, 1_000_000, 16 << 20
#: Words that a batch of fragments has at most.
PIECE = 4 << 20
_STEPS = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)
_R = np.uint64(0xD1342543DE82EF95)
_R_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _hashed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and offsets by row."""
    w = words(col)
    return word_hashes(w.vocab)[w.codes] if len(w.vocab) else np.zeros(0, np.uint64), w.offsets


def _grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of K words, by doubling."""
    g, size, step = h, 1, 0
    while size < K:
        g = mix(g[:-size] * _STEPS[step] + g[size:])
        size, step = 2 * size, step + 1
    return g


def _leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each i, the place of the least of g[i : i + width], the leftmost of equals."""
    at, size = np.arange(len(g)), 1
    while 2 * size <= width:
        a, b = at[:-size], at[size:]
        at = np.where(g[a] <= g[b], a, b)
        size *= 2
    if size < width:
        a, b = at[: len(at) - (width - size)], at[width - size :]
        at = np.where(g[a] <= g[b], a, b)
    return at


def _content(h: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the words lo .. lo + size of h."""
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _R)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), _R_INV)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])
    return mix((sums[lo + size] - sums[lo]) * back[lo] + size.astype(np.uint64))


def fragments(h: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(row, start within h, words, anchor's hash, content's hash) of each stretch of windows that share an anchor."""
    empty = np.zeros(0, np.int64)
    if len(h) < min_words:
        return empty, empty, empty, empty, empty
    g = _grams(h)
    anchor = _leftmost_least(g, min_words - K + 1)
    n = np.diff(offsets)
    wins = np.maximum(n - min_words + 1, 0)
    at = ragged(offsets[:-1], wins)
    if not len(at):
        return empty, empty, empty, empty, empty
    row = np.repeat(np.arange(len(n)), wins)
    a = anchor[at]
    new = np.r_[True, (a[1:] != a[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, size = at[first], at[last] - at[first] + min_words
    return row[first], lo, size, g[a[first]].view(np.int64), _content(h, lo, size).view(np.int64)


def _cut_up(docs: DataFrame, kind: str, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, off = _hashed(b.column("text"))
            row, lo, size, g, c = fragments(h, off, min_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int64()), pa.array(c, pa.int64()), b.column("id").take(pa.array(row)), pa.array((lo - off[row]).astype(np.int32)), pa.array(size.astype(np.int32))], ["g", "c", "id", "lo", "size"]
            )

    return docs.mapInArrow(run, f"g bigint, c bigint, id {kind}, lo int, size int")


def _with_words(docs: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(g, c, id, lo, more, words) of the wanted fragments, the words as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, off = _hashed(b.column("text"))
            lists = b.column("want")
            count = np.diff(lists.offsets.to_numpy())
            s = lists.flatten()
            lo0, size = (s.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "size"))
            c = s.field("c").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(count)), count)
            lo = lo0 + off[row]
            fits = lo + size <= off[row + 1]
            safe_lo, safe = np.where(fits, lo, 0), np.where(fits, size, 0)
            ok = np.flatnonzero(fits & (_content(h, safe_lo, safe).view(np.int64) == c))  # else another text under the same id
            piece = np.cumsum(size[ok]) // PIECE  # offsets within a batch stay small, whatever a text's length
            for part in np.split(ok, np.flatnonzero(np.diff(piece)) + 1):
                flat = np.ascontiguousarray(h[ragged(lo[part], size[part])])
                ends = np.concatenate([[0], np.cumsum(size[part] * 8)]).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
                pick = pa.array(part)
                yield pa.RecordBatch.from_arrays([s.field("g").take(pick), s.field("c").take(pick), b.column("id").take(pa.array(row[part])), s.field("lo").take(pick), s.field("more").take(pick), body], ["g", "c", "id", "lo", "more", "words"])

    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("g", "c", "lo", "size", "more")).alias("want"))
    return docs.join(lists, "id").select("id", "text", "want").mapInArrow(run, f"g bigint, c bigint, id {kind}, lo int, more boolean, words binary")


class Shard:
    """A shard's fragments: their words in a file, mapped as the text to sort, and a few numbers for each fragment in memory."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.store = folder, induced_sort.Store(folder, memory)
        self.rows: list[pa.RecordBatch] = []
        self.sizes: list[np.ndarray] = []
        self.vocab = np.zeros(0, np.uint64)
        self.path = os.path.join(folder, "words")
        self.out = open(self.path, "wb")

    def add(self, b: pa.RecordBatch) -> None:
        body = b.column("words")
        off = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64) // 8
        h = np.frombuffer(body.buffers()[2], np.uint64)[off[0] : off[-1]]
        h.tofile(self.out)
        self.sizes.append(np.diff(off))
        self.vocab = np.union1d(self.vocab, h)
        every = pa.array(np.arange(b.num_rows))  # taken, so that nothing holds on to the batch's words
        self.rows.append(pa.RecordBatch.from_arrays([b.column(n).take(every) for n in ("g", "c", "id", "lo", "more")], ["g", "c", "id", "lo", "more"]))

    def close(self) -> None:
        """The text: fragments one after the other, each followed by a separator, and the end."""
        self.out.close()
        t = pa.Table.from_batches(self.rows).combine_chunks()
        self.rows = []
        self.g, self.c, self.ids = (t.column(n).combine_chunks() for n in ("g", "c", "id"))
        self.lo = t.column("lo").to_numpy().astype(np.int64)
        self.more = t.column("more").to_numpy(zero_copy_only=False).astype(bool)
        self.rank = pc.rank(self.ids, "ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        self.size = np.concatenate(self.sizes)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]])
        self.n = int((self.size + 1).sum())
        self.text = self.store.new(self.n + 1, np.int32)
        words_ = np.memmap(self.path, np.uint64, "r") if self.size.sum() else np.zeros(0, np.uint64)
        at = 0
        for i, j in self.runs():
            size = self.size[i:j]
            here = int(size.sum())
            block = np.ones(here + j - i, np.int32)
            block[ragged(self.start[i:j] - self.start[i], size)] = np.searchsorted(self.vocab, words_[at : at + here]) + 2
            self.text[self.start[i] : self.start[i] + len(block)] = block
            at += here
        self.text[self.n] = 0
        self.vocab = None

    def runs(self) -> Iterator[tuple[int, int]]:
        """Runs of fragments of about BLOCK words."""
        part = self.start // induced_sort.BLOCK
        cut = np.flatnonzero(np.diff(part)) + 1
        yield from zip([0, *cut.tolist()], [*cut.tolist(), len(self.start)])

    def own(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, pos, side="right") - 1

    def occurrence(self, pos: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For places of the text a rank of (id, place in its document)."""
        return (self.rank[own] << 32) + self.lo[own] + pos - self.start[own]


def repeats(shard: Shard, min_words: int, memory: int) -> np.ndarray:
    """For each place of the text the place of the least occurrence of its window, -1 where the window occurs nowhere else.

    The sort gives the windows of a group one after the other; groups are settled as they end.
    """
    least = shard.store.new(shard.n, np.int32)
    for part in induced_sort._blocks(shard.n):
        least[part] = -1
    wait_pos, wait_group, waiting, group = [], [], 0, 0

    def settle(pos: np.ndarray, g: np.ndarray) -> None:
        if not len(pos):
            return
        own = shard.own(pos)
        at = shard.occurrence(pos, own)
        order = np.lexsort((at, g))
        pos, g, at, own = pos[order], g[order], at[order], own[order]
        edge = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.append(edge, len(g)))
        again = np.logical_or.reduceat(shard.more[own], edge) | (at[edge + size - 1] > at[edge])
        hit = np.repeat(again, size)
        least[pos[hit]] = np.repeat(pos[edge], size)[hit]

    for pos, lcp in induced_sort.sort(shard.text, folder=shard.folder, memory=memory):
        real = pos < shard.n
        pos, lcp = pos[real].astype(np.int64), lcp[real]
        own = shard.own(pos)
        whole = shard.start[own] + shard.size[own] - pos >= min_words
        g = group + np.cumsum(~(whole & (lcp >= min_words)))
        group = int(g[-1]) if len(g) else group
        wait_pos.append(pos[whole]), wait_group.append(g[whole])
        waiting += int(whole.sum())
        if waiting >= induced_sort.BLOCK:
            p, g = np.concatenate(wait_pos), np.concatenate(wait_group)
            end = int(np.searchsorted(g, g[-1]))  # the last group may go on
            settle(p[:end], g[:end])
            wait_pos, wait_group = [p[end:]], [g[end:]]
            waiting = 0 if end else waiting  # a group that alone is as large is joined when it ends
    if wait_pos:
        settle(np.concatenate(wait_pos), np.concatenate(wait_group))
    return least


def _sort_shards(frags: DataFrame, kind: str, min_words: int, folder: str | None, memory: int) -> DataFrame:
    """(g, c, o1, o2, first_id, first_lo): windows o1 .. o2 of the fragment repeat; the first of them has its original at first_id, first_lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with induced_sort.scratch(folder) as where:
            shard = Shard(where, memory)
            for b in batches:
                if b.num_rows:
                    shard.add(b)
            if not shard.rows:
                shard.out.close()
                return
            shard.close()
            least = repeats(shard, min_words, memory)
            for i, j in shard.runs():  # no span crosses a fragment's end
                base = int(shard.start[i])
                part = np.asarray(least[base : int(shard.start[j - 1] + shard.size[j - 1])])
                pos = np.flatnonzero(part >= 0)
                if not len(pos):
                    continue
                first = part[pos].astype(np.int64)
                pos = pos + base
                f, f0 = shard.own(pos), shard.own(first)
                o, at0 = pos - shard.start[f], shard.lo[f0] + first - shard.start[f0]
                new = np.r_[True, (f[1:] != f[:-1]) | (o[1:] != o[:-1] + 1) | (shard.rank[f0[1:]] != shard.rank[f0[:-1]]) | (at0[1:] != at0[:-1] + 1)]
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(pos)) - 1
                pick = pa.array(f[a])
                yield pa.RecordBatch.from_arrays(
                    [shard.g.take(pick), shard.c.take(pick), pa.array(o[a].astype(np.int32)), pa.array(o[z].astype(np.int32)), shard.ids.take(pa.array(f0[a])), pa.array(at0[a].astype(np.int32))],
                    ["g", "c", "o1", "o2", "first_id", "first_lo"],
                )

    return frags.mapInArrow(run, f"g bigint, c bigint, o1 int, o2 int, first_id {kind}, first_lo int")


def local_path(where: str) -> str:
    """The shared folder as the path under which every executor mounts it."""
    scheme, sep, rest = where.partition(":")
    if sep and scheme != "file" and "/" not in scheme:
        raise ValueError(f"the sort's queues need a shared folder that is mounted, not {where}")
    return "/" + rest.lstrip("/") if sep and scheme == "file" else where


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, memory: int = MEMORY) -> DataFrame:
    """(id, start, end, original): the words start .. end of a document (from 0, end excluded) that recur elsewhere, in spans as long as can be.

    Each window of min_words words that has two occurrences or more is covered: by a span with original = true at its least (id, place),
    by one with original = false at each other. Occurrences within one document count. Words are what white space parts, compared as
    they are. Rows with a null id or text and texts of fewer words have no spans. Rows that repeat an id are one document; of
    equal rows one counts. Other columns, whatever their names, are dropped. An empty table gives an empty result. min_words: K at least.
    """
    if min_words < K:
        raise ValueError(f"min_words is {K} at least")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    frags = materialize(_cut_up(source, kind, min_words))
    place = F.struct("id", "lo")
    contents = frags.groupBy("g", "c").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("size").alias("size"))
    contents = contents.select("g", "c", "first", "size", (F.col("first") < F.col("last")).alias("more"))
    by = Window.partitionBy("g")
    wanted = contents.withColumn("of", F.count(F.lit(1)).over(by)).withColumn("any", F.max("more").over(by)).filter("of > 1 or any").select("g", "c", "first.id", "first.lo", "size", "more")
    wanted = materialize(wanted)
    total = wanted.agg(F.sum("size")).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-total // shard_words))
    found = _sort_shards(_with_words(source, wanted, kind).repartition(shards, "g"), kind, min_words, local_path(shared_dir(spark)), memory)
    found = materialize(found)
    discard(wanted)
    hits = frags.join(found, ["g", "c"]).select("id", (F.col("lo") + F.col("o1")).alias("start"), (F.col("lo") + F.col("o2") + min_words).alias("end"), ((F.col("first_id") == F.col("id")) & (F.col("first_lo") == F.col("lo") + F.col("o1"))).alias("original"))
    return merged(hits)


def merged(hits: DataFrame) -> DataFrame:
    """Spans of one id and kind that overlap or touch, as one."""
    order = Window.partitionBy("id", "original").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = hits.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    part = part.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("id", "original", "span").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("id", "start", "end", "original")


def find_repeats(docs: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """repeated_spans with the id under its own name and the number of words; edge cases are its."""
    s = repeated_spans(docs, id_col=id_col, **kw)
    return s.select(F.col("id").alias(id_col), "start", "end", "original", (F.col("end") - F.col("start")).alias("n_words"))


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars", **kw) -> DataFrame:
    """The rows of docs, all columns, without the words of their spans that aren't original; of a text that is copied whole nothing
    is left, and its row goes. count_col, where there is one, becomes the characters left. Rows with a null id or text stay as they are, and so do
    texts without a repeat, empty and very long ones included. Of repeats the least (id, place) stays whole. Rows that repeat an id are cut alike, each at the
    words that its text has there. Extra columns, whatever their names, are kept; an empty table stays empty."""
    spans = repeated_spans(docs, id_col=id_col, text_col=text_col, **kw).filter("not original")
    own, cut = _unused("_cut_id", docs), _unused("_cut", docs)
    lists = spans.groupBy(F.col("id").alias(own)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    joined = docs.join(lists, docs[id_col] == lists[own], "left").drop(own)
    where = docs.columns.index(text_col)
    counts = docs.columns.index(count_col) if count_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            cuts = b.column(b.num_columns - 1)
            if cuts.null_count == b.num_rows:
                yield b.select(b.schema.names[:-1])
                continue
            w = words(b.column(where))
            vocab = w.vocab.to_pylist()
            texts, keep = b.column(where).to_pylist(), np.ones(b.num_rows, bool)
            for r, spans_ in enumerate(cuts.to_pylist()):
                if spans_ and texts[r] is not None:
                    texts[r] = _without(texts[r], [vocab[c] for c in w.codes[w.offsets[r] : w.offsets[r + 1]]], [(s["start"], s["end"]) for s in spans_])
                    keep[r] = texts[r] is not None
            cols = list(b.columns[:-1])
            cols[where] = pa.array(texts, b.schema.field(where).type)
            if counts is not None:
                was = cols[counts].to_pylist()
                cols[counts] = pa.array([len(t) if c is not None and t is not None else x for t, c, x in zip(texts, cuts.to_pylist(), was)], b.schema.field(counts).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1]).filter(pa.array(keep))

    return joined.mapInArrow(run, T.StructType(docs.schema.fields))


def _unused(name: str, docs: DataFrame) -> str:
    """name, made longer until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(text: str, parts: list[str], spans: list[tuple[int, int]]) -> str | None:
    """text without the spans of its words and the white space that follows each; None where no word is left."""
    out, k, at, kept = [], 0, 0, False
    begin = 0
    for lo, hi in [*spans, (len(parts), len(parts))]:
        lo, hi = min(lo, len(parts)), min(hi, len(parts))
        while k < lo:
            at = text.index(parts[k], at) + len(parts[k])
            k, kept = k + 1, True
        if lo == len(parts):
            out.append(text[begin:])
            break
        head = text.index(parts[lo], at)
        out.append(text[begin:head])
        while k < hi:
            at = text.index(parts[k], at) + len(parts[k])
            k += 1
        begin = text.index(parts[hi], at) if hi < len(parts) else len(text)
    return "".join(out) if kept else None


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(table(spark, sf_dir, "documents"))
