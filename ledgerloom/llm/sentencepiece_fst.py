"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled: the normaliser (leftmost-longest rewrites, the dummy blank), the pieces (a trie whose final
states carry the piece and its cost and lead back to the root), and byte fallback (an arc over each character that no
one-character piece covers, with the unknown cost, writing the bytes' pieces). The composition with an input is explored
state by state, (position, trie state), and the shortest path in the tropical semiring (min, +) is the encoding; an
arc relaxes a state only if it is strictly cheaper, from the leftmost start on, which is the tokenizer's tie rule.
The distinct words of a chunk are composed together in numpy, one position at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab as V
from .common import alike, ragged, raw, slices, table
from .token_counts import CHUNK, LOCKSTEP, MATRIX, prepared, segments


class Normalizer:
    """A deterministic transducer of rewrites: at each place the longest source that matches is replaced."""

    def __init__(self, rules: dict[bytes, bytes]):
        self.root: dict = {}
        for src, dst in rules.items():
            node = self.root
            for b in src:
                node = node.setdefault(b, {})
            node[-1] = dst

    def __call__(self, text: str) -> str:
        data, out, i = text.encode(), bytearray(), 0
        while i < len(data):
            node, j, hit = self.root, i, None
            while j < len(data) and data[j] in node:
                node = node[data[j]]
                j += 1
                if -1 in node:
                    hit = (j, node[-1])
            if hit:
                i, dst = hit
                out += dst
            else:
                n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                out += data[i : i + n]
                i += n
        return out.decode()


class Transducer:
    """Pieces and byte fallback as arc tables: arcs[row[s], b] is the next trie state or -1; final[s] a piece or -1."""

    def __init__(self, vocab: V.Vocab):
        kids: list[dict[int, int]] = [{}]
        final = [-1]
        items = vocab.matchable()
        for k, (_, word, _) in enumerate(items):
            s = 0
            for b in word:
                t = kids[s].get(b)
                if t is None:
                    t = kids[s][b] = len(kids)
                    kids.append({})
                    final.append(-1)
                s = t
            if final[s] < 0:
                final[s] = k
        inner = [s for s in range(len(kids)) if kids[s]]
        self.row = np.zeros(len(kids), np.int32)
        self.arcs = np.full((len(inner) + 1, 256), -1, np.int32)  # row 0: no arc leaves
        for r, s in enumerate(inner, 1):
            self.row[s] = r
            self.arcs[r, list(kids[s])] = list(kids[s].values())
        self.kids, self.final_list = kids, final
        self.final = np.array(final, np.int32)
        self.ids = np.array([i for i, _, _ in items], np.int32)
        self.size = np.array([len(w) for _, w, _ in items], np.int32)
        self.ring = max(4, int(self.size.max(initial=0))) + 1
        self.cost = np.array([-s for _, _, s in items], np.float32)
        self.one_char = np.array([len(w.decode()) == 1 for _, w, _ in items])
        self.unk_cost, self.fallback, self.unk_id = -vocab.unk_score, vocab.byte_fallback, vocab.unk_id
        self.bytes_ = np.array(vocab.byte_ids(), np.int32)
        self.cross = vocab.whole_texts()

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of them for each word, taken as it is."""
        data, starts, lens = raw(words)
        count, made = np.zeros(len(starts), np.int64), []
        for run, single in alike(lens, 13, MATRIX, LOCKSTEP):
            if single:
                for i in run:
                    ids = np.array(self.encode_one(data[starts[i] : starts[i] + lens[i]].tobytes()), np.int32)
                    made.append((np.array([i]), ids, np.array([len(ids)])))
            else:
                made.append((run, *self._together(data, starts[run], lens[run])))
            count[run] = np.concatenate([c for _, _, c in made[-len(run) if single else -1 :]])
        off = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(int(off[-1]), np.int32)
        for run, ids, c in made:
            flat[ragged(off[run], c)] = ids
        return flat, count

    def _together(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words in descending order of length, a position of all of them at a time."""
        w, top = len(start), int(size[0])
        count = np.zeros(w, np.int64)
        if top:
            byte = np.zeros((top, w), np.uint8)
            active = np.searchsorted(-size, -np.arange(1, top + 1), side="right")  # words with more than t bytes
            for t in range(top):
                byte[t, : active[t]] = data[start[: active[t]] + t]
            dist, piece, frm = np.full((top + 1, w), np.inf, np.float32), np.full((top + 1, w), -1, np.int32), np.zeros((top + 1, w), np.int32)
            dist[0] = 0
            for p in range(top):
                a = int(active[p])
                idx = np.flatnonzero(np.isfinite(dist[p, :a]))
                base, state, at, todo = dist[p], np.zeros(len(idx), np.int32), p, idx
                known = np.zeros(a, bool)
                while len(todo):
                    state = self.arcs[self.row[state], byte[at, todo]]
                    ok = state >= 0
                    todo, state = todo[ok], state[ok]
                    at += 1
                    k = self.final[state]
                    f = k >= 0
                    if f.any():
                        h, k = todo[f], k[f]
                        known[h[self.one_char[k]]] = True
                        d = base[h] + self.cost[k]
                        up = d < dist[at, h]
                        h = h[up]
                        dist[at, h], piece[at, h], frm[at, h] = d[up], k[up], p
                    ok = size[todo] > at
                    todo, state = todo[ok], state[ok]
                h = idx[~known[idx]]
                if len(h):
                    b0 = byte[p, h]
                    end = p + np.where(b0 < 0x80, 1, np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4)))
                    d = base[h] + np.float32(self.unk_cost)
                    up = d < dist[end, h]
                    h, end = h[up], end[up]
                    dist[end, h], piece[end, h], frm[end, h] = d[up], -1, p
            steps = []  # walk back, all words at once; the last piece comes first
            idx, pos = np.arange(w), size.copy()
            num = np.zeros(w, np.int64)
            while len(idx):
                k, f = piece[pos, idx], frm[pos, idx]
                unk = k < 0
                if unk.any() and self.fallback:
                    reach = pos - f
                    for back in range(1, 5):
                        m = (~unk if back == 1 else np.zeros(len(idx), bool)) | (unk & (reach >= back))
                        ids = np.where(unk[m], self.bytes_[byte[np.maximum(pos[m] - back, 0), idx[m]]], self.ids[k[m]])
                        steps.append((idx[m], num[idx[m]], ids))
                        num[idx[m]] += 1
                else:
                    steps.append((idx, num[idx].copy(), np.where(unk, self.unk_id, self.ids[k])))
                    num[idx] += 1
                pos = f
                more = pos > 0
                idx, pos = idx[more], pos[more]
            count = num
        off = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(int(off[-1]), np.int32)
        if top:
            for idx, place, ids in steps:
                flat[off[1:][idx] - 1 - place] = ids
        return flat, count

    def encode_one(self, text: bytes) -> list[int]:
        """The same for one text, state by state. Four bytes are held for each of its own, and distances for as many as a piece may be long."""
        n, ring, cost = len(text), self.ring, self.cost
        dist, back = [np.inf] * ring, array("i", bytes(4 * (n + 1)))
        dist[0] = np.float32(0)
        for p in range(n):
            base = dist[p % ring]
            dist[p % ring] = np.inf  # free for the position that takes its place
            if base == np.inf:
                continue
            s, known = 0, False
            for at in range(p, n):
                s = self.kids[s].get(text[at])
                if s is None:
                    break
                k = self.final_list[s]
                if k >= 0:
                    known |= bool(self.one_char[k])
                    d = base + cost[k]
                    if d < dist[(at + 1) % ring]:
                        dist[(at + 1) % ring], back[at + 1] = d, k
            if not known:
                b0 = text[p]
                end = p + (1 if b0 < 0x80 else 2 if b0 < 0xE0 else 3 if b0 < 0xF0 else 4)
                d = base + np.float32(self.unk_cost)
                if d < dist[end % ring]:
                    dist[end % ring], back[end] = d, -1
        out, p = [], n
        while p:
            k = back[p]
            f = p - int(self.size[k]) if k >= 0 else p - 1
            while k < 0 and text[f] & 0xC0 == 0x80:
                f -= 1
            out += [int(self.ids[k])] if k >= 0 else [int(self.bytes_[b]) for b in reversed(text[f:p])] if self.fallback else [self.unk_id]
            p = f
        return out[::-1]


_MADE: dict[int, Transducer] = {}


def transducer(vocab: V.Vocab) -> Transducer:
    key = hash((vocab.pieces, vocab.scores, vocab.types, vocab.byte_fallback))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Transducer(vocab)
    return _MADE[key]


def encode_array(col: pa.Array, vocab: V.Vocab) -> pa.ListArray:
    """Lists of ids; null for null."""
    fst = transducer(vocab)
    col = prepared(col, vocab)
    w = segments(col, fst.cross, vocab.add_dummy_prefix)
    flat, count = fst.encode_words(w.vocab)
    off = np.concatenate([[0], np.cumsum(count)])
    ids = flat[ragged(off[:-1][w.codes], count[w.codes])]
    ends = np.concatenate([[0], np.cumsum(count[w.codes])])[w.offsets]
    null = pc.is_null(col).to_numpy(zero_copy_only=False)
    if not vocab.byte_fallback and len(ids):  # neighbours that are unknown make one token
        keep = np.ones(len(ids), bool)
        keep[1:] = ~((ids[1:] == vocab.unk_id) & (ids[:-1] == vocab.unk_id))
        keep[ends[:-1][ends[:-1] < len(ids)]] = True
        ends, ids = np.concatenate([[0], np.cumsum(keep)])[ends], ids[keep]
    offsets = pa.array(ends.astype(np.int32), mask=np.append(null, False)) if null.any() else pa.array(ends.astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


class Decoder:
    """Ids to text, the inverse projection: bytes of each piece, one after the other, without the dummy blank."""

    def __init__(self, vocab: V.Vocab):
        parts = []
        for p, t in zip(vocab.pieces, vocab.types):
            parts.append(bytes([int(p[3:5], 16)]) if t == V.BYTE else b"" if t == V.CONTROL else " ⁇ ".encode() if t == V.UNKNOWN else p.replace("▁", " ").encode())
        self.lens = np.array([len(x) for x in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]])
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.strip = vocab.add_dummy_prefix

    def array(self, lists: pa.ListArray) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        data = self.data[ragged(self.starts[ids], self.lens[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.lens[ids])])[np.concatenate([[0], np.cumsum(size)])]
        out = []
        for ok, i, j in zip(pc.is_valid(lists).to_pylist(), ends.tolist(), ends[1:].tolist()):
            x = data[i:j].decode(errors="replace") if ok else None
            out.append(x[1:] if x and self.strip and x[0] == " " else x)
        return pa.array(out, pa.string())


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str = V.DEFAULT_MODEL, check: bool = True) -> DataFrame:
    """(id, ids, n_tokens, decodes) for each row of docs; no shuffle.

    ids is the cheapest path; decodes says whether decoding ids gives the normalised text again (null without check).
    A null text gives nulls, an empty one an empty list that decodes. Repeated rows and null ids are encoded row by row; other
    columns, whatever their names, are dropped. An empty table gives an empty result. Texts of any length are whole; a task's memory is as in
    token_counts, but for the four bytes that each byte of a long word takes.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(V.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        back = Decoder(vocab)
        for b in slices(batches, "text", CHUNK):
            ids = encode_array(b.column("text"), vocab)
            same = pc.equal(back.array(ids), prepared(b.column("text"), vocab)) if check else pa.nulls(len(ids), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("id"), ids, pc.list_value_length(ids).cast(pa.int64()), same], ["id", "ids", "n_tokens", "decodes"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint, decodes boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = V.DEFAULT_MODEL) -> DataFrame:
    """(id, text): the text of each list of ids; null for null, empty for empty. Bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(V.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), back.array(b.column("ids"))], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    picked = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
