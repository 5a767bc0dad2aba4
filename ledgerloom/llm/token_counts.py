"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton over UTF-8 bytes enumerates, for each end position, the pieces that end there; dynamic
programming carries only the best score and the number of pieces. All distinct words of a chunk of text advance
together, one byte at a time, in numpy. Words can be taken one by one because no piece of the vocabulary holds a blank
after another character and scores are sixteenths; where that isn't so, whole texts are the words (Vocab.whole_texts).

Ties are the tokenizer's: a candidate replaces the best only if it is strictly better, and candidates for one end come by
ascending start (the longest piece first, the unknown character last). As there, scores and their sums are floats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import vocab as V
from .common import Words, alike, as_string, of_lists, raw, slices, table

#: So many words at least advance together; bytes of the matrices for them; bytes of text whose distinct words are taken together.
LOCKSTEP, MATRIX, CHUNK = 24, 32 << 20, 2 << 20


class Automaton:
    """Aho-Corasick over bytes. delta[row[s], b] is the next state; out[s] the longest piece that ends in s, link the next shorter."""

    def __init__(self, vocab: V.Vocab):
        kids: list[dict[int, int]] = [{}]
        piece = [-1]
        self.items = vocab.matchable()
        for k, (_, word, _) in enumerate(self.items):
            s = 0
            for b in word:
                s = kids[s].setdefault(b, len(kids)) if b in kids[s] else self._grow(kids, piece, s, b)
            if piece[s] < 0:
                piece[s] = k
        n = len(kids)
        fail, link, row, rows = [0] * n, [-1] * n, [0] * n, []
        order, head = [0], 0
        while head < len(order):
            s = order[head]
            head += 1
            base = rows[row[fail[s]]] if s else np.zeros(256, np.int32)
            f = fail[s]
            link[s] = -1 if not s else (f if piece[f] >= 0 else link[f])
            if kids[s] or not s:
                mine = base.copy()
                row[s] = len(rows)
                for b, c in kids[s].items():
                    fail[c] = int(base[b])
                    mine[b] = c
                    order.append(c)
                rows.append(mine)
            else:
                row[s] = row[f]
        self.delta, self.row = np.array(rows, np.int32), np.array(row, np.int32)
        piece_, link_ = np.array(piece, np.int32), np.array(link, np.int32)
        self.out = np.where(piece_ >= 0, np.arange(n, dtype=np.int32), link_)
        self.link = link_
        self.size = np.array([len(self.items[k][1]) if k >= 0 else 0 for k in piece], np.int32)
        self.score = np.array([self.items[k][2] if k >= 0 else 0.0 for k in piece], np.float32)
        self.ring = max(4, int(self.size.max())) + 1
        self.single = np.array([k >= 0 and len(self.items[k][1].decode()) == 1 for k in piece])
        self.unk, self.fallback = vocab.unk_score, vocab.byte_fallback
        self.cross = vocab.whole_texts()

    @staticmethod
    def _grow(kids: list, piece: list, s: int, b: int) -> int:
        kids.append({})
        piece.append(-1)
        kids[s][b] = len(kids) - 1
        return len(kids) - 1

    def counts(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and best score of each word, taken as it is."""
        data, starts, lens = raw(words)
        count, score = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        for run, single in alike(lens, 8, MATRIX, LOCKSTEP):
            if single:
                for i in run:
                    count[i], score[i] = self.one(data[starts[i] : starts[i] + lens[i]].tobytes())
            else:
                count[run], score[run] = self._together(data, starts[run], lens[run])
        return count, score

    def _together(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words in descending order of length, a byte of all of them at a time."""
        top, w = int(size[0]), len(start)
        best, num = np.full((top + 1, w), -np.inf, np.float32), np.zeros((top + 1, w), np.int32)
        best[0] = 0
        state, first, done = np.zeros(w, np.int32), np.zeros(w, np.int32), np.arange(w)
        active = np.searchsorted(-size, -np.arange(1, top + 1), side="right")  # words with more than t bytes
        for t in range(top):
            a = int(active[t])
            byte = data[start[:a] + t]
            state[:a] = self.delta[self.row[state[:a]], byte]
            lead = (byte & 0xC0) != 0x80
            first[:a][lead] = t
            width = np.where(byte < 0x80, 1, 0)
            if (byte >= 0x80).any():
                at = first[:a]
                b0 = data[start[:a] + at]
                need = np.where(b0 < 0x80, 1, np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4)))
                width = np.where(t + 1 - at == need, need, 0)
            b, c = best[t + 1], num[t + 1]
            known = np.zeros(a, bool)
            s = self.out[state[:a]]
            idx = np.flatnonzero(s >= 0)
            s = s[idx]
            while len(idx):
                frm = t + 1 - self.size[s]
                cand = best[frm, idx] + self.score[s]
                known[idx[self.single[s]]] = True
                up = cand > b[idx]
                hit = idx[up]
                b[hit] = cand[up]
                c[hit] = num[frm[up], hit] + 1
                s = self.link[s]
                more = s >= 0
                idx, s = idx[more], s[more]
            idx = np.flatnonzero(~known & (width > 0))
            if len(idx):
                frm = t + 1 - width[idx]
                cand = best[frm, idx] + np.float32(self.unk)
                up = cand > b[idx]
                hit = idx[up]
                b[hit] = cand[up]
                c[hit] = num[frm[up], hit] + (width[hit] if self.fallback else 1)
        return num[size, done].astype(np.int64), best[size, done].astype(np.float64)

    def one(self, text: bytes) -> tuple[int, float]:
        """The same for one text, position by position; only as many of them are held as a piece may be long."""
        n, ring = len(text), self.ring
        best, num, s, lead = [np.float32(-np.inf)] * ring, [0] * ring, 0, 0
        best[0] = np.float32(0)
        delta, row, out, link, size, score, single = self.delta, self.row, self.out, self.link, self.size, self.score, self.single
        for t in range(n):
            s = int(delta[row[s], text[t]])
            if text[t] & 0xC0 != 0x80:
                lead = t
            k, known, top, c = int(out[s]), False, np.float32(-np.inf), 0
            while k >= 0:
                frm = (t + 1 - int(size[k])) % ring
                v = best[frm] + score[k]
                known |= bool(single[k])
                if v > top:
                    top, c = v, num[frm] + 1
                k = int(link[k])
            if not known and (t + 1 == n or text[t + 1] & 0xC0 != 0x80):
                v = best[lead % ring] + np.float32(self.unk)
                if v > top:
                    top, c = v, num[lead % ring] + (t + 1 - lead if self.fallback else 1)
            best[(t + 1) % ring], num[(t + 1) % ring] = top, c
        return num[n % ring], float(best[n % ring])


def prepared(col: pa.Array, vocab: V.Vocab) -> pa.StringArray:
    """The normaliser's text with blanks as spaces, before the dummy prefix."""
    col = as_string(col)
    if vocab.rules:
        from .sentencepiece_fst import Normalizer

        n = Normalizer(vocab.rules)
        col = pa.array([None if x is None else n(x) for x in col.to_pylist()], pa.string())
    col = pc.replace_substring(col, "▁", " ")
    if vocab.remove_extra_whitespaces:
        col = pc.utf8_trim(pc.replace_substring_regex(col, " +", " "), " ")
    return col


def segments(col: pa.StringArray, whole: bool = False, prefix: bool = True) -> Words:
    """Words of prepared texts with the blanks before them; the first of a text has one more where there is a dummy prefix.

    whole: a text is one word.
    """
    if whole:
        return of_lists(pa.array([[" " * prefix + x] if x else [] for x in col.to_pylist()], pa.list_(pa.string())))
    lists = pc.split_pattern(col, " ")
    odd = pc.or_(pc.or_(pc.match_substring(col, "  "), pc.starts_with(col, " ")), pc.or_(pc.ends_with(col, " "), pc.equal(col, "")))
    if pc.any(pc.fill_null(odd, False)).as_py():
        hard = pc.fill_null(odd, False).to_numpy(zero_copy_only=False)
        split = re.compile(" +[^ ]*").findall
        fixed = pa.array([[y[1:] for y in split(" " + x)] if x else [] for x in col.filter(pa.array(hard)).to_pylist()], pa.list_(pa.string()))
        pick = np.where(hard, len(col) + np.cumsum(hard) - 1, np.arange(len(col)))
        lists = pa.concat_arrays([lists, fixed]).take(pa.array(pick))
    w = of_lists(lists)
    blank = pc.binary_join_element_wise(pa.scalar(""), w.vocab, pa.scalar(" ")) if len(w.vocab) else w.vocab
    if prefix:
        return Words(w.offsets, w.codes, blank)
    codes = w.codes.astype(np.int64)
    codes[w.offsets[:-1][w.counts > 0]] += len(w.vocab)  # first words stand without the blank
    return Words(w.offsets, codes, pa.concat_arrays([blank, w.vocab]))


_MADE: dict[int, Automaton] = {}


def automaton(vocab: V.Vocab) -> Automaton:
    key = hash((vocab.pieces, vocab.scores, vocab.types, vocab.byte_fallback))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Automaton(vocab)
    return _MADE[key]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str = V.DEFAULT_MODEL) -> DataFrame:
    """(id, n_tokens, best_score) for each row of docs; no shuffle.

    A null text gives nulls, an empty one 0 tokens and score 0; a text that is blank has tokens. Repeated rows and null ids
    are counted row by row; other columns, whatever their names, are dropped. An empty table gives an empty result.
    The vocabulary (fixed size) is read on the driver and goes out with the code. Texts of any length are whole: a task holds about CHUNK bytes of
    them, one text at least, and MATRIX bytes for words that advance together; longer words take memory for one piece's length only.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(V.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        ac = automaton(vocab)
        for b in slices(batches, "text", CHUNK):
            col = prepared(b.column("text"), vocab)
            w = segments(col, ac.cross, vocab.add_dummy_prefix)
            n, s = ac.counts(w.vocab)
            null = pc.is_null(col).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(w.sums(n), pa.int64(), mask=null), pa.array(w.sums(s), pa.float64(), mask=null)], ["id", "n_tokens", "best_score"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"id {kind}, n_tokens bigint, best_score double").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
