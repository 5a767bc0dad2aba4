"""Unigram vocabularies read from a SentencePiece model file, without the library."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNK_PENALTY = 10.0


@dataclass(frozen=True)
class Vocab:
    """Pieces by id; space stands for the visible blank. rules: the normaliser's rewrites, longest first wins."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    byte_fallback: bool = True
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = False
    rules: dict[bytes, bytes] = field(default_factory=dict)

    @property
    def unk_id(self) -> int:
        return self.types.index(UNKNOWN)

    @property
    def unk_score(self) -> float:
        return min((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0) - UNK_PENALTY

    def matchable(self) -> list[tuple[int, bytes, float]]:
        """(id, bytes, score) of the pieces that text may match."""
        best = max((s for s, t in zip(self.scores, self.types) if t == NORMAL), default=0.0)
        out = []
        for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types)):
            if p and t in (NORMAL, USER_DEFINED):
                out.append((i, p.replace("▁", " ").encode(), s if t == NORMAL else len(p.encode()) * best - 0.1))
        return out

    def byte_ids(self) -> list[int]:
        """The id of each byte's piece, or the unknown id."""
        ids = [self.unk_id] * 256
        for i, (p, t) in enumerate(zip(self.pieces, self.types)):
            if t == BYTE:
                ids[int(p[3:5], 16)] = i
        return ids

    def whole_texts(self) -> bool:
        """Whether words can't be taken one by one: a piece holds a blank after another character, or scores aren't sixteenths.

        The tokenizer's sums are floats over a whole text. Of sixteenths they are exact, so that a word's path is the same by itself;
        of other numbers they are rounded by what comes before, and the rounding decides between paths that are as good.
        """
        items = self.matchable()
        return any(b" " in p.lstrip(b" ") for _, p, _ in items) or any(16 * s % 1 for _, _, s in items)


def _fields(buf: bytes):
    i = 0
    while i < len(buf):
        key, i = _varint(buf, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(buf, i)
        elif kind == 1:
            v, i = buf[i : i + 8], i + 8
        elif kind == 2:
            n, i = _varint(buf, i)
            v, i = buf[i : i + n], i + n
        elif kind == 5:
            v, i = buf[i : i + 4], i + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, v


def _varint(buf: bytes, i: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        b = buf[i]
        v |= (b & 127) << shift
        i += 1
        if b < 128:
            return v, i
        shift += 7


def charsmap(blob: bytes) -> dict[bytes, bytes]:
    """The rewrites of a precompiled map: a double-array trie of sources, then the targets."""
    if not blob:
        return {}
    n = struct.unpack_from("<I", blob)[0]
    units, targets, out = struct.unpack_from(f"<{n // 4}I", blob, 4), blob[4 + n :], {}
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    stack = [(offset(units[0]), b"")]
    while stack:
        at, key = stack.pop()
        for c in range(1, 256):
            u = units[at ^ c] if at ^ c < len(units) else 0
            if u & 0x800000FF == c:
                nxt, k = (at ^ c) ^ offset(u), key + bytes([c])
                if u >> 8 & 1:
                    v = units[nxt] & 0x7FFFFFFF
                    out[k] = targets[v : targets.index(b"\0", v)]
                stack.append((nxt, k))
    return out


def load(path: str = DEFAULT_MODEL) -> Vocab:
    """Read a model file.

    A unigram model keeps its scores. Another kind has merge ranks and no probabilities; its pieces get those of
    Zipf's law by place, -ln(id + 2) rounded to sixteenths, whose sums are exact so that ties are real ties.
    """
    with open(path, "rb") as f:
        buf = f.read()
    pieces, scores, types, kind, fallback, dummy, squeeze, rules = [], [], [], 1, False, True, True, {}
    for n, v in _fields(buf):
        if n == 1:
            p, s, t = "", 0.0, NORMAL
            for m, x in _fields(v):
                if m == 1:
                    p = x.decode()
                elif m == 2:
                    s = struct.unpack("<f", x)[0]
                elif m == 3:
                    t = x
            pieces.append(p), scores.append(s), types.append(t)
        elif n == 2:
            for m, x in _fields(v):
                kind, fallback = (x if m == 3 else kind), (bool(x) if m == 35 else fallback)
        elif n == 3:
            for m, x in _fields(v):
                if m == 2:
                    rules = charsmap(x)
                dummy, squeeze = (bool(x) if m == 3 else dummy), (bool(x) if m == 4 else squeeze)
    if kind != 1:
        scores = [-round(16 * math.log(i + 2)) / 16 for i in range(len(pieces))]
    return Vocab(tuple(pieces), tuple(scores), tuple(types), fallback, dummy, squeeze, rules)
