"""Hashed character n-grams of words, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint32(0x9E3779B1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 32-bit hash, in place."""
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def features(vocab: pa.StringArray, lo: int, hi: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the n-grams, lo to hi characters long, of each word between '<' and '>', and offsets by word.

    A word shorter than lo - 2 characters has no n-gram of its own and gives one for the whole marked word. buckets: a power of two.
    """
    if not len(vocab):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    text = "<" + "><".join(vocab.to_pylist()) + ">"
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    size = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int32) + 2
    start = np.cumsum(size, dtype=np.int64) - size
    word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    left = np.repeat((start + size).astype(np.int32), size) - np.arange(len(cp), dtype=np.int32)  # characters up to the word's end
    per = np.maximum(size[:, None] - np.arange(lo, hi + 1)[None, :] + 1, 0)
    short = size < lo
    off = np.concatenate([[0], np.cumsum(per.sum(1) + short)])
    out = np.empty(int(off[-1]), np.int32)
    place = off[:-1].copy()  # where each word's next n-grams go
    h = np.zeros(len(cp), np.uint32)
    for n in range(1, hi + 1):
        m = len(cp) - n + 1
        if m <= 0:
            break
        h = h[:m] * _STEP
        h += cp[n - 1 :]
        h += np.uint32(1)
        at = np.flatnonzero((left[:m] == n) & (size[word[:m]] == n)) if n < lo else np.flatnonzero(left[:m] >= n)
        own = word[at]
        out[place[own] + (at - start[own])] = (_mix(h[at] + np.uint32(n)) & np.uint32(buckets - 1)).astype(np.int32)
        place += per[:, n - lo] if n >= lo else (short & (size == n))
    return out, off


def word_sums(ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per word, each of which has an n-gram, the sum of its n-grams' weights (one row per bucket)."""
    if len(offsets) < 2:
        return np.zeros((0, *weights.shape[1:]))
    if weights.ndim == 1:
        return np.add.reduceat(weights[ids], offsets[:-1])
    return np.stack([np.add.reduceat(np.ascontiguousarray(weights[:, c])[ids], offsets[:-1]) for c in range(weights.shape[1])], 1)
