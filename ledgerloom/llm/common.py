"""Arrow and numpy helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import checkpoint_root, cut, drop_cut

CHUNK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Frames written to the shared folder, so that lineage ends at files that survive executors, and their deletion.
shared_dir, materialize, discard = checkpoint_root, cut, drop_cut


def give_back() -> None:
    """Free memory to the system: that of Arrow's pool, and with glibc that of the heap, which else stay with this process until it ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # another C library


def as_string(col: pa.Array) -> pa.StringArray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col if pa.types.is_string(col.type) else col.cast(pa.string())


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about max_bytes of the text column, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


@dataclass
class Words:
    """Tokens of a run of texts: codes[offsets[i]:offsets[i + 1]] index vocab for row i."""

    offsets: np.ndarray
    codes: np.ndarray
    vocab: pa.StringArray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Per row, the sum of per_word over its tokens."""
        c = np.concatenate([np.zeros((1, *per_word.shape[1:]), per_word.dtype), np.cumsum(per_word[self.codes], axis=0)])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]


def of_lists(lists: pa.ListArray) -> Words:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = lists.flatten().dictionary_encode()
    return Words(np.concatenate([[0], np.cumsum(size)]), enc.indices.to_numpy(zero_copy_only=False), enc.dictionary)


def words(col: pa.Array, lower: bool = False) -> Words:
    """Split at Unicode white space; a null text has no words."""
    col = as_string(col)
    if lower:
        col = pc.utf8_lower(col)
    # trimmed first: the split keeps white space that ends the last text of a buffer in its last word
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(col))
    w = of_lists(lists)
    if len(w.vocab) and pc.any(pc.equal(w.vocab, "")).as_py():
        # a text without words gives an empty string: drop it
        keep = pc.not_equal(w.vocab, "").to_numpy(zero_copy_only=False)
        ok = keep[w.codes]
        kept = np.concatenate([[0], np.cumsum(ok)])
        new = np.cumsum(keep) - 1
        return Words(kept[w.offsets], new[w.codes[ok]].astype(np.int32), w.vocab.filter(pa.array(keep)))
    return w


def raw(vocab: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a string array without nulls."""
    _, off, data = vocab.buffers()
    off = np.frombuffer(off, np.int32)[vocab.offset : vocab.offset + len(vocab) + 1].astype(np.int64) if len(vocab) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), off[:-1], np.diff(off)


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(vocab: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    data, starts, lens = raw(vocab)
    out = np.zeros(len(starts), np.uint64)
    if not len(starts) or not lens.sum():
        return mix(out)
    powers = np.cumprod(np.full(int(lens.max()) + 1, _MULT, np.uint64))
    lo, hi = int(starts[0]), int(starts[-1] + lens[-1])
    at = np.arange(lo, hi) - np.repeat(starts, lens)
    terms = _BYTE[data[lo:hi]] * powers[at]
    full = lens > 0
    out[full] = np.add.reduceat(terms, (starts - lo)[full])
    return mix(out + lens.astype(np.uint64))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lens[i] - 1 for each i, one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    shift = starts - (ends - lens)
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31) else np.int64
    out = np.arange(total, dtype=kind)
    out += np.repeat(shift.astype(kind), lens)
    return out


def alike(lens: np.ndarray, each: int, limit: int, few: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Runs of places, the longest first, whose matrix of each bytes for every place and character stays within limit; lengths of a run differ by
    half at most unless they are small. True for a run of few long ones, which go faster, and in less memory, one by one."""
    order = np.argsort(-lens, kind="stable")
    at = 0
    while at < len(order):
        top = int(lens[order[at]])
        end = at + max(1, limit // ((top + 2) * each))
        if top > 64:
            end = min(end, int(np.searchsorted(-lens[order], -(top // 2), side="right")))
        run = order[at : max(at + 1, end)]
        yield run, top > 64 and len(run) < few
        at += len(run)


def uniform(col) -> F.Column:
    """A number in [0, 1) from md5 of the id; SQL of other engines can say the same."""
    return F.conv(F.substring(F.md5(col.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
