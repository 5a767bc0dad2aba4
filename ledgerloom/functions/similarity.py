"""String similarities that Spark lacks, as Arrow functions over columns of distinct pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("snippet", StringType())])

#: Characters of texts that are searched in one step.
TOGETHER = 1 << 18


def jaro_winkler(a: str, b: str) -> float:
    """Prefix weight 0.1 over at most four characters, where the Jaro similarity exceeds 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for j, c in enumerate(b) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths, by bit-parallel rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    lcs = len(a) - v.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def _indel_windows(rows: list[tuple[str, str, np.ndarray]]) -> list[np.ndarray]:
    """For each (quote, text, starts) indel_ratio of quote with each window of text as long as it; all windows in step, 64 characters of a quote to a word.

    The quotes have one length, and their texts all at least that or all one other.
    """
    points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, size = len(rows[0][0]), min(len(rows[0][0]), len(rows[0][1]))
    words, masks, places, starts, chars, base = range(0, n, 64), [], [], [], 0, 0
    for quote, text, at in rows:
        t = points(text)
        kinds, code = np.unique(points(quote), return_inverse=True)
        mask = np.zeros((len(words), len(kinds) + 1), np.uint64)
        for k, i in enumerate(words):
            np.bitwise_or.at(mask[k], code[i : i + 64], np.uint64(1) << np.arange(len(code[i : i + 64]), dtype=np.uint64))
        place = np.minimum(np.searchsorted(kinds, t), len(kinds) - 1)
        masks.append(mask), places.append(np.where(kinds[place] == t, place, len(kinds)) + base), starts.append(at + chars)  # the last mask is empty
        chars, base = chars + len(t), base + len(kinds) + 1
    mask, place, at = np.concatenate(masks, 1), np.concatenate(places), np.concatenate(starts)
    full = [np.uint64((1 << min(64, n - i)) - 1) for i in words]
    v = [np.full(len(at), x) for x in full]
    for j in range(size):
        c, carry = place[at + j], None
        for k, x in enumerate(v):
            u = x & mask[k][c]
            total = x + u
            if len(v) > 1:
                over = total < u
                if carry is not None:
                    total = total + carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            v[k] = (total | (x ^ u)) & full[k]
    lcs = n - sum(np.bitwise_count(x).astype(np.int64) for x in v)
    return np.split(200.0 * lcs / (n + size), np.cumsum([len(x) for *_, x in rows])[:-1])


#: Characters of a step of jaro_winkler_all.
CELLS = 1 << 21


def _codes(texts: list[str], width: int) -> np.ndarray:
    """A row of code points for each text, filled up with zeros."""
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(texts), width)


def jaro_winkler_all(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler of each pair, for many pairs in step."""
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out, at = np.zeros(len(a)), 0
    order = np.argsort(np.maximum(la, lb), kind="stable")
    longest = np.maximum(np.maximum(la, lb)[order], 1)
    while at < len(order):
        ends = min(len(order), at + max(1, CELLS // int(longest[at])))
        # the longest of a step, which is its last, decides how many it may have
        size = max(1, int(np.searchsorted(np.arange(1, ends - at + 1) * longest[at:ends], CELLS, side="right")))
        i = order[at : at + size]
        at += size
        out[i] = _together([a[j] for j in i], [b[j] for j in i], la[i], lb[i])
    return out


def _together(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, wa, wb = len(a), max(1, int(la.max())), max(1, int(lb.max()))
    x, y = _codes(a, wa), _codes(b, wb)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free = np.arange(wb)[None, :] < lb[:, None]
    taken, left, place = np.zeros((n, wb), bool), np.zeros((n, wa), bool), np.arange(wb)[None, :]
    for i in range(wa):
        near = free & ~taken & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach[:, None]) & (i < la)[:, None]
        first = near.argmax(1)
        hit = near[np.arange(n), first]
        taken[np.flatnonzero(hit), first[hit]] = True
        left[:, i] = hit
    m = left.sum(1)
    # the matched characters of both sides in order
    width = max(1, int(m.max()) if n else 1)
    p = np.take_along_axis(x, np.argsort(~left, axis=1, kind="stable")[:, :width], 1)
    q = np.take_along_axis(y, np.argsort(~taken, axis=1, kind="stable")[:, :width], 1)
    swaps = ((p != q) & (np.arange(p.shape[1])[None, :] < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / np.maximum(m, 1)) / 3, 0.0)
    four = min(4, wa, wb)
    same = (x[:, :four] == y[:, :four]) & (np.arange(four)[None, :] < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, axis=1).sum(1)
    equal = np.fromiter((s == t for s, t in zip(a, b)), bool, n)
    return np.where(equal, 1.0, np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro))


def _jw(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = jaro_winkler_all(a[known].tolist(), b[known].tolist())
    return pd.Series(out, dtype="float64")


def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _fuzzy(text: pd.Series, quote: pd.Series, least: pd.Series) -> pd.DataFrame:
    out: list[tuple] = [(None, None, None)] * len(text)
    alike: dict = {}
    chars: Counter = Counter()

    def search(held: list[tuple]) -> None:
        for (i, q, t, at, low), ratio in zip(held, _indel_windows([x[1:4] for x in held])):
            k = int(np.argmax(ratio))
            if ratio[k] > low:
                best = int(at[k])
                out[i] = best, min(best + len(q), len(t)), t[best : best + len(q)]

    for i, (t, q, low) in enumerate(zip(text, quote, least)):
        q = (q or "").strip()
        n = len(q)
        if t and n:
            kind = n, min(n, len(t))
            held = alike.setdefault(kind, [])
            chars[kind] += len(t)
            held.append((i, q, t, np.arange(0, max(1, len(t) - n + 1), max(1, n // 4)), low))
            if chars[kind] > TOGETHER:
                search(held)
                held.clear()
                chars[kind] = 0
    for held in alike.values():
        if held:
            search(held)
    return pd.DataFrame(out, columns=["start", "end", "snippet"])


def jw(a: Column, b: Column) -> Column:
    return pandas_udf(_jw, DoubleType())(a, b)


def indel(a: Column, b: Column) -> Column:
    return pandas_udf(_indel, DoubleType())(a, b)


def ground_fuzzy(text: Column, quote: Column, min_score: float = 85.0) -> Column:
    """The window, as long as the quote and a quarter of it apart, with the best ratio above min_score; the first of equals."""
    hit = pandas_udf(_fuzzy, SPAN)(text, quote, F.lit(min_score))
    return F.when(hit["start"].isNotNull(), hit)
