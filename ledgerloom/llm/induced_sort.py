"""External induced suffix sorting with common-prefix values.

sort(text) gives the suffixes of an integer text in order, each with the length of the prefix it shares with its neighbour. As in
SA-IS, the suffixes at local minima of type S are sorted first: their substrings by an induction, then, where substrings repeat,
by recursion on the text of their names; the order of all suffixes is induced from theirs, L-types upwards, then S-types downwards.

Induction is by a monotone priority queue. Its keys are characters; an entry is a tuple (character, position, common prefix with the
entry before it under that character) and entries of one character leave in the order in which they came. The alphabet is cut into
ranges of about RANGE entries, so that a range is handled in numpy at once; ranges that wait are held in memory up to a bound
and beyond it in files of the given folder, written and read in sequence. Common prefixes are carried along: of two suffixes
induced in turn into one bucket it is 1 + the least value between their sources, kept for each character as a running minimum.
Of a range, only the entries that it induces into itself need more: their order is found by pointer doubling.

Nothing as long as the text is held: text, types, orders, names and prefixes are mapped files beyond the bound, read and written in blocks of BLOCK,
and the first order of the minima comes out of a queue too. So are the few numbers for each distinct character, of which a recursion has
as many as names. What is held is a few numbers for each range.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

RANGE, BLOCK = 8192, 1 << 17
FAR = np.int32(2**31 - 1)
ENTRY = np.dtype([("c", np.int32), ("p", np.int32), ("l", np.int32)])


class Queue:
    """Entries by range of characters; past `memory` bytes the ranges that wait go to files."""

    def __init__(self, ranges: int, folder: str | None, memory: int):
        self.held: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.folder, self.memory, self.size, self.spilled = folder, memory, 0, 0
        self.files: set[int] = set()

    def _path(self, r: int) -> str:
        return os.path.join(self.folder, f"{id(self):x}-{r}")

    def push(self, ranges: np.ndarray, entries: np.ndarray) -> None:
        """Entries in order; ranges is the range of each."""
        if not len(entries):
            return
        order = np.argsort(ranges, kind="stable")
        which, cut = np.unique(ranges[order], return_index=True)
        for r, part in zip(which.tolist(), np.split(entries[order], cut[1:])):
            self.held[r].append(part)
        self.size += entries.nbytes
        if self.folder and self.size > self.memory:
            self.flush()

    def flush(self) -> None:
        for r, parts in enumerate(self.held):
            if parts:
                with open(self._path(r), "ab") as f:
                    for x in parts:
                        x.tofile(f)
                self.files.add(r)
                self.spilled += sum(x.nbytes for x in parts)
                self.held[r] = []
        self.size = 0

    def pop(self, r: int) -> np.ndarray:
        """All entries of a range, in the order in which they came."""
        parts = self.held[r]
        self.held[r] = []
        self.size -= sum(x.nbytes for x in parts)
        if r in self.files:
            parts = [np.fromfile(self._path(r), ENTRY), *parts]
            os.remove(self._path(r))
            self.files.discard(r)
        return np.concatenate(parts) if parts else np.zeros(0, ENTRY)


class Store:
    """Arrays as long as the text: in memory, or mapped from files where a folder is given and they are large."""

    def __init__(self, folder: str | None, memory: int):
        self.folder, self.memory, self.n = folder, memory, 0

    def new(self, n: int, kind) -> np.ndarray:
        if self.folder and n * np.dtype(kind).itemsize > self.memory // 8:
            self.n += 1
            return np.memmap(os.path.join(self.folder, f"a{id(self):x}-{self.n}"), kind, "w+", shape=(n,))
        return np.zeros(n, kind)


def _blocks(n: int) -> Iterator[slice]:
    for i in range(0, n, BLOCK):
        yield slice(i, min(n, i + BLOCK))


def _types(t: np.ndarray, s_type: np.ndarray, run: np.ndarray) -> int:
    """Whether each suffix is of type S, and the length of the run of its first character, block by block from the end; the number of L-types.

    The last character is the least.
    """
    n, n_l = len(t), 0
    after, after_s, after_run = -1, True, 0  # the character after the block, its type and run
    for part in reversed(list(_blocks(n))):
        x = np.asarray(t[part])
        change = np.flatnonzero(np.diff(x)) + 1
        start = np.concatenate([[0], change])
        size = np.diff(np.concatenate([start, [len(x)]]))
        s_run = np.ones(len(start), bool)
        s_run[:-1] = x[start[:-1]] < x[start[1:]]
        same = int(x[-1]) == after
        s_run[-1] = after_s if same else (int(x[-1]) < after if after >= 0 else True)
        r = np.repeat(start + size, size) - np.arange(len(x))
        if same:
            r[start[-1] :] += after_run
        kinds = np.repeat(s_run, size)
        s_type[part], run[part] = kinds, r
        n_l += int((~kinds).sum())
        after, after_s, after_run = int(x[0]), bool(kinds[0]), int(r[0])
    return n_l


def _minima(a: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k has the minima of 2**k neighbours."""
    out, k = [a], 1
    while 2 * k <= len(a):
        p = out[-1]
        out.append(np.minimum(p[:-k], p[k:]))
        k *= 2
    return out


def _least(tab: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of each a[lo..hi], hi >= lo."""
    size = hi - lo + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int32)
    for k in np.unique(level).tolist():
        m = level == k
        out[m] = np.minimum(tab[k][lo[m]], tab[k][hi[m] - (1 << k) + 1])
    return out


def _induce(t, s_type, run, bounds, seeds: Iterator, down: bool, folder: str | None, memory: int, lcps: bool, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One pass. seeds gives, for each range in order, positions and common prefixes (with the seed before it) in processing order.

    Yields for each range (positions, common prefix with the one before, is a seed), in processing order: upwards of the L-types, each
    character's before its seeds, or downwards of the S-types.
    """
    sigma, ranges = int(bounds[-1]), len(bounds) - 1
    q = Queue(ranges, folder, memory)
    # least value since the last entry of a character within its range, and that range from 1 on, 0 where there was none; least[k]: of all ranges from k on
    since, stamp, least = store.new(sigma, np.int32), store.new(sigma, np.int32), np.full(ranges + 2, FAR, np.int32)
    flip = lambda c: sigma - 1 - c if down else c

    def lately(c: np.ndarray) -> np.ndarray:
        """The least value since each character's last entry, before this range; -1 where there was none."""
        at = np.asarray(stamp[c])
        return np.where(at == 0, -1, np.minimum(since[c], least[at + 1]))

    for r, (sp, sl) in enumerate(seeds):
        lo, hi = int(bounds[r]), int(bounds[r + 1])
        a = q.pop(r)
        order = np.argsort(a["c"], kind="stable")
        a = a[order]
        sc = flip(t[sp])
        n0, n1 = len(a), len(sp)
        pos, char, val = np.concatenate([a["p"], sp]).astype(np.int32), np.concatenate([a["c"], sc]).astype(np.int32), np.concatenate([a["l"], sl]).astype(np.int32)
        if not len(pos):
            yield pos, val, np.zeros(0, bool)
            continue
        kind = np.concatenate([np.zeros(n0, np.int8), np.full(n1, 2, np.int8)])
        # entries that the range induces into itself, wave by wave
        src, wave, base = [np.arange(n0 + n1)], pos, 0
        more_p, more_c = [], []
        while True:
            pre = wave - 1
            ok = pre >= 0
            pre = np.where(ok, pre, 0)
            ok &= s_type[pre] == down
            c = flip(t[pre])
            ok &= c < hi
            ok = np.flatnonzero(ok)
            if not len(ok):
                break
            src.append(ok + base)
            base += len(wave)
            wave = pre[ok].astype(np.int32)
            more_p.append(wave)
            more_c.append(c[ok].astype(np.int32))
        if more_p:
            nd = sum(map(len, more_p))
            pos, char = np.concatenate([pos, *more_p]), np.concatenate([char, *more_c])
            val, kind = np.concatenate([val, np.full(nd, FAR, np.int32)]), np.concatenate([kind, np.ones(nd, np.int8)])
            jump = np.concatenate(src)
            tie = np.concatenate([np.arange(n0 + n1), np.zeros(nd, np.int64)])
            order = np.lexsort((tie, kind, char))
            new = np.r_[True, (np.diff(char[order]) != 0) | (np.diff(kind[order]) != 0) | (np.diff(tie[order]) != 0)]
            rank = np.empty(len(pos), np.int64)
            rank[order] = np.cumsum(new)
            hop = jump
            while not new.all():
                second = rank[hop]
                order = np.lexsort((second, rank))
                new = np.r_[True, (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)]
                rank[order] = np.cumsum(new)
                hop = hop[hop]
        else:
            order = np.lexsort((kind, char)) if n0 and n1 else np.arange(n0 + n1)
        pos, char, val, kind = pos[order], char[order], val[order], kind[order]
        n = len(pos)
        if lcps:
            edge = np.r_[True, np.diff(char) != 0]
            meet = np.r_[False, (kind[1:] == 2) & (kind[:-1] != 2)] & ~edge
            val[edge] = 0
            m = np.flatnonzero(meet)
            val[m] = np.minimum(run[pos[m]], run[pos[m - 1]])
            if more_p:
                place = np.empty(n, np.int64)
                place[order] = np.arange(n)
                where = place[jump[order]]  # place of the source
                last: dict[int, int] = {}
                for i in np.flatnonzero(kind == 1).tolist():
                    c = int(char[i])
                    j, k = last.get(c, -1), int(where[i])
                    last[c] = k
                    if edge[i]:
                        continue
                    w = int(val[j + 1 : k + 1].min()) if k > j else 0
                    if j < 0:
                        w = min(w, int(lately(np.array([c]))[0]))
                    val[i] = w + 1
        pre = pos - 1
        ok = pre >= 0
        pre = np.where(ok, pre, 0)
        ok &= s_type[pre] == down
        c = flip(t[pre])
        ok &= c >= hi
        at = np.flatnonzero(ok)
        ent = np.zeros(len(at), ENTRY)
        ent["c"], ent["p"] = c[at], pre[at]
        if lcps:
            by = np.argsort(ent["c"], kind="stable")
            cc, aa = ent["c"][by], at[by]
            first = np.r_[True, np.diff(cc) != 0] if len(cc) else np.zeros(0, bool)
            tab = _minima(val)
            left = np.where(first, 0, np.r_[0, aa[:-1] + 1]) if len(aa) else aa
            got = _least(tab, left, aa) + 1 if len(aa) else np.zeros(0, np.int32)
            old = lately(cc)
            got = np.where(first, np.where(old < 0, 0, np.minimum(got, np.where(old < 0, 0, old) + np.where(old == FAR, 0, 1))), got)
            ent["l"][by] = got
            least[: r + 2] = np.minimum(least[: r + 2], val.min())
            if len(cc):
                end = np.r_[first[1:], True]
                tail = np.concatenate([np.minimum.accumulate(val[::-1])[::-1], [FAR]])
                since[cc[end]] = tail[aa[end] + 1]
                stamp[cc[end]] = r + 1
        q.push(np.searchsorted(bounds, ent["c"], side="right") - 1, ent)
        yield pos, val, kind == 2
    _induce.spilled += q.spilled


_induce.spilled = 0


def _ranges(count: np.ndarray) -> np.ndarray:
    """Bounds of ranges of characters with about RANGE suffixes each."""
    cuts, before, last = [np.zeros(1, np.int64)], 0, None
    for block in _blocks(len(count)):
        x = np.cumsum(count[block]) + before
        before = int(x[-1])
        part = x // RANGE
        step = np.flatnonzero(np.diff(part, prepend=part[0] if last is None else last)) + block.start
        cuts.append(step)
        last = part[-1]
    return np.concatenate([*cuts, [len(count)]])


def _upto(count: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The sum of count before each of the places, which ascend."""
    out, before = np.zeros(len(places), np.int64), 0
    for block in _blocks(len(count)):
        i, j = np.searchsorted(places, [block.start + 1, block.stop + 1])
        x = np.cumsum(count[block])
        out[i:j] = before + x[places[i:j] - block.start - 1]
        before += int(x[-1])
    return out


def _counts(values: np.ndarray, sigma: int, store: Store, of: np.ndarray | None = None) -> np.ndarray:
    """How often each character is among values, or among those of the text at the places values."""
    out = store.new(sigma, np.int64)
    for part in _blocks(len(values)):
        c, k = np.unique(values[part] if of is None else of[values[part]], return_counts=True)
        out[c] += k
    return out


def _by_range(count: np.ndarray, pos: np.ndarray, val: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted seeds by range; count: how many each character has."""
    at = _upto(count, bounds)
    for i, j in zip(at, at[1:]):
        yield np.asarray(pos[i:j]), np.asarray(val[i:j])


def _by_character(t: np.ndarray, lms: np.ndarray, bounds: np.ndarray, folder: str | None, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The minima by their first character only, through a queue."""
    q = Queue(len(bounds) - 1, folder, memory)
    for part in _blocks(len(lms)):
        ent = np.zeros(part.stop - part.start, ENTRY)
        ent["p"] = lms[part]
        ent["c"] = t[ent["p"]]
        q.push(np.searchsorted(bounds, ent["c"], side="right") - 1, ent)
    for r in range(len(bounds) - 1):
        a = q.pop(r)
        a = a[np.argsort(a["c"], kind="stable")]
        yield a["p"].copy(), np.zeros(len(a), np.int32)
    _induce.spilled += q.spilled


def _passes(t, s_type, run, n_l: int, count: np.ndarray, seeds: Callable[[np.ndarray], Iterator], folder, memory: int, lcps: bool, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes but the last, largest first, in blocks of (positions, common prefix with the one before, which is larger). seeds: by bounds of ranges."""
    sigma = len(count)
    up = _ranges(count)
    lp, ll = store.new(n_l, np.int32), store.new(n_l, np.int32)
    of_l = store.new(sigma, np.int64)
    k = 0
    for pos, val, is_seed in _induce(t, s_type, run, up, seeds(up), False, folder, memory, lcps, store):
        p, v = pos[~is_seed], val[~is_seed]
        lp[k : k + len(p)], ll[k : k + len(p)] = p, v
        k += len(p)
        if len(p):
            c, m = np.unique(t[p], return_counts=True)
            of_l[c] += m
    dn = _ranges(count[::-1])

    def seeds_down() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at = _upto(of_l, (sigma - dn)[::-1])[::-1]  # a range of mirrored characters [x, y) is [sigma - y, sigma - x)
        for j, i in zip(at, at[1:]):
            p = np.asarray(lp[i:j])[::-1]
            # with the one before in this order: the next larger of the same character, whose value says so
            v = np.r_[np.asarray(ll[i + 1 : j])[::-1], np.int32(0)] if j > i else np.zeros(0, np.int32)
            yield p, np.r_[np.int32(0), v[:-1]] if j > i else v

    for pos, val, _ in _induce(t, s_type, run, dn, seeds_down(), True, folder, memory, lcps, store):
        yield pos, val


def _equal_ahead(t: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes a[i] and b[i], known to agree on start[i] characters."""
    out = start.copy()
    live = np.arange(len(a))
    n = len(t)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        same = np.zeros(len(live), bool)
        same[ok] = t[x[ok]] == t[y[ok]]
        live = live[same]
        out[live] += 1
    return out


def sort(text: np.ndarray, *, folder: str | None = None, memory: int = 128 << 20, lcps: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of text, largest first, in blocks of (positions, common prefix with the one before).

    text: integers from 0 on, dense; its last is 0 and no other is. folder: where what exceeds `memory` bytes is held.
    """
    t = np.asarray(text, np.int32) if not isinstance(text, np.memmap) else text
    n = len(t)
    store = Store(folder, memory)
    if n <= 1:
        return
    sigma = max(int(np.max(t[part])) for part in _blocks(n)) + 1
    s_type, run, is_lms = store.new(n, bool), store.new(n, np.int32), store.new(n, bool)
    n_l = _types(t, s_type, run)
    m = 0
    for part in _blocks(n):
        lo = max(part.start - 1, 0)
        x = np.asarray(s_type[lo : part.stop])
        is_lms[lo + 1 : part.stop] = x[1:] & ~x[:-1]
        m += int((x[1:] & ~x[:-1]).sum())
    lms, k = store.new(m, np.int32), 0
    for part in _blocks(n):
        at = np.flatnonzero(is_lms[part]) + part.start
        lms[k : k + len(at)] = at
        k += len(at)
    count = _counts(t, sigma, store)
    # 1. the substrings between minima, by an induction whose seeds are in order of their first character only
    order, k = store.new(m, np.int32), m
    for p, _ in _passes(t, s_type, run, n_l, count, lambda up: _by_character(t, lms, up, folder, memory), folder, memory, False, store):
        p = p[is_lms[p]]
        order[k - len(p) : k] = p[::-1]  # the largest come first
        k -= len(p)
    order[:k] = lms[m - k :]  # the last of all, which no pass gives
    # 2. names; equal substrings have equal names
    small, names = store.new(m, np.int32), -1
    before = None
    for part in _blocks(m):
        here = np.asarray(order[part]).astype(np.int64)
        index = np.searchsorted(lms, here)
        size = np.where(index + 1 < m, lms[np.minimum(index + 1, m - 1)], n - 1) - here
        pos, length = (here, size) if before is None else (np.r_[before[0], here], np.r_[before[1], size])
        equal = np.zeros(len(pos) - 1, bool)
        live, j = np.flatnonzero(length[1:] == length[:-1]), 0
        while len(live):
            done = length[1:][live] < j
            equal[live[done]] = True
            live = live[~done]
            live = live[t[pos[1:][live] + j] == t[pos[:-1][live] + j]]
            j += 1
        new = ~equal if before is not None else np.r_[True, ~equal]
        name = names + np.cumsum(new)
        small[index] = name
        names, before = int(name[-1]), (here[-1:], size[-1:])
    # 3. the order of the minima's suffixes and their common prefixes
    seeds, lcp = store.new(m, np.int32), store.new(m, np.int32)
    if names + 1 < m:
        rank, shared, k = store.new(m, np.int32), store.new(m, np.int32), m
        for p, v in sort(small, folder=folder, memory=memory, lcps=lcps):
            rank[k - len(p) : k] = p[::-1]
            # a block's values are with the one before, which is larger; here they are with the next smaller
            lo, hi = k - len(p) + 1, min(k + 1, m)
            shared[lo:hi] = v[::-1][: hi - lo]
            k -= len(p)
        rank[0] = m - 1
        shared[:2] = 0
    else:
        rank, shared = store.new(m, np.int32), None
        for part in _blocks(m):
            rank[part] = np.searchsorted(lms, order[part])
    for part in _blocks(m):
        seeds[part] = lms[np.asarray(rank[part])]
    if lcps:
        for part in _blocks(m - 1):  # of neighbours part.start .. part.stop
            i, j = np.asarray(rank[part]), np.asarray(rank[part.start + 1 : part.stop + 1])
            both = np.zeros(len(i), np.int64) if shared is None else np.asarray(shared[part.start + 1 : part.stop + 1]).astype(np.int64)
            known = lms[np.minimum(i + both, m - 1)].astype(np.int64) - lms[i]
            lcp[part.start + 1 : part.stop + 1] = _equal_ahead(t, lms[i].astype(np.int64), lms[j].astype(np.int64), known)
    first = _counts(lms, sigma, store, t)
    yield from _passes(t, s_type, run, n_l, count, lambda up: _by_range(first, seeds, lcp, up), folder, memory, lcps, store)


def dense(words: np.ndarray) -> np.ndarray:
    """Integers as ranks from 1 on, with the end 0 after them."""
    _, inv = np.unique(words, return_inverse=True)
    return np.append(inv.astype(np.int32) + 1, np.int32(0))


def scratch(folder: str | None):
    """A folder for one sort, deleted after it; within the given shared folder, or the system's where none is given (tests)."""
    if folder:
        os.makedirs(folder, exist_ok=True)
    return tempfile.TemporaryDirectory(prefix="sort-", dir=folder)
