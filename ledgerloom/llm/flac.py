"""FLAC media columns: Rice residuals, fixed and linear predictors and stereo decorrelation decoded to PCM blocks, checksums verified.

Each frame becomes a row with the offset of its first sample, so that a reader seeks to a sample by the offsets alone.
A partition's code words are found one after the other through a table of the next set bit; their remainders are read in numpy.
Linear predictors are undone for a run of frames in step, one sample of every subframe at a time. A frame's checksum is the exclusive or of what
each byte adds at its distance from the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCHEMA = "block int, first_sample bigint, n_samples int, channels int, sample_rate int, bits int, crc_ok boolean, pcm array<int>, error string"
#: Frames, and samples of all channels, that are held at once.
ROWS, SAMPLES = 1024, 1 << 20
CLIP = 16


def _table(poly: int, width: int) -> list[int]:
    out = []
    for i in range(256):
        v = i << (width - 8)
        for _ in range(8):
            v = ((v << 1) ^ (poly if v >> (width - 1) else 0)) & ((1 << width) - 1)
        out.append(v)
    return out


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    v = 0
    for b in data:
        v = _CRC8[v ^ b]
    return v


def _distances(n: int) -> np.ndarray:
    """[d, b]: the checksum of byte b with d zero bytes after it."""
    out = np.empty((n, 256), np.uint16)
    out[0] = _CRC16
    for d in range(1, n):
        out[d] = (out[d - 1] << 8) ^ out[0][out[d - 1] >> 8]
    return out


_FAR = _distances(1024)


def crc16(data: bytes) -> int:
    v, x = 0, np.frombuffer(data, np.uint8)
    for i in range(0, len(x), len(_FAR)):
        part = x[i : i + len(_FAR)]
        if v:  # what came before is two bytes that the next ones start with
            part = np.concatenate([part, np.zeros(max(0, 2 - len(part)), np.uint8)])
            if len(x) - i < 2:
                v = ((v << 8) & 0xFF00) ^ _CRC16[(v >> 8) ^ int(x[i])]
                break
            part = part.copy()
            part[0] ^= v >> 8
            part[1] ^= v & 255
        v = int(np.bitwise_xor.reduce(_FAR[np.arange(len(part) - 1, -1, -1), part]))
    return v


class BadFrame(ValueError):
    pass


class Bits:
    """Reads from a byte on; the table of next set bits is made for stretches as they are needed."""

    WINDOW = 1 << 16

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.lo, self.hi = data, at * 8, 0, 0

    def get(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise BadFrame("ends within a frame")
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n)
        self.at += n
        return v & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.get(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.get(1):
            n += 1
        return n

    def _load(self, at: int) -> None:
        byte = at >> 3
        part = np.unpackbits(np.frombuffer(self.data, np.uint8, min(self.WINDOW, len(self.data) - byte), byte))
        if not len(part):
            raise BadFrame("ends within a frame")
        self.lo, self.hi = byte * 8, byte * 8 + len(part)
        self.bits = part
        following = np.where(part, np.arange(len(part)), len(part))
        self.next = [*np.minimum.accumulate(following[::-1])[::-1].tolist(), len(part)]

    def array(self, n: int, count: int) -> np.ndarray:
        """count signed numbers of n bits."""
        if not n:
            return np.zeros(count, np.int64)
        a, b = self.at >> 3, (self.at + n * count + 7) >> 3
        if b > len(self.data):
            raise BadFrame("ends within a frame")
        bits = np.unpackbits(np.frombuffer(self.data, np.uint8, b - a, a))[self.at - 8 * a :][: n * count].reshape(count, n)
        self.at += n * count
        v = bits.astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
        return v - (bits[:, 0].astype(np.int64) << n)

    def rice(self, k: int, count: int) -> np.ndarray:
        """count Rice codes with parameter k."""
        out, done, at = np.empty(count, np.int64), 0, self.at
        while done < count:
            if not self.lo <= at < self.hi - (8 if self.hi < len(self.data) * 8 else 0):
                self._load(at)
            first, end, nxt = at - self.lo, self.hi - self.lo, self.next
            start, pos, step = [], first, k + 1
            add = start.append
            last = self.hi == len(self.data) * 8
            for _ in range(count - done):
                one = nxt[pos]
                pos = one + step
                if pos > end:
                    break
                add(one)
            if not start:
                if last or at - self.lo < 8:
                    # a code longer than the window, or the data's end within one
                    self.at = at
                    q = self.unary()
                    out[done] = (q << k) | self.get(k)
                    at, done = self.at, done + 1
                else:
                    self._load(at)
                continue
            one = np.array(start)
            quotient = one - np.concatenate([[first], one[:-1] + step])
            low = self.bits[one[:, None] + np.arange(1, k + 1)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
            out[done : done + len(one)] = (quotient << k) | low
            done, at = done + len(one), int(one[-1]) + step + self.lo
        self.at = at
        return (out >> 1) ^ -(out & 1)


def _residual(b: Bits, size: int, order: int) -> np.ndarray:
    method = b.get(2)
    if method > 1:
        raise BadFrame("reserved residual coding")
    wide, parts = 5 if method else 4, 1 << b.get(4)
    if size % parts or size // parts < order:
        raise BadFrame("partitions don't fit the block")
    out = []
    for i in range(parts):
        n = size // parts - (order if i == 0 else 0)
        k = b.get(wide)
        out.append(b.array(b.get(5), n) if k == (1 << wide) - 1 else b.rice(k, n))
    return np.concatenate(out)


class Predicted:
    """A subframe whose linear predictor is still to be undone."""

    def __init__(self, warm: np.ndarray, residual: np.ndarray, coef: np.ndarray, shift: int, wasted: int):
        self.warm, self.residual, self.coef, self.shift, self.wasted = warm, residual, coef, shift, wasted


def restore(parts: list[Predicted]) -> list[np.ndarray]:
    """The samples of each, those of one order and length in step."""
    alike: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(parts):
        alike.setdefault((len(p.warm), len(p.residual)), []).append(i)
    out: list = [None] * len(parts)
    for (order, n), members in alike.items():
        x = np.empty((order + n, len(members)), np.int64)
        coef = np.empty((order, len(members)), np.int64)
        for k, i in enumerate(members):
            x[:order, k], x[order:, k], coef[:, k] = parts[i].warm, parts[i].residual, parts[i].coef[::-1]
        shift = np.array([parts[i].shift for i in members])
        for t in range(order, order + n):
            x[t] += np.einsum("om,om->m", coef, x[t - order : t]) >> shift
        for k, i in enumerate(members):
            out[i] = x[:, k] << parts[i].wasted
    return out


def _subframe(b: Bits, size: int, bits: int) -> np.ndarray | Predicted:
    if b.get(1):
        raise BadFrame("padding bit of a subframe")
    kind = b.get(6)
    wasted = b.unary() + 1 if b.get(1) else 0
    bits -= wasted
    if bits < 1:
        raise BadFrame("more wasted bits than a sample has")
    if kind == 0:
        x = np.full(size, b.signed(bits), np.int64)
    elif kind == 1:
        x = b.array(bits, size)
    elif 8 <= kind <= 12:
        order = kind - 8
        if order > size:
            raise BadFrame("order above the block")
        warm = b.array(bits, order)
        x = _residual(b, size, order)
        for d in range(order, 0, -1):  # undo the differences, the last taken first
            lead = np.diff(warm, d - 1)[0] if d > 1 else warm[0]
            x = np.cumsum(np.concatenate([[lead], x]))
    elif kind >= 32:
        order = kind - 31
        warm = b.array(bits, order)
        precision = b.get(4) + 1
        if precision == 16:
            raise BadFrame("reserved coefficient precision")
        shift = b.signed(5)
        if shift < 0:
            raise BadFrame("negative shift")
        coef = b.array(precision, order)
        return Predicted(warm, _residual(b, size, order), coef, shift, wasted)
    else:
        raise BadFrame("reserved subframe")
    return x << wasted


def _coded_number(b: Bits) -> int:
    first = b.get(8)
    if first < 0x80:
        return first
    n = 0
    while first << n & 0x80:
        n += 1
    if n in (1, 8):
        raise BadFrame("coded number")
    v = first & ((1 << (7 - n)) - 1 if n < 7 else 0)
    for _ in range(n - 1):
        c = b.get(8)
        if c >> 6 != 2:
            raise BadFrame("coded number")
        v = v << 6 | c & 63
    return v


def _frame(b: Bits, at: int, info: dict) -> tuple[dict, int]:
    """The frame at a byte, its channels as they are coded, and the byte after it."""
    data = b.data
    b.at = at * 8
    if b.get(15) != 0x7FFC:
        raise BadFrame("no sync code")
    variable = b.get(1)
    size_code, rate_code, channel, bits_code = b.get(4), b.get(4), b.get(4), b.get(3)
    if b.get(1) or channel > 10 or not size_code or bits_code == 3 or rate_code == 15:
        raise BadFrame("reserved value in a frame header")
    number = _coded_number(b)
    size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else b.get(8 * (size_code - 5)) + 1 if size_code < 8 else 256 << (size_code - 8)
    rate = b.get(8) * 1000 if rate_code == 12 else b.get(16) * (10 if rate_code == 14 else 1) if rate_code > 12 else [info["rate"], 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000][rate_code]
    if crc8(data[at : b.at // 8]) != b.get(8):
        raise BadFrame("checksum of a frame header")
    bits = [info["bits"], 8, 12, 0, 16, 20, 24, 32][bits_code]
    first = number if variable else number * info["block"]
    out = {"first": first, "size": size, "rate": rate, "bits": bits, "channels": 2 if channel > 7 else channel + 1, "ok": False, "pcm": None, "error": None}
    try:
        side = {8: 1, 9: 0, 10: 1}.get(channel)
        x = [_subframe(b, size, bits + (c == side)) for c in range(out["channels"])]
        end = (b.at + 7) // 8
        if end + 2 > len(data):
            raise BadFrame("ends within a frame")
    except (BadFrame, IndexError, ValueError, OverflowError) as e:
        out["error"] = str(e)
        return out, -1
    if crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        out["error"] = "checksum of a frame"
        return out, -1
    out["ok"], out["coded"], out["mode"] = True, x, channel
    return out, end + 2


def finish(run: list[dict]) -> None:
    """Samples of frames that were read: predictors undone together, then the stereo modes."""
    open_ = [(f["coded"], c) for f in run if f["ok"] for c in range(f["channels"]) if isinstance(f["coded"][c], Predicted)]
    for (coded, c), x in zip(open_, restore([coded[c] for coded, c in open_])):
        coded[c] = x
    for f in run:
        if f["ok"]:
            x, mode = f.pop("coded"), f.pop("mode")
            if mode == 8:
                x[1] = x[0] - x[1]
            elif mode == 9:
                x[0] = x[0] + x[1]
            elif mode == 10:
                mid = (x[0] << 1) | (x[1] & 1)
                x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
            f["pcm"] = np.stack(x, 1).ravel()


def frames(data: bytes) -> Iterator[dict]:
    """Every frame of a stream with its samples, in runs of ROWS frames. What read says of damage holds."""
    run: list[dict] = []
    for f in read(data):
        run.append(f)
        if len(run) >= ROWS:
            finish(run)
            yield from run
            run = []
    finish(run)
    yield from run


def read(data: bytes) -> Iterator[dict]:
    """Every frame of a stream, for finish; one whose checksum fails has no samples, and reading goes on at the next frame header that checks.

    Raises BadFrame where the stream isn't FLAC.
    """
    if data[:4] != b"fLaC":
        raise BadFrame("not a FLAC stream")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise BadFrame("ends within its metadata")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            v = int.from_bytes(data[at + 4 : at + 38], "big")
            info = {"block": v >> 240 & 0xFFFF, "rate": v >> 172 & 0xFFFFF, "channels": (v >> 169 & 7) + 1, "bits": (v >> 164 & 31) + 1, "total": v >> 128 & ((1 << 36) - 1)}
            info["block"] = v >> 256 & 0xFFFF or info["block"]
        at += 4 + size
        if last:
            break
    if info is None:
        raise BadFrame("no stream information")
    bits = Bits(data, at)
    while at < len(data):
        end = -1
        try:
            frame, end = _frame(bits, at, info)
            yield frame
        except BadFrame:
            pass
        if end < 0:  # to the next header that checks
            end = at + 1
            while (end := data.find(b"\xff", end)) >= 0:
                if data[end + 1 : end + 2] in (b"\xf8", b"\xf9"):
                    try:
                        b = Bits(data, end)
                        b.get(32)
                        _coded_number(b)
                        code = data[end + 2]
                        b.get({6: 8, 7: 16}.get(code >> 4, 0)), b.get({12: 8, 13: 16, 14: 16}.get(code & 15, 0))
                        if crc8(data[end : b.at // 8]) == b.get(8):
                            break
                    except BadFrame:
                        pass
                end += 1
            if end < 0:
                return
        at = end


def decode(media: DataFrame, *, id_col: str = "clip_id", media_col: str = "flac") -> DataFrame:
    """(id, block, first_sample, n_samples, channels, sample_rate, bits, crc_ok, pcm, error): a row for each frame; no shuffle.

    pcm has the channels' samples interleaved. A frame whose checksum fails has crc_ok = false, a null pcm and its error. A null, empty
    or foreign value gives one row with its error and null otherwise; a stream without frames gives none. Repeated rows and null ids are decoded
    row by row; other columns, whatever their names, are dropped. An empty table gives an empty result. Streams of any length are
    whole; rows go out in runs of ROWS frames.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[int, int | None, dict]] = []

            def flush() -> pa.RecordBatch:
                finish([f for _, _, f in held])  # noqa: B023
                cols = [[i for _, i, _ in held], *([f[n] for _, _, f in held] for n in ("first", "size", "channels", "rate", "bits", "ok", "pcm", "error"))]  # noqa: B023
                return pa.RecordBatch.from_arrays([b.column("id").take(pa.array([r for r, _, _ in held], pa.int64())), *(pa.array(c, t) for c, t in zip(cols, TYPES))], ["id", *NAMES])  # noqa: B023

            samples = 0
            for r, value in enumerate(b.column("media")):
                data = value.as_py()
                try:
                    if data is None:
                        raise BadFrame("null")
                    for i, f in enumerate(read(data)):
                        held.append((r, i, f))
                        samples += f["size"] * f["channels"]
                        if len(held) >= ROWS or samples >= SAMPLES:
                            yield flush()
                            held, samples = [], 0
                except BadFrame as e:
                    held.append((r, None, {"first": None, "size": None, "channels": None, "rate": None, "bits": None, "ok": False, "pcm": None, "error": str(e)}))
            if held:
                yield flush()

    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.string()]


def write_blocks(decoded: DataFrame, path: str, *, id_col: str = "clip_id") -> None:
    """PCM blocks as Parquet, sorted within files by id and first sample, so that row groups are skipped when a reader seeks.

    Rows without samples (damaged, null or foreign) aren't written; those that repeat a block are, each. A null id is written under null. An empty table gives
    an empty folder of the same schema. Clips are spread by id and first sample, so that one of any length is in many files.
    """
    decoded.filter("pcm is not null").repartitionByRange(id_col, "first_sample").sortWithinPartitions(id_col, "first_sample").write.mode("overwrite").parquet(path)


def seek(blocks: DataFrame, clip, first: int, n: int, *, id_col: str = "clip_id") -> DataFrame:
    """The blocks that hold the samples first .. first + n of a clip, with the part of pcm that is theirs; none for an id that isn't there, null, or past the end."""
    hit = blocks.filter((F.col(id_col) == F.lit(clip)) & (F.col("first_sample") < first + n) & (F.col("first_sample") + F.col("n_samples") > first))
    lo, hi = F.greatest(F.lit(first) - F.col("first_sample"), F.lit(0)), F.least(F.lit(first + n) - F.col("first_sample"), F.col("n_samples").cast("long"))
    part = F.slice("pcm", (lo * F.col("channels") + 1).cast("int"), ((hi - lo) * F.col("channels")).cast("int"))
    return hit.select(id_col, (F.col("first_sample") + lo).alias("first_sample"), (hi - lo).cast("int").alias("n_samples"), "channels", part.alias("pcm")).orderBy("first_sample")


class _Writer:
    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(np.array([value >> i & 1 for i in range(n - 1, -1, -1)], np.uint8))

    def array(self, values: np.ndarray, n: int) -> None:
        if n and len(values):
            self.parts.append((values[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8).ravel())

    def rice(self, r: np.ndarray, k: np.ndarray, heads: np.ndarray, wide: int = 4) -> None:
        """Codes of r with the parameters k; before each of heads, the parameter itself in wide bits."""
        u = (r << 1) ^ (r >> 63)
        size = (u >> k) + 1 + k
        size[heads] += wide
        end = np.cumsum(size)
        bits = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
        bits[end - k - 1] = 1
        for i in range(int(k.max()) if len(k) else 0):
            m = k > i
            bits[end[m] - 1 - i] = u[m] >> i & 1
        for i in range(wide):
            bits[end[heads] - size[heads] + i] = k[heads] >> (wide - 1 - i) & 1
        self.parts.append(bits)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes() if self.parts else b""


_KS = np.arange(15)


def _best_k(u: np.ndarray) -> np.ndarray:
    """For each row of folded residuals the parameter with the fewest bits."""
    return np.argmin((u[:, :, None] >> _KS).sum(1) + u.shape[1] * (_KS + 1), 1)


def _price(r: np.ndarray) -> float:
    """About the bits of residuals under one parameter, from their mean."""
    mean = np.abs(r).mean() if len(r) else 0.0
    return len(r) * (np.log2(mean + 1) + 2)


def _put_residual(w: _Writer, r: np.ndarray, size: int, order: int) -> None:
    po = 0
    while po < 3 and size % (2 << po) == 0 and size >> (po + 1) > max(order, 16):
        po += 1
    w.put(0, 2), w.put(po, 4)
    each = size >> po
    u = (np.concatenate([np.zeros(order, np.int64), (r << 1) ^ (r >> 63)])).reshape(1 << po, each)
    k = _best_k(u)
    if each > order:
        heads = np.arange(1 << po) * each - order
        heads[0] = 0
        w.rice(r, np.repeat(k, each)[order:], heads)
    else:  # a single partition without codes
        w.put(0, 4)


def _lpc(x: np.ndarray, order: int, precision: int = 12) -> tuple[np.ndarray, int] | None:
    """Quantised coefficients by Levinson and Durbin, and their shift."""
    y = x.astype(np.float64) * np.hanning(len(x) + 2)[1:-1]
    a = np.array([float(y[: len(y) - i] @ y[i:]) for i in range(order + 1)])
    if a[0] <= 0:
        return None
    coef, err = np.zeros(order), a[0] * (1 + 1e-9)
    for i in range(order):
        k = (a[i + 1] - coef[:i] @ a[i:0:-1][:i]) / err
        coef[:i] = coef[:i] - k * coef[:i][::-1]
        coef[i] = k
        err *= 1 - k * k
        if err <= 0:
            return None
    top = np.abs(coef).max()
    if top == 0:
        return None
    shift = int(np.clip(precision - 2 - np.floor(np.log2(top)), 0, 15))
    return np.clip(np.round(coef * (1 << shift)), -(1 << (precision - 1)), (1 << (precision - 1)) - 1).astype(np.int64), shift


def _put_subframe(w: _Writer, x: np.ndarray, bits: int) -> None:
    wasted = 0
    if len(x) and x.any():
        while not (x & ((2 << wasted) - 1)).any():
            wasted += 1
    x, bits = x >> wasted, bits - wasted
    flag = lambda: (w.put(1, 1), w.put(1, wasted)) if wasted else w.put(0, 1)
    if (x == x[0]).all():
        w.put(0, 7), flag(), w.put(int(x[0]) & ((1 << bits) - 1), bits)
        return
    best = (len(x) * bits, 1, None)
    for order in range(min(4, len(x) - 1) + 1):
        r = np.diff(x, order)
        best = min(best, (_price(r) + order * bits, 8 + order, r), key=lambda t: t[0])
    order = min(8, len(x) // 4)
    lpc = _lpc(x, order) if order else None
    if lpc:
        c, shift = lpc
        pred = np.convolve(x, c)[order - 1 : len(x) - 1] >> shift
        r = x[order:] - pred
        best = min(best, (_price(r) + order * (bits + 12), 31 + order, r), key=lambda t: t[0])
    _, kind, r = best
    w.put(kind, 7), flag()
    if kind == 1:
        w.array(x, bits)
        return
    order = kind - 31 if kind >= 32 else kind - 8
    w.array(x[:order], bits)
    if kind >= 32:
        w.put(11, 4), w.put(shift, 5), w.array(c, 12)
    _put_residual(w, r, len(x), order)


def encode(pcm: np.ndarray, *, rate: int = 16000, bits: int = 16, block: int = 256) -> bytes:
    """A stream of the samples (n, channels), for fixtures and queries: fixed and linear predictors, partitions, stereo modes."""
    x = np.asarray(pcm, np.int64)
    x = x[:, None] if x.ndim == 1 else x
    n, channels = x.shape
    width = (bits + 7) // 8
    raw = x.astype("<i4").view(np.uint8).reshape(n, channels, 4)[:, :, :width].tobytes() if n else b""
    head = (block << 16 | block) << 240 | rate << 172 | (channels - 1) << 169 | (bits - 1) << 164 | n << 128 | int.from_bytes(hashlib.md5(raw).digest(), "big")
    out = bytearray(b"fLaC" + bytes([0x80, 0, 0, 34]) + head.to_bytes(34, "big"))
    for i in range(0, n, block):
        part = x[i : i + block]
        mode, chans = channels - 1, [(part[:, c], bits) for c in range(channels)]
        if channels == 2:
            left, right = part[:, 0], part[:, 1]
            side = left - right
            cost = lambda v: int(np.abs(np.diff(v, 1)).sum())
            options = [(cost(left) + cost(right), 1, [(left, bits), (right, bits)]), (cost(left) + cost(side), 8, [(left, bits), (side, bits + 1)]), (cost(side) + cost(right), 9, [(side, bits + 1), (right, bits)]), (cost((left + right) >> 1) + cost(side), 10, [((left + right) >> 1, bits), (side, bits + 1)])]
            _, mode, chans = min(options, key=lambda t: t[0])
        w = _Writer()
        w.put(0x7FFC << 1, 16), w.put(7, 4), w.put(0, 4), w.put(mode, 4), w.put({8: 1, 12: 2, 16: 4, 20: 5, 24: 6}.get(bits, 0), 3), w.put(0, 1)
        header = w.bytes() + _utf8(i // block) + (len(part) - 1).to_bytes(2, "big")
        header += bytes([crc8(header)])
        w = _Writer()
        for v, size in chans:
            _put_subframe(w, v, size)
        body = header + w.bytes()
        out += body + crc16(body).to_bytes(2, "big")
    return bytes(out)


def _utf8(v: int) -> bytes:
    if v < 0x80:
        return bytes([v])
    tail = []
    n = 1
    while v >> (6 * n) and v >= 1 << (5 * n + 1 if n < 6 else 36):
        n += 1
    while len(tail) < n - 1 or v >= 1 << (6 - len(tail) if len(tail) else 7):
        tail.insert(0, 0x80 | v & 63)
        v >>= 6
    lead = len(tail) + 1
    return bytes([(0xFF << (8 - lead)) & 0xFF | v, *tail])


def clips(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(clip_id, flac): CLIP vectors of consecutive ids make a stereo clip of 16 bits, values alternating between left and right.

    The tables hold no sound; these are the numbers in them that behave most like it. A value is held within [-1, 1]; null and NaN are silence.
    Rows with a null id or vector are left out, an empty vector adds nothing, an odd last value is dropped, rows that repeat an id follow
    one another by value. Other columns, whatever their names, are dropped; an empty table gives an empty result.
    """
    sound = lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(F.greatest(F.least(v.cast("double"), F.lit(1.0)), F.lit(-1.0)))
    value = F.transform(F.col(vector_col), lambda v: F.round(sound(v) * 32767).cast("int"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).groupBy(F.floor(F.col(id_col) / CLIP).alias("clip_id")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("i"), value.alias("v")))), lambda s: s["v"])).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x")
            off, flat = x.offsets.to_numpy(), x.values.to_numpy(zero_copy_only=False).astype(np.int64)
            made = [encode(flat[i : i + (j - i) // 2 * 2].reshape(-1, 2)) for i, j in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([b.column("clip_id"), pa.array(made, pa.binary())], ["clip_id", "flac"])

    return rows.mapInArrow(run, "clip_id bigint, flac binary")


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCM blocks of every clip; pcm as text, so that SQL can say the same."""
    return decode(clips(table(spark, sf_dir, "embeddings"))).select("clip_id", "first_sample", "n_samples", "channels", "sample_rate", "bits", "crc_ok", F.array_join("pcm", ",").alias("pcm"))


SQL = f"""with v as (select vec_id // {CLIP} as clip_id, flatten(list(list_transform(embedding, lambda x: cast(round(cast(x as double) * 32767) as int)) order by vec_id)) as x from embeddings where vec_id is not null and embedding is not null group by 1),
b as (select clip_id, unnest(range(0, cast(len(x) // 2 as bigint), 256)) as first_sample, x from v)
select clip_id, first_sample, cast(least(256, len(x) // 2 - first_sample) as int) as n_samples, 2 as channels, 16000 as sample_rate, 16 as bits, true as crc_ok,
  array_to_string(x[2 * first_sample + 1 : 2 * first_sample + 2 * least(256, len(x) // 2 - first_sample)], ',') as pcm from b"""
