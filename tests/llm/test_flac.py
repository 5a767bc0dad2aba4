import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import flac


def samples(kind, n, channels, bits, seed):
    rng, m = np.random.default_rng(seed), 1 << (bits - 1)
    t = np.arange(n)[:, None]
    x = [
        rng.integers(-m, m, (n, channels)), np.cumsum(rng.integers(-9, 10, (n, channels)), 0), np.round(m * 0.7 * np.sin(t * np.array([0.05, 0.051])[None, :channels])), np.full((n, channels), int(rng.integers(-m, m))),
        rng.integers(-m // 16, m // 16, (n, channels)) * 8, np.where(t == n // 2, m - 1, rng.integers(-3, 4, (n, channels))),
    ][kind]
    return np.clip(x.astype(np.int64), -m, m - 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.integers(0, 1200), st.integers(1, 2), st.sampled_from([8, 12, 16, 20, 24]), st.sampled_from([192, 256, 1000]), st.integers(0, 99))
def test_round_trip(kind, n, channels, bits, block, seed):
    x = samples(kind, n, channels, bits, seed)
    got = list(flac.frames(flac.encode(x, bits=bits, block=block)))
    assert all(f["ok"] for f in got)
    assert [f["first"] for f in got] == list(range(0, n, block))
    assert not n or (np.concatenate([f["pcm"] for f in got]) == x.ravel()).all()


@pytest.mark.parametrize("v", [0, 127, 128, 2047, 2048, 65535, 65536, 2**21, 2**26, 2**31, 2**36 - 1])
def test_coded_numbers(v):
    assert flac._coded_number(flac.Bits(flac._utf8(v), 0)) == v


def test_damage_is_found_and_passed_over():
    d = bytearray(flac.encode(samples(2, 2000, 2, 16, 0)))
    d[len(d) // 2] ^= 4
    got = list(flac.frames(bytes(d)))
    assert [f["ok"] for f in got].count(False) == 1 and len(got) == 8
    assert all(not f["ok"] for f in list(flac.frames(bytes(d[: len(d) - 3])))[-1:])
    with pytest.raises(flac.BadFrame):
        list(flac.frames(b"RIFF"))


def test_column(spark, tmp_path):
    x = samples(1, 700, 2, 16, 3)
    rows = [(1, flac.encode(x), 5), (1, flac.encode(x), 5), (2, None, None), (3, b"", 5), (None, flac.encode(x[:0]), 5), (4, b"fLaC" + bytes(10), 5)]
    media = spark.createDataFrame(rows, "clip_id long, flac binary, block long").selectExpr("*", "1 as id", "2 as pcm")
    got = flac.decode(media).collect()
    assert sorted((r.clip_id, r.first_sample) for r in got if r.crc_ok) == sorted([(1, 0), (1, 256), (1, 512)] * 2)
    assert {r.clip_id for r in got if r.error} == {2, 3, 4}
    assert flac.decode(media.limit(0)).count() == 0
    flac.write_blocks(flac.decode(media.limit(1)), str(tmp_path / "pcm"))
    part = flac.seek(spark.read.parquet(str(tmp_path / "pcm")), 1, 200, 400).collect()
    assert [r.first_sample for r in part] == [200, 256, 512] and sum((r.pcm for r in part), []) == x[200:600].ravel().tolist()


#: Streams of other encoders: the three of RFC 9639, appendix D.
FOREIGN = {
    "one sample": "664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a",
    "two frames": "664c614300000022001000100000170000440ac442f000000013d5b0564975e98b8d8b930422757b8103030000120000000000000000000000000000000000100400003a200000007265666572656e6365206c6962464c414320312e332e33203230313930383034010000000e0000005449544c453dd7a9d79cd795d79d81000006000000000000fff86998000f991208670162 3d1442998f5df70d6fe00c17caeb21000ee7a77a24a1590c1217b603097b784faa9a33d285e070ad5b1b4851b4010d99d2cd1a68f1e6b810fff869180102a402c382c40bc14a03ee48dd03b67c1330",
    "linear predictor": "664c6143800000221000100000001f00001f07d0007000000018f8f9e396f5cbcfc6dc807f9977906b32fff868020017e944004f6f313d1047d227cb6d090831452bdc28222280 57a3",
}


def md5(got, bits):
    import hashlib

    pcm = np.concatenate([f["pcm"] for f in got])
    width = (bits + 7) // 8
    return hashlib.md5(pcm.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest()


@pytest.mark.parametrize("name", FOREIGN)
def test_streams_of_other_encoders(name):
    data = bytes.fromhex(FOREIGN[name])
    got = list(flac.frames(data))
    assert got and all(f["ok"] for f in got)
    assert md5(got, got[0]["bits"]) == data[26:42]  # of the samples, as the encoder gives it


def naive_crc16(data):
    v = 0
    for x in data:
        v ^= x << 8
        for _ in range(8):
            v = (v << 1 ^ (0x8005 if v & 0x8000 else 0)) & 0xFFFF
    return v


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1023, 1024, 1025, 1026, 2047, 2048, 2049, 5000])
def test_checksum(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert flac.crc16(data) == naive_crc16(data)


def by_hand(blocks, bits, *, variable):
    """A stream of one channel whose subframes are written by the functions in blocks [(size, put)]."""
    head = (16 << 16 | 4096) << 240 | 44100 << 172 | (bits - 1) << 164
    out, first = bytearray(b"fLaC" + bytes([0x80, 0, 0, 34]) + head.to_bytes(34, "big")), 0
    for i, (size, put) in enumerate(blocks):
        w = flac._Writer()
        w.put(0x7FFC << 1 | variable, 16), w.put(7, 4), w.put(0, 4), w.put(0, 4), w.put({16: 4, 24: 6, 32: 7}[bits], 3), w.put(0, 1)
        body = w.bytes() + flac._utf8(first if variable else i) + (size - 1).to_bytes(2, "big")
        body += bytes([flac.crc8(body)])
        w = flac._Writer()
        put(w)
        body += w.bytes()
        out += body + naive_crc16(body).to_bytes(2, "big")
        first += size
    return bytes(out)


def put_rice(w, values, k):
    for v in values:
        u = 2 * v if v >= 0 else -2 * v - 1
        for _ in range(u >> k):
            w.put(0, 1)
        w.put(1, 1), w.put(u & ((1 << k) - 1), k)


def test_residual_methods_escapes_and_variable_blocks():
    rng = np.random.default_rng(6)
    wanted, blocks = [], []

    def block(size, order, parts, wide, escape):
        x = np.cumsum(rng.integers(-900, 900, size)).tolist()
        wanted.append(x)
        r = np.diff(np.array(x), order).tolist()

        def put(w):
            w.put(0, 1), w.put(8 + order, 6), w.put(0, 1)
            for v in x[:order]:
                w.put(v & 0xFFFFFF, 24)
            w.put(wide == 5, 2), w.put(parts, 4)
            at, each = 0, size >> parts
            for i in range(1 << parts):
                n = each - (order if i == 0 else 0)
                part, at = r[at : at + n], at + n
                if escape and i % 2:
                    w.put((1 << wide) - 1, wide), w.put(17, 5)
                    for v in part:
                        w.put(v & 0x1FFFF, 17)
                else:
                    k = 18 if wide == 5 and i % 3 == 0 else 9
                    w.put(k, wide)
                    put_rice(w, part, k)

        blocks.append((size, put))

    block(256, 1, 5, 5, True), block(32, 2, 4, 4, True), block(1000, 0, 3, 5, False), block(17, 1, 0, 4, False)
    got = list(flac.frames(by_hand(blocks, 24, variable=1)))
    assert [f["first"] for f in got] == [0, 256, 288, 1288] and [f["pcm"].tolist() for f in got] == wanted


def test_predictors_of_every_order_at_32_bits():
    rng = np.random.default_rng(7)
    wanted, blocks = [], []
    for order in range(1, 33):
        coef, shift, size = rng.integers(-(1 << 13), 1 << 13, order).tolist(), 15, 64
        x = rng.integers(-(1 << 30), 1 << 30, order).tolist()
        r = rng.integers(-5000, 5000, size - order).tolist()
        warm = list(x)
        for v in r:  # sample by sample, in whole numbers of any size
            x.append(v + (sum(c * y for c, y in zip(coef, x[::-1])) >> shift))
        if max(map(abs, x)) >= 1 << 31:
            continue
        wanted.append(x)

        def put(w, warm=warm, coef=coef, r=r, order=order):
            w.put(0, 1), w.put(31 + order, 6), w.put(0, 1)
            for v in warm:
                w.put(v & 0xFFFFFFFF, 32)
            w.put(14, 4), w.put(shift, 5)
            for c in coef:
                w.put(c & 0x7FFF, 15)
            w.put(0, 2), w.put(0, 4), w.put(12, 4)
            put_rice(w, r, 12)

        blocks.append((size, put))
    got = list(flac.frames(by_hand(blocks, 32, variable=0)))
    assert len(wanted) > 8 and [f["pcm"].tolist() for f in got] == wanted


def test_clips_of_odd_values(spark):
    nan = float("nan")
    rows = [(0, [0.5, None, nan, 1.5, -9.0, float("inf")]), (1, None), (None, [0.1]), (2, []), (2, [0.25, 0.75, 1.0]), (40, [0.0]), (7, [0.125]), (7, [0.125])]
    got = {r.clip_id: r for r in flac.decode(flac.clips(spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as clip_id", "2 as x"))).collect()}
    h = lambda v: round(v * 32767)
    assert got[0].pcm == [16384, 0, 0, 32767, -32767, 32767, h(0.25), h(0.75), 32767, h(0.125)] and got[0].crc_ok and set(got) == {0}
    assert flac.decode(flac.clips(spark.createDataFrame([], "vec_id long, embedding array<double>"))).count() == 0
