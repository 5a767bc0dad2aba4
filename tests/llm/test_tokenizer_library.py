"""Counting and encoding held against the public library, whose model file is rewritten as one of the unigram kind; nothing is trained."""

import dataclasses
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from util import MID, have_tables

from ledgerloom.llm import sentencepiece_fst, token_counts, vocab


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(field, body):
    return varint(field << 3 | 2) + varint(len(body)) + body


def rewritten(scores, *, dummy=True, squeeze=False, fallback=True):
    """The model file with other scores, kind and normaliser: a field that is written again replaces the first."""
    out, i, types = b"", 0, vocab.load().types
    with open(vocab.DEFAULT_MODEL, "rb") as f:
        fields = list(vocab._fields(f.read()))
    for n, v in fields:
        if n == 1:
            v += bytes([2 << 3 | 5]) + struct.pack("<f", scores[i])
            if not fallback and types[i] == vocab.BYTE:
                v += bytes([3 << 3, vocab.UNUSED])
            i += 1
        elif n == 2:
            v += bytes([3 << 3, 1]) + varint(35 << 3) + bytes([fallback])
        elif n == 3:
            v += bytes([3 << 3, dummy, 4 << 3, squeeze])
        out += message(n, v)
    return out


def load(tmp_path, **kw):
    base = vocab.load()
    scores = kw.pop("scores", None)
    body = rewritten(scores if scores is not None else base.scores, **kw)
    (tmp_path / "m.model").write_bytes(body)
    return vocab.load(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_proto=body)


TEXTS = ["", "a", "Hello world", "  two  blanks ", "unhappiness of the naïve café", "日本語 テスト 😀😀", "tab\tnew\nline", "x" * 300, "aaa aaa aaaa" * 9, "The quick brown fox — jumped; 1234567", " lead", "trail "]


def same(texts, v, sp):
    ids = sentencepiece_fst.encode_array(pa.array(texts), v).to_pylist()
    assert ids == [sp.encode(t) for t in texts]
    ac = token_counts.Automaton(v)
    w = token_counts.segments(token_counts.prepared(pa.array(texts), v), ac.cross, v.add_dummy_prefix)
    n, _ = ac.counts(w.vocab)
    if v.byte_fallback:
        assert w.sums(n).tolist() == list(map(len, ids))


@pytest.mark.parametrize("kw", [{}, {"dummy": False}, {"squeeze": True}, {"fallback": False}, {"dummy": False, "squeeze": True}], ids=str)
def test_encoding_is_the_librarys(tmp_path, kw):
    same(TEXTS, *load(tmp_path, **kw))


@pytest.mark.skipif(not have_tables, reason="no tables")
def test_documents_are_encoded_as_by_the_library(spark, tmp_path):
    """Whole texts of a table with the engine's scores, which tie, and with real numbers, whose sums the library rounds as it goes along."""
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{MID}/documents.parquet").column("text").to_pylist()
    rng = np.random.default_rng(0)
    real = [float(np.float32(s - x)) if t == vocab.NORMAL else 0.0 for s, t, x in zip(vocab.load().scores, vocab.load().types, rng.random(32000) * 3)]
    for scores, some in ((vocab.load().scores, texts), (real, [t for t in texts[::4] if len(t) < 9000])):
        v, sp = load(tmp_path, scores=scores)
        for i in range(0, len(some), 200):
            same(some[i : i + 200], v, sp)


V = vocab.load()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab étx▁ 日😀\n"), max_size=40), min_size=1, max_size=5), st.booleans())
def test_one_by_one_is_together(texts, prefix):
    v = dataclasses.replace(V, add_dummy_prefix=prefix)
    fst, ac = sentencepiece_fst.transducer(v), token_counts.automaton(v)
    w = token_counts.segments(token_counts.prepared(pa.array(texts), v), False, prefix)
    flat, count = fst.encode_words(w.vocab)
    off = np.concatenate([[0], np.cumsum(count)])
    n, s = ac.counts(w.vocab)
    for i, word in enumerate(w.vocab.to_pylist()):
        assert fst.encode_one(word.encode()) == flat[off[i] : off[i + 1]].tolist()
        assert ac.one(word.encode()) == (n[i], s[i])
    back = sentencepiece_fst.Decoder(v).array(sentencepiece_fst.encode_array(pa.array(texts), v))
    assert back.to_pylist() == token_counts.prepared(pa.array(texts), v).to_pylist()


def test_normaliser_is_the_librarys():
    sp = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    spec = next(v for n, v in vocab._fields(sp.serialized_model_proto()) if n == 3)
    rules = vocab.charsmap(next(v for n, v in vocab._fields(spec) if n == 2))
    ours = sentencepiece_fst.Normalizer(rules)
    assert len(rules) > 1000
    for t in ["ﬁne Ａｂｃ ①② ㍿ e\u0301 x\u200by", "ｶﾞｷﾞ ½ ™ \u00a0 \u3000", "plain", "", "\ufeffx\tz\n", "각 각 한글"]:
        assert ours(t) == sp.normalize(t), t


def test_memory_of_long_words():
    """Long words beside many short ones: what advances together stays within its bound."""
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda n: "".join(rng.choice(letters, n))
    text = pa.array([" ".join([word(int(n)) for n in rng.integers(2, 9, 40_000)] + [word(2000) for _ in range(30)] + [word(100_000)])])
    sentencepiece_fst.encode_array(pa.array(["x"]), V)
    ac = token_counts.automaton(V)
    tracemalloc.start()
    ids = sentencepiece_fst.encode_array(text, V)
    w = token_counts.segments(token_counts.prepared(text, V), ac.cross)
    n, _ = ac.counts(w.vocab)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.sums(n).tolist() == [len(ids[0])] and peak < 200 << 20
