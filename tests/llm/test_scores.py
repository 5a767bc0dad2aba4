"""Scores of the classifiers against plain loops over the n-grams of a text."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import language_id, ngrams, toxicity
from ledgerloom.llm.common import words


def grams(word, lo, hi):
    w = f"<{word}>"
    out = [w[i : i + n] for n in range(lo, hi + 1) for i in range(len(w) - n + 1)]
    return out + ([w] if len(w) < lo else [])


def bucket(gram, buckets):
    h = 0
    for c in gram:
        h = (h * 0x9E3779B1 + ord(c) + 1) % 2**32
    h = (h + len(gram)) % 2**32
    for shift, mult in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h ^= h >> shift
        h = h * mult % 2**32
    return h & (buckets - 1)


TEXTS = ["You are a stupid, STUPID idiot!", "le café d'été", "", "  ", "x", "«hé» ?! 日本語 日本語", "a " * 500 + "b", "w" * 3000]


def test_buckets_are_those_of_every_gram():
    vocab = pa.array(["ab", "x", "stupid", "日本語", "<>"])
    for lo, hi in ((3, 6), (1, 4)):
        ids, off = ngrams.features(vocab, lo, hi, 1 << 12)
        for k, w in enumerate(vocab.to_pylist()):
            assert Counter(ids[off[k] : off[k + 1]].tolist()) == Counter(bucket(g, 1 << 12) for g in grams(w, lo, hi))


def test_toxicity_by_hand():
    rng = np.random.default_rng(0)
    m = toxicity.Model(rng.normal(0, 40, toxicity.BUCKETS), -0.3)
    got = m.probability(toxicity.bags_of_words(pa.array([*TEXTS, None])))
    for t, p in zip([*TEXTS, ""], got):
        total = n = 0.0
        for w, times in Counter(t.lower().split()).items():  # a word with other marks at its ends is another one
            g = grams(w.strip(toxicity.MARKS), toxicity.LO, toxicity.HI)
            total += (1 + math.log(times)) * sum(m.folded[bucket(x, toxicity.BUCKETS)] for x in g)
            n += (1 + math.log(times)) * len(g)
        want = 1 / (1 + math.exp(-(total / (n + toxicity.PRIOR) + m.bias))) if n else 0.0
        assert p == pytest.approx(want, abs=1e-9), t


def test_language_by_hand():
    rng = np.random.default_rng(1)
    m = language_id.Model(["de", "en", "fr"], rng.normal(0, 1, (language_id.BUCKETS, 3)), np.array([0.1, -0.2, 0.3]), 1.7)
    got = m.probabilities(words(pa.array(TEXTS), lower=True))
    for t, p in zip(TEXTS, got):
        g = [x for w in t.lower().split() for x in grams(w, language_id.LO, language_id.HI)]
        z = sum((m.weights[bucket(x, language_id.BUCKETS)] for x in g), np.zeros(3)) / max(1, len(g)) * language_id.SCALE + m.bias
        e = np.exp(z / m.temperature - (z / m.temperature).max())
        assert np.allclose(p, e / e.sum()), t
