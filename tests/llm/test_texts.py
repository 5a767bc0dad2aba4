import numpy as np
import pyarrow as pa
import pytest
from util import MID, empty, have_tables, messy

from ledgerloom.llm import language_id, sentencepiece_fst, token_counts, toxicity, vocab

LOADED = vocab.load()


def shortest(text, v):
    """Piece ids and score by trying every piece at every place."""
    items = {}
    for i, p, s in v.matchable():
        items.setdefault(p, (i, s))
    data = text.encode()
    n = len(data)
    best, back = [-np.inf] * (n + 1), [None] * (n + 1)
    best[0] = 0.0
    longest = max(map(len, items))
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            hit = items.get(data[start:end])
            if hit and best[start] + hit[1] > best[end]:
                best[end], back[end] = best[start] + hit[1], (start, [hit[0]])
        if end == n or data[end] & 0xC0 != 0x80:
            start = end - 1
            while data[start] & 0xC0 == 0x80:
                start -= 1
            if data[start:end] not in items and best[start] + v.unk_score > best[end]:
                best[end], back[end] = best[start] + v.unk_score, (start, [v.byte_ids()[b] for b in data[start:end]])
    ids, at = [], n
    while at:
        at, part = back[at]
        ids = part + ids
    return ids, best[n]


TEXTS = ["", "a", "Hello world", "  two  blanks ", "unhappiness of the naïve café", "日本語 テスト 😀😀", "tab\tnew\nline", "x" * 300, "aaa aaa aaaa", "▁mark", "\u0000\u0001"]


def test_against_every_piece():
    ids = sentencepiece_fst.encode_array(pa.array(TEXTS), LOADED).to_pylist()
    ac = token_counts.automaton(LOADED)
    for t, got in zip(TEXTS, ids):
        ready = token_counts.prepared(pa.array([t]), LOADED)[0].as_py()
        want, score = shortest(" " + ready, LOADED) if ready else ([], 0.0)
        assert got == want, t
        if ready:
            n, s = ac.one(b" " + ready.encode())
            assert n == len(want) and s == pytest.approx(score)
    assert sentencepiece_fst.Decoder(LOADED).array(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == token_counts.prepared(pa.array(TEXTS), LOADED).to_pylist()


@pytest.mark.skipif(not have_tables, reason="no tables")
def test_counts_are_lengths(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    enc = {r.doc_id: r for r in sentencepiece_fst.encode(docs).select("doc_id", "n_tokens", "decodes").collect()}
    assert len(enc) == docs.count() and all(r.decodes for r in enc.values())
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == {i: r.n_tokens for i, r in enc.items()}


def test_token_edges(spark):
    d = messy(spark)
    e = sentencepiece_fst.encode(d)
    got = sorted((str(r.doc_id), str(r.n_tokens)) for r in e.collect())
    assert got == sorted((str(r.doc_id), str(r.n_tokens)) for r in token_counts.count_tokens(d).collect()) and len(got) == d.count()
    by = {r.doc_id: r for r in e.filter("doc_id in (3, 4)").collect()}
    assert (by[3].n_tokens, by[3].decodes, by[4].n_tokens, by[4].ids) == (0, True, None, None)
    text = {r.doc_id: r.text for r in sentencepiece_fst.decode(e.filter("doc_id > 2")).collect()}
    assert text == {r.doc_id: r.text for r in d.filter("doc_id > 2").collect()}
    assert sentencepiece_fst.encode(empty(spark)).count() == 0 == token_counts.count_tokens(empty(spark)).count() == sentencepiece_fst.decode(sentencepiece_fst.encode(empty(spark))).count()


def test_toxicity_learns_misspellings():
    rng = np.random.default_rng(0)
    bad, plain = ["stupididiot", "horribletrash", "disgustingscum"], [f"word{i}" for i in range(60)]
    texts, y = [], []
    for i in range(400):
        w = rng.choice(plain, 60).tolist()
        y.append(i % 4 == 0)
        if y[-1]:
            w[5:5] = rng.choice(bad, 12).tolist()
        texts.append(" ".join(w))
    m = toxicity.train(texts, np.array(y))
    p = lambda t: m.probability(toxicity.bags_of_words(pa.array([t])))[0]
    clean = " ".join(rng.choice(plain, 60))
    assert p(clean + " " + "stupidi1diot horriblletrash disgustiingscum " * 5) > p(clean) + 0.1
    assert p("") == 0
    assert toxicity.train([], np.array([])).threshold == 0.5


@pytest.mark.skipif(not have_tables, reason="no tables")
def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = toxicity.score(docs, model).join(labels.filter("doc_id % 2 = 1").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "y"), "doc_id").select("toxic", "y").toPandas()
    tp = (rows.toxic & (rows.y == 1)).sum()
    assert tp / max(1, rows.toxic.sum()) >= 0.75 and tp / (rows.y == 1).sum() >= 0.85  # 225 toxic texts to learn from
    small = spark.read.parquet(f"{MID}/documents.parquet")
    lm = language_id.fit(small.filter("doc_id % 2 = 0"), max_train=300)
    got = language_id.identify(small.filter("doc_id % 2 = 1"), lm).join(small.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.language == got.lang).mean() >= 0.95
    assert (lm.weights == 0).mean() > 0.2  # the penalty leaves weights out


def test_classifier_edges(spark):
    d = messy(spark)
    y = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0), (77, 1)], "doc_id long, toxic int").selectExpr("*", "1 as id", "2 as y")
    m = toxicity.fit(d, y)
    s = toxicity.score(d, m)
    assert s.count() == d.count() and {r.p_toxic for r in s.filter("doc_id in (3, 4, 5)").collect()} == {0.0}
    kept = toxicity.drop_toxic(d, m)
    assert kept.columns == d.columns and {3, 4, 5} <= {r.doc_id for r in kept.collect()}
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), y.limit(0))).count() == 0 == toxicity.drop_toxic(empty(spark), m).count()
    lm = language_id.fit(d)
    g = language_id.identify(d, lm)
    assert g.count() == d.count() and {r.language for r in g.filter("doc_id in (3, 4, 5)").collect()} == {None}
    assert language_id.identify(empty(spark), language_id.fit(empty(spark))).count() == 0


def test_words_of_texts_that_end_in_blanks():
    from ledgerloom.llm.common import words

    for texts in (["a b ", "r s t " * 60], [" x", "y \n", " "], ["é  "], [""], [None, "z "]):
        w = words(pa.array(texts))
        v = w.vocab.to_pylist()
        assert [[v[c] for c in w.codes[i:j]] for i, j in zip(w.offsets, w.offsets[1:])] == [(t or "").split() for t in texts]
