"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text's features are the character n-grams of its lower-cased words; each has a vector, a text is their average, and a
softmax over a linear map of it gives the classes. A word that occurs n times, with the same marks at its ends, counts 1 + ln n, and PRIOR n-grams with a zero
vector join each average, so that neither a line repeated a thousand times nor a text of three words decides by one vector. Vectors and map are fitted together by Adagrad on minibatches, so
that a misspelling the training texts lack still shares most n-gram vectors with the word it stands for.
For prediction the map is folded into the vectors; a chunk's distinct words are summed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngrams
from .common import Words, give_back, slices, table, uniform, words

LO, HI, BUCKETS, DIM = 3, 6, 1 << 18, 8
PRIOR = 1000.0
MARKS = "".join(map(chr, range(33, 48))) + ":;<=>?[]^_`{|}~«»¿¡…“”„‚‘’–—"


def bags_of_words(col: pa.Array) -> Words:
    """Lower-cased words, without the marks at their ends."""
    w = words(col, lower=True)
    return Words(w.offsets, w.codes, pc.utf8_trim(w.vocab, MARKS))


def damped(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and weight of each row's distinct words."""
    n = max(1, len(w.vocab))
    key, times = np.unique(np.repeat(np.arange(len(w.counts)), w.counts) * n + w.codes, return_counts=True)
    return key // n, key % n, 1 + np.log(times)


@dataclass
class Model:
    """folded[b]: logit of toxic against clean that n-gram b adds; threshold: the probability from which a text is rejected."""

    folded: np.ndarray
    bias: float
    threshold: float = 0.5

    def probability(self, w: Words) -> np.ndarray:
        """Of each row; 0 for rows without words."""
        ids, off = ngrams.features(w.vocab, LO, HI, BUCKETS)
        row, code, weight = damped(w)
        sums = lambda x: np.bincount(row, weights=x[code] * weight, minlength=len(w.counts))
        total, n = sums(ngrams.word_sums(ids, off, self.folded)), sums(np.diff(off).astype(np.float64))
        p = 1 / (1 + np.exp(-np.clip(total / (n + PRIOR) + self.bias, -50, 50)))
        return np.where(n > 0, p, 0.0)


def _bags(texts: list[str], min_df: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams that min_df texts hold, and their shares, text by text, and each text's place in both. Runs of texts are read twice, so that little
    is held at once; what is held are two arrays whose memory goes back to the system with them, which that of an array for each text doesn't."""

    def runs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(texts), 100):
            w = bags_of_words(pa.array(texts[at : at + 100], pa.string()))
            ids, off = ngrams.features(w.vocab, LO, HI, BUCKETS)
            row, codes, weights = damped(w)
            cut = np.searchsorted(row, np.arange(len(w.counts) + 1))
            for i, j in zip(cut, cut[1:]):
                code = codes[i:j]
                size = off[code + 1] - off[code]
                at_ = np.repeat(off[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                b = np.bincount(ids[at_], weights=np.repeat(weights[i:j], size)) if len(at_) else np.zeros(0)
                k = np.flatnonzero(b)
                yield k, b[k] / (b.sum() + PRIOR)

    df = np.zeros(BUCKETS, np.int64)
    for k, _ in runs():
        df[k] += 1
    known = df >= min_df
    size = int(df[known].sum())
    ids, shares, off = np.empty(size, np.int32), np.empty(size, np.float32), np.zeros(len(texts) + 1, np.int64)
    for r, (k, v) in enumerate(runs()):
        ok = known[k]
        off[r + 1] = off[r] + np.count_nonzero(ok)
        ids[off[r] : off[r + 1]], shares[off[r] : off[r + 1]] = k[ok], v[ok]
    return ids, shares, off


def train(texts: list[str], labels: np.ndarray, *, epochs: int = 8, batch: int = 32, rate: float = 2.0, min_df: int = 10, ratio: float = 1.0, seed: int = 7) -> Model:
    """Fit on four fifths; the threshold has the best F1 on the rest, where a clean text counts ratio times. One class or none: nothing is toxic."""
    y = np.asarray(labels).astype(int)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), -50.0, 0.5)
    rng = np.random.default_rng(seed)
    # an n-gram of few training texts would only memorise them; its vector stays zero
    grams, shares, off = _bags(texts, min(min_df, max(2, len(y) // 100)))
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    seen = np.zeros((BUCKETS, 1), np.float32)
    seen[grams] = 1
    emb *= seen
    out, bias = (rng.standard_normal((DIM, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    g_emb, g_out, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full(out.shape, 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    share = np.bincount(y[fit], minlength=2) / len(fit)
    weight = (0.5 / np.maximum(share, 1e-9)).astype(np.float32)
    for _ in range(epochs):
        for i in range(0, len(fit), batch):
            rows = [r for r in rng.permuted(fit[i : i + batch]) if off[r] < off[r + 1]]
            if not rows:
                continue
            ids, val = (np.concatenate([x[off[r] : off[r + 1]] for r in rows]) for x in (grams, shares))
            start = np.cumsum([0] + [off[r + 1] - off[r] for r in rows[:-1]])
            own = np.repeat(np.arange(len(rows)), [off[r + 1] - off[r] for r in rows])
            hid = np.add.reduceat(emb[ids] * val[:, None], start)
            z = hid @ out + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            d = p
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= weight[y[rows]][:, None] / len(rows)
            back = d @ out.T
            uniq, inv = np.unique(ids, return_inverse=True)
            s = np.argsort(inv, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(inv[s]) > 0])
            ge = np.add.reduceat((back[own] * val[:, None])[s], cut)
            g_emb[uniq] += (ge * ge).mean(1)
            emb[uniq] -= rate * ge / np.sqrt(g_emb[uniq])[:, None]
            go = hid.T @ d
            g_out += go * go
            out -= rate * 0.1 * go / np.sqrt(g_out)
            gb = d.sum(0)
            g_bias += gb * gb
            bias -= rate * 0.1 * gb / np.sqrt(g_bias)
        fit = rng.permutation(fit)
    model = Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
    if len(held):
        p = model.probability(bags_of_words(pa.array([texts[i] for i in held], pa.string())))
        t = y[held]
        cand = np.unique(p)
        each = np.where(t == 1, 1.0, ratio)
        hits = [(2 * ((p >= c) & (t == 1)).sum() / max(1.0, each[p >= c].sum() + (t == 1).sum()), c) for c in cand]
        best, at = max(hits)
        below = p[(t == 0) & (p < at)]
        if best > 0:
            # halfway, in log odds, between the best cut and the next clean text
            odds = lambda x: np.log(np.clip(x, 1e-12, 1 - 1e-12) / (1 - np.clip(x, 1e-12, 1 - 1e-12)))
            mid = (odds(at) + (odds(below.max()) if len(below) else odds(at))) / 2
            model.threshold = float(1 / (1 + np.exp(-mid)))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, max_train: int = 2500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **kw) -> Model:
    """Train on at most max_train labelled texts of each class, those whose ids have the least hash; each text is whole.

    Rows with a null id, text or label don't count; of an id that is labelled more than once, the highest label does. The driver keeps nothing of it but the model.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    size = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = {y: min(n, max_train) for y, n in size.items()}
    ratio = (size[0] / seen[0]) / (size[1] / seen[1]) if size.get(0) and size.get(1) else 1.0
    some = None
    for y in (0, 1):
        part = lab.filter(F.col("y") == y).orderBy(uniform(F.col("id")), "id").limit(max_train)
        some = part if some is None else some.unionByName(part)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(some), "id")
    rows = picked.select("id", "text", "y").toPandas().drop_duplicates("id").sort_values("id")
    texts, y = rows["text"].tolist(), rows["y"].to_numpy()
    del rows
    model = train(texts, y, ratio=ratio, **kw)
    del texts
    give_back()
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_toxic, toxic) for each row of docs; no shuffle.

    A null text, or one without words, has probability 0. Repeated rows and null ids are scored row by row; other columns, whatever
    their names, are dropped. An empty table gives an empty result. Every word of a text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = shared.value.probability(bags_of_words(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p), pa.array(p >= shared.value.threshold)], ["id", "p_toxic", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"id {kind}, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject. One pass, no shuffle or join.

    A null text, and one without words, stays. Repeated rows and null ids are judged row by row; extra columns, whatever their names, are kept as they
    are; an empty table stays empty. Every word of a text counts, whatever its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            p = shared.value.probability(bags_of_words(b.column(text_col)))
            keep = b.filter(pa.array(p < shared.value.threshold))
            if keep.num_rows:
                yield keep

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
