"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (per-coordinate FTRL-proximal) with elastic-net penalties, so that most weights are
exactly zero; a temperature is then fitted on held-out texts. tf is an n-gram's share of the text's n-grams and idf is
ln((1 + N) / (1 + df)) + 1 with df and N counted over all texts. Both passes sum each chunk's distinct words once.
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
from .common import Words, slices, table, uniform, words

LO, HI, BUCKETS = 1, 4, 1 << 17


@dataclass
class Model:
    """weights[b, c]: idf times FTRL weight of n-gram b for language c; logits are divided by temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, w: Words) -> np.ndarray:
        """One row for each row of w; rows without words have the prior alone."""
        ids, off = ngrams.features(w.vocab, LO, HI, BUCKETS)
        n = w.sums(np.diff(off).astype(np.float64))
        logits = ngrams.word_sums(ids, off, self.weights)
        z = np.stack([w.sums(logits[:, c]) for c in range(logits.shape[1])], 1) / np.maximum(n, 1)[:, None] * SCALE + self.bias
        z = z / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


SCALE = 10.0  # shares are small; with this a text's values are of the order of one


def document_frequencies(docs: DataFrame, *, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many texts hold each n-gram, and the number of texts, over all rows whose text is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, seen = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
        for b in slices(batches, "text"):
            w = words(b.column("text"), lower=True)
            ids, off = ngrams.features(w.vocab, LO, HI, BUCKETS)
            n += len(b) - b.column("text").null_count
            size = np.diff(off)
            for i, j in zip(w.offsets, w.offsets[1:]):
                code = np.unique(w.codes[i:j]) if j - i < 200_000 else np.flatnonzero(np.bincount(w.codes[i:j], minlength=len(w.vocab)))
                if not len(code):
                    continue
                m = size[code]
                at = np.arange(int(m.sum())) + np.repeat(off[code] - (np.cumsum(m) - m), m)
                seen[ids[at]] = True
                hit = np.flatnonzero(seen)
                df[hit] += 1
                seen[hit] = False
        k = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(df[k], n))], ["bucket", "df"])

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(run, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    n = int(rows.loc[rows.bucket < 0, "df"].sum())
    rows = rows[rows.bucket >= 0]
    out[rows.bucket.to_numpy()] = rows.df.to_numpy()
    return out, n


def train(texts: list[str], labels: list[str], idf: np.ndarray, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3, seed: int = 11) -> Model:
    """FTRL-proximal on four fifths of the texts, the temperature on the rest. No texts: one language named '' with weight zero."""
    names = sorted(set(labels))
    if not names:
        return Model([""], np.zeros((BUCKETS, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in labels])
    bags = []
    for run in range(0, len(texts), 100):
        w = words(pa.array(texts[run : run + 100], pa.string()), lower=True)
        ids, off = ngrams.features(w.vocab, LO, HI, BUCKETS)
        for i, j in zip(w.offsets, w.offsets[1:]):
            code, times = np.unique(w.codes[i:j], return_counts=True)
            m = off[code + 1] - off[code]
            at = np.arange(int(m.sum())) + np.repeat(off[code] - (np.cumsum(m) - m), m)
            b = np.bincount(ids[at], weights=np.repeat(times, m)) if len(at) else np.zeros(0)
            k = np.flatnonzero(b)
            bags.append((k.astype(np.int32), (b[k] / max(1, b.sum()) * idf[k] * SCALE).astype(np.float32)))
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    c = len(names)
    z, n = np.zeros((BUCKETS + 1, c)), np.zeros((BUCKETS + 1, c))  # the last row is the bias

    def weights(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        return np.where(np.abs(zk) <= l1, 0.0, -(zk - np.sign(zk) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2))

    for _ in range(epochs):
        for r in rng.permutation(fit):
            k, x = bags[r]
            k, x = np.append(k, BUCKETS), np.append(x, np.float32(1))
            wk = weights(k)
            s = x @ wk
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
            z[k] += g - sigma * wk
            n[k] += g * g
    full = weights(np.arange(BUCKETS + 1))
    model = Model(names, full[:-1] * idf[:, None], full[-1])
    if len(held):
        raw = np.array([bags[r][1] @ full[bags[r][0]] + full[-1] for r in held])

        def loss(t: float) -> float:
            q = raw / t
            q = q - q.max(1, keepdims=True)
            return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(held)), y[held]]).mean())

        grid = np.exp(np.linspace(-3, 3, 121))
        model.temperature = float(min(grid, key=loss))
    return model


def fit(docs: DataFrame, *, max_train: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", **kw) -> Model:
    """Document frequencies over all texts; weights from at most max_train whole texts of those labelled, by least hash of id.

    Rows with a null id, text or label don't train; rows that repeat an id and label are one.
    """
    df, total = document_frequencies(docs, text_col=text_col)
    idf = np.log((1 + total) / (1 + df)) + 1
    lab = docs.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("y"), F.col(text_col).isNotNull().alias("t")).filter("t and id is not null and y is not null")
    some = lab.groupBy("id").agg(F.min("y").alias("y")).orderBy(uniform(F.col("id")), "id").limit(max_train)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(some), "id")
    rows = picked.toPandas().drop_duplicates("id").sort_values("id")
    return train(rows["text"].tolist(), rows["y"].tolist(), idf, **kw)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, language, confidence) for each row of docs; no shuffle.

    confidence is the calibrated probability. A null text, or one without words, gets null and 0. Repeated rows and null ids are
    judged row by row; other columns, whatever their names, are dropped. An empty table gives an empty result. Ties go to the first
    language by name. Every word of a text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text"):
            w = words(b.column("text"), lower=True)
            p = m.probabilities(w)
            best, none = p.argmax(1), w.counts == 0
            name = pa.array(m.languages, pa.string()).take(pa.array(best, mask=none))
            yield pa.RecordBatch.from_arrays([b.column("id"), name, pa.array(np.where(none, 0.0, p.max(1)))], ["id", "language", "confidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"id {kind}, language string, confidence double").withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
