"""The vector index: entity texts, embeddings by a pluggable model, exact nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def entity_text(name: Column, aliases: Column) -> Column:
    """Name and aliases, each once, without empty ones."""
    return F.array_join(F.array_distinct(F.filter(F.concat(F.array(name), aliases), lambda x: x.isNotNull() & (x != ""))), " | ")


def stable_id(key: Column) -> Column:
    """A number from the first fifteen hex digits of sha1."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 15), 16, 10).cast("long")


def hashed_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Character trigrams hashed into unit vectors; stands in where no model is given."""
    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            padded = f"  {t.lower()} "
            for j in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[j : j + 3].encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return run


def embed(rows: DataFrame, text_col: str, make: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_embedder, *, batch: int = 64) -> DataFrame:
    """rows with embedding; make is called once for each task and returns the model."""
    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            texts = ["" if x is None else x for x in s]
            parts = [model(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            yield pd.Series(list(np.concatenate(parts)) if parts else [], dtype="object")
    return rows.withColumn("embedding", run(F.col(text_col)))


def build_entity_vectors(entities: DataFrame, make=hashed_embedder, *, only_missing: bool = True) -> DataFrame:
    """(id, text, embedding) of entities, of those without an embedding where only_missing."""
    rows = entities.filter("embedding is null").drop("embedding") if only_missing and "embedding" in entities.columns else entities
    return embed(rows.select("id", entity_text(F.col("canonical_name"), F.col("aliases")).alias("text")), "text", make)


def cosine(a: Column, b: Column) -> Column:
    d = lambda c: F.transform(c, lambda x: x.cast("double"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return add(F.zip_with(d(a), d(b), lambda x, y: x * y)) / F.sqrt(add(F.transform(d(a), lambda x: x * x)) * add(F.transform(d(b), lambda x: x * x)))


def search(vectors: DataFrame, query: list[float], k: int = 10, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest by cosine; equal scores by id. Each task keeps k, so the driver never sees more."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q).alias("s")).orderBy(F.desc("s"), "id").limit(k).select("id", F.round("s", 4).alias("score"))


def search_entities(vectors: DataFrame, query: str, k: int = 10, make=hashed_embedder) -> DataFrame:
    return search(vectors, [float(x) for x in make()([query])[0]], k)
