"""Embeddings: a model of one's own in batches, and one that is trained here by a truncated singular value decomposition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from textquarry.functions.text import tokens
from textquarry.operators.search import padded

#: Numbers of an embedding, numbers that are stored, texts of a batch.
SIZE, STORED, BATCH = 384, 1536, 64


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """A row of numbers for each text."""


def model_embeddings(docs: DataFrame, text: str, load: Callable[[], Embedder], out: str = "embedding", stored: int = STORED) -> DataFrame:
    """docs with `out`: what the embedder gives, padded. `load` runs once on each worker; texts go through it in batches."""
    from pyspark.ml.functions import predict_batch_udf

    def predictor():
        embedder = load()
        return lambda texts: np.asarray(embedder.embed([str(t) for t in texts.reshape(-1)]), dtype=np.float32)

    model = predict_batch_udf(predictor, return_type=ArrayType(FloatType()), batch_size=BATCH)
    return docs.withColumn(out, padded(model(F.coalesce(F.col(text), F.lit(""))), stored))


def weighted_terms(docs: DataFrame, text: str, features: int) -> DataFrame:
    """docs with `_x`: words hashed to so many features, by one plus the logarithm of their number, at unit length."""
    hashed = F.transform(tokens(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    return docs.withColumn("_h", hashed)


def _matrix(hashed: pd.Series, features: int) -> np.ndarray:
    x = np.zeros((len(hashed), features))
    for row, h in zip(x, hashed):
        np.add.at(row, np.asarray(h, dtype=np.int64), 1)
    x = np.log1p(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class SvdEmbedder:
    """Projects a text's weighted words on the strongest directions of the corpus. features x size numbers."""

    directions: np.ndarray

    @staticmethod
    def fit(docs: DataFrame, text: str, size: int = SIZE, features: int = 1024, rounds: int = 30, seed: int = 5) -> SvdEmbedder:
        """Subspace iteration on the corpus's product matrix. Tasks add up the products of their rows, features x features numbers each,
        which is bounded by the parameter; texts are read once."""

        def products(batches):
            total = np.zeros((features, features))
            for frame in batches:
                x = _matrix(frame["_h"], features)
                total += x.T @ x
            yield pd.DataFrame({"row": np.arange(features), "values": list(total)})

        parts = weighted_terms(docs, text, features).select("_h").mapInPandas(products, "row int, values array<double>")
        at = F.posexplode("values").alias("column", "value")
        sums = parts.select("row", at).groupBy("row", "column").agg(F.sum("value").alias("value")).where("value <> 0").toPandas()  # features x features at most
        gram = np.zeros((features, features))
        gram[sums["row"], sums["column"]] = sums["value"]
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, min(size, features))))[0]
        for _ in range(rounds):
            q = np.linalg.qr(gram @ q)[0]
        values, vectors = np.linalg.eigh(q.T @ gram @ q)
        return SvdEmbedder(q @ vectors[:, np.argsort(-values)])

    def embed(self, docs: DataFrame, text: str, out: str = "embedding", stored: int | None = STORED) -> DataFrame:
        directions, features = self.directions.astype(np.float64), self.directions.shape[0]

        @F.pandas_udf("array<float>")
        def project(hashed: pd.Series) -> pd.Series:
            y = _matrix(hashed, features) @ directions
            return pd.Series(list((y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)).astype(np.float32)))

        made: Column = project("_h")
        return weighted_terms(docs, text, features).withColumn(out, padded(made, stored) if stored else made).drop("_h")
