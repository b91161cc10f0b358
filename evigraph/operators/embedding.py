"""Text vectors: a deterministic hashing embedder and the hook for a real model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.functions.text import tokenize

DIMENSION = 64


def _signed_dimensions(tokens: pa.Array, dim: int) -> np.ndarray:
    """Per token its signed dimension 1..dim; the token's hash gives dimension and sign. Equal tokens are hashed once."""
    coded = tokens.cast(pa.binary()).dictionary_encode()
    digests = [hashlib.md5(t).hexdigest() for t in coded.dictionary.to_pylist()]
    signed = np.array([(int(g[:8], 16) % dim + 1) * (1 if g[8] < "8" else -1) for g in digests], np.int64)
    return signed[coded.indices.to_numpy()]


def hash_embed(text: Column, dim: int = DIMENSION) -> Column:
    """L2-normalised signed token counts, the zero vector for a text without tokens."""

    @F.arrow_udf("array<double>")
    def densify(tokens: pa.Array) -> pa.Array:
        n = len(tokens)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
        flat = _signed_dimensions(tokens.flatten(), dim)
        row = np.repeat(np.arange(n), sizes)
        counts = np.bincount(row * dim + np.abs(flat) - 1, weights=np.sign(flat), minlength=n * dim)
        dense = counts.reshape(n, dim).astype(np.float64)
        norm = np.linalg.norm(dense, axis=1, keepdims=True)
        unit = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))

    return densify(tokenize(F.lower(text)))


def embed_text(df: DataFrame, text: str = "text", dim: int = DIMENSION) -> DataFrame:
    return df.withColumn("embedding", hash_embed(F.col(text), dim))


def embed_with_model(df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text") -> DataFrame:
    """Vectors from a pluggable model: ``load`` runs once per Python worker, texts go in Arrow batches.

    The model returns one row per text; rows are L2-normalised here.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vecs = np.asarray(model(list(texts)), dtype=np.float32)
            norm = np.linalg.norm(vecs, axis=1, keepdims=True)
            yield pd.Series(list(vecs / np.where(norm > 0, norm, 1)))

    return df.withColumn("embedding", encode(F.col(text)))
