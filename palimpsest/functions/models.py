"""Embedding plug-ins. A model is made once a Python worker and is given whole Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embed = Callable[[list[str]], np.ndarray]


def embedder(make: Callable[[], Embed]):
    """A column function from text to a unit vector; null for null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            known = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if known.any():
                v = np.asarray(model(texts[known].tolist()), np.float32)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                out[known] = pd.Series(list(v), index=texts.index[known])
            yield out

    return embed


def hashed(dim: int = 64) -> Callable[[], Embed]:
    """A deterministic stand-in: bytes of the text's digest."""

    def make() -> Embed:
        def one(s: str) -> np.ndarray:
            d = hashlib.sha256(s.encode()).digest()
            return np.frombuffer((d * (-(-dim // len(d))))[:dim], np.uint8) / 255

        return lambda texts: np.stack([one(s) for s in texts])

    return make
