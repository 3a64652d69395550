"""A deterministic embedder that stands in for a model: hashed words and bigrams.

Any function from a list of texts to a matrix can take its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
DIM = 128


def hashing_embedder(texts: list[str], dim: int = DIM) -> np.ndarray:
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        words = re.findall(r"\w+", (t or "").lower())
        for w in [*words, *map(" ".join, zip(words, words[1:]))]:
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embed(texts: DataFrame, id_col: str, text_col: str, embedder: Embedder = hashing_embedder) -> DataFrame:
    """(id, vec) in Arrow batches."""
    source = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b.id, "vec": list(embedder(b.text.tolist()))})

    return source.mapInPandas(run, f"id {dict(source.dtypes)['id']}, vec array<float>")
