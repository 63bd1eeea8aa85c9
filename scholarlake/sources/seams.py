"""Places where a model would plug in, each with a deterministic stand-in: no claim is made of their quality."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


def hashed_vector(text: str | None) -> list[float]:
    """Words hashed to signed places, normalised."""
    v = np.zeros(DIMENSIONS)
    for w in re.findall(r"[a-z0-9]{2,}", (text or "").lower()):
        h = hashlib.blake2b(w.encode(), digest_size=4).digest()
        v[h[0] % DIMENSIONS] += 1.0 if h[1] & 1 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


def embed(df: DataFrame, text: str, embedder: Callable[[str | None], list[float]] = hashed_vector) -> DataFrame:
    """`df` with a column `embedding`; an embedder is built once a worker and given batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([embedder(t) for t in texts], index=texts.index)

    return df.withColumn("embedding", F.pandas_udf(run, "array<double>")(F.col(text)))


def lead_summary(text: Column, sentences: int = 2) -> Column:
    """The first sentences."""
    return F.array_join(F.slice(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1, sentences), " ")


def keyword_topics(text: Column, topics: dict[str, str]) -> Column:
    """The topics whose word the text holds."""
    return F.array_compact(F.array(*(F.when(F.contains(F.lower(text), F.lit(w)), F.lit(t)) for t, w in topics.items())))
