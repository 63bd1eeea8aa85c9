"""Exact vector search, and diversification of what it finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.plans.cluster import cut

BLOCK = 4_096  # vectors packed into one row


def packed(vectors: DataFrame, key: str, vector: str, block: int = BLOCK, group: str | None = None) -> DataFrame:
    """Blocks (keys, groups, flat) of the vectors, made batch by batch without a shuffle; vectors that are null or all zero are left out."""
    sorts = F.coalesce(F.col(group).cast("long"), F.lit(-1)) if group else F.lit(0).cast("long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["v"].map(lambda v: v is not None and len(v) > 0)]
            for at in range(0, len(pdf), block):
                part = pdf.iloc[at : at + block]
                m = np.stack([np.asarray(v, dtype="float64") for v in part["v"]])
                n = np.linalg.norm(m, axis=1)
                keep = n > 0
                if keep.any():
                    yield pd.DataFrame({"keys": [part["k"].to_numpy()[keep]], "groups": [part["g"].to_numpy()[keep]], "flat": [(m[keep] / n[keep, None]).ravel()]})

    return vectors.select(F.col(key).alias("k"), F.col(vector).alias("v"), sorts.alias("g")).mapInPandas(run, "keys array<long>, groups array<long>, flat array<double>")


def _best(row: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest, equal ones by key; only what reaches the k-th is sorted."""
    if len(row) > k:
        least = np.partition(row, len(row) - k)[len(row) - k]
        there = np.flatnonzero(row >= least)
    else:
        there = np.arange(len(row))
    there = there[row[there] > -np.inf]
    return there[np.lexsort((keys[there], -row[there]))][:k]


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, group: str | None = None) -> DataFrame:
    """(query, key, similarity, pos): the k most similar vectors of `corpus` to each of `queries` by cosine, itself left out.

    With `group` only vectors of the query's own group are near it. The blocks of the stated queries are written once and meet the
    blocks of the corpus; each meeting keeps its k best a query, and the best of those are ranked. Equal similarities, to nine
    places, go by key.
    """
    q = cut(packed(queries, key, vector, group=group)).select(F.col("keys").alias("qk"), F.col("groups").alias("qg"), F.col("flat").alias("qf"))
    meetings = packed(corpus, key, vector, group=group).crossJoin(q)  # blocks, not rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for keys, groups, flat, qk, qg, qf in zip(*(pdf[c] for c in ("keys", "groups", "flat", "qk", "qg", "qf"))):
                c, x = np.asarray(flat).reshape(len(keys), -1), np.asarray(qf).reshape(len(qk), -1)
                s = np.round(x @ c.T, 9)
                s[(np.asarray(qk)[:, None] == keys[None, :]) | (np.asarray(qg)[:, None] != groups[None, :])] = -np.inf
                best = [_best(row, keys, k) for row in s]
                if any(len(b) for b in best):
                    yield pd.DataFrame({"query": np.repeat(qk, [len(b) for b in best]), "key": keys[np.concatenate(best)], "similarity": np.concatenate([row[b] for row, b in zip(s, best)])})

    near = meetings.mapInPandas(run, "query long, key long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return near.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def laddered(queries: DataFrame, corpus: DataFrame, key: str, vector: str, group: str, k: int, fallback: int) -> DataFrame:
    """(query, key, similarity, pos, stage): the nearest of the query's own group, and of all vectors for queries whose group holds none."""
    own = cut(nearest(queries, corpus, key, vector, k, group=group))
    rest = queries.join(own.select(F.col("query").alias(key)).distinct(), key, "left_anti")
    return own.withColumn("stage", F.lit("filtered")).unionByName(nearest(rest, corpus, key, vector, fallback).withColumn("stage", F.lit("unfiltered")))


def diversified(candidates: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, weight: float = 0.6) -> DataFrame:
    """(query, key, rank): k of each query's candidates (query, key, similarity) by maximal marginal relevance.

    `weight` is held within 0.3 and 0.95. A group is one query's candidates, bounded by the search that made them.
    """
    lam = min(0.95, max(0.3, weight))
    rows = candidates.join(corpus.select(F.col(key).alias("key"), F.col(vector).alias("v")), "key").select("query", "key", "similarity", "v")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", "key"], ascending=[False, True]).reset_index(drop=True)
        m = np.stack([np.asarray(v, dtype="float64") for v in pdf["v"]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        sim, relevance = m @ m.T, pdf["similarity"].to_numpy()
        chosen = [0]
        while len(chosen) < min(k, len(pdf)):
            score = np.round(lam * relevance - (1 - lam) * sim[:, chosen].max(axis=1), 9)
            score[chosen] = -np.inf
            chosen.append(int(score.argmax()))
        return pd.DataFrame({"query": pdf["query"].iloc[0], "key": pdf["key"].iloc[chosen].to_numpy(), "rank": range(1, len(chosen) + 1)})

    return rows.groupBy("query").applyInPandas(choose, "query long, key long, rank int")
