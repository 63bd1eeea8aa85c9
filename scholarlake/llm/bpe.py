"""Encoding of a corpus with a public byte-level BPE vocabulary, by a pair occurrence index.

The words of a batch that aren't known yet stand in one array of symbols. An index maps each pair to all its positions; ranks
that occur are taken in ascending order from a heap, all positions of the pair merged left to right, and only the lists of the
neighbouring pairs updated. What a word comes to is kept for later batches, up to a bound.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that splits text into words before the merges of the rank files.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 400_000
KEPT_LENGTH = 64
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str = VOCABULARY) -> bytes:
    """The rank file's bytes: bounded by the vocabulary, under 1 MB for 50,000 tokens."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Text -> token ids."""

    def __init__(self, rank_file: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.text_of = {v: k for k, v in self.ranks.items()}
        self.byte_id = [self.ranks[bytes([i])] for i in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(WORDS).findall

    def _merge(self, a: int, b: int) -> int:
        """The rank of the pair's merge, which is also its token's id; -1 where there is none."""
        pair = a, b
        if (r := self.merged.get(pair)) is None:
            r = self.merged[pair] = self.ranks.get(self.text_of[a] + self.text_of[b], -1)
        return r

    def words(self, fresh: list[str]) -> dict[str, list[int]]:
        """Ids of words, all encoded in one go over the shared index."""
        symbols: list[int] = []
        starts = []
        for w in fresh:
            starts.append(len(symbols))
            symbols += [self.byte_id[x] for x in w.encode("utf-8", "surrogatepass")]
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0 and (r := self._merge(a, b)) >= 0:
                index.setdefault(r, []).append(i)
        heap = list(index)
        heapq.heapify(heap)
        text = self.text_of
        while heap:
            rank = heapq.heappop(heap)
            positions = index.pop(rank, None)
            if not positions:
                continue
            positions.sort()
            for i in positions:
                a = symbols[i]
                j = after[i] if a >= 0 else n
                if j >= n or (b := symbols[j]) < 0 or self._merge(a, b) != rank or len(text[a]) + len(text[b]) != len(text[rank]):
                    continue
                symbols[i] = rank
                symbols[j] = -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if symbols[k] >= 0 and (r := self._merge(rank, symbols[k])) >= 0:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(heap, r)
                        index[r].append(i)
                h = before[i]
                if h >= 0 and symbols[h] >= 0 and (r := self._merge(symbols[h], rank)) >= 0:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(h)
        out = {}
        for w, start in zip(fresh, starts):
            ids, i = [], start
            while symbols[i] != -1:
                ids.append(symbols[i])
                i = after[i]
            out[w] = ids
        return out

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of a batch of texts; null and empty texts have none."""
        split = [self.split(t) if t else () for t in texts]
        known = self.known
        fresh = list({w for ws in split for w in ws if w not in known})
        if len(known) + len(fresh) > KEPT_WORDS:
            known.clear()
            fresh = list({w for ws in split for w in ws})
        for at in range(0, len(fresh), 20_000):
            known.update(self.words(fresh[at : at + 20_000]))
        flat: list[int] = []
        offsets = [0]
        for ws in split:
            for w in ws:
                flat += known[w]
            offsets.append(len(flat))
        for w in fresh:
            if len(w) > KEPT_LENGTH:
                del known[w]
        return np.array(offsets, dtype=np.int32), np.array(flat, dtype=np.int32)


def _encode(docs: DataFrame, key: str, text: str, rank_file: bytes, schema: str, give) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                offsets, ids = encoder.batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), give(offsets, ids)], names=[key, "out"])

    return docs.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, out {schema}")


def encode(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) for every row of `docs`, without special tokens; their strings in a text are ordinary text.

    Null and empty texts give an empty list. Rows are independent: no shuffle, repeated rows stay repeated, other columns are dropped.
    """
    give = lambda offsets, ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
    return _encode(docs, key, text, read_ranks(vocabulary), "array<int>", give).withColumnRenamed("out", "ids")


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) for every row of `docs`; null and empty texts count 0."""
    give = lambda offsets, ids: pa.array(np.diff(offsets).astype(np.int32))
    return _encode(docs, key, text, read_ranks(vocabulary), "int", give).withColumnRenamed("out", "n_tokens")
