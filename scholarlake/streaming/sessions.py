"""Keyed state over streams: anchors and summaries by session, upserts by batch, and event-time windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholarlake.operators.dialog import ANCHOR_SCHEMA, next_anchor


def anchor_stream(turns: DataFrame) -> DataFrame:
    """anchor_states() over a stream: the anchor of a session is kept as its state, and each question gives one row."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        for pdf in batches:
            out = []
            for r in pdf.sort_values("turn").to_dict("records"):
                held, label = next_anchor(held, {k: (None if isinstance(v, float) and v != v else v) for k, v in r.items()})
                out.append((key[0], r["turn"], held["value"] if held else None, held["confidence"] if held else 0.0, label))
            yield pd.DataFrame(out, columns=["session", "turn", "anchor", "confidence", "action"])
        state.update((json.dumps(held),))

    return turns.groupBy("session").applyInPandasWithState(step, ANCHOR_SCHEMA, "held string", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, folder: str, key: str, order: str, checkpoint: str):
    """A writer that keeps the latest row of each key in `folder`, one version a batch; a batch replayed gives the same version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.parquet(f"{folder}/v{number - 1}").unionByName(batch)
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("x"))
        latest.select(key, "x.*").write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def in_order(steps: list[Callable[[DataFrame], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that runs the steps of a job batch one after another over the batch read once."""

    def run(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            for step in steps:
                step(held)
        finally:
            held.unpersist()

    return run


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; rows more than `late` behind the latest seen are dropped where `events` is a stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")
