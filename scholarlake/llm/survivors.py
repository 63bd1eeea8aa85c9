"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.biblio import doi_key, title_key, usable_date, usable_title

FIELDS = ("work_title", "doi", "publication_date")
HALF_LIFE_DAYS = 365.0
MOST_SOURCES = 100_000  # rows of the source table up to which it is broadcast

_LONG = "group_id long, id long, field string, value string, norm string, fineness int, trust int, at timestamp"


def _unpivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for g, i, title, doi, date, trust, at in zip(*(pdf[c] for c in ("group_id", "id", "work_title", "doi", "publication_date", "trust", "at"))):
            at = None if pd.isna(at) else at
            day = usable_date(date, at)
            fine = 0 if day is None else 1 + (day[1] > 0) + (day[2] > 0)
            out.append((g, i, "work_title", title, title_key(title) if usable_title(title) else None, 1, trust, at))
            out.append((g, i, "doi", doi, doi_key(doi), 1, trust, at))
            out.append((g, i, "publication_date", date, None if day is None else "-".join(f"{x:02d}" for x in day if x), fine, trust, at))
        yield pd.DataFrame(out, columns=["group_id", "id", "field", "value", "norm", "fineness", "trust", "at"])


def survivors(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, field, ri_id, value, norm, votes, share, n_rows): the surviving value of each field of each group of two or more records.

    `records` has paper_id, id, work_title, doi, publication_date, feed and ingested_at. Fields are unpivoted to long rows; the votes
    of a normal form are the sum of source trust times recency decay (half-life HALF_LIFE_DAYS), given for the winner with its
    share of all votes. The winner itself is fixed by order, by max_by: the finer date, then the higher trust, the later arrival,
    the larger id. Groups and normal forms are pre-aggregated before each shuffle, so one large group is no burden. A group_id that
    is null or below 1 is no group; a field without a usable value has no row; a source that is null or unknown has trust 0; a null
    arrival sorts before all others. Repeated rows count as often as they come.
    """
    known = sources.where(F.col("feed").isNotNull()).groupBy("feed").agg(F.max("trust").cast("int").alias("trust"))
    if known.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        known = F.broadcast(known)
    rows = (
        records.where(F.col("paper_id") >= 1).select(F.col("paper_id").cast("long").alias("group_id"), "id", *FIELDS, "feed", F.col("ingested_at").cast("timestamp").alias("at"))
        .join(known, "feed", "left").select("group_id", "id", *FIELDS, F.coalesce("trust", F.lit(0)).alias("trust"), "at")
    )
    long = rows.mapInPandas(_unpivot, _LONG)
    order = F.struct("fineness", "trust", "at", "id")
    weight = F.col("trust") * F.pow(F.lit(2.0), (F.coalesce(F.unix_micros("at"), F.lit(0)) / F.lit(86_400e6) - 20_000) / HALF_LIFE_DAYS)
    forms = long.groupBy("group_id", "field", "norm").agg(F.count("*").alias("n"), F.sum(weight).alias("votes"), F.max(order).alias("best"), F.max_by("value", order).alias("value"))
    usable = F.col("norm").isNotNull()
    won = forms.groupBy("group_id", "field").agg(
        F.sum("n").alias("n_rows"), F.max_by(F.struct("best", "value", "norm", "votes"), F.when(usable, F.col("best"))).alias("w"), F.sum(F.when(usable, F.col("votes"))).alias("all_votes"),
    )
    return won.where((F.col("n_rows") >= 2) & F.col("w.norm").isNotNull()).select(
        "group_id", "field", F.col("w.best.id").alias("ri_id"), F.col("w.value").alias("value"), F.col("w.norm").alias("norm"), F.col("w.votes").alias("votes"),
        F.when(F.col("all_votes") > 0, F.col("w.votes") / F.col("all_votes")).alias("share"), "n_rows",
    )


def golden_records(won: DataFrame) -> DataFrame:
    """One row per group: survivors() pivoted back."""
    return won.groupBy("group_id").pivot("field", list(FIELDS)).agg(F.first("value").alias("value"), F.first("ri_id").alias("ri_id"))
