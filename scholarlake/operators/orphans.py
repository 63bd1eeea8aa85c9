"""References to records that do not exist, were deleted, or arrive later than what refers to them.

Keys are range-partitioned: the parents of a range stand in one sorted array, and blocks of references are probed against it
by binary search. A range that much refers to (one key may hold a third of all references) is salted into several blocks of
bounded size, each with its own copy of the range's array.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarlake.plans.cluster import cut

PARENTS_PER_RANGE = 50_000
REFS_PER_BLOCK = 400_000
MOST_RANGES = 4_096
KINDS = ("", "missing", "deleted", "late")

_FOUND = T.StructType([T.StructField("tbl", T.StringType()), T.StructField("row_id", T.LongType()), T.StructField("period", T.StringType()), T.StructField("kind", T.StringType())])


def parent_states(parents: DataFrame, key: str, arrived: str, deleted: str) -> DataFrame:
    """One row (key, first, gone) per parent: its earliest arrival and whether its latest row is deleted.

    Of rows that arrived at the same time a deleted one counts as the later.
    """
    return (
        parents.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(arrived).alias("first"), F.max(F.struct(F.col(arrived), F.col(deleted).isNotNull().alias("gone")))["gone"].alias("gone"))
    )


def _probe(_, refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    parents = parents.sort_values("key")
    keys, first, gone = parents["key"].to_numpy("int64"), parents["first_us"].to_numpy("int64"), parents["gone"].to_numpy(bool)
    wanted, at = refs["key"].to_numpy("int64"), refs["at_us"].to_numpy("int64")
    if len(keys):
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        known = keys[i] == wanted
        kind = np.select([~known, gone[i], first[i] > at], [1, 2, 3], 0)
    else:
        kind = np.ones(len(refs), dtype=int)
    miss = kind > 0
    out = {"tbl": refs["tbl"].to_numpy(object)[miss], "row_id": refs["row_id"].to_numpy()[miss], "period": refs["period"].to_numpy(object)[miss], "kind": np.array(KINDS, dtype=object)[kind[miss]]}
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})


def orphan_references(refs: DataFrame, states: DataFrame) -> DataFrame:
    """The references (tbl, row_id, key, at) of `refs` whose parent is missing, deleted or late, as (tbl, row_id, period, kind).

    `states` is what parent_states() gives. A null or non-positive key is no reference; a null `at` can't be early, so such a
    reference is never late, and has a null period. Repeated rows of `refs` come out repeated. With no parents all are missing;
    with no references the result is empty.
    """
    states = cut(states.select("key", F.coalesce(F.unix_micros(F.col("first").cast("timestamp")), F.lit(-(2**63))).alias("first_us"), F.coalesce("gone", F.lit(False)).alias("gone")))
    count = states.count()
    ranges = max(1, min(MOST_RANGES, -(-count // PARENTS_PER_RANGE)))
    marks = sorted(set(states.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    marks = [int(x) for x in marks]

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(marks, dtype="int64"), keys.to_numpy("int64"), side="right").astype("int32"), index=keys.index)

    assert bisect_right(marks, -(2**63)) == 0
    placed = refs.where(F.col("key") >= 1).select(
        "tbl", "row_id", F.col("key").cast("long").alias("key"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(2**63 - 1)).alias("at_us"),
        F.date_format("at", "yyyy-MM").alias("period"),
    ).withColumn("rng", range_of("key") if marks else F.lit(0))
    sizes = placed.groupBy("rng").count().collect()  # at most MOST_RANGES + 1 rows
    spread = {r["rng"]: -(-r["count"] // REFS_PER_BLOCK) for r in sizes}
    plan = refs.sparkSession.createDataFrame([(k, v) for k, v in spread.items()] or [(0, 1)], "rng int, blocks int")
    salted = placed.join(F.broadcast(plan), "rng").withColumn("salt", F.pmod(F.xxhash64("row_id", "tbl"), F.col("blocks")).cast("int")).drop("blocks")
    copies = states.withColumn("rng", range_of("key") if marks else F.lit(0)).join(F.broadcast(plan), "rng").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return salted.groupBy("rng", "salt").cogroup(copies.groupBy("rng", "salt")).applyInPandas(lambda k, a, b: _probe(k, a, b), _FOUND)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, period and kind."""
    return found.groupBy("tbl", "period", "kind").agg(F.count("*").alias("n"))
