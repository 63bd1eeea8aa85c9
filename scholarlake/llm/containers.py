"""Filling containers of fixed capacity with items of varying length.

The items' lengths make a histogram no longer than the capacity. Over it stands the configuration linear program (as few
configurations as possible, each a set of lengths that fits, covering all items). Multiplicative weights on the lengths price
configurations by a knapsack dynamic programme: of each length the best configuration that holds it, all that are nearly the best
being raised together. Any weights bound the containers needed from below; every few rounds what was raised is rounded down and
filled up by best fit, the best such plan is kept, and the rounds end when it is within GAP of the bound. Items take the slots of
their length by rank; ranks are counted in salted groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.plans.cluster import cut

CAPACITY = 2_048
ROUNDS = 60  # of each rate, where the gap isn't closed before
RATES = (0.1, 0.5)
NEARLY = 0.02  # how far below the best a configuration's price may be to be raised with it
GAP = 0.001
GROUP = 200_000  # items of one length ranked together


def price(worth: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack over all capacities up to this one: the greatest worth that fits, and the length taken last (0: none)."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        n = np.searchsorted(lengths, c, side="right")
        got = best[c - lengths[:n]] + worth[:n]
        k = got.argmax()
        best[c], took[c] = (got[k], lengths[k]) if got[k] > best[c - 1] else (best[c - 1], 0)
    return best, took


def _taken(took: np.ndarray, room: int, first: int) -> tuple[int, ...]:
    out = [first]
    while room > 0:
        if took[room]:
            out.append(int(took[room]))
        room -= int(took[room]) or 1
    return tuple(sorted(out))


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(multiplicities by length, containers) that hold left[l] items of each length: the longest that fits, again and again."""
    left, out = left.copy(), []
    while left.any():
        pattern, room = np.zeros(len(left), dtype=np.int64), capacity
        have = np.flatnonzero(left)
        while room > 0:
            i = int(np.searchsorted(have, room, side="right")) - 1
            if i < 0:
                break
            l = int(have[i])
            n = min(room // l, int(left[l] - pattern[l]))
            if n == 0:
                have = np.delete(have, i)
                continue
            pattern[l] += n
            room -= n * l
            if pattern[l] == left[l]:
                have = np.delete(have, i)
        used = pattern > 0
        k = int((left[used] // pattern[used]).min())
        left -= k * pattern
        out.append((pattern, k))
    return out


def rounded(raised: dict[tuple[int, ...], float], least: float, counts: np.ndarray, capacity: int) -> tuple[list[tuple[np.ndarray, int]], int]:
    """The plan that what was raised comes to, over its least cover, in whole containers, the rest by best fit; and how many are the program's."""
    left, out, by_program = counts.astype(np.int64).copy(), [], 0
    for taken, amount in sorted(raised.items(), key=lambda x: (-x[1], x[0])):
        lengths, each = np.unique(taken, return_counts=True)
        k = int(min(np.floor(amount / least + 1e-9), (left[lengths] // each).min()))
        if k > 0:
            left[lengths] -= k * each
            by_program += k
            pattern = np.zeros(len(counts), dtype=np.int64)
            pattern[lengths] = each
            out.append((pattern, k))
    return out + best_fit(left, capacity), by_program


def solved(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[np.ndarray, int]], int, int]:
    """(plan, least, by_program): (multiplicities by length, containers) that hold counts[l] items of each length l exactly, the
    fewest containers any plan can have by the best dual bound found, and how many of the plan's come from the program."""
    plan, by_program = best_fit(counts, capacity), 0
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return plan, 0, 0
    n, place = counts[lengths].astype(float), np.zeros(capacity + 1, dtype=np.int64)
    place[lengths] = np.arange(len(lengths))
    used = lambda p: sum(k for _, k in p)
    least = 0
    for rate in RATES:
        worth, cover, raised = lengths / capacity, np.zeros(len(lengths)), {}
        for t in range(ROUNDS):
            best, took = price(worth, lengths, capacity)
            top = best[capacity]
            least = max(least, int(np.ceil(n @ worth / top - 1e-6)))
            holding = worth + best[capacity - lengths]
            fresh = {_taken(took, capacity - int(lengths[i]), int(lengths[i])) for i in np.flatnonzero(holding >= (1 - NEARLY) * top)}
            parts = [(c, *np.unique(place[list(c)], return_counts=True)) for c in sorted(fresh)]
            load, gained = np.zeros(len(lengths)), np.zeros(len(lengths))
            for _, at, _ in parts:
                load[at] += 1
            for c, at, each in parts:  # no length is covered more than once by a round
                amount = (n[at] / each / load[at]).min()
                raised[c] = raised.get(c, 0.0) + amount
                gained[at] += each * amount / n[at]
            cover += gained
            worth = worth * np.exp(-rate * gained)
            worth /= worth.max()
            if t % 5 == 4 and cover.min() > 0:
                made, own = rounded(raised, cover.min(), counts, capacity)
                if used(made) <= used(plan):
                    plan, by_program = made, own
                if used(plan) <= least * (1 + GAP):
                    return plan, least, by_program
    return plan, least, by_program


def configurations(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """The plan of solved()."""
    return solved(counts, capacity)[0]


def slots(plans: list[tuple[np.ndarray, int]]) -> pd.DataFrame:
    """For each length the runs of its slots: ranks from `start` on go to containers from `first` on, `each` to one, from `at` in it."""
    rows, taken = [], {}
    first = 0
    for pattern, k in plans:
        at = 0
        for l in np.flatnonzero(pattern)[::-1]:
            start = taken.get(int(l), 0)
            rows.append((int(l), start, first, int(pattern[l]), at))
            taken[int(l)] = start + k * int(pattern[l])
            at += int(l * pattern[l])
        first += k
    return pd.DataFrame(rows, columns=["length", "start", "first", "each", "at"])


def containers(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part, first_unit, length, container, at): every item of `items` (key unique) in a container, from unit `at` of it.

    Only an item over `capacity` is divided: into parts of the capacity, each a container of its own, and what remains, which is
    placed like other items. A null, zero or negative size takes no room and lies in container 0. The histogram and the plan are
    bounded by the capacity; ranks are counted over (length, hash group) and offset by the groups before, so that no length,
    however common, is gathered in one task. Containers are numbered from 0 without gaps, those of whole parts last.
    """
    spark = items.sparkSession
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0))
    sized = cut(items.select(F.col(key).alias("key"), n.cast("long").alias("n")).select("key", "n", F.floor(F.col("n") / capacity).alias("whole"), (F.col("n") % capacity).cast("int").alias("rest")))
    rows = sized.groupBy("rest").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows:
        counts[r["rest"]] += r["count"]
    counts[0] = 0
    plans = configurations(counts, capacity)
    filled = sum(k for _, k in plans)
    table = spark.sparkContext.broadcast({l: g.sort_values("start") for l, g in slots(plans).groupby("length")})
    groups = max(1, -(-int(counts.max()) // GROUP))

    loose = sized.where("rest > 0").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    before = loose.groupBy("rest", "g").count().withColumn("offset", F.sum("count").over(Window.partitionBy("rest").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = loose.withColumn("r", F.row_number().over(Window.partitionBy("rest", "g").orderBy("key")) - 1).join(before.select("rest", "g", F.coalesce("offset", F.lit(0)).alias("offset")), ["rest", "g"])
    ranked = ranked.select("key", "whole", "rest", (F.col("r") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for l, part in pdf.groupby("rest", sort=False):
                runs = table.value[l]
                i = np.searchsorted(runs["start"].to_numpy(), part["rank"].to_numpy(), side="right") - 1
                run = runs.iloc[i]
                inside = part["rank"].to_numpy() - run["start"].to_numpy()
                each = run["each"].to_numpy()
                out.append(pd.DataFrame({
                    "key": part["key"].to_numpy(object), "part": part["whole"].to_numpy("int64"), "first_unit": part["whole"].to_numpy("int64") * capacity, "length": part["rest"].to_numpy("int64"),
                    "container": run["first"].to_numpy() + inside // each, "at": run["at"].to_numpy() + (inside % each) * l,
                }))
            if out:
                yield pd.concat(out)

    schema = f"key {items.schema[key].dataType.simpleString()}, part long, first_unit long, length long, container long, at long"
    placed = ranked.mapInPandas(place, schema)
    empty = sized.where("n = 0").select("key", *(F.lit(0).cast("long").alias(c) for c in ("part", "first_unit", "length", "container", "at")))
    large = sized.where("whole > 0").withColumn("g", F.pmod(F.xxhash64("key"), F.lit(256)).cast("int"))
    ahead = large.groupBy("g").agg(F.sum("whole").alias("w")).withColumn("offset", F.sum("w").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)))  # 256 rows
    running = F.sum("whole").over(Window.partitionBy("g").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("whole")
    whole = large.withColumn("run", running).join(F.broadcast(ahead.select("g", F.coalesce("offset", F.lit(0)).alias("offset"))), "g")
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).select(
        "key", "part", (F.col("part") * capacity).alias("first_unit"), F.lit(capacity).cast("long").alias("length"),
        (F.col("run") + F.col("offset") + F.col("part") + filled).cast("long").alias("container"), F.lit(0).cast("long").alias("at"),
    )
    return placed.unionByName(empty).unionByName(whole).withColumnRenamed("key", key)
