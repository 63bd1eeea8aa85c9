from __future__ import annotations

import datetime as dt

import pytest

from scholarlake.operators import orphans
from scholarlake.operators.orphans import orphan_references, parent_states

T0, T1, T2 = (dt.datetime(2024, m, 1) for m in (1, 2, 3))


def parents(spark, rows):
    return spark.createDataFrame(rows, "paper_id long, ingested_at timestamp, deleted_at timestamp, tbl string, key long")


def refs(spark, rows):
    return spark.createDataFrame(rows, "tbl string, row_id long, key long, at timestamp, kind string")


@pytest.mark.parametrize("small", [False, True])
def test_kinds(spark, monkeypatch, small):
    if small:  # many ranges, salted blocks
        monkeypatch.setattr(orphans, "PARENTS_PER_RANGE", 2)
        monkeypatch.setattr(orphans, "REFS_PER_BLOCK", 3)
    p = [(1, T0, None, "", 0), (2, T0, None, "", 0), (2, T1, T1, "", 0), (3, T2, None, "", 0), (4, T0, T0, "", 0), (4, T1, None, "", 0), (None, T0, None, "", 0), (9, T0, None, "", 0)]
    r = [("a", i, 1, T1, "x") for i in range(20)] + [("a", 100, 2, T2, "x"), ("a", 101, 3, T1, "x"), ("a", 102, 4, T1, "x"), ("b", 103, 7, T1, "x"), ("b", 104, None, T1, "x"), ("b", 105, 0, T1, "x"), ("b", 106, -3, T1, "x"), ("b", 107, 99, None, "x"), ("b", 107, 99, None, "x")]
    got = orphan_references(refs(spark, r), parent_states(parents(spark, p), "paper_id", "ingested_at", "deleted_at")).collect()
    assert sorted((x.tbl, x.row_id, x.period, x.kind) for x in got if x.period) == [("a", 100, "2024-03", "deleted"), ("a", 101, "2024-02", "late"), ("b", 103, "2024-02", "missing")]
    assert [(x.row_id, x.kind) for x in got if not x.period] == [(107, "missing")] * 2


def test_empty(spark):
    none, one = refs(spark, []), refs(spark, [("a", 1, 5, T0, "")])
    states = parent_states(parents(spark, []), "paper_id", "ingested_at", "deleted_at")
    assert orphan_references(none, states).count() == 0
    assert [x.kind for x in orphan_references(one, states).collect()] == ["missing"]
