"""Every query of the core against its SQL on the smallest tables."""

from __future__ import annotations

import importlib

import pytest
from compare import compare, session  # noqa: F401

import __spark_entry__ as entry

CORE = [n for m in entry.MODULES for n in importlib.import_module(m).QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    assert compare(spark, name, entry.SF_SMOKE) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["tbl", "period", "kind", "n"]
