"""Operators on the texts and entities of a corpus, with their queries; nothing outside this package imports it.

QUERIES and ORACLES are gathered from the query modules when first asked for, so that workers import only what they run.
"""

from __future__ import annotations

import importlib

MODULES = ["queries_text", "queries_entities"]


def __getattr__(name: str) -> dict:
    if name in ("QUERIES", "ORACLES"):
        return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"{__name__}.{m}"), name).items()}
    raise AttributeError(name)
