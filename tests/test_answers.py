"""Answers, folds and sinks against cases worked by hand and brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from scholarlake.operators import answers as A
from scholarlake.operators import chunks, dialog, vectors
from scholarlake.sources import sinks


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Answer: Final answer: The soil is wet. It rained.", "Final answer: The soil is wet. It rained."),
        ("Summary: Answer: The soil is wet.", "The soil is wet."),
        ("Retrieval count: 5\nThe soil is wet.\n\nThe soil is wet!\n\nPlease let me know if you need more.", "The soil is wet."),
        ("The moisture of the soil rose.\n\nThe moisture of the soils rose.\n\nGranite is old.", "The moisture of the soil rose. Granite is old."),
        ("It rained. It snowed. It rained. And then the", "It rained. It snowed."),
        ("Confidence level: high\n\nIt rained.", "It rained."),
        ("- a first point\n- a second one", "- a first point\n\n- a second one"),
        ("Detected intent: list", "Detected intent: list"),
        ("", ""), (None, None), ("  ", "  "),
    ],
)
def test_tidied(raw, want):
    assert A.tidied(raw) == want


def test_citations():
    titles = ["How elastic cortex shapes pollen emission", None, " "]
    true, false, short = 'See "How elastic cortex shapes pollen emissions".', 'See "A history of the granite quarries of Skarn".', 'It is "short".'
    assert A.without_false_citations(f"{true}\n{false}\n{short}", titles) == f"{true}\n{short}"
    assert A.without_false_citations(false, titles) == false and A.without_false_citations(false, []) == false and A.without_false_citations(None, titles) is None
    assert A.matching_ratio("abcd", "bcde") == pytest.approx(0.75)


def test_answer_queries(spark):
    rows = spark.createDataFrame([(1, "Answer: It rained.", ["x"]), (2, None, None), (3, "", [])], "id long, text string, titles array<string>")
    assert [tuple(r) for r in A.tidied_answers(rows, "id", "text").orderBy("id").collect()] == [(1, "It rained."), (2, None), (3, "")]
    assert A.checked_citations(rows, "id", "text", "titles").count() == 3
    assert A.tidied_answers(rows.limit(0), "id", "text").count() == 0


def test_packs():
    rng = random.Random(3)
    for _ in range(200):
        ss = ["w " * rng.randrange(1, 30) + "." for _ in range(rng.randrange(12))]
        got = chunks.packs(ss, 20, 8)
        assert not ss and not got or got[-1].endswith(ss[-1])
        joined = iter(ss)  # each sentence comes first in its order
        for chunk in got:
            assert any(chunk.endswith(s) for s in ss)
        assert all(any(s in c for c in got) for s in joined)
    assert chunks.packs(["a b c d.", "e f.", "g h i.", "j k l m."], 10, 4) == ["a b c d. e f. g h i.", "g h i. j k l m."]
    assert chunks.packs([], 10, 4) == [] and len(chunks.packs(["a."] * 50_000, 10, 4)) > 5_000


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(5)
    m = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties, some all zero
    df = spark.createDataFrame([(i, [float(x) for x in v], int(i % 3)) for i, v in enumerate(m)] + [(900, None, 0), (901, [], 1)], "id long, v array<double>, g int")
    norm = np.linalg.norm(m, axis=1)
    for group in (None, "g"):
        got: dict[int, list[int]] = {}
        for r in vectors.nearest(df.where("id % 50 = 0"), df, "id", "v", 7, group=group).orderBy("query", "pos").collect():
            got.setdefault(r.query, []).append(r.key)
        for q in range(0, 300, 50):
            if norm[q] == 0:
                continue
            there = [j for j in range(300) if j != q and norm[j] > 0 and (group is None or j % 3 == q % 3)]
            want = sorted(there, key=lambda j: (-round(float(m[q] @ m[j] / norm[q] / norm[j]), 9), j))[:7]
            assert got[q] == want
    e = df.withColumn("g", df["g"] + 10)
    rows = vectors.laddered(e.where("id = 50"), df, "id", "v", "g", 5, 3).collect()
    assert len(rows) == 3 and {r.stage for r in rows} == {"unfiltered"}


def test_named_in():
    assert dialog.named_in("Ann Boler", "what does ann boler study") and dialog.named_in("Ann Boler", "Boler, Ann?") and not dialog.named_in("Ann Boler", "Ann") and not dialog.named_in(None, "x") and not dialog.named_in(" ", "x")


def test_harmonised(spark):
    rows = spark.createDataFrame([("Ann", "T", "http://x", "2001", "again")], " Researcher string, TITLE string, `pdf link` string, date string, title2 string")
    assert sinks.harmonised(rows).first().asDict() == {"researcher_name": "Ann", "work_title": "T", "publication_date": "2001", "pdf_url": "http://x", "info": None}
    assert sinks.read_tables(spark, ["/no/such/folder"]).count() == 0
