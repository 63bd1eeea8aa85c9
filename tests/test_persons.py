from __future__ import annotations

import re

import pytest
from compare import rows_of

import __spark_entry__ as entry
from scholarlake.plans import persons

NAMES = ["Ann Boler", "Jo Maria Lind", "Cy Boler", "Prince", "Zoë Lind", "Al Stone", "Ramona Nes?bemin"]
CHUNKS = [
    ("c1", "w1", "Ann Boler", None, "Boler, A. on meadows and stone"),
    ("c1", "w1", "Ann Boler", None, "Boler, A. on meadows and stone"),
    ("c2", "w1", None, "A. Boler; Lind, J. M.", "lind"),
    ("c3", None, "Jo M. Lind", "Stone", None),
    (None, "w2", "C. Boler", "", "Cy x. Boler said so"),
    (None, "w2", "C. Boler", "", "Cy x. Boler said so"),
    ("", "w2", None, None, "al stone"),
    ("e1", "w3", "Ramona Nesübemin", "Ramona Nesübemin | An Other", "nesübemin and ébemin"),
    ("e2", "w4", None, None, "ramona bemin"),
    ("e3", "w4", "Bemin, R.", None, "bemin"),
    ("e4", "w4", "R. Bemin", None, "bemin_1 bemin"),
    *((f"d{i:02}", f"w{i % 5}", None, "Al Stone" if i % 3 else None, f"a stone {i} of boler") for i in range(30)),
]


@pytest.fixture(scope="module")
def people(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("people"))
    docs = [(i, "qa_pair", f"Q: What does {n} study in fields?\nA: x") for i, n in enumerate(NAMES * 2)]
    spark.createDataFrame(docs, "doc_id long, doc_kind string, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(CHUNKS, "chunk_id string, work_id string, researcher string, su_researchers string, text string").write.parquet(f"{d}/chunks.parquet")
    return d


@pytest.mark.parametrize("most", [20_000, 0])
@pytest.mark.parametrize("name", ["ag_person_support", "tk_person_evidence"])
def test_evidence_equals_its_sql(spark, people, monkeypatch, name, most):
    monkeypatch.setattr(persons, "MOST_ASKED", most, raising=False)
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "chunks"):
        con.execute(f"create view {t} as select * from read_parquet('{people}/{t}.parquet/*.parquet')")
    got = con.execute(entry.oracle_sql()[name])
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    df = entry.queries()[name](spark, people)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs and theirs[1]


def test_no_text_goes_with_each_of_its_words(spark, people):
    plan = persons.person_scores(spark, people)._jdf.queryExecution().executedPlan().toString()
    taken = re.findall(r"Generate explode\(array_distinct.*\), \[(.*?)\], (?:true|false)", plan)
    assert taken and not any(re.search(r"\bh[rat]#", x) for x in taken), taken


FAR = "on meadows and stones " * 500  # 11,000 characters before the name
LONG = [("f1", "w1", None, None, f"{FAR}said Ann Boler"), ("f2", "w1", None, None, f"{FAR}said A. Boler"), ("f3", "w1", None, None, f"{FAR}said boler"), ("f4", "w1", None, None, FAR)]


def _far(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame([(1, "qa_pair", "Q: What does Ann Boler study in fields?\nA: x")], "doc_id long, doc_kind string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LONG, "chunk_id string, work_id string, researcher string, su_researchers string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    con = duckdb.connect()
    for t in ("documents", "chunks"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = con.execute(entry.oracle_sql()[name])
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    df = entry.queries()[name](spark, str(tmp_path))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == theirs
    return df


def test_support_counts_people_named_anywhere_in_a_text(spark, tmp_path):
    df = _far(spark, tmp_path, "ag_person_support")
    assert [tuple(r) for r in df.select("name", "total", "strong", "matched").collect()] == [("Ann Boler", 3, 0, 2)]


def test_evidence_is_found_anywhere_in_a_text(spark, tmp_path):
    df = _far(spark, tmp_path, "tk_person_evidence")
    assert sorted(tuple(r) for r in df.select("chunk_id", "score", "k").collect()) == [("f1", 1.2, 1), ("f2", 1.0, 2), ("f3", 0.15, 3)]
