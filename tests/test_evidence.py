from __future__ import annotations

import __spark_entry__ as entry
from scholarlake.plans.retrieval import evidence_graph


def test_evidence_graph(spark):
    hits = spark.createDataFrame([("Ann Boler", "w1", 1, "Meadows", "Ecology"), ("ann boler", "w2", 2, None, "N/A"), ("Cy Dom", "w1", 1, "Meadows", "ecology"), ("Cy Dom", "w3", 2, "Alone", " ")], "researcher string, work_id string, p int, title string, topic string")
    many = [(f"Author {i}",) for i in range(20)]
    works = spark.createDataFrame([("w1", [("Ann Boler",), (" ",), ("ANN BOLER",), (None,), ("Edda Fo",)]), ("w2", many), ("w9", many)], "openalex_id string, a array<struct<name: string>>")
    rows = [tuple(r) for r in evidence_graph(hits, works).collect()]
    assert len(rows) == len(set(rows))
    edges = {r[1:4] for r in rows if r[0] == "edge"}
    assert {e for e in edges if e[0] == "AUTHORED"} == {("AUTHORED", "author:ann boler", "paper:w1"), ("AUTHORED", "author:edda fo", "paper:w1")} | {("AUTHORED", f"author:author {i}", "paper:w2") for i in range(12)}
    assert {e for e in edges if e[0] != "AUTHORED"} == {("WROTE", f"researcher:{a}", f"paper:{w}") for a, w in (("ann boler", "w1"), ("ann boler", "w2"), ("cy dom", "w1"), ("cy dom", "w3"))} | {("HAS_TOPIC", "paper:w1", "topic:ecology")}
    nodes = {r[2]: r[4] for r in rows if r[0] == "node"}
    assert {e for x in edges for e in x[1:]} == set(nodes)
    assert nodes["paper:w2"] == "paper w2" and nodes["topic:ecology"] == "Ecology" and nodes["researcher:ann boler"] == "Ann Boler" and len(nodes) == 3 + 2 + 2 + 12 + 1


def test_authored_edges_of_the_tables(spark):
    rows = entry.queries()["gr_evidence_graph"](spark, entry.SF_SMOKE).groupBy("part", "kind").count().collect()
    assert {(r["part"], r["kind"]) for r in rows} >= {("edge", "AUTHORED"), ("edge", "WROTE"), ("node", "author"), ("node", "paper")}
