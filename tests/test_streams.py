from __future__ import annotations

import json

import pyspark.sql.functions as F

from scholarlake.operators.dialog import anchor_states
from scholarlake.sources import records
from scholarlake.streaming.sessions import anchor_stream, in_order, upsert_batches, windowed_counts

SEEN = "session string, turn long, value string, confidence double, ratio double, overlap boolean, names_candidate boolean, follow_up boolean, entity boolean"
ROWS = [("s", 1, "a", 0.9, 0.9, False, True, False, False), ("s", 2, None, 0.0, 0.0, False, False, True, False), ("t", 1, "b", 0.5, 0.9, False, True, False, False), ("s", 3, "c", 0.95, 0.9, False, True, False, True)]


def test_anchor_stream_is_the_batch(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SEEN)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SEEN).parquet(str(tmp_path / "in"))
    q = anchor_stream(stream).writeStream.format("memory").queryName("anchors").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("anchors").collect())) == sorted(map(tuple, anchor_states(df).collect()))


def test_upserts(spark, tmp_path):
    src = tmp_path / "in"
    for i, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 2)]]):
        spark.createDataFrame(rows, "id long, v string, at int").coalesce(1).write.mode("append").parquet(str(src))
        q = upsert_batches(spark.readStream.schema("id long, v string, at int").parquet(str(src)), str(tmp_path / "out"), "id", "at", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()) == [(1, "c"), (2, "b")]


def test_steps_in_order(spark):
    said = []
    in_order([lambda b: said.append(("first", b.count())), lambda b: said.append(("then", b.count()))])(spark.range(3), 0)
    assert said == [("first", 3), ("then", 3)]


def test_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.total) for r in windowed_counts(df).collect()) == [(1, 4.0), (2, 3.0)]


WORK = {
    "id": "https://x.org/W1", "title": "On <i>deep</i> seas", "publication_year": 2001, "updated_date": "2024-01-01", "abstract_inverted_index": {"deep": [1], "we": [0], "study": [2]}, "cited_by_count": 3,
    "authorships": [
        {"author_position": "first", "author": {"id": "https://x.org/A1", "display_name": "Ann Bo"}, "institutions": [{"id": "https://x.org/I9", "lineage": []}]},
        {"author_position": "last", "author": {"id": "https://x.org/A2", "display_name": "Cy Do"}, "institutions": [{"id": "https://x.org/I8", "lineage": ["https://x.org/I7"]}]},
    ],
    "topics": [{"id": "https://x.org/T1", "display_name": "Sea", "score": 0.5, "field": {"display_name": "Ocean"}, "domain": {"display_name": "Earth"}}], "keywords": [{"display_name": "sea"}, {"keyword": "sea"}, {"keyword": "ice"}], "referenced_works": ["W2", ""],
}


def test_records(spark, tmp_path):
    newer = WORK | {"title": "On deep seas, again", "updated_date": "2024-02-01"}
    lines = [json.dumps(WORK), "{broken", "", json.dumps(newer), json.dumps({"id": "", "title": "x"}), json.dumps({"id": "https://x.org/W3"})]
    (tmp_path / "w.jsonl").write_text("\n".join(lines))
    good, bad = records.read_records(spark, str(tmp_path / "w.jsonl"))
    assert bad.count() == 1
    (w,) = records.normalized_works(good, "I7").collect()
    assert (w.openalex_id, w.title, w.abstract, w.publication_year) == ("W1", "On deep seas, again", "we deep study", 2001)
    assert (w.su_researchers, w.primary_researcher, w.authors_str, w.keywords, w.referenced_works) == (["Cy Do"], "Cy Do", "Ann Bo, Cy Do", ["sea", "ice"], ["W2"])


def test_authors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "https://x.org/A1", "display_name": " Ann Bo ", "display_name_alternatives": ["A. Bo", ""], "summary_stats": {"h_index": 4}}))
    good, _ = records.read_records(spark, str(tmp_path / "a.jsonl"), records.RAW_AUTHOR)
    (a,) = records.normalized_authors(good).collect()
    assert (a.author_id, a.name, a.alternatives, a.h_index, a.works_count) == ("A1", "Ann Bo", ["A. Bo"], 4, 0)


def test_paged_source(spark, tmp_path):
    for i, day in enumerate(["2024-01-01", "2024-03-01"]):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"results": [{"id": f"W{i}", "updated_date": day}]}))
    (tmp_path / "page2.json").write_text(json.dumps({"results": []}))
    spark.dataSource.register(records.PagedRecords)
    read = lambda **o: spark.read.format("paged_records").options(path=str(tmp_path), **o).load()
    assert sorted(r.id for r in read().collect()) == ["W0", "W1"]
    assert [r.id for r in read(since="2024-02-01").collect()] == ["W1"]
