from __future__ import annotations

from pyspark.sql import functions as F

from scholarlake.sources import files, seams
from scholarlake.sources.catalog import Catalog, Corpus

SF = "/root/testdata/sf0.001"


def test_catalog(spark):
    c = Catalog([Corpus("Main", SF, ("papers", "works")), Corpus("Gone", "/nowhere", ("papers",))])
    assert c.resolve("main ").folder == SF and c.resolve("what").name == "Main"
    assert c.health(spark, "MAIN") == {"papers": True, "works": True} and c.health(spark, "gone") == {"papers": False}
    assert c.register(spark, "main") == ["papers", "works"] and spark.table("works").count() > 0
    assert files.first_existing(spark, ["/nowhere/x", f"{SF}/works.parquet", SF]) == f"{SF}/works.parquet"


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 hello")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4 seen")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-bad")
    known = spark.createDataFrame([("c.pdf", 1)], "file_name string, content int")
    got = files.new_documents(spark, str(tmp_path), known, lambda b: b[9:].decode() if b[5:6] == b"1" else 1 / 0)
    assert sorted((r.file_name, r.text) for r in got.collect()) == [("a.pdf", "hello"), ("d.pdf", None)]


def test_acquired(spark):
    df = spark.createDataFrame([(1, None, "x" * 300), (2, "y" * 300, "z" * 300), (3, "y", None)], "id int, xml string, pdf string")
    got = {r.id: (r.fulltext_status, (r.fulltext or "")[:1]) for r in files.acquired(df, {"tei_xml": F.col("xml"), "pdf": F.col("pdf")}).collect()}
    assert got == {1: ("pdf", "x"), 2: ("tei_xml", "y"), 3: ("none", "")}


def test_links(spark):
    df = spark.createDataFrame([(("",), [("",), ("u",)]), (("b",), []), (None, None)], "best struct<url:string>, locs array<struct<url:string>>")
    assert [r[0] for r in df.select(files.best_pdf_link(F.col("best"), F.col("locs"))).collect()] == ["u", "b", None]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "sum", "t"), (2, "old", "t")], "id int, summary string, turns string")
    new = spark.createDataFrame([(1, " ", "u"), (3, "n", "v")], "id int, summary string, turns string")
    assert sorted(map(tuple, files.upserted(old, new, "id", ("summary",)).collect())) == [(1, "sum", "u"), (2, "old", "t"), (3, "n", "v")]
    assert [r.id for r in files.without_keys(old, new, "id").collect()] == [2]


def test_seams(spark):
    df = spark.createDataFrame([("Deep sea ice. It melts! Then more.",), (None,)], "text string")
    rows = seams.embed(df, "text").select("*", seams.lead_summary(F.col("text")).alias("s"), seams.keyword_topics(F.col("text"), {"Sea": "sea", "Law": "court"}).alias("t")).collect()
    assert rows[0].s == "Deep sea ice. It melts!" and rows[0].t == ["Sea"] and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-9
    assert rows[1].embedding == [0.0] * seams.DIMENSIONS
