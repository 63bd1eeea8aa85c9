"""Queries on entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.matching import matches
from scholarlake.llm.survivors import golden_records, survivors
from scholarlake.llm.variants import linked_spellings, variant_pairs
from scholarlake.operators.split_values import split_field
from scholarlake.plans.cluster import spread
from scholarlake.sources.tables import table


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paper that each record without a reference describes, with a confidence; papers whose latest row is deleted are none."""
    none = F.lit(None).cast("string")
    latest = table(spark, sf_dir, "papers").groupBy("paper_id").agg(F.max_by(F.struct("title", "doi", "authors", "publication_date", "deleted_at", "ingested_at"), "ingested_at").alias("p"))
    papers = latest.where("p.deleted_at is null").select(F.col("paper_id").alias("id"), "p.title", "p.doi", "p.authors", none.alias("person"), F.col("p.publication_date").alias("date"), F.col("p.ingested_at").alias("arrived"))
    records = table(spark, sf_dir, "research_info").where("paper_id is null or paper_id < 1").select(
        "id", F.col("work_title").alias("title"), "doi", "authors", F.col("researcher_name").alias("person"), F.col("publication_date").alias("date"), F.col("ingested_at").alias("arrived"),
    )
    return matches(records, papers).select(F.col("entity").alias("paper_id"), F.col("record").alias("ri_id"), "confidence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and the papers they describe."""
    return p3_matches(spark, sf_dir).select("paper_id", "ri_id")


def p5_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving value of each field of each paper, with its votes."""
    return survivors(table(spark, sf_dir, "research_info"), table(spark, sf_dir, "feeds")).withColumnRenamed("group_id", "paper_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row's value survives."""
    return p5_survivors(spark, sf_dir).select("paper_id", "field", "ri_id")


def p5_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per paper."""
    return golden_records(p5_survivors(spark, sf_dir).withColumnRenamed("paper_id", "group_id")).withColumnRenamed("group_id", "paper_id")


def _spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "research_info").select("id", "researcher_name", "authors")
    typed = rows.select(F.regexp_replace("researcher_name", r"^[\s\u00a0]+|[\s\u00a0]+$", "").alias("name")).where("name <> ''")
    packed = split_field(spread(rows), "id", "authors").select(F.col("val").alias("name"))
    return typed.unionByName(packed).groupBy("name").agg(F.count("*").alias("n"))


def p7_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the label of its person or organisation."""
    return linked_spellings(_spellings(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of the same person or organisation."""
    return variant_pairs(p7_entities(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_matches": p3_matches, "p7_found": p7_found, "p7_entities": p7_entities, "p5_found": p5_found, "p5_survivors": p5_survivors, "p5_golden": p5_golden}
ORACLES: dict[str, str] = {}
