"""Queries p1 and p2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.operators.orphans import orphan_references, orphan_report, parent_states
from scholarlake.operators.split_values import split_field
from scholarlake.plans.cluster import spread
from scholarlake.sources.tables import table


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every packed value of the two fields with its position and error flag."""
    authors = table(spark, sf_dir, "research_info").select("id", "authors").where("authors is not null")
    people = table(spark, sf_dir, "chunks").select("chunk_id", "su_researchers").where("su_researchers is not null").distinct()
    return (
        split_field(spread(authors), "id", "authors").withColumn("tbl", F.lit("research_info"))
        .unionByName(split_field(people, "chunk_id", "su_researchers").withColumn("tbl", F.lit("chunks")))
        .select("tbl", "row_key", "pos", "val", "flag")
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value; `id` is unique and repeated chunks are dropped before parsing, so nothing comes twice."""
    return p1_values(spark, sf_dir).select("tbl", "row_key", "pos", "val")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of works and research_info whose paper is missing, deleted or late."""
    refs = None
    for name in ("works", "research_info"):
        part = table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col("id").alias("row_id"), F.col("paper_id").alias("key"), F.col("ingested_at").alias("at"))
        refs = part if refs is None else refs.unionByName(part)
    return orphan_references(refs, parent_states(table(spark, sf_dir, "papers"), "paper_id", "ingested_at", "deleted_at"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table and month."""
    return orphan_report(p2_found(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_values": p1_values, "p2_found": p2_found, "p2_report": p2_report}

_P2 = """
with state as (select paper_id, min(ingested_at) first_at, arg_max(deleted_at is not null, ingested_at) gone from papers group by paper_id),
refs as (select 'works' tbl, id row_id, paper_id, ingested_at from works where paper_id >= 1
         union all select 'research_info', id, paper_id, ingested_at from research_info where paper_id >= 1),
found as (select tbl, row_id, strftime(r.ingested_at, '%Y-%m') period,
                 case when s.paper_id is null then 'missing' when gone then 'deleted' when first_at > r.ingested_at then 'late' end kind
          from refs r left join state s using (paper_id))
"""

ORACLES = {
    "p2_found": _P2 + "select tbl, row_id, period, kind from found where kind is not null",
    "p2_report": _P2 + "select tbl, period, kind, count(*) n from found where kind is not null group by all",
}
