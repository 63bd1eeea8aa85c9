"""Queries on texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.llm.bpe import encode, token_counts
from scholarlake.llm.containers import CAPACITY, containers, solved
from scholarlake.llm.garbled import garbled_documents
from scholarlake.llm.pieces import newest_texts, pieces, ranges_of, stitched
from scholarlake.llm.scans import repaired
from scholarlake.plans.cluster import spread
from scholarlake.sources.tables import table


def _long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    abstracts = table(spark, sf_dir, "normalized_works").select(F.lit("normalized_works").alias("tbl"), F.col("openalex_id").alias("item_key"), F.col("abstract").alias("text"), F.col("updated_date").alias("version"))
    scans = table(spark, sf_dir, "works").select(F.lit("works").alias("tbl"), F.col("id").cast("string").alias("item_key"), F.col("full_text").alias("text"), F.lit("").alias("version"))
    return newest_texts(abstracts.unionByName(scans))


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found in each text of works, and its paragraphs after repair."""
    works = spread(table(spark, sf_dir, "works").select("id", "full_text"))
    return repaired(works, "id", "full_text").withColumnRenamed("id", "work_row")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct item of each text."""
    return p4_repaired(spark, sf_dir).select("work_row", F.explode("found").alias("f")).select("work_row", "f.kind", "f.item")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that had to be split: those whose ranges are entered by a first piece."""
    return stitched(ranges_of(_long_texts(spark, sf_dir))).where("first_no = 0").select("tbl", "item_key")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all items over the limit."""
    return pieces(_long_texts(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode(docs, "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of 2,048 tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return containers(token_counts(docs, "doc_id", "text"), "doc_id", "n_tokens")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the fewest there could be by the program's dual bound, those that come from the program, and the share of room filled."""
    placed = p9_containers(spark, sf_dir)
    lengths = placed.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()  # at most the capacity
    counts = np.zeros(CAPACITY + 1, dtype=np.int64)
    for r in lengths:
        counts[r["length"]] = r["n"]
    whole, counts[CAPACITY] = int(counts[CAPACITY]), 0  # parts of the capacity fill a container each
    plan, least, by_program = solved(counts)
    used = sum(k for _, k in plan) + whole
    tokens = int((counts * np.arange(CAPACITY + 1)).sum()) + whole * CAPACITY
    row = (used, least + whole, by_program + whole, round(tokens / max(1, used * CAPACITY), 6))
    return spark.createDataFrame([row], "containers long, least long, by_program long, filled double")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled documents with the MD5 of what they said."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return garbled_documents(docs, "doc_id", "text").select("doc_id", "restored_md5")


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired, "p6_found": p6_found, "p6_pieces": p6_pieces, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found}
ORACLES = {
    "p6_found": """select distinct 'normalized_works' tbl, openalex_id item_key from normalized_works where length(abstract) > 2048
                   union all select 'works', cast(id as varchar) from works where length(full_text) > 2048""",
}
