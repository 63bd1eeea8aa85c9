"""Sinks: records written once each, results appended run by run, delivered tables with headers of their own."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.plans.cluster import shared_folder
from scholarlake.sources.files import exists

# The spellings of headers, and the column each becomes.
HEADERS = {"researcher": "researcher_name", "name": "researcher_name", "title": "work_title", "publication title": "work_title", "date": "publication_date", "pdf": "pdf_url", "pdf link": "pdf_url", "url": "pdf_url"}
WANTED = ("researcher_name", "work_title", "publication_date", "pdf_url", "info")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own among those all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_sections(sections: DataFrame, path: str) -> None:
    """Sections as JSON, a folder a source."""
    sections.write.mode("overwrite").partitionBy("source").json(path)


def append_results(results: DataFrame, path: str) -> None:
    """Results of one more run beside those of earlier ones; a run that fails leaves nothing behind."""
    results.write.mode("append").json(path)


def harmonised(df: DataFrame) -> DataFrame:
    """A delivered table under the headers in use: trimmed, in small letters, renamed, of repeated columns the first, what lacks null; all as text."""
    seen: dict[str, str] = {}
    for c in df.columns:
        low = re.sub(r"\d+$", "", c.strip().lower()).strip("_ ")
        seen.setdefault(HEADERS.get(low, low), c)
    return df.select(*((F.col(f"`{seen[c]}`").cast("string") if c in seen else F.lit(None).cast("string")).alias(c) for c in WANTED))


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Tables of comma-separated values united under common headers; those that aren't there are passed over, rows without a link, a person or a title left out."""
    out = None
    for p in paths:
        if exists(spark, p):
            one = harmonised(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(p))
            out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in WANTED))
    return out.where("trim(pdf_url) <> '' and trim(researcher_name) <> '' and trim(work_title) <> ''")
