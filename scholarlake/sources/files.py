"""Files as sources and sinks: documents of a folder, acquisition by several strategies, keyed tables kept as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_TEXT = 200  # characters from which a fetched text counts as one


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of several inputs that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def is_pdf(content: Column) -> Column:
    """Whether the bytes begin as a PDF does."""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(bytearray(b"%PDF")), F.lit(False))


def new_documents(spark: SparkSession, folder: str, known: DataFrame, extract: Callable[[bytes], str]) -> DataFrame:
    """(file_name, text) of the PDF files of a folder whose name `known` (file_name) lacks.

    Names are anti-joined before contents are read through; files that aren't PDFs inside are left out; a file whose text can't be
    extracted has a null text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).join(known.select("file_name"), "file_name", "left_anti").where(is_pdf(F.col("content")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                try:
                    texts.append(extract(bytes(content)) or None)
                except Exception:
                    texts.append(None)
            yield pd.DataFrame({"file_name": pdf["file_name"].to_numpy(object), "text": pd.Series(texts, dtype=object)})

    return named.select("file_name", "content").mapInPandas(run, "file_name string, text string")


def best_pdf_link(best: Column, locations: Column) -> Column:
    """The link of the best location, else the first of the others that has one."""
    other = F.get(F.filter(locations, lambda x: F.coalesce(x["url"] != "", F.lit(False))), F.lit(0))["url"]
    return F.coalesce(F.when(best["url"] != "", best["url"]), other)


def acquired(works: DataFrame, strategies: dict[str, Column]) -> DataFrame:
    """`works` with `fulltext` and `fulltext_status`: the first strategy, in order, that gives a text of LEAST_TEXT characters; status none where none does."""
    good = {name: F.when(F.length(text) > LEAST_TEXT, text) for name, text in strategies.items()}
    status = reduce(lambda c, name: c.when(good[name].isNotNull(), F.lit(name)), good, F.when(F.lit(False), F.lit("")))
    return works.withColumns({"fulltext": F.coalesce(*good.values()), "fulltext_status": status.otherwise("none")})


def upserted(table: DataFrame, changes: DataFrame, key: str, fill_only: tuple[str, ...] = ()) -> DataFrame:
    """`table` with `changes` (one row a key) written over it; in the columns of `fill_only` a blank change keeps what stood."""
    a, b = table.alias("a"), changes.alias("b")
    merged = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    there = F.col(f"b.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"a.{key}", f"b.{key}").alias(c)
        if c not in changes.columns:
            return F.col(f"a.{c}").alias(c)
        new = F.col(f"b.{c}")
        given = there & (F.coalesce(F.trim(new.cast("string")) != "", F.lit(False)) if c in fill_only else F.lit(True))
        return F.when(given, new).otherwise(F.col(f"a.{c}")).alias(c)

    return merged.select(*(value(c) for c in table.columns))


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`table` without the rows of `keys`."""
    return table.join(keys.select(key), key, "left_anti")


def metadata_value(c: Column) -> Column:
    """A value as a metadata store takes it: null as '', text trimmed."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))
