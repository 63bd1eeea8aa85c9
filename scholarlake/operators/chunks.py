"""Cutting texts into chunks of whole sentences that overlap."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.functions.text import sentences, strip

MOST_TOKENS = 512
OVERLAP_TOKENS = 128


def packs(sentences: list[str], most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[str]:
    """Chunks of whole sentences; each sentence is looked at once, and once more for each chunk it is carried into."""
    tokens = [int(len(re.findall(r"[^ \t\r\n\f\x0b]+", s)) * 1.3) for s in sentences]
    out, first, held = [], 0, 0
    for i, t in enumerate(tokens):
        if held + t > most and i > first:
            out.append(" ".join(sentences[first:i]))
            kept, j = 0, i
            while j > first and kept + tokens[j - 1] <= overlap:
                j -= 1
                kept += tokens[j]
            first, held = j, kept
        held += t
    if first < len(sentences):
        out.append(" ".join(sentences[first:]))
    return out


def packed_sentences(text: Column, most: int = MOST_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Array of chunks of at most `most` estimated tokens, each beginning with the last sentences of the one before.

    Linear in the text, over Arrow batches. Tokens are estimated and cut to whole numbers sentence by sentence. A sentence over the
    limit is a chunk of its own; what is carried over is the longest run of last sentences within `overlap`. Null gives null,
    blank no chunk.
    """

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([packs(list(s), most, overlap) if s is not None else None for s in lists], index=lists.index, dtype=object)

    return run(sentences(text))


def context_prefix(work: DataFrame) -> Column:
    """`Research by X in T (Y). ` as far as the parts are known."""
    topic = F.get("topics", F.lit(0))["name"]
    named = lambda c, before, after="": F.when(F.coalesce(F.trim(c) != "", F.lit(False)), F.concat(F.lit(before), c, F.lit(after)))
    parts = F.concat_ws(" ", named(F.col("primary_researcher"), "Research by "), named(topic, "in "), F.when(F.col("publication_year").isNotNull(), F.concat(F.lit("("), F.col("publication_year").cast("string"), F.lit(")"))))
    return F.when(parts != "", F.concat(parts, F.lit(". "))).otherwise("")


def chunked_works(works: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk_id, work_id, chunk_type, chunk_index, text, embed_text) of normalised works.

    `sections` has work_id, pos, heading, body and element_type. Title and abstract come first, keywords and topics second,
    sections from index 100 on: bodies under 30 characters are left out, tables and captions stay whole, text is packed into
    overlapping chunks.
    """
    base = works.withColumn("prefix", context_prefix(works))
    whole = F.when(F.coalesce(F.trim("abstract"), F.lit("")) != "", F.concat_ws("\n\n", "title", "abstract")).otherwise(F.col("title"))
    first = base.where("trim(title) <> ''").select("openalex_id", "prefix", F.lit("title_abstract").alias("chunk_type"), F.lit(0).alias("chunk_index"), whole.alias("text"))
    names = F.filter(F.transform(F.slice("topics", 1, 5), lambda t: t["name"]), lambda n: F.coalesce(n != "", F.lit(False)))
    fields = F.array_distinct(F.filter(F.transform(F.slice("topics", 1, 5), lambda t: t["field"]), lambda n: F.coalesce(n != "", F.lit(False))))
    listed = lambda a, label: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, ", ")))
    told = F.concat_ws(". ", F.col("title"), listed(F.slice("keywords", 1, 15), "Keywords: "), listed(names, "Research topics: "), listed(fields, "Fields: "))
    second = base.where("size(keywords) > 0 or size(topics) > 0").select("openalex_id", "prefix", F.lit("keywords").alias("chunk_type"), F.lit(1).alias("chunk_index"), told.alias("text"))
    bodies = sections.where(F.length(strip(F.col("body"))) >= 30)
    split = F.when(F.col("element_type") == "section", packed_sentences(F.col("body"))).otherwise(F.array(strip(F.col("body"))))
    parts = F.transform(split, lambda s: F.struct(F.col("pos"), F.col("element_type").alias("chunk_type"), F.concat(F.col("heading"), F.lit(": "), s).alias("text")))
    grouped = bodies.select("work_id", F.col("pos"), parts.alias("parts")).groupBy("work_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parts"))), lambda x: x["parts"])).alias("parts"))
    placed = grouped.select("work_id", F.posexplode("parts").alias("i", "p"))
    third = placed.join(base.select(F.col("openalex_id").alias("work_id"), "prefix", "title"), "work_id").select(
        F.col("work_id").alias("openalex_id"), "prefix", "p.chunk_type", (F.col("i") + 100).alias("chunk_index"), F.concat_ws(" — ", "title", "p.text").alias("text"),
    )
    return first.unionByName(second).unionByName(third).select(
        F.concat_ws("_", "openalex_id", "chunk_type", F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("openalex_id").alias("work_id"), "chunk_type", "chunk_index", "text", F.concat("prefix", "text").alias("embed_text"),
    )
