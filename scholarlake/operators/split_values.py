"""Several values packed in one field, split into one value per row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.functions.fields import split_packed

_PARSED = "array<struct<pos:int,val:string,flag:string>>"


def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Array of (pos, val, flag) of each field; equal fields of a batch are parsed once."""
    for fields in batches:
        memo = {t: [{"pos": i, "val": v, "flag": f} for i, (v, f) in enumerate(split_packed(t))] for t in fields.dropna().unique()}
        yield pd.Series([memo.get(t, []) for t in fields], index=fields.index, dtype=object)


def split_field(df: DataFrame, key: str, field: str) -> DataFrame:
    """One row (row_key, pos, val, flag) per value packed in `field` of `df`.

    Rows are independent: no shuffle, whatever the skew. Null, empty and blank fields give no rows; `flag` names what was
    malformed ('' elsewhere); repeated rows give repeated results; columns of `df` besides the two are ignored.
    """
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(field).alias("_field")).where(F.trim("_field") != "")
    return rows.select("row_key", F.explode(F.pandas_udf(_parse, _PARSED)("_field")).alias("_v")).select("row_key", "_v.pos", "_v.val", "_v.flag")
