"""Audits, fill-only updates and references between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarlake.functions.text import blank_to_null, missing


def column_audit(df: DataFrame, name: str) -> DataFrame:
    """(tbl, col, rows, nulls, empties, missing) of every scalar column of `df`, in a single pass over it."""
    columns = [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    text = {f.name for f in columns if isinstance(f.dataType, T.StringType)}
    counts = [F.count("*").alias("rows")]
    for f in columns:
        counts.append(F.count_if(F.col(f.name).isNull()).alias(f"{f.name}|n"))
        counts.append((F.count_if(F.col(f.name) == "") if f.name in text else F.lit(0).cast("long")).alias(f"{f.name}|e"))
    row = df.agg(*counts)
    cells = F.array(*(F.struct(F.lit(f.name).alias("col"), F.col(f"`{f.name}|n`").alias("nulls"), F.col(f"`{f.name}|e`").alias("empties")) for f in columns))
    long = row.select("rows", F.explode(cells).alias("c"))
    return long.select(F.lit(name).alias("tbl"), "c.col", "rows", "c.nulls", "c.empties", (F.col("c.nulls") + F.col("c.empties")).alias("missing"))


def schema_of(df: DataFrame, name: str) -> DataFrame:
    """(tbl, pos, col, is_text) of the columns of `df`; read from the schema, no data is touched."""
    rows = [(name, i, f.name, isinstance(f.dataType, T.StringType)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "tbl string, pos int, col string, is_text boolean")


def any_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (missing(F.col(c)) for c in columns))


def fill_blank(target: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`target` with blank values of `columns` filled from `source` (one row a key); what is there is never overwritten."""
    new = source.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = target.join(new, target[key] == F.col("_k"), "left")
    return joined.select(*((F.coalesce(blank_to_null(F.col(c)), F.col(f"_{c}")).alias(c) if c in columns else F.col(c)) for c in target.columns))


def fill_unique(target: DataFrame, offers: DataFrame, key: str, column: str, cased: bool = False) -> DataFrame:
    """Blank `column` values filled from `offers` (key, column) where no row holds the value yet, whatever its case unless `cased`.

    Of several keys offered one value the least gets it. Taken values are anti-joined, not compared row by row.
    """
    value = F.trim(column) if cased else F.lower(F.trim(column))
    taken = target.where(~missing(F.col(column))).select(value.alias("_v")).distinct()
    free = offers.where(~missing(F.col(column))).select(key, F.trim(column).alias("_new"), value.alias("_v"))
    blank = target.where(missing(F.col(column))).select(key)
    claims = free.join(blank, key, "left_semi").join(taken, "_v", "left_anti").groupBy("_v").agg(F.min_by(F.struct(key, "_new"), key).alias("c")).select(f"c.{key}", "c._new")
    one = claims.groupBy(key).agg(F.min("_new").alias("_new"))
    return target.join(one, key, "left").withColumn(column, F.coalesce(blank_to_null(F.col(column)), F.col("_new"))).select(*target.columns)


def add_missing_rows(target: DataFrame, keys: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """`target` with a row of defaults for each key of `keys` it lacks."""
    lacking = keys.where(F.col(key).isNotNull()).select(key).distinct().join(target.select(key), key, "left_anti")
    rows = lacking.select(key, *(v.alias(c) for c, v in defaults.items()))
    return target.unionByName(rows, allowMissingColumns=True)


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with those of `columns` it lacks: additive schema evolution."""
    return df.withColumns({c: v for c, v in columns.items() if c not in df.columns})


def first_column(df: DataFrame, names: list[str]) -> str:
    """The first of several spellings of a column that `df` has."""
    return next(n for n in names if n in df.columns)
