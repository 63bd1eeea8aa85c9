"""The registry of corpora: names, their folders, and whether they are fit for use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from scholarlake.sources.files import exists
from scholarlake.sources.tables import table


@dataclass(frozen=True)
class Corpus:
    name: str
    folder: str
    tables: tuple[str, ...]


class Catalog:
    """Corpora by name, whatever its case; an unknown name gives the first."""

    def __init__(self, corpora: list[Corpus]) -> None:
        self.corpora = {c.name.lower(): c for c in corpora}

    def resolve(self, name: str) -> Corpus:
        return self.corpora.get((name or "").strip().lower(), next(iter(self.corpora.values())))

    def register(self, spark: SparkSession, name: str) -> list[str]:
        """Temporary views over the corpus's tables; gives their names."""
        c = self.resolve(name)
        for t in c.tables:
            table(spark, c.folder, t).createOrReplaceTempView(t)
        return list(c.tables)

    def health(self, spark: SparkSession, name: str) -> dict[str, bool]:
        """Of each table whether it is there and holds a row."""
        c = self.resolve(name)
        return {t: exists(spark, f"{c.folder}/{t}.parquet") and not table(spark, c.folder, t).isEmpty() for t in c.tables}
