"""Nested bibliographic records: read from JSON lines, page by page or whole, and brought to the stable schema of works and authors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from scholarlake.functions.text import id_tail, or_default, without_any_tags, year_of

_NAMED = "struct<display_name:string>"
RAW_WORK = (
    "id string, doi string, title string, display_name string, type string, publication_date string, publication_year string, cited_by_count int, updated_date string, abstract_inverted_index map<string,array<int>>, "
    "open_access struct<oa_status:string,oa_url:string>, referenced_works array<string>, authorships array<struct<author_position:string,is_corresponding:boolean,author:struct<id:string,display_name:string,orcid:string>,"
    f"institutions:array<struct<id:string,lineage:array<string>>>>>, topics array<struct<id:string,display_name:string,score:double,subfield:{_NAMED},field:{_NAMED},domain:{_NAMED}>>, "
    "keywords array<struct<display_name:string,keyword:string>>, fulltext_status string, docling_status string, _corrupt_record string"
)
RAW_AUTHOR = (
    "id string, display_name string, orcid string, display_name_alternatives array<string>, works_count int, cited_by_count int, summary_stats struct<h_index:int,i10_index:int>, "
    "topics array<struct<id:string,display_name:string,count:int>>, last_known_institutions array<struct<id:string,display_name:string,country_code:string,type:string>>, _corrupt_record string"
)


def read_records(spark: SparkSession, path: str, schema: str = RAW_WORK) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines) of JSON-lines files; a line that can't be read doesn't fail the rest."""
    return parsed_records(spark.read.text(path), schema)


def parsed_records(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """The same of lines at hand (value); blank ones are none."""
    rows = lines.where("trim(value) <> ''").select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.select("_corrupt_record").where("_corrupt_record is not null")


def abstract_of(index: Column) -> Column:
    """The text of an inverted index: words in the order of their positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " ")


def normalized_works(raw: DataFrame, institution: str) -> DataFrame:
    """Records of works in the stable schema, one row an id (the latest `updated_date`); those without an id or a title are dropped."""
    tail = lambda c: F.coalesce(id_tail(c), F.lit(""))
    member = lambda a: F.exists(F.coalesce(a["institutions"], F.array()), lambda i: (tail(i["id"]) == institution) | F.array_contains(F.transform(F.coalesce(i["lineage"], F.array()), tail), institution))
    person = lambda a: F.struct(
        tail(a["author"]["id"]).alias("id"), or_default(a["author"]["display_name"]).alias("name"), or_default(a["author_position"]).alias("position"),
        F.coalesce(a["is_corresponding"], F.lit(False)).alias("is_corresponding"), F.coalesce(member(a), F.lit(False)).alias("is_su"),
    )
    people = F.filter(F.transform(F.coalesce("authorships", F.array().cast("array<struct<author_position:string,is_corresponding:boolean,author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<id:string,lineage:array<string>>>>>")), person), lambda p: p["name"] != "")
    topic = lambda t: F.struct(tail(t["id"]).alias("id"), or_default(t["display_name"]).alias("name"), or_default(t["field"]["display_name"]).alias("field"), or_default(t["domain"]["display_name"]).alias("domain"), F.coalesce(t["score"], F.lit(0.0)).alias("score"))
    keyword = F.transform("keywords", lambda k: F.coalesce(F.nullif(or_default(k["display_name"]), F.lit("")), or_default(k["keyword"])))
    x = raw.select(
        tail("id").alias("openalex_id"), or_default(F.col("doi")).alias("doi"), F.trim(without_any_tags(F.coalesce(F.nullif(or_default(F.col("title")), F.lit("")), or_default(F.col("display_name"))))).alias("title"),
        F.coalesce(abstract_of(F.col("abstract_inverted_index")), F.lit("")).alias("abstract"), year_of(F.col("publication_year")).alias("publication_year"), or_default(F.col("publication_date")).alias("publication_date"),
        or_default(F.col("type")).alias("work_type"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), or_default(F.col("open_access.oa_status")).alias("oa_status"), people.alias("all_authors"),
        F.transform(F.slice("topics", 1, 5), topic).alias("topics"), F.array_distinct(F.filter(keyword, lambda k: k != "")).alias("keywords"), F.filter("referenced_works", lambda r: F.coalesce(r != "", F.lit(False))).alias("referenced_works"),
        F.coalesce("fulltext_status", F.lit("none")).alias("fulltext_status"), F.coalesce("docling_status", F.lit("none")).alias("docling_status"), F.coalesce("updated_date", F.lit("")).alias("updated_date"),
    ).where("openalex_id <> '' and title <> ''")
    latest = x.groupBy("openalex_id").agg(F.max_by(F.struct(*[c for c in x.columns if c != "openalex_id"]), "updated_date").alias("x")).select("openalex_id", "x.*")
    own = F.transform(F.filter("all_authors", lambda a: a["is_su"]), lambda a: a["name"])
    names = F.transform("all_authors", lambda a: a["name"])
    listed = F.concat(F.array_join(F.slice(names, 1, 10), ", "), F.when(F.size(names) > 10, F.concat(F.lit(" et al. ("), F.size(names).cast("string"), F.lit(" authors)"))).otherwise(""))
    return latest.withColumns({"su_researchers": own, "primary_researcher": F.coalesce(F.get(own, F.lit(0)), F.get(names, F.lit(0)), F.lit("")), "authors_str": listed})


def normalized_authors(raw: DataFrame) -> DataFrame:
    """Records of authors in the stable schema."""
    topic = lambda t: F.struct(id_tail(t["id"]).alias("id"), t["display_name"].alias("name"), F.coalesce(t["count"], F.lit(0)).alias("count"))
    return raw.where("trim(id) <> '' and trim(display_name) <> ''").select(
        id_tail(F.col("id")).alias("author_id"), F.trim("display_name").alias("name"), or_default(F.col("orcid")).alias("orcid"), F.filter("display_name_alternatives", lambda n: F.coalesce(F.trim(n) != "", F.lit(False))).alias("alternatives"),
        F.coalesce("works_count", F.lit(0)).alias("works_count"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"), F.coalesce("summary_stats.h_index", F.lit(0)).alias("h_index"),
        F.transform(F.slice("topics", 1, 10), topic).alias("topics"), F.transform("last_known_institutions", lambda i: F.struct(id_tail(i["id"]).alias("id"), i["display_name"].alias("name"), i["country_code"].alias("country"))).alias("affiliations"),
    )


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _PagedReader(DataSourceReader):
    """One partition a page file; pages end with the first that is empty."""

    def __init__(self, folder: str, since: str) -> None:
        self.folder, self.since = folder, since

    def partitions(self) -> list[InputPartition]:
        return [_File(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in json.loads(Path(partition.path).read_text()).get("results", []):
            if str(r.get("updated_date") or "") >= self.since:
                yield str(r.get("id") or ""), str(r.get("updated_date") or ""), json.dumps(r)


class _PagedStream(SimpleDataSourceStreamReader):
    """The cursor of the next page is the offset: a restart goes on where it stopped."""

    def __init__(self, folder: str, since: str) -> None:
        self.folder, self.since = folder, since

    def initialOffset(self) -> dict:
        return {"page": 0}

    def _pages(self) -> list[Path]:
        return sorted(Path(self.folder).glob("*.json"))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        pages = self._pages()
        return self.readBetweenOffsets(start, {"page": len(pages)}), {"page": len(pages)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        reader = _PagedReader(self.folder, self.since)
        return iter([row for p in self._pages()[start["page"] : end["page"]] for row in reader.read(_File(str(p)))])


class PagedRecords(DataSource):
    """Format `paged_records`: a paged listing of records, saved page by page; option `since` keeps what was updated from that day on."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "id string, updated_date string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options["path"], self.options.get("since", ""))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PagedStream(self.options["path"], self.options.get("since", ""))
