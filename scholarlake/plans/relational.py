"""Queries on tables: joins, audits, repair, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import quality
from scholarlake.plans.texts import _DOI, _STRIP
from scholarlake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def current_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each paper, deleted ones left out."""
    p = table(spark, sf_dir, "papers")
    fields = [c for c in p.columns if c not in ("paper_id", "ingested_at")]
    latest = p.groupBy("paper_id").agg(F.max_by(F.struct(*fields), "ingested_at").alias("p"))
    return latest.where("p.deleted_at is null").select("paper_id", "p.*")


_PAPERS = "papers_now as (select * from (select paper_id, unnest(arg_max_null(struct_pack(title := title, authors := authors, publication_date := publication_date, doi := doi, arxiv_id := arxiv_id, deleted_at := deleted_at), ingested_at)) from papers group by paper_id) where deleted_at is null)"
_BLANK = lambda c: f"coalesce(trim({c}) = '', true)"


@query(
    "jn_left_join",
    "select r.id, r.paper_id, w.id work_row, r.work_title, length(w.full_text) n_chars from research_info r left join works w using (paper_id)",
)
def jn_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, SC25, SC26: records with the texts of their paper; the text's column is found by its spelling."""
    w = table(spark, sf_dir, "works")
    text = quality.first_column(w, ["full_text", "fultext", "fulltext"])
    w = w.select("paper_id", F.col("id").alias("work_row"), F.length(text).cast("long").alias("n_chars"))
    return table(spark, sf_dir, "research_info").select("id", "paper_id", "work_title").join(w, "paper_id", "left").select("id", "paper_id", "work_row", "work_title", "n_chars")


@query(
    "jn_two_hops",
    f"""with {_PAPERS}, w as (select paper_id, min(id) work_row, arg_min_null(file_name, id) file_name from works where paper_id is not null group by paper_id), r as (select paper_id, min(id) ri_id, arg_min_null(work_title, id) work_title from research_info where paper_id is not null group by paper_id)
    select w.paper_id, work_row, file_name, title, ri_id, work_title from w left join papers_now using (paper_id) left join r using (paper_id)""",
)
def jn_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2, JN3: one row per worked paper with its title and first record; a bare column of a group is that of the least id."""
    w = table(spark, sf_dir, "works").where("paper_id is not null").groupBy("paper_id").agg(F.min("id").alias("work_row"), F.min_by("file_name", "id").alias("file_name"))
    r = table(spark, sf_dir, "research_info").where("paper_id is not null").groupBy("paper_id").agg(F.min("id").alias("ri_id"), F.min_by("work_title", "id").alias("work_title"))
    return w.join(current_papers(spark, sf_dir).select("paper_id", "title"), "paper_id", "left").join(r, "paper_id", "left").select("paper_id", "work_row", "file_name", "title", "ri_id", "work_title")


@query(
    "jn_needs_repair",
    f"with {_PAPERS} select w.id, paper_id, {_BLANK('title')} no_title, {_BLANK('authors')} no_authors, {_BLANK('doi')} no_doi from works w join papers_now p using (paper_id) where trim(full_text) <> '' and ({_BLANK('title')} or {_BLANK('authors')} or {_BLANK('doi')})",
)
def jn_needs_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4, PF11, PF12: works with a text whose paper lacks a title, authors or a DOI."""
    p = current_papers(spark, sf_dir).where(quality.any_missing(["title", "authors", "doi"]))
    w = table(spark, sf_dir, "works").where("trim(full_text) <> ''").select("id", "paper_id")
    return w.join(p, "paper_id").select("id", "paper_id", *(T.missing(F.col(c)).alias(f"no_{c}") for c in ("title", "authors", "doi")))


@query("jn_anti", "select distinct paper_id from works w where paper_id is not null and not exists (select 1 from research_info r where r.paper_id = w.paper_id)")
def jn_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6, JN17, JN18: papers with a text but no record."""
    return table(spark, sf_dir, "works").where("paper_id is not null").select("paper_id").distinct().join(table(spark, sf_dir, "research_info").select("paper_id"), "paper_id", "left_anti")


@query(
    "jn_ensure_rows",
    """select paper_id, id, work_title, topics_status from research_info union all
    select distinct paper_id, cast(null as bigint), cast(null as varchar), 'untagged' from works w where paper_id is not null and not exists (select 1 from research_info r where r.paper_id = w.paper_id)""",
)
def jn_ensure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, JN7, JN24, DM12: records, with a stub for each worked paper that has none."""
    r = table(spark, sf_dir, "research_info").select("paper_id", "id", "work_title", "topics_status")
    return quality.add_missing_rows(r, table(spark, sf_dir, "works"), "paper_id", {"topics_status": F.lit("untagged")})


@query(
    "jn_orphan_counts",
    """select 'works_without_paper' what, count(*) n from works w where paper_id is not null and not exists (select 1 from papers p where p.paper_id = w.paper_id)
    union all select 'records_without_paper', count(*) from research_info r where paper_id is not null and not exists (select 1 from papers p where p.paper_id = r.paper_id)
    union all select 'works_without_record', count(*) from works w where paper_id is not null and not exists (select 1 from research_info r where r.paper_id = w.paper_id)
    union all select 'records_without_work', count(*) from research_info r where paper_id is not null and not exists (select 1 from works w where r.paper_id = w.paper_id)
    union all select 'works_without_key', count(*) from works where paper_id is null union all select 'records_without_key', count(*) from research_info where paper_id is null""",
)
def jn_orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN8: references without a counterpart, by kind."""
    w, r, p = (table(spark, sf_dir, t).select("paper_id") for t in ("works", "research_info", "papers"))
    lone = lambda a, b, what: a.where("paper_id is not null").join(b, "paper_id", "left_anti").agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    none = lambda a, what: a.where("paper_id is null").agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    parts = [lone(w, p, "works_without_paper"), lone(r, p, "records_without_paper"), lone(w, r, "works_without_record"), lone(r, w, "records_without_work"), none(w, "works_without_key"), none(r, "records_without_key")]
    return reduce(DataFrame.unionByName, parts)


@query("jn_known_citations", "select distinct openalex_id src, r dst from (select openalex_id, unnest(referenced_works) r from normalized_works) where r in (select openalex_id from normalized_works)")
def jn_known_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15, JN16: citations whose target is known."""
    w = table(spark, sf_dir, "normalized_works")
    cites = w.select(F.col("openalex_id").alias("src"), F.explode("referenced_works").alias("dst")).distinct()
    return cites.join(w.select(F.col("openalex_id").alias("dst")), "dst", "left_semi").select("src", "dst")


_GROUPED = "m as (select paper_id, max(nullif(trim(work_title), '')) title, max(nullif(trim(authors), '')) authors, max(nullif(trim(publication_date), '')) publication_date from research_info where paper_id is not null group by paper_id)"


@query("ag_group_max", f"with {_GROUPED} select * from m")
def ag_group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3, AG4: the greatest value of each field that isn't blank, by paper."""
    r = table(spark, sf_dir, "research_info").where("paper_id is not null")
    pick = lambda c, name: F.max(T.blank_to_null(F.trim(c))).alias(name)
    return r.groupBy("paper_id").agg(pick("work_title", "title"), pick("authors", "authors"), pick("publication_date", "publication_date"))


@query(
    "dm_fill_papers",
    f"with {_PAPERS}, {_GROUPED} select paper_id, coalesce(nullif(trim(p.title), ''), m.title) is not null has_title, case when trim(p.title) <> '' then p.title else m.title end title, case when trim(p.authors) <> '' then p.authors else m.authors end authors, case when trim(p.publication_date) <> '' then p.publication_date else m.publication_date end publication_date from papers_now p left join m using (paper_id)",
)
def dm_fill_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN9, DM1, DM16: blanks of papers filled from their records."""
    filled = quality.fill_blank(current_papers(spark, sf_dir), ag_group_max(spark, sf_dir), "paper_id", ["title", "authors", "publication_date"])
    return quality.with_columns(filled, {"has_title": F.col("title").isNotNull()}).select("paper_id", "has_title", "title", "authors", "publication_date")


@query(
    "dm_unique_doi",
    f"""with {_PAPERS}, o as (select distinct paper_id, {_DOI('doi')} doi from research_info where paper_id is not null), taken as (select distinct lower(trim(doi)) v from papers_now where trim(doi) <> ''),
    claims as (select o.doi v, min(o.paper_id) paper_id from o join papers_now p using (paper_id) where {_BLANK('p.doi')} and trim(o.doi) <> '' and lower(trim(o.doi)) not in (select v from taken) group by o.doi),
    one as (select paper_id, min(v) v from claims group by paper_id)
    select p.paper_id, case when trim(p.doi) <> '' then p.doi else one.v end doi from papers_now p left join one using (paper_id)""",
)
def dm_unique_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: blank DOIs filled from records, each DOI at most once."""
    offers = table(spark, sf_dir, "research_info").where("paper_id is not null").select("paper_id", T.doi(F.col("doi")).alias("doi")).distinct()
    return quality.fill_unique(current_papers(spark, sf_dir).select("paper_id", "doi"), offers, "paper_id", "doi")


@query(
    "dm_tag_update",
    """with best as (select topic, max(domain) domain from (select unnest(topics, recursive := true) from normalized_works) t(id, topic, field, domain, score) where topic is not null group by topic),
    r as (select id, primary_topic, subject, topics_status, json_extract_string(topics_json, '$[0].topic') t from research_info)
    select id, coalesce(t, primary_topic) primary_topic, case when trim(subject) <> '' then subject else coalesce(domain, 'Unknown') end subject, case when t is not null then 'tagged' else coalesce(nullif(trim(topics_status), ''), 'untagged') end topics_status from r left join best on t = topic""",
)
def dm_tag_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN23, DM10, SC44, SC45, QO29: topics and their hierarchy written to records, fill-only where a value stands."""
    topics = table(spark, sf_dir, "normalized_works").select(F.explode("topics").alias("t")).select("t.name", "t.domain").where("name is not null").groupBy("name").agg(F.max("domain").alias("domain"))
    r = table(spark, sf_dir, "research_info").withColumn("t", F.get(F.from_json("topics_json", "array<struct<topic:string,score:double>>"), F.lit(0))["topic"])
    status = F.when(F.col("t").isNotNull(), F.lit("tagged")).otherwise(F.coalesce(T.blank_to_null(F.trim("topics_status")), F.lit("untagged")))
    return r.join(topics, r["t"] == topics["name"], "left").select(
        "id", F.coalesce("t", "primary_topic").alias("primary_topic"), F.coalesce(T.blank_to_null(F.col("subject")), "domain", F.lit("Unknown")).alias("subject"), status.alias("topics_status"),
    )


@query(
    "dm_summaries",
    """select id, case when summary_status = 'unsummarized' and progress = 0 and trim(full_text) <> '' then full_text[:200] else summary end summary,
    case when summary_status = 'unsummarized' and progress = 0 and trim(full_text) <> '' then 'summarized' else summary_status end summary_status, case when summary_status = 'unsummarized' and progress = 0 and trim(full_text) <> '' then 1 else progress end progress from works""",
)
def dm_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF13, DM11, DM15, QO30, QO31: the queue of texts without a summary gets one; the stand-in takes the start of the text."""
    due = F.coalesce((F.col("summary_status") == "unsummarized") & (F.col("progress") == 0) & (F.trim("full_text") != ""), F.lit(False))
    new = {"summary": F.substring("full_text", 1, 200), "summary_status": F.lit("summarized"), "progress": F.lit(1)}
    return table(spark, sf_dir, "works").select("id", *(F.when(due, v).otherwise(F.col(c)).alias(c) for c, v in new.items()))


KEY_RANGES = 4_096


@query(
    "dm_new_keys",
    """with top as (select max(paper_id) m from papers), w as (select id, row_number() over (order by id) n from works where paper_id is null) select id, m + n paper_id from w, top""",
)
def dm_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM14: new keys, without gaps, for works that have none.

    Ranks are counted in at most KEY_RANGES ranges of ids and offset by the ranges before, so that no single task numbers all rows
    and what is added up in one task doesn't grow.
    """
    w = table(spark, sf_dir, "works").where("paper_id is null")
    ends = w.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    lo, width = ends["lo"] or 0, ((ends["hi"] or 0) - (ends["lo"] or 0)) // KEY_RANGES + 1
    w = w.select("id", F.floor((F.col("id") - lo) / width).alias("g"))
    sizes = w.groupBy("g").count().withColumn("offset", F.sum("count").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)))
    top = table(spark, sf_dir, "papers").agg(F.max("paper_id").alias("m"))
    numbered = w.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("id"))).join(sizes.select("g", F.coalesce("offset", F.lit(0)).alias("offset")), "g")
    return numbered.crossJoin(F.broadcast(top)).select("id", (F.col("m") + F.col("n") + F.col("offset")).alias("paper_id"))


_AUDITED = {"papers": ["paper_id", "title", "authors", "publication_date", "doi", "arxiv_id", "ingested_at", "deleted_at"], "works": ["id", "paper_id", "file_name", "full_text", "summary", "summary_status", "progress", "ingested_at"],
            "research_info": ["id", "paper_id", "researcher_name", "work_title", "authors", "info", "doi", "publication_date", "primary_topic", "topics_json", "topics_status", "subject", "feed", "ingested_at"]}
_NO_TEXT = {"paper_id", "ingested_at", "deleted_at", "id", "progress"}
_AUDIT = " union all ".join(
    f"select '{t}' tbl, '{c}' col, count(*) rows, count(*) filter ({c} is null) nulls, {0 if c in _NO_TEXT else f'''count(*) filter ({c} = '')'''} empties, count(*) filter ({c} is null) + {0 if c in _NO_TEXT else f'''count(*) filter ({c} = '')'''} missing from {t}"
    for t, cs in _AUDITED.items() for c in cs
)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (quality.column_audit(table(spark, sf_dir, t), t) for t in _AUDITED))


@query("ag_audit", _AUDIT)
def ag_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5, AG25-AG27, QO28: null and empty values of every column, one pass a table."""
    return _audit(spark, sf_dir)


@query("ag_missing_ranking", f"select tbl, col, missing, round(100.0::double * missing / rows, 4) pct from ({_AUDIT}) order by missing desc, tbl desc, col desc limit 50")
def ag_missing_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: the fifty columns that lack most."""
    return _audit(spark, sf_dir).orderBy(F.desc("missing"), F.desc("tbl"), F.desc("col")).limit(50).select("tbl", "col", "missing", F.round(100.0 * F.col("missing") / F.col("rows"), 4).alias("pct"))


@query("ag_schema", " union all ".join(f"select '{t}' tbl, cast({i} as int) pos, '{c}' col, {'false' if c in _NO_TEXT else 'true'} is_text" for t, cs in _AUDITED.items() for i, c in enumerate(cs)))
def ag_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG29, AG30, PF40: columns of the tables."""
    return reduce(DataFrame.unionByName, (quality.schema_of(table(spark, sf_dir, t), t) for t in _AUDITED))


@query("ag_sample", "select id, paper_id from research_info where coalesce(trim(doi) = '', true) order by id limit 20")
def ag_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG28: twenty records without a DOI, for inspection."""
    return table(spark, sf_dir, "research_info").where(T.missing(F.col("doi"))).select("id", "paper_id").orderBy("id").limit(20)


@query(
    "ag_counts_snapshot",
    f"""select p.n papers, p.t papers_no_title, p.a papers_no_authors, p.d papers_no_doi, w.n works, w.t works_no_text, w.s works_unsummarized, r.n records, r.t records_no_title, r.d records_no_doi, r.u records_untagged, r.p tagged_papers, r.k papers_recorded from
    (select count(*) n, count(*) filter ({_BLANK('title')}) t, count(*) filter ({_BLANK('authors')}) a, count(*) filter ({_BLANK('doi')}) d from papers) p,
    (select count(*) n, count(*) filter ({_BLANK('full_text')}) t, count(*) filter (summary_status = 'unsummarized') s from works) w,
    (select count(*) n, count(*) filter ({_BLANK('work_title')}) t, count(*) filter ({_BLANK('doi')}) d, count(*) filter (coalesce(trim(topics_status), '') in ('', 'untagged')) u, count(distinct paper_id) filter (topics_status = 'tagged') p, count(distinct paper_id) k from research_info) r""",
)
def ag_counts_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, AG2, PF14, SC41: the state of the corpus in thirteen counts; each table is read once."""
    blank = lambda c, name: F.count_if(T.missing(F.col(c))).alias(name)
    p = table(spark, sf_dir, "papers").agg(F.count("*").alias("papers"), blank("title", "papers_no_title"), blank("authors", "papers_no_authors"), blank("doi", "papers_no_doi"))
    w = table(spark, sf_dir, "works").agg(F.count("*").alias("works"), blank("full_text", "works_no_text"), F.count_if(F.col("summary_status") == "unsummarized").alias("works_unsummarized"))
    untagged = F.coalesce(F.trim("topics_status"), F.lit("")).isin("", "untagged")
    r = table(spark, sf_dir, "research_info").agg(
        F.count("*").alias("records"), blank("work_title", "records_no_title"), blank("doi", "records_no_doi"), F.count_if(untagged).alias("records_untagged"),
        F.count_distinct(F.when(F.col("topics_status") == "tagged", F.col("paper_id"))).alias("tagged_papers"), F.count_distinct("paper_id").alias("papers_recorded"),
    )
    return p.crossJoin(w).crossJoin(r)  # one row each


@query("ag_status_histogram", "select coalesce(fulltext_status, 'none') fulltext_status, coalesce(docling_status, 'none') docling_status, count(*) n from normalized_works group by all")
def ag_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7, SC17: works by status."""
    s = [F.coalesce(c, F.lit("none")).alias(c) for c in ("fulltext_status", "docling_status")]
    return table(spark, sf_dir, "normalized_works").groupBy(*s).agg(F.count("*").alias("n"))


@query("ag_chunk_types", "select chunk_type, count(*) n, count(distinct work_id) works from chunks group by all")
def ag_chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8, AG24, SC28: chunks by type."""
    return table(spark, sf_dir, "chunks").groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_distinct("work_id").alias("works"))


@query("ag_longest_per_group", "select paper_id, arg_max_null(id, struct_pack(l := length(full_text), i := -id)) work_row, max(length(full_text)) n_chars from works where paper_id is not null and full_text is not null group by paper_id")
def ag_longest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9: the longest text of each paper, the first of several."""
    w = table(spark, sf_dir, "works").where("paper_id is not null and full_text is not null").select("paper_id", "id", F.length("full_text").cast("long").alias("l"))
    return w.groupBy("paper_id").agg(F.max_by("id", F.struct("l", -F.col("id"))).alias("work_row"), F.max("l").alias("n_chars"))


@query("ag_year_span", "with y as (select try_cast(regexp_extract(publication_date, '\\b((?:19|20)[0-9]{2})\\b', 1) as int) y, openalex_id from normalized_works) select min(y) oldest, max(y) newest, count(y) dated, count(*) works from y")
def ag_year_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: first and last year of the corpus."""
    y = table(spark, sf_dir, "normalized_works").select(T.year_of(F.col("publication_date")).alias("y"))
    return y.agg(F.min("y").alias("oldest"), F.max("y").alias("newest"), F.count("y").alias("dated"), F.count("*").alias("works"))


@query(
    "ag_extreme_years",
    """with x as (select min(publication_year) lo, max(publication_year) hi from normalized_works) select 'most_recent' which, openalex_id, title, publication_year from normalized_works, x where publication_year = hi
    union all select 'oldest', openalex_id, title, publication_year from normalized_works, x where publication_year = lo""",
)
def ag_extreme_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17: all works of the newest and of the oldest year; the extremes come from one aggregate, not from a ranked single partition."""
    w = table(spark, sf_dir, "normalized_works").select("openalex_id", "title", "publication_year")
    x = w.agg(F.min("publication_year").alias("lo"), F.max("publication_year").alias("hi"))
    at = w.join(F.broadcast(x), (F.col("publication_year") == F.col("lo")) | (F.col("publication_year") == F.col("hi")))
    which = F.explode(F.array_compact(F.array(F.when(F.col("publication_year") == F.col("hi"), "most_recent"), F.when(F.col("publication_year") == F.col("lo"), "oldest"))))
    return at.select(which.alias("which"), "openalex_id", "title", "publication_year")


@query(
    "sc_csv_union",
    f"""select {_STRIP('title')} title, doi, authors from papers where {_STRIP('title')} <> '' and trim(authors) <> '' union all select {_STRIP('work_title')}, doi, authors from research_info where {_STRIP('work_title')} <> '' and trim(authors) <> ''
    union all select {_STRIP('title')}, doi, authors_str from normalized_works where {_STRIP('title')} <> '' and trim(authors_str) <> ''""",
)
def sc_csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, PF8, PF9, ST2: three sources brought to one schema, missing columns null, rows without title or authors dropped."""
    parts = [
        table(spark, sf_dir, "papers").select("title", "doi", "authors"),
        table(spark, sf_dir, "research_info").select(F.col("work_title").alias("title"), "doi", "authors"),
        table(spark, sf_dir, "normalized_works").select("title", "doi", F.col("authors_str").alias("authors")),
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.withColumn("title", T.strip(F.col("title"))).where("title <> '' and trim(authors) <> ''").select("title", "doi", "authors")


@query(
    "pf_info_line",
    "select openalex_id, concat_ws(' | ', case when trim(work_type) <> '' then 'Type: ' || work_type end, case when trim(oa_status) <> '' then 'Access: ' || oa_status end, case when publication_year is not null then 'Year: ' || publication_year end) info from normalized_works",
)
def pf_info_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF10, PF29: labelled parts joined, blank ones left out."""
    part = lambda label, c: F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{label}: "), F.col(c).cast("string")))
    return table(spark, sf_dir, "normalized_works").select("openalex_id", F.concat_ws(" | ", part("Type", "work_type"), part("Access", "oa_status"), part("Year", "publication_year")).alias("info"))


@query(
    "fn_qa_pairs",
    """with r as (select id, work_title t, researcher_name n, publication_date d, info i from research_info where trim(work_title) <> '' and trim(researcher_name) <> '')
    select id, 0 k, 'Who wrote "' || t || '"?' prompt, n target from r union all select id, 1, 'What did ' || n || ' write?', t from r
    union all select id, 2, 'When was "' || t || '" published?', coalesce(nullif(trim(d), ''), 'Unknown') from r
    union all select id, 3, 'What is "' || t || '" about?', case when length(i) > 512 then i[:512] || '...' else coalesce(nullif(trim(i), ''), 'No information') end from r""",
)
def fn_qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN98, SC37: four question-answer pairs per record, in one pass."""
    r = table(spark, sf_dir, "research_info").where("trim(work_title) <> '' and trim(researcher_name) <> ''").select("id", F.col("work_title").alias("t"), F.col("researcher_name").alias("n"), F.col("publication_date").alias("d"), F.col("info").alias("i"))
    quoted = lambda a, b: F.concat(F.lit(f'{a} "'), F.col("t"), F.lit(f'"{b}'))
    pair = lambda k, p, a: F.struct(F.lit(k).alias("k"), p.alias("prompt"), a.alias("target"))
    about = F.when(F.length("i") > 512, F.concat(F.substring("i", 1, 512), F.lit("..."))).otherwise(F.coalesce(T.blank_to_null(F.trim("i")), F.lit("No information")))
    pairs = F.array(
        pair(0, quoted("Who wrote", "?"), F.col("n")), pair(1, F.concat(F.lit("What did "), "n", F.lit(" write?")), F.col("t")),
        pair(2, quoted("When was", " published?"), F.coalesce(T.blank_to_null(F.trim("d")), F.lit("Unknown"))), pair(3, quoted("What is", " about?"), about),
    )
    return r.select("id", F.explode(pairs).alias("p")).select("id", "p.*")


_BENCH = "b as (select event_id, event_type model, cast(user_id % 5 as int) db, cast(event_id % 31 as int) ord, value, case when value < 5 then 'weak' when value < 15 then 'inconsistent' when value < 40 then 'medium' else 'high' end conf, event_type = 'error' failed from events)"


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    conf = F.when(v < 5, "weak").when(v < 15, "inconsistent").when(v < 40, "medium").otherwise("high")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("db"), (F.col("event_id") % 31).cast("int").alias("ord"), "value", conf.alias("conf"), (F.col("event_type") == "error").alias("failed"))


@query("ag_bench_rollup", f"with {_BENCH} select model, db, ord, count(*) runs, round(avg(value), 6) avg_value, round(avg(value) filter (value > 20), 6) avg_large, count(*) filter (failed) errors from b group by grouping sets ((model), (db), (ord))")
def ag_bench_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18, AG19, AG20, QO25: three rollups of the benchmark by grouping sets: one scan, one shuffle."""
    _bench(spark, sf_dir).createOrReplaceTempView("bench_runs")
    return spark.sql(
        "select model, db, ord, count(*) runs, round(avg(value), 6) avg_value, round(avg(case when value > 20 then value end), 6) avg_large, count_if(failed) errors from bench_runs group by grouping sets ((model), (db), (ord))"
    )


@query("ag_confidence_pivot", f"with {_BENCH} select ord, count(*) filter (conf = 'weak') weak, count(*) filter (conf = 'inconsistent') inconsistent, count(*) filter (conf = 'medium') medium, count(*) filter (conf = 'high') high from b group by ord")
def ag_confidence_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG20: confidence labels by question, pivoted."""
    labels = ["weak", "inconsistent", "medium", "high"]
    return _bench(spark, sf_dir).groupBy("ord").pivot("conf", labels).count().na.fill(0, labels)


@query("jn_config_product", "select m.model, d.db from (select distinct event_type model from events) m, (select distinct cast(user_id % 5 as int) db from events) d")
def jn_config_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN22: every model with every corpus; both sides are configuration, a few rows each."""
    b = _bench(spark, sf_dir)
    return b.select("model").distinct().crossJoin(b.select("db").distinct())
