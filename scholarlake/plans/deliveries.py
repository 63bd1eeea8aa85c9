"""Queries that write and read again: delivered tables, sections, results by run, and the steps of a whole build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.plans.texts import _COLL, _NORM
from scholarlake.sources import sinks
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


_ASCII = "not regexp_matches(coalesce(work_title, '') || coalesce(researcher_name, '') || coalesce(info, ''), '[\"\\\\\\r\\n]')"


@query(
    "sc_csv_files",
    f"""with r as (select id, trim(researcher_name) researcher_name, trim(work_title) work_title, trim(publication_date) publication_date, trim(info) info, case when id % 3 <> 0 then 'https://x.org/' || id || '.pdf' end pdf_url from research_info where {_ASCII})
    select researcher_name, work_title, nullif(publication_date, '') publication_date, pdf_url, nullif(concat_ws(' | ', case when info <> '' then info end, case when publication_date <> '' then 'Date: ' || publication_date end), '') info from r where pdf_url is not null and researcher_name <> '' and work_title <> ''""",
)
def sc_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, PF8, PF9, PF10: records written as comma-separated files under three sets of headers, one of them never delivered; read, united under one, filtered, with their labelled line."""
    clean = ~F.concat(F.coalesce("work_title", F.lit("")), F.coalesce("researcher_name", F.lit("")), F.coalesce("info", F.lit(""))).rlike('["\\\\\\r\\n]')
    r = table(spark, sf_dir, "research_info").where(clean).select("id", *(F.trim(c).alias(c) for c in ("researcher_name", "work_title", "publication_date", "info")), F.when(F.col("id") % 3 != 0, F.concat(F.lit("https://x.org/"), "id", F.lit(".pdf"))).alias("pdf_url"))
    folder = sinks.fresh_folder(spark, "tables")
    headers = [[" Researcher ", "TITLE", "Date", "PDF", "info"], ["Name", "Publication Title", "publication_date", "Pdf Link", "INFO"]]
    for i, h in enumerate(headers):
        part = r.where(F.pmod("id", F.lit(2)) == i).select("researcher_name", "work_title", "publication_date", "pdf_url", "info").toDF(*h)
        part.write.option("header", True).option("escape", '"').csv(f"{folder}/{i}")
    got = sinks.read_tables(spark, [f"{folder}/{i}" for i in range(3)])
    dated = F.when(F.trim("publication_date") != "", F.concat(F.lit("Date: "), "publication_date"))
    return got.withColumn("info", F.nullif(F.concat_ws(" | ", T.blank_to_null(F.col("info")), dated), F.lit("")))


@query(
    "sc_section_sink",
    f"""with s as (select id, case when summary_status = 'summarized' then 'summary' else 'text' end source, unnest(string_split(full_text, chr(10) || chr(10))) body, unnest(generate_series(0, len(string_split(full_text, chr(10) || chr(10))) - 1)) pos from works where trim(full_text) <> '')
    select id, source, cast(pos as int) pos, {_COLL('body')} body from s where length({_COLL('body')}) >= 30""",
)
def sc_section_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC15, SC22, FN99: the sections of full texts written as JSON by source, and read again."""
    w = table(spark, sf_dir, "works").where("trim(full_text) <> ''")
    s = w.select("id", F.when(F.col("summary_status") == "summarized", "summary").otherwise("text").alias("source"), F.posexplode(F.split("full_text", "\n\n")).alias("pos", "body"))
    path = sinks.fresh_folder(spark, "sections")
    sinks.write_sections(s.withColumn("body", T.collapse(F.col("body"))).where("length(body) >= 30"), path)
    return spark.read.schema("id long, pos int, body string, source string").json(path).select("id", "source", "pos", "body")


@query("sc_run_log", "select source, doc_kind, count(*) n, cast(count(*) filter (text is null) as bigint) failed from documents where source is not null group by all")
def sc_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC38, SC39: results appended run by run, an atomic write each, and read as one."""
    path = sinks.fresh_folder(spark, "runs")
    d = table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_kind", F.col("text").isNull().cast("int").alias("failed"))
    for run in (0, 1):
        sinks.append_results(d.where(F.pmod(F.hash("source"), F.lit(2)) == run).groupBy("source", "doc_kind").agg(F.count("*").alias("n"), F.sum("failed").alias("failed")), path)
    return spark.read.schema("source string, doc_kind string, n long, failed long").json(path)


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[], DataFrame] | None]]) -> DataFrame:
    """(step, status, n) of each step in order: ok with its rows, skipped where it is None, error where it fails; one that fails doesn't end the run."""
    rows = []
    for name, f in steps:
        if f is None:
            rows.append((name, "skipped", None))
            continue
        try:
            rows.append((name, "ok", f().count()))
        except Exception:  # noqa: BLE001  whatever a step dies of, the next one is tried
            rows.append((name, "error", None))
    return spark.createDataFrame(rows, "step string, status string, n long")


@query(
    "qo_pipeline",
    """select 'normalise' step, 'ok' status, count(distinct openalex_id) n from normalized_works where trim(title) <> '' union all select 'repair', 'ok', count(*) from research_info union all select 'summarise', 'skipped', null
    union all select 'fetch', 'error', null union all select 'audit', 'ok', 30""",
)
def qo_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO26, QO27: a whole build step by step, with one skipped by its flag and one that fails without ending the rest."""
    from scholarlake.plans import parsing, records, relational

    steps: list = [
        ("normalise", lambda: records.sc_read_works(spark, sf_dir)), ("repair", lambda: parsing.dm_fill_records(spark, sf_dir)), ("summarise", None),
        ("fetch", lambda: spark.read.parquet(f"{sf_dir}/no-such-table.parquet")), ("audit", lambda: relational.ag_audit(spark, sf_dir)),
    ]
    return run_steps(spark, steps)


@query(
    "qo_simple_ask",
    f"""with q as (select doc_id, regexp_extract(text, '^Q: ([^\\n]*)', 1) question, regexp_extract(text, '^Q: What does (.*) study in', 1) who from documents where doc_kind = 'qa_pair' and text is not null), c as (select researcher, title, row_number() over (partition by researcher order by coalesce(cited, 0) desc, chunk_id) k from (select chunk_id, any_value(researcher) researcher, any_value(title) title, any_value(cited_by_count) cited from chunks group by chunk_id) where researcher is not null)
    select doc_id, case when title is null then 'No context.' else {_NORM('title')} end answer from q left join (select * from c where k = 1) c on researcher = who""",
)
def qo_simple_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO22: a question, the best chunk of whom it names, an answer, without the guards of the whole pipeline."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'qa_pair' and text is not null").select("doc_id", F.regexp_extract("text", "^Q: What does (.*) study in", 1).alias("researcher"))
    c = table(spark, sf_dir, "chunks").where("researcher is not null").dropDuplicates(["chunk_id"])
    best = c.groupBy("researcher").agg(F.min_by(F.struct("title"), F.struct((-F.coalesce("cited_by_count", F.lit(0))).alias("c"), "chunk_id")).alias("x"))
    return d.join(best, "researcher", "left").select("doc_id", F.when(F.col("x.title").isNull(), F.lit("No context.")).otherwise(T.norm(F.col("x.title"))).alias("answer"))


@query(
    "fn_snippet_full",
    f"""with c as (select distinct chunk_id, text, title, su_researchers from chunks where text is not null), h as (select chunk_id, title, su_researchers, trim(regexp_replace(text, '(?is)^Paper[ \\t]+ID:[^\\n]*\\n(Researcher:[^\\n]*\\n)?(Title:[^\\n]*\\n)?(Authors:[^\\n]*\\n)?(DOI:[^\\n]*\\n)?', '')) r from c),
    t as (select chunk_id, su_researchers, case when trim(title) <> '' and starts_with(lower(r), lower(trim(title))) then ltrim(r[length(trim(title)) + 1:], ' ' || chr(10) || chr(9) || ':-|') else r end r from h), a as (select chunk_id, case when trim(su_researchers) <> '' and starts_with(lower(r), lower(trim(su_researchers))) then ltrim(r[length(trim(su_researchers)) + 1:], ' ' || chr(10) || chr(9) || ':-|') else r end r from t),
    f as (select chunk_id, case when length(regexp_replace(string_split(r, chr(10))[1], '[^,]', '', 'g')) >= 6 and length(string_split(r, chr(10))[1]) <= 240 then trim(regexp_replace(r, '^[^\\n]*\\n?', '')) else r end r from a)
    select chunk_id, {_COLL('r')} snippet from f""",
)
def fn_snippet_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN12: chunks without a labelled head, a leading title or leading authors, or a first line that is a list of names."""
    c = table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", "text", "title", "su_researchers").distinct()
    r = F.trim(F.regexp_replace("text", r"(?is)^Paper[ \t]+ID:[^\n]*\n(Researcher:[^\n]*\n)?(Title:[^\n]*\n)?(Authors:[^\n]*\n)?(DOI:[^\n]*\n)?", ""))
    without = lambda c, lead: F.when((F.trim(lead) != "") & F.startswith(F.lower(c), F.lower(F.trim(lead))), F.ltrim(c.substr(F.length(F.trim(lead)) + 1, F.length(c)), F.lit(" \n\t:-|"))).otherwise(c)
    c = c.withColumn("r", r).withColumn("r", without(F.col("r"), F.col("title"))).withColumn("r", without(F.col("r"), F.col("su_researchers")))
    line = F.get(F.split("r", "\n"), F.lit(0))
    listed = (F.length(F.regexp_replace(line, "[^,]", "")) >= 6) & (F.length(line) <= 240)
    return c.select("chunk_id", T.collapse(F.when(listed, F.trim(F.regexp_replace("r", r"^[^\n]*\n?", ""))).otherwise(F.col("r"))).alias("snippet"))


@query("fn_whole_words", "select id, regexp_matches(lower(work_title), '\\b' || w || '\\b') whole, contains(lower(work_title), w) anywhere, w word from (select id, work_title, lower(regexp_extract(primary_topic, '([A-Za-z]+)', 1)) w from research_info where work_title is not null and regexp_matches(primary_topic, '[A-Za-z]') and not regexp_matches(work_title, '[^\\x00-\\x7F]'))")
def fn_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN8: whether a title holds the first word of its topic as a word, and whether at all."""
    r = table(spark, sf_dir, "research_info").where(F.col("work_title").isNotNull() & F.col("primary_topic").rlike("[A-Za-z]") & ~F.col("work_title").rlike(r"[^\x00-\x7F]"))
    r = r.select("id", F.lower("work_title").alias("t"), F.lower(F.regexp_extract("primary_topic", "([A-Za-z]+)", 1)).alias("word"))
    return r.select("id", F.rlike(F.col("t"), F.concat(F.lit(r"\b"), "word", F.lit(r"\b"))).alias("whole"), F.contains("t", "word").alias("anywhere"), "word")
