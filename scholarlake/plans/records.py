"""Queries on records as they are delivered, on state that sessions keep, and on what is handed to a model."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import answers as A
from scholarlake.plans.relational import current_papers
from scholarlake.plans.retrieval import _RUN, asked_run
from scholarlake.plans.texts import _COLL, _NORM, _STOP, _STRIP, _questions
from scholarlake.sources import files, records
from scholarlake.sources.catalog import Catalog, Corpus
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


# ---- records as delivered: the tables written out as JSON lines, with lines that can't be read among them, and read again


def _inverted(texts: pd.Series) -> pd.Series:
    """Word -> places: how texts are delivered."""
    out = []
    for t in texts:
        places: dict[str, list[int]] = {}
        for i, w in enumerate(re.split(" +", (t or "").strip(" "))):
            places.setdefault(w, []).append(i)
        out.append(places)
    return pd.Series(out, index=texts.index, dtype=object)


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "normalized_works")
    index = F.pandas_udf(_inverted, "map<string,array<int>>")("abstract")
    person = lambda a: F.struct(
        a["position"].alias("author_position"), a["is_corresponding"].alias("is_corresponding"), F.struct(F.concat(F.lit("https://x.org/"), a["id"]).alias("id"), a["name"].alias("display_name")).alias("author"),
        F.when(a["is_su"], F.array(F.struct(F.lit("https://x.org/I7").alias("id")))).alias("institutions"),
    )
    raw = F.to_json(F.struct(
        F.concat(F.lit("https://x.org/"), "openalex_id").alias("id"), "doi", F.concat(F.lit("<i>"), "title", F.lit("</i>")).alias("title"), F.col("work_type").alias("type"), "publication_date", "publication_year", "cited_by_count", F.when(F.trim("abstract") != "", index).alias("abstract_inverted_index"),
        F.transform("all_authors", person).alias("authorships"), "referenced_works", F.transform("keywords", lambda k: F.struct(k.alias("display_name"))).alias("keywords"), "updated_date",
    ))
    return w.select(F.explode(F.array(raw, F.concat(F.lit('{"id": "'), "openalex_id", F.lit('", "title": {')), F.lit("  "))).alias("value"))


@query(
    "sc_read_works",
    f"""with w as (select openalex_id, arg_max(struct_pack(title := title, abstract := abstract, a := all_authors, k := keywords, n := cited_by_count), coalesce(updated_date, '')) x from normalized_works where trim(title) <> '' group by openalex_id),
    p as (select openalex_id, x, list_filter(list_transform(x.a, lambda a: trim(a.name)), lambda n: n <> '') names, list_filter(list_filter(x.a, lambda a: trim(a.name) <> ''), lambda a: a.is_su) own from w)
    select openalex_id, trim(x.title) title, coalesce(array_to_string(list_filter(string_split_regex(trim(x.abstract), ' +'), lambda t: t <> ''), ' '), '') abstract, cast(len(own) as int) n_own, coalesce(trim(own[1].name), names[1], '') primary_researcher,
      array_to_string(names[:10], ', ') || case when len(names) > 10 then ' et al. (' || len(names) || ' authors)' else '' end authors_str, list_filter(list_transform(x.k, lambda k: trim(k)), lambda k, i: k <> '' and list_position(list_transform(x.k, lambda y: trim(y)), k) = i) keywords, coalesce(x.n, 0) cited from p""",
)
def sc_read_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2, SC5, SC18, PF1, PF2, PF3, PF4, PF6: works written out as nested JSON lines with corrupt and blank lines among them, read, normalised, and the latest kept."""
    good, _ = records.parsed_records(_raw_lines(spark, sf_dir), records.RAW_WORK)
    n = records.normalized_works(good, "I7")
    return n.select("openalex_id", "title", "abstract", F.size("su_researchers").alias("n_own"), "primary_researcher", "authors_str", "keywords", F.col("cited_by_count").alias("cited"))


@query("sc_corrupt_lines", "select 3 * count(*) - count(*) n_lines, count(*) filter (title is not null) readable, count(*) + count(*) filter (title is null) corrupt from normalized_works")
def sc_corrupt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5: how many lines there are without the blank ones, how many state a title, and how many can't be read or state none."""
    good, bad = records.parsed_records(_raw_lines(spark, sf_dir), records.RAW_WORK)
    a = good.agg(F.count_if(F.col("title").isNotNull()).alias("readable"), F.count_if(F.col("title").isNull()).alias("bare"))
    return a.crossJoin(bad.agg(F.count("*").alias("bad"))).select((F.col("readable") + F.col("bare") + F.col("bad")).alias("n_lines"), "readable", (F.col("bad") + F.col("bare")).alias("corrupt"))  # one row each


@query(
    "sc_read_authors",
    """with a as (select a.id id, min(a.name) n, count(distinct openalex_id) works, sum(coalesce(cited_by_count, 0)) cited from (select openalex_id, cited_by_count, unnest(all_authors) a from normalized_works) where trim(a.id) <> '' and trim(a.name) <> '' group by a.id)
    select string_split(id, '/')[-1] author_id, trim(n) name, cast(works as int) works_count, cast(cited as int) cited_by_count, case when works > 1 then [n] else [] end alternatives from a""",
)
def sc_read_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, PF7: authors rolled up from the works, written out as JSON lines and read into their schema."""
    w = table(spark, sf_dir, "normalized_works").select("openalex_id", "cited_by_count", F.explode("all_authors").alias("a")).where("trim(a.id) <> '' and trim(a.name) <> ''")
    rolled = w.groupBy(F.col("a.id").alias("id")).agg(F.min("a.name").alias("display_name"), F.count_distinct("openalex_id").cast("int").alias("works_count"), F.sum(F.coalesce("cited_by_count", F.lit(0))).cast("int").alias("cited_by_count"))
    lines = rolled.select(F.to_json(F.struct(F.concat(F.lit("https://x.org/"), "id").alias("id"), "display_name", F.array(F.when(F.col("works_count") > 1, F.col("display_name")), F.lit(" ")).alias("display_name_alternatives"), "works_count", "cited_by_count")).alias("value"))
    good, _ = records.parsed_records(lines, records.RAW_AUTHOR)
    return records.normalized_authors(good).select("author_id", "name", "works_count", "cited_by_count", "alternatives")


@query(
    "sc_acquisition",
    """with w as (select openalex_id, updated_date, doi, abstract, title from normalized_works)
    select openalex_id, updated_date, case when length(abstract) > 200 then 'structured' when length(title || ' ' || abstract) > 200 then 'open_pdf' when length(repeat(coalesce(doi, ''), 9)) > 200 then 'doi' else 'none' end status,
      length(case when length(abstract) > 200 then abstract when length(title || ' ' || abstract) > 200 then title || ' ' || abstract when length(repeat(coalesce(doi, ''), 9)) > 200 then repeat(doi, 9) end) n_chars from w""",
)
def sc_acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10, SC12, SC17, SC20: the first strategy that gives a text long enough, with its status."""
    w = table(spark, sf_dir, "normalized_works").select("openalex_id", "updated_date", "doi", "abstract", "title")
    got = files.acquired(w, {"structured": F.col("abstract"), "open_pdf": F.concat("title", F.lit(" "), "abstract"), "doi": F.repeat(F.coalesce("doi", F.lit("")), 9)})
    return got.select("openalex_id", "updated_date", F.col("fulltext_status").alias("status"), F.length("fulltext").alias("n_chars"))


@query(
    "sc_pdf_links",
    """with w as (select openalex_id, updated_date, doi, list_transform(referenced_works, lambda r: case when ends_with(r, '7') then '' else 'https://x.org/' || r || '.pdf' end) links from normalized_works)
    select openalex_id, updated_date, coalesce(case when doi <> '' then doi end, list_filter(links, lambda l: l <> '')[1]) link, starts_with(coalesce(doi, ''), '%PDF') pdf from w""",
)
def sc_pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC13, SC14: the link of the best location, else the first of the others that has one; whether bytes begin as a PDF does."""
    other = F.transform("referenced_works", lambda r: F.struct(F.when(F.endswith(r, F.lit("7")), "").otherwise(F.concat(F.lit("https://x.org/"), r, F.lit(".pdf"))).alias("url")))
    w = table(spark, sf_dir, "normalized_works").select("openalex_id", "updated_date", F.struct(F.col("doi").alias("url")).alias("best"), other.alias("locations"), F.coalesce("doi", F.lit("")).cast("binary").alias("content"))
    return w.select("openalex_id", "updated_date", files.best_pdf_link(F.col("best"), F.col("locations")).alias("link"), files.is_pdf(F.col("content")).alias("pdf"))


_META = ["work_id", "chunk_type", "researcher", "year", "topic", "doi", "title", "work_type", "fulltext_status", "docling_status"]
_DROPPED = {"chunk_id", "path", "url", "chunk"}


@query(
    "pf_metadata_values",
    " union all ".join(f"""select chunk_id, '{c}' key, trim(coalesce({c}, '')) "value" from (select distinct * from chunks)""" for c in _META if not c.endswith("_id")),
)
def pf_metadata_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC29, PF19: what a metadata store takes of each chunk: no nulls, text trimmed, keys that only identify left out but for the paper's."""
    keys = [c for c in _META if c not in _DROPPED and (not c.endswith("_id") or c == "paper_id")]
    cells = F.array(*(F.struct(F.lit(c).alias("key"), files.metadata_value(F.col(c)).alias("value")) for c in keys))
    return table(spark, sf_dir, "chunks").distinct().select("chunk_id", F.explode(cells).alias("c")).select("chunk_id", "c.key", "c.value")


@query("sc_catalog", " union all ".join(f"select 'Chunks' corpus, '{t}' tbl, count(*) > 0 healthy, cast(count(*) as bigint) n from {t}" for t in ("chunks", "normalized_works")) + " union all select 'Papers', 'papers', count(*) > 0, count(*) from papers")
def sc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6, SC40, SC41, AG30: the registered corpora with their tables, whether each is there and holds a row, and how many."""
    known = Catalog([Corpus("Chunks", sf_dir, ("chunks", "normalized_works")), Corpus("Papers", sf_dir, ("papers",))])
    out = None
    for name in ("chunks", "PAPERS"):
        c = known.resolve(name)
        for t, healthy in known.health(spark, name).items():
            row = table(spark, sf_dir, t).agg(F.lit(c.name).alias("corpus"), F.lit(t).alias("tbl"), F.lit(healthy).alias("healthy"), F.count("*").alias("n"))
            out = row if out is None else out.unionByName(row)
    return out


@query("gr_unique_keys", "select 'Work' label, count(distinct openalex_id) keys, count(distinct openalex_id) - count(distinct openalex_id) repeated from normalized_works where openalex_id is not null union all select 'Author', count(distinct a.id), 0 from (select unnest(all_authors) a from normalized_works) where a.id <> '' union all select 'Topic', count(distinct t.id), 0 from (select unnest(topics) t from normalized_works) where t.id <> ''")
def gr_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC31, SC32: the constraint of the graph's nodes as a query: keys of each label, and how many come more than once."""
    from scholarlake.plans.retrieval import gr_nodes

    once = gr_nodes(spark, sf_dir).groupBy("label", "oid").agg(F.count("*").alias("n"))
    return once.groupBy("label").agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"))


# ---- sessions


_TURN = "s as (select source session, max(doc_id) last_turn, count(*) turns, arg_max_null(text, doc_id) last_text from documents where source is not null group by source)"


@query(
    "sm_session_store",
    f"""with {_TURN}, old as (select session, 'before ' || session summary, turns from s where turns % 2 = 0), new as (select session, case when last_turn % 3 = 0 then '' else {_COLL("coalesce(last_text, '')")}[:80] end summary, turns from s where turns % 5 <> 0),
    m as (select coalesce(o.session, n.session) session, case when trim(n.summary) <> '' then n.summary else o.summary end summary, coalesce(n.turns, o.turns) turns from old o full join new n using (session)) select session, coalesce(summary, '') summary, turns from m where session not in (select session from s where turns % 7 = 0)""",
)
def sm_session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC34, SC35, SC36, SM15: what sessions keep, written over by a newer state (a blank summary keeps what stood), some deleted, the rest read with defaults."""
    d = table(spark, sf_dir, "documents").where("source is not null")
    s = d.groupBy(F.col("source").alias("session")).agg(F.max("doc_id").alias("last_turn"), F.count("*").alias("turns"), F.max_by("text", "doc_id").alias("last_text"))
    old = s.where("turns % 2 = 0").select("session", F.concat(F.lit("before "), "session").alias("summary"), "turns")
    told = F.when(F.col("last_turn") % 3 == 0, "").otherwise(F.substring(T.collapse(F.coalesce("last_text", F.lit(""))), 1, 80))
    new = s.where("turns % 5 <> 0").select("session", told.alias("summary"), "turns")
    kept = files.without_keys(files.upserted(old, new, "session", ("summary",)), s.where("turns % 7 = 0"), "session")
    return kept.select("session", F.coalesce("summary", F.lit("")).alias("summary"), "turns")


@query(
    "sm_job_order",
    """with j as (select source session, doc_id turn, unnest(['append', 'memory', 'summary']) job, unnest([1, 2, 3]) o from documents where source is not null and doc_kind = 'qa_pair'), q as (select *, row_number() over (partition by session order by turn, o) place from j qualify place <= 2000)
    select session, turn, job, cast(place as int) place from q where session not in (select source from documents where source is not null group by source having count(*) % 4 = 0)""",
)
def sm_job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM3, SM4, SM5: the jobs of each session in the order they are done, the queue of a session bounded at 2,000, the jobs of drained sessions gone."""
    d = table(spark, sf_dir, "documents").where("source is not null")
    jobs = F.array(*(F.struct(F.lit(i).alias("o"), F.lit(n).alias("job")) for i, n in enumerate(("append", "memory", "summary"))))
    j = d.where("doc_kind = 'qa_pair'").select(F.col("source").alias("session"), F.col("doc_id").alias("turn"), F.explode(jobs).alias("j"))
    q = j.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("turn", "j.o"))).where("place <= 2000")
    drained = d.groupBy(F.col("source").alias("session")).agg(F.count("*").alias("n")).where("n % 4 = 0")
    return q.join(drained, "session", "left_anti").select("session", "turn", "j.job", "place")


@query(
    "fn_anchor_checks",
    f"""with r as (select id, {_COLL("coalesce(primary_topic, '')")} v, work_title, info, try_cast(json_extract_string(topics_json, '$[0].score') as double) score from research_info), a as (select *, greatest(0, least(1, coalesce(score, 0))) conf, list_filter(regexp_extract_all(lower(v), '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1), lambda t: length(t) >= 3) toks, regexp_extract_all({_NORM("coalesce(work_title, '') || ' ' || coalesce(info, '')")}, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1) said from r where v <> '' and lower(v) not in ('n/a', 'unknown', 'none', 'null'))
    select id, v "value", 'metadata' "type", 'retrieval' source, round(conf, 6) confidence, conf >= 0.72 stable, contains({_NORM("coalesce(work_title, '') || ' ' || coalesce(info, '')")}, lower(v)) or len(toks) >= 2 and len(list_filter(toks, lambda t: not list_contains(said, t))) = 0 in_text from a""",
)
def fn_anchor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN16, FN17, FN18, FN67: each record's topic as an anchor: defaults, confidence held within 0 and 1, whether it is stable and whether the record's text names it."""
    score = F.get(F.from_json("topics_json", "array<struct<topic:string,score:double>>"), F.lit(0))["score"]
    r = table(spark, sf_dir, "research_info").select("id", T.collapse(F.coalesce("primary_topic", F.lit(""))).alias("value"), T.norm(F.concat_ws(" ", F.coalesce("work_title", F.lit("")), F.coalesce("info", F.lit("")))).alias("said"), score.alias("score"))
    r = r.where("value <> '' and lower(value) not in ('n/a', 'unknown', 'none', 'null')")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))))
    toks = F.filter(T.words(F.col("value")), lambda t: F.length(t) >= 3)
    named = F.contains("said", F.lower("value")) | ((F.size(toks) >= 2) & (F.size(F.array_except(toks, T.words(F.col("said")))) == 0))
    return r.select("id", "value", F.lit("metadata").alias("type"), F.lit("retrieval").alias("source"), F.round(conf, 6).alias("confidence"), (conf >= 0.72).alias("stable"), named.alias("in_text"))


# ---- evidence


@query(
    "ag_entity_votes",
    f"""with p as (select paper_id, id, unnest(string_split(info, ' | ')) v, unnest(generate_series(1, len(string_split(info, ' | ')))) k from research_info where paper_id is not null and info is not null), n as (select *, {_NORM('v')} key from p where trim(v) <> '')
    select paper_id, key, arg_min(trim(v), id * 1000 + k) display, count(*) votes from n group by paper_id, key having count(*) >= 2""",
)
def ag_entity_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: what two or more records of a paper say, whatever its case, as it was first written; pre-aggregated before the shuffle."""
    r = table(spark, sf_dir, "research_info").where("paper_id is not null and info is not null")
    p = r.select("paper_id", "id", F.posexplode(F.split("info", r" \| ")).alias("k", "v")).where("trim(v) <> ''")
    return p.groupBy("paper_id", T.norm(F.col("v")).alias("key")).agg(F.min_by(F.trim("v"), F.struct("id", "k")).alias("display"), F.count("*").alias("votes")).where("votes >= 2")


@query(
    "ag_title_ambiguity",
    f"""with {_RUN}, t as (select researcher, count(*) docs, count(distinct case when length(trim(topic)) > 3 and lower(trim(topic)) not in ('unknown', 'n/a', 'other') then lower(trim(topic)) end) topics from run group by researcher),
    w as (select researcher, unnest(regexp_extract_all(lower(coalesce(title, '')), '([a-z]{{5,}})', 1)) word from run where pos <= 12), c as (select researcher, word, count(*) n from w where not list_contains([{_STOP}], word) group by all), f as (select researcher, max(n) top, count(*) filter (n >= 2) repeated from c group by researcher)
    select researcher, docs, topics, coalesce(top, 0) top, coalesce(repeated, 0) repeated, topics > 2 or coalesce(top, 0) <= 2 and coalesce(repeated, 0) <= 1 and docs > 4 ambiguous from t left join f using (researcher)""",
)
def ag_title_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22: whether what is found for a name seems to be of several people: many topics, or no word that the first twelve titles share."""
    run = asked_run(spark, sf_dir)
    topic = F.lower(F.trim("topic"))
    t = run.groupBy("researcher").agg(F.count("*").alias("docs"), F.count_distinct(F.when((F.length(topic) > 3) & ~topic.isin("unknown", "n/a", "other"), topic)).alias("topics"))
    w = run.where("pos <= 12").select("researcher", F.explode(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("([a-z]{5,})"), F.lit(1))).alias("word")).where(~F.col("word").isin(T.STOPWORDS))
    f = w.groupBy("researcher", "word").agg(F.count("*").alias("n")).groupBy("researcher").agg(F.max("n").alias("top"), F.count_if(F.col("n") >= 2).alias("repeated"))
    j = t.join(f, "researcher", "left").withColumns({"top": F.coalesce("top", F.lit(0)), "repeated": F.coalesce("repeated", F.lit(0))})
    return j.withColumn("ambiguous", (F.col("topics") > 2) | ((F.col("top") <= 2) & (F.col("repeated") <= 1) & (F.col("docs") > 4)))


@query(
    "fn_evidence_context",
    f"""with {_RUN}, c as (select researcher, pos, 'topic:' || {_COLL('topic')} part from run where pos <= 18 and len(list_filter(regexp_extract_all({_NORM('topic')}, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1), lambda t: length(t) >= 3 and not list_contains([{_STOP}], t))) >= 2)
    select researcher, 'researcher:' || researcher || coalesce(' | ' || string_agg(part, ' | ' order by pos), '') context from (select distinct researcher from run) left join c using (researcher) group by researcher""",
)
def fn_evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN84: researcher and topics of the first eighteen chunks as one line of context."""
    run = asked_run(spark, sf_dir)
    telling = F.filter(T.words(F.col("topic")), lambda t: (F.length(t) >= 3) & ~t.isin(T.STOPWORDS))
    part = F.when((F.col("pos") <= 18) & (F.size(telling) >= 2), F.struct("pos", F.concat(F.lit("topic:"), T.collapse(F.col("topic"))).alias("part")))
    g = run.groupBy("researcher").agg(F.array_sort(F.collect_list(part)).alias("ps"))  # eighteen at most
    return g.select("researcher", F.concat_ws(" | ", F.concat(F.lit("researcher:"), "researcher"), F.array_join(F.transform("ps", lambda x: x["part"]), " | ")).alias("context")).select("researcher", F.regexp_replace("context", r" \| $", "").alias("context"))


@query(
    "qo_compact_context",
    f"""with {_RUN}, l as (select researcher, pos, concat_ws(chr(10), 'title: ' || coalesce(regexp_replace(title, '</?[a-zA-Z][^>]*>', '', 'g'), ''), 'researcher: ' || researcher, 'year: ' || coalesce("year", ''), case when trim(topic) <> '' then 'primary_topic: ' || topic end, 'snippet: ' || {_COLL('"text"[:160]')}) block from run where pos <= 16)
    select researcher, '--- Papers by ' || researcher || ' ---' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) order by pos) context from l group by researcher""",
)
def qo_compact_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO14, TK7: a researcher's first sixteen chunks as labelled lines under a heading."""
    lines = [
        F.concat(F.lit("title: "), F.coalesce(T.without_tags(F.col("title")), F.lit(""))), F.concat(F.lit("researcher: "), "researcher"), F.concat(F.lit("year: "), F.coalesce("year", F.lit(""))),
        F.when(F.trim("topic") != "", F.concat(F.lit("primary_topic: "), "topic")), F.concat(F.lit("snippet: "), T.collapse(F.substring("text", 1, 160))),
    ]
    blocks = asked_run(spark, sf_dir).where("pos <= 16").select("researcher", F.struct("pos", F.concat_ws("\n", *lines).alias("block")).alias("b"))
    g = blocks.groupBy("researcher").agg(F.array_sort(F.collect_list("b")).alias("bs"))  # sixteen at most
    return g.select("researcher", F.concat(F.lit("--- Papers by "), "researcher", F.lit(" ---\n\n"), F.array_join(F.transform("bs", lambda x: x["block"]), "\n\n")).alias("context"))


_POLICY = "Answer from the context only."


@query(
    "qo_prompts",
    f"""with q as (select doc_id, regexp_extract(text, '^Q: ([^\\n]*)', 1) question, coalesce(regexp_extract(text, 'A: (.*)', 1), '') ctx from documents where doc_kind = 'qa_pair' and text is not null)
    select doc_id, 'ANSWER POLICY:' || chr(10) || '{_POLICY}' || chr(30) || case when trim(ctx) <> '' then 'RETRIEVED CONTEXT:' || chr(10) || trim(ctx) || chr(10) || chr(10) else '' end || 'QUESTION: ' || question prompt from q""",
)
def qo_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO12: what a model is handed for each question: policy, context where there is any, the question; system and user kept apart by a separator."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'qa_pair' and text is not null").select("doc_id", F.regexp_extract("text", r"^Q: ([^\n]*)", 1).alias("question"), F.trim(F.coalesce(F.regexp_extract("text", "A: (.*)", 1), F.lit(""))).alias("ctx"))
    context = F.when(F.col("ctx") != "", F.concat(F.lit("RETRIEVED CONTEXT:\n"), "ctx", F.lit("\n\n"))).otherwise("")
    return d.select("doc_id", F.concat(F.lit(f"ANSWER POLICY:\n{_POLICY}\x1e"), context, F.lit("QUESTION: "), "question").alias("prompt"))


# By memory pressure the scales of the budgets for memory, papers and the trigger, and their least.
_SCALES = [(0, 1.0, 1.0, 1.0, 0, 0, 0), (1, 0.9, 0.92, 0.97, 450, 2000, 4200), (2, 0.78, 0.84, 0.92, 350, 1600, 3500), (3, 0.65, 0.7, 0.88, 300, 1200, 3000)]


@query(
    "qo_budgets",
    f"""with c as (select unnest([0, 2048, 8192, 131072, 200000]) ctx), r as (select unnest([0, 256, 9000]) reserve), s(pressure, sm, sp, st, lm, lp, lt) as (values {", ".join(map(str, _SCALES))})
    select pressure, ctx, reserve, cast(greatest(256, case when ctx <= 0 or ctx > 131072 then 8192 else ctx end - greatest(64, reserve + 24)) as int) prompt_tokens, cast(greatest(lm, floor(600 * sm::double)) as int) memory, cast(greatest(lp, floor(20000 * sp::double)) as int) papers from c, r, s""",
)
def qo_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO13, FN96, FN97: room for a prompt by a model's context and what is kept for its answer, and budgets by memory pressure; a table of configurations."""
    s = spark.createDataFrame(_SCALES, "pressure int, sm double, sp double, st double, lm int, lp int, lt int")
    grid = s.withColumn("ctx", F.explode(F.array(*map(F.lit, (0, 2048, 8192, 131072, 200000))))).withColumn("reserve", F.explode(F.array(*map(F.lit, (0, 256, 9000)))))
    room = F.when((F.col("ctx") <= 0) | (F.col("ctx") > 131072), 8192).otherwise(F.col("ctx"))
    return grid.select("pressure", "ctx", "reserve", F.greatest(F.lit(256), room - F.greatest(F.lit(64), F.col("reserve") + 24)).alias("prompt_tokens"), F.greatest("lm", F.floor(600 * F.col("sm")).cast("int")).alias("memory"), F.greatest("lp", F.floor(20_000 * F.col("sp")).cast("int")).alias("papers"))


@query("pf_source_refs", f"with {_RUN} select researcher, pos, work_id paper_id, chunk_id chunk, coalesce(nullif(trim(title), ''), 'Untitled') title from run where pos <= 8")
def pf_source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF25: the sources an answer refers to, as paper, chunk and title."""
    return asked_run(spark, sf_dir).where("pos <= 8").select("researcher", "pos", F.col("work_id").alias("paper_id"), F.col("chunk_id").alias("chunk"), F.coalesce(T.blank_to_null(F.trim("title")), F.lit("Untitled")).alias("title"))


@query(
    "pf_token_prune",
    f"""with {_RUN}, q as (select researcher, [lower(regexp_extract(researcher, '([A-Za-z]+)$', 1)), 'sediment', 'survey'] toks from (select distinct researcher from run)), h as (select run.*, len(list_filter(toks, lambda t: t <> '' and contains(lower(coalesce(title, '') || ' ' || coalesce("text", '')), t))) > 0 hit from run join q using (researcher)), a as (select researcher, bool_or(hit) some_hit from h group by researcher)
    select researcher, chunk_id, hit from h join a using (researcher) where hit or not some_hit""",
)
def pf_token_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF22, FN9: of what is found for up to four words only the chunks that hold one of them; all of it where none does."""
    run = asked_run(spark, sf_dir)
    toks = F.array(F.lower(F.regexp_extract("researcher", "([A-Za-z]+)$", 1)), F.lit("sediment"), F.lit("survey"))
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    h = run.select("researcher", "chunk_id", F.exists(toks, lambda t: (t != "") & F.contains(hay, t)).alias("hit"))
    some = h.groupBy("researcher").agg(F.bool_or("hit").alias("some_hit"))
    return h.join(some, "researcher").where("hit or not some_hit").select("researcher", "chunk_id", "hit")


# ---- small functions on text


@query("fn_term_split", """select id, list_filter(list_transform(regexp_split_to_array(info, '[,;\\n|]'), lambda t: lower(trim(t))), lambda t: t <> '') terms from research_info where info is not null""")
def fn_term_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN14: terms between commas, semicolons, line ends and bars, in small letters."""
    return table(spark, sf_dir, "research_info").where("info is not null").select("id", F.filter(F.transform(F.split("info", r"[,;\n|]"), lambda t: F.lower(F.trim(t))), lambda t: t != "").alias("terms"))


@query(
    "fn_graph_authors",
    """with a as (select id, list_filter(list_transform(regexp_split_to_array(authors, '[;,|]| and '), lambda n: trim(n)), lambda n: n <> '') ns from research_info where authors is not null)
    select id, list_filter(ns, lambda n, i: list_position(list_transform(ns, lambda x: lower(x)), lower(n)) = i)[:25] names from a""",
)
def fn_graph_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN28: authors as the graph takes them: split at bars too, each once whatever its case, twenty-five at most."""
    a = table(spark, sf_dir, "research_info").where("authors is not null").select("id", F.filter(F.transform(F.split("authors", "[;,|]| and "), lambda n: F.trim(n)), lambda n: n != "").alias("ns"))
    a = a.withColumn("low", F.transform("ns", lambda n: F.lower(n)))
    return a.select("id", F.slice(F.filter("ns", lambda n, i: F.array_position(F.col("low"), F.lower(n)) == i + 1), 1, 25).alias("names"))


_LEAK = "^[ \\t]*(?:papers[ \\t]*:|paper context[ \\t]*:|question[ \\t]*:|system[ \\t]*:|user[ \\t]*:|assistant[ \\t]*:|\\[paper|\\[mem|\\[recent|\\[summary|q[ \\t]*:)"


@query(
    "fn_leak_strip",
    f"""with d as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: not regexp_matches(lower(l), '{_LEAK}')) ls from documents where doc_kind in ('qa_pair', 'answer') and text is not null)
    select doc_id, {_STRIP("regexp_replace(array_to_string(ls, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} said from d""",
)
def fn_leak_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN22, FN93: answers without lines that belong to the prompt, runs of blank lines made one."""
    d = table(spark, sf_dir, "documents").where("doc_kind in ('qa_pair', 'answer') and text is not null")
    ls = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: ~F.lower(x).rlike(_LEAK))
    return d.select("doc_id", T.strip(F.regexp_replace(F.array_join(ls, "\n"), r"\n{3,}", "\n\n")).alias("said"))


_UNLABEL = lambda c: f"regexp_replace(regexp_replace(regexp_replace({c}, '{A.LABEL}', ''), '{A.LABEL}', ''), '{A.LABEL}', '')"


@query(
    "fn_clip_turns",
    f"""with d as (select doc_id, {_COLL(_UNLABEL("array_to_string(list_filter(string_split(text, chr(10)), lambda l: not contains(lower(l), 'confidence level') and not contains(lower(l), 'let me know if you need')), ' ')"))} t from documents where doc_kind = 'answer' and trim(text) <> ''),
    s as (select doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') ss from d), h as (select doc_id, case when len(ss) > 0 then array_to_string(ss[:2], ' ') else t end head from s)
    select doc_id, case when length(head) > 360 then rtrim(head[:360], ' ') || '...' else head end clipped from h""",
)
def fn_clip_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN87, FN91, FN92: answers as a later prompt repeats them: no labels or closing lines, two sentences, 360 characters."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'answer' and trim(text) <> ''")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.contains(F.lower(x), F.lit("confidence level")) & ~F.contains(F.lower(x), F.lit("let me know if you need")))
    t = F.array_join(kept, " ")
    for _ in range(3):
        t = F.regexp_replace(t, A.LABEL, "")
    return d.select("doc_id", T.collapse(t).alias("t")).select("doc_id", A.clipped(F.col("t"), T.sentences(F.col("t")), 2, 360).alias("clipped"))


@query("fn_tidy_answers")
def fn_tidy_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN85, FN86, FN88, FN89: answers fit to be shown, with repetitions told by the ratio of matching blocks; no SQL has that, so it is held to cases worked by hand."""
    return A.tidied_answers(table(spark, sf_dir, "documents").where("doc_kind = 'answer' and text is not null"), "doc_id", "text")


@query("fn_checked_citations")
def fn_checked_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO17, JN21, FN86, FN95: answers without the lines that cite what no title of their paper is like; held to cases worked by hand."""
    titles = current_papers(spark, sf_dir).where("trim(title) <> ''").select("paper_id", F.array("title").alias("titles"))
    a = table(spark, sf_dir, "documents").where("doc_kind in ('answer', 'qa_pair') and text is not null").select("doc_id", "paper_id", "text").join(titles, "paper_id", "left")
    return A.checked_citations(a, "doc_id", "text", "titles")


@query(
    "fn_question_kinds",
    f"""with q as (select doc_id, coalesce(lower(regexp_extract(text, '^Q: ([^\\n]*)', 1)), '') q from documents where doc_kind = 'qa_pair')
    select doc_id, regexp_matches(q, '{T.RESET_COMMAND.replace("'", "''")}') command, regexp_matches(q, '{T.SUMMARY_QUESTION}') summary, regexp_matches(q, '{T.ESCAPE_QUESTION}') escapes from q""",
)
def fn_question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF32, PF33, PF34: whether a question is a command, asks for a summary, or leaves whoever was spoken of."""
    q = F.col("question")
    return _questions(spark, sf_dir).select("doc_id", T.meta_command(q).alias("command"), T.summary_intent(q).alias("summary"), T.anchor_escape(q).alias("escapes"))


@query(
    "fn_extra_state",
    """with s as (select source session, max(doc_id) m, count(*) n from documents where source is not null group by source) select session, 'f' || n last_focus, '' last_topic, n % 2 = 0 summary_updated, case when n % 3 = 0 then 0 else round(n / 7::double, 4) end anchor_support_ratio, greatest(0, least(1, n / 10::double)) anchor_confidence from s""",
)
def fn_extra_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN68: what a session keeps besides its turns, packed as JSON with keys it mustn't have and a ratio that may be no number, read back through the list of allowed keys with types and defaults."""
    s = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("session")).agg(F.count("*").alias("n"))
    ratio = F.when(F.col("n") % 3 == 0, "none").otherwise(F.round(F.col("n") / 7, 4).cast("string"))
    packed = F.to_json(F.struct(F.concat(F.lit("f"), "n").alias("last_focus"), F.lit("x").alias("not_allowed"), (F.col("n") % 2 == 0).alias("summary_updated"), ratio.alias("anchor_support_ratio"), F.struct((F.col("n") / 10).alias("confidence")).alias("anchor")))
    allowed = "last_focus string, last_topic string, summary_updated boolean, anchor_support_ratio string, anchor struct<confidence:double>"
    r = s.select("session", F.from_json(packed, allowed).alias("x"))
    return r.select(
        "session", F.coalesce("x.last_focus", F.lit("")).alias("last_focus"), F.coalesce("x.last_topic", F.lit("")).alias("last_topic"), F.coalesce("x.summary_updated", F.lit(False)).alias("summary_updated"),
        F.coalesce(F.expr("try_cast(x.anchor_support_ratio as double)"), F.lit(0.0)).alias("anchor_support_ratio"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("x.anchor.confidence", F.lit(0.0)))).alias("anchor_confidence"),
    )


@query(
    "sc_preprint_feed",
    """with f as (select paper_id, ingested_at, '<entry><id>' || arxiv_id || '</id><title> ' || title || chr(10) || ' </title><published>' || coalesce(regexp_extract(publication_date, '((?:19|20)[0-9]{2})', 1), '') || '-01-01</published></entry>' feed from papers where trim(arxiv_id) <> '' and title is not null)
    select paper_id, ingested_at, trim(regexp_replace(regexp_extract(feed, '(?s)<title>(.*?)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g')) title, regexp_extract(feed, '<published>([0-9]{4})', 1) "year" from f""",
)
def sc_preprint_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC43: title and year read from the feed a preprint server gives; the stand-in writes the feed from the papers."""
    p = table(spark, sf_dir, "papers").where("trim(arxiv_id) <> '' and title is not null")
    year = F.coalesce(F.regexp_extract("publication_date", "((?:19|20)[0-9]{2})", 1), F.lit(""))
    feed = F.concat(F.lit("<entry><id>"), "arxiv_id", F.lit("</id><title> "), "title", F.lit("\n </title><published>"), year, F.lit("-01-01</published></entry>"))
    f = p.select("paper_id", "ingested_at", feed.alias("feed"))
    return f.select("paper_id", "ingested_at", F.trim(F.regexp_replace(F.regexp_extract("feed", "(?s)<title>(.*?)</title>", 1), r"[ \t\r\n]+", " ")).alias("title"), F.regexp_extract("feed", "<published>([0-9]{4})", 1).alias("year"))
