"""Queries on questions and answers: what is named in them, how they are rewritten, fitted and tidied."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.plans.relational import _PAPERS, current_papers
from scholarlake.plans.retrieval import _RUN, asked_run
from scholarlake.plans.texts import _COLL, _NORM, _STRIP
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


@query(
    "fn_snippets",
    f"""with c as (select chunk_id, {_COLL("case when starts_with(text, title) and trim(title) <> '' then ltrim(text[length(title) + 1:], ' ' || chr(10) || chr(9) || ':-|') else text end")} s from chunks where text is not null)
    select chunk_id, case when length(s) <= 160 then s when {_STRIP("regexp_replace(s[:160], '(?s)[.][^.]*$', '')")} <> '' then {_STRIP("regexp_replace(s[:160], '(?s)[.][^.]*$', '')")} || '...' else rtrim(s[:160], ' ') || '...' end snippet from c""",
)
def fn_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN12, FN94: a short piece of each chunk without the title it begins with."""
    bare = F.when(F.startswith("text", "title") & (F.trim("title") != ""), F.ltrim(F.expr("substring(text, length(title) + 1)"), F.lit(" \n\t:-|"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", T.collapse(bare).alias("s")).select("chunk_id", T.truncated(F.col("s"), 160).alias("snippet"))


_SPAN = "([A-Z][a-z]+(?: [A-Z][a-z]+){1,3})"


@query(
    "fn_entities",
    f"""with d as (select doc_id, text from documents where text is not null), e as (select doc_id, regexp_extract_all(text, '{_SPAN}', 1) a, regexp_extract_all(text, '(?:^|[ (])([A-Z]{{2,6}}[0-9]*)(?:[ ,.;)]|$)', 1) k, regexp_extract_all(text, '[“"]([^”"]{{3,80}})[”"]', 1) q from d)
    select doc_id, list_filter(a, lambda x, i: list_position(a, x) = i)[:6] people, list_filter(k, lambda x, i: list_position(k, x) = i)[:6] acronyms, list_filter(q, lambda x, i: list_position(q, x) = i)[:6] quoted from e""",
)
def fn_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN69, FN71, FN72, FN75: capitalised spans, acronyms and quoted spans of texts, the first six of each."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    first = lambda pattern: F.slice(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))), 1, 6)
    return d.select("doc_id", first(_SPAN).alias("people"), first("(?:^|[ (])([A-Z]{2,6}[0-9]*)(?:[ ,.;)]|$)").alias("acronyms"), first('[“"]([^”"]{3,80})[”"]').alias("quoted"))


_ASKED = "q as (select doc_id, regexp_extract(text, '^Q: ([^\\n]*)', 1) question, regexp_extract(text, '^Q: What does (.*) study in', 1) who from documents where doc_kind = 'qa_pair' and text is not null)"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_kind = 'qa_pair' and text is not null")
    return d.select("doc_id", F.regexp_extract("text", r"^Q: ([^\n]*)", 1).alias("question"), F.regexp_extract("text", "^Q: What does (.*) study in", 1).alias("who"))


_ONE_PRONOUN = r"(?i)^(.*?)\b(he|she|they|him|her|them)\b(.*)$"


@query(
    "qo_rewrites",
    f"""with {_ASKED}, t as (select doc_id, who, replace(question, who, 'they') loose from q where who <> '')
    select doc_id, (case when regexp_matches(loose, '{_ONE_PRONOUN}') then regexp_replace(loose, '{_ONE_PRONOUN}', '\\1' || who || '\\3') else rtrim(loose, '?') || ' for ' || who || '?' end)[:220] resolved from t""",
)
def qo_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN76: questions with a pronoun resolved to the anchor: the first pronoun only, else the anchor is appended; at most 220 characters."""
    t = _asked(spark, sf_dir).where("who <> ''").withColumn("loose", F.replace("question", "who", F.lit("they")))
    part = lambda k: F.regexp_extract("loose", _ONE_PRONOUN, k)
    said = F.when(F.col("loose").rlike(_ONE_PRONOUN), F.concat(part(1), "who", part(3))).otherwise(F.concat(F.rtrim("loose", F.lit("?")), F.lit(" for "), "who", F.lit("?")))
    return t.select("doc_id", F.substring(said, 1, 220).alias("resolved"))


@query(
    "fn_title_likeness",
    f"""with {_PAPERS}, t as (select r.id, regexp_replace({_NORM('r.work_title')}, '[^a-z0-9 ]', '', 'g') a, regexp_replace({_NORM('p.title')}, '[^a-z0-9 ]', '', 'g') b from research_info r join papers_now p using (paper_id) where trim(r.work_title) <> '' and trim(p.title) <> '')
    select id, cast(levenshtein(a, b) as int) distance, round(1 - levenshtein(a, b)::double / greatest(length(a), length(b)), 6) likeness from t where a <> '' and b <> ''""",
)
def fn_title_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN85: how like the title of a record is to that of its paper."""
    plain = lambda c: F.regexp_replace(T.norm(F.col(c)), "[^a-z0-9 ]", "")
    p = current_papers(spark, sf_dir).where("trim(title) <> ''").select("paper_id", "title")
    t = table(spark, sf_dir, "research_info").where("trim(work_title) <> ''").join(p, "paper_id").select("id", plain("work_title").alias("a"), plain("title").alias("b")).where("a <> '' and b <> ''")
    d = F.levenshtein("a", "b")
    return t.select("id", d.alias("distance"), F.round(1 - d / F.greatest(F.length("a"), F.length("b")), 6).alias("likeness"))


@query(
    "fn_display_paragraphs",
    f"""with s as (select doc_id, list_filter(string_split(regexp_replace({_STRIP('text')}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') ss from documents where doc_kind = 'answer' and trim(text) <> ''), n as (select doc_id, ss, unnest(generate_series(0, (len(ss) - 1) // 3)) k from s where len(ss) > 0)
    select doc_id, cast(k as int) k, array_to_string(ss[k * 3 + 1:k * 3 + 3], ' ') paragraph from n""",
)
def fn_display_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN90: answers in paragraphs of three sentences."""
    a = table(spark, sf_dir, "documents").where("doc_kind = 'answer' and trim(text) <> ''").select("doc_id", T.sentences(F.col("text")).alias("ss")).where("size(ss) > 0")
    n = a.select("doc_id", "ss", F.explode(F.sequence(F.lit(0), F.floor((F.size("ss") - 1) / 3).cast("int"))).alias("k"))
    return n.select("doc_id", "k", F.array_join(F.slice("ss", F.col("k") * 3 + 1, F.lit(3)), " ").alias("paragraph"))


@query(
    "wn_sentence_dedupe",
    f"""with recursive s as (select doc_id, list_filter(string_split(regexp_replace({_STRIP('text')}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') ss from documents where doc_kind = 'section' and trim(text) <> ''),
    r as (select doc_id, ss, 0 i, []::varchar[] kept from s union all select doc_id, ss, i + 1, case when list_contains(kept[-6:], ss[i + 1]) then kept else list_append(kept, ss[i + 1]) end from r where i < len(ss))
    select doc_id, cast(len(ss) as int) said, cast(len(kept) as int) kept, array_to_string(kept, ' ') text from r where i = len(ss)""",
)
def wn_sentence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN11: sections without the sentences that repeat one of the last six kept; linear in the text, over Arrow batches."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'section' and trim(text) <> ''").select("doc_id", T.sentences(F.col("text")).alias("ss"))

    @F.pandas_udf("array<string>")
    def fresh(lists: pd.Series) -> pd.Series:
        out = []
        for ss in lists:
            kept: list[str] = []
            for x in ss:
                if x not in kept[-6:]:
                    kept.append(x)
            out.append(kept)
        return pd.Series(out, index=lists.index, dtype=object)

    kept = fresh("ss")
    return d.select("doc_id", F.size("ss").alias("said"), F.size(kept).alias("kept"), F.array_join(kept, " ").alias("text"))


@query(
    "tk_splice",
    f"with {_RUN} select researcher, chunk_id, cast(row_number() over (partition by researcher order by coalesce(list_position([4, 2, 7], pos), 100), pos) as int) place from run qualify place <= 12",
)
def tk_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK5: a model's choice of ranks first, the rest as they stand, twelve in all."""
    chosen = F.nullif(F.array_position(F.array(F.lit(4), F.lit(2), F.lit(7)), F.col("pos")), F.lit(0))
    order = Window.partitionBy("researcher").orderBy(F.coalesce(chosen, F.lit(100)), "pos")
    return asked_run(spark, sf_dir).select("researcher", "chunk_id", "pos").withColumn("place", F.row_number().over(order)).where("place <= 12").drop("pos")


@query(
    "sm_memory_items",
    f"""with s as (select doc_id, source session, list_filter(string_split(regexp_replace({_STRIP('text')}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')[:20] ss from documents where doc_kind = 'answer' and trim(text) <> ''),
    i as (select session, doc_id, unnest(ss)[:220] item from s), k as (select session, item, doc_id, {_NORM('item')} k from i) select session, min(doc_id) doc_id, k, cast(least(5, greatest(1, count(*) + 2)) as int) salience from k group by session, k""",
)
def sm_memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM6: what a session keeps of answers: twenty sentences each, 220 characters long, each once whatever its case, with a salience of 1 to 5."""
    a = table(spark, sf_dir, "documents").where("doc_kind = 'answer' and trim(text) <> ''").select(F.col("source").alias("session"), "doc_id", F.explode(F.slice(T.sentences(F.col("text")), 1, 20)).alias("s"))
    k = a.select("session", "doc_id", T.norm(F.substring("s", 1, 220)).alias("k"))
    return k.groupBy("session", "k").agg(F.min("doc_id").alias("doc_id"), F.least(F.lit(5), F.greatest(F.lit(1), F.count("*") + 2)).cast("int").alias("salience"))


@query(
    "qo_prompt_fit",
    f"""with {_RUN}, c as (select unnest([16, 12, 8, 4, 2, 1]) docs, unnest([600, 600, 450, 450, 300, 160]) chars), s as (select researcher, docs, chars, sum(least(length("text"), chars)) used from run, c where pos <= docs group by all)
    select researcher, docs, chars, cast((used + 3) // 4 as bigint) tokens from s where (used + 3) // 4 <= 1200 qualify row_number() over (partition by researcher order by docs desc, chars desc) = 1""",
)
def qo_prompt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO11: the widest caps on documents and characters with which a researcher's evidence fits 1,200 tokens."""
    caps = spark.createDataFrame([(16, 600), (12, 600), (8, 450), (4, 450), (2, 300), (1, 160)], "docs int, chars int")
    s = asked_run(spark, sf_dir).select("researcher", "pos", F.length("text").alias("n")).join(F.broadcast(caps), F.col("pos") <= F.col("docs"))
    used = s.groupBy("researcher", "docs", "chars").agg(F.floor((F.sum(F.least("n", "chars")) + 3) / 4).alias("tokens")).where("tokens <= 1200")
    return used.groupBy("researcher").agg(F.max(F.struct("docs", "chars", "tokens")).alias("b")).select("researcher", "b.*")
