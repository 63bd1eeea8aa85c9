"""Queries on conversations and on streams of events, in their batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import dialog
from scholarlake.operators.vectors import nearest
from scholarlake.plans.retrieval import _RUN, ag_researcher_evidence, ag_support_confidence, asked_run
from scholarlake.plans.texts import _NORM
from scholarlake.sources import seams
from scholarlake.sources.tables import table
from scholarlake.streaming.sessions import windowed_counts

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_TURNS = "t as (select source session, doc_id turn, case doc_kind when 'qa_pair' then 'user' when 'record' then 'system' else 'assistant' end as \"role\", text from documents where source is not null)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as turns of conversations: a source is a session, its documents in order are what was said."""
    role = F.when(F.col("doc_kind") == "qa_pair", "user").when(F.col("doc_kind") == "record", "system").otherwise("assistant")
    return table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("session"), F.col("doc_id").alias("turn"), role.alias("role"), "text")


@query(
    "wn_turn_trim",
    f"""with {_TURNS}, l as (select * from t qualify row_number() over (partition by session order by turn desc) <= 24), v as (select * from l where "role" in ('user', 'assistant') and trim(text) <> ''),
    s as (select *, row_number() over (partition by session order by turn desc) k, sum(length(text)) over (partition by session order by turn desc) run, sum(length(text)) over (partition by session) total from v)
    select session, turn, "role", length(text) n from s where total <= 32000 or run <= 24000 or k <= 2""",
)
def wn_turn_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN7, C9, SC34, SM7: the turns each session keeps."""
    return dialog.trimmed_turns(turns(spark, sf_dir)).select("session", "turn", "role", F.length("text").cast("long").alias("n"))


@query("wn_last_user_turn", f"with {_TURNS} select session, max(turn) turn, arg_max(text, turn) text from t where \"role\" = 'user' and trim(text) <> '' group by session")
def wn_last_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN9: what was asked last in each session."""
    asked = turns(spark, sf_dir).where("role = 'user' and trim(text) <> ''")
    return asked.groupBy("session").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query(
    "wn_recent_turns",
    f"""with {_TURNS}, l as (select * from t where trim(text) <> '' qualify row_number() over (partition by session order by turn desc) <= 4) select session, string_agg(upper("role"[1:1]) || "role"[2:] || ': ' || text[:160], chr(10) order by turn) recent from l group by session""",
)
def wn_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN8, QO37: the last four turns of each session as text."""
    back = Window.partitionBy("session").orderBy(F.desc("turn"))
    last = turns(spark, sf_dir).where("trim(text) <> ''").withColumn("r", F.row_number().over(back)).where("r <= 4")
    line = F.concat(F.initcap("role"), F.lit(": "), F.substring("text", 1, 160))
    return last.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("recent"))


@query(
    "wn_memory_prune",
    "with m as (select user_id session, event_id id from events), n as (select session, count(*) n from m group by session), r as (select *, row_number() over (partition by session order by id desc) r from m) select session, id from r join n using (session) where n <= 500 or r <= 420",
)
def wn_memory_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN12: memories kept of each session."""
    return dialog.pruned_memory(table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("id")))


@query(
    "wn_dedupe_ci",
    f"with d as (select doc_id, {_NORM('text')} k from documents where trim(text) <> '') select min(doc_id) doc_id, count(*) copies from d group by k having count(*) > 1",
)
def wn_dedupe_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN2, SC27: the first of texts that come several times but for case and white space; only hashes are shuffled."""
    d = table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", F.sha2(T.norm(F.col("text")), 256).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


_ANSWERS = "a as (select doc_id, text from documents where doc_kind = 'answer' and text is not null)"


@query(
    "fn_clean_answers",
    f"""with {_ANSWERS}, s as (select doc_id, regexp_replace(regexp_replace(text, '(?s)\\n\\nSources:.*$', ''), '^(?:Based on the papers: |\\*\\*Short answer\\.\\*\\* |[0-9]+\\. |- )', '') b from a)
    select doc_id, trim(b) body, cast(len(list_filter(regexp_split_to_array(b, '[ \\t\\r\\n\\f\\x0B]+'), lambda w: w <> '')) as int) n_words, cast(len(regexp_extract_all(text, '\\[[0-9]+\\]')) as int) n_sources from s join a using (doc_id)""",
)
def fn_clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN83, FN102: answers without leading labels and source lists, with counts of words and sources."""
    a = table(spark, sf_dir, "documents").where("doc_kind = 'answer' and text is not null").select("doc_id", "text")
    body = F.regexp_replace(F.regexp_replace("text", r"(?s)\n\nSources:.*$", ""), r"^(?:Based on the papers: |\*\*Short answer\.\*\* |[0-9]+\. |- )", "")
    n_words = F.size(F.filter(F.split(body, r"[ \t\r\n\f\x0B]+"), lambda w: w != ""))
    return a.select("doc_id", F.trim(body).alias("body"), n_words.alias("n_words"), F.size(F.regexp_extract_all("text", F.lit(r"(\[[0-9]+\])"), F.lit(1))).alias("n_sources"))


@query(
    "st_token_overlap",
    f"""with q as (select doc_id, regexp_extract_all({_NORM("regexp_extract(text, '^Q: ([^\\n]*)', 1)")}, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1) a, regexp_extract_all({_NORM("regexp_extract(text, 'A: (.*)', 1)")}, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1) b from documents where doc_kind = 'qa_pair' and text is not null)
    select doc_id, list_has_any(a, b) overlap, cast(len(list_distinct(list_filter(a, lambda x: not list_contains(b, x)))) as int) unanswered from q""",
)
def st_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, ST4, ST5: what words of a question its answer takes up."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'qa_pair' and text is not null")
    a, b = T.words(F.regexp_extract("text", r"^Q: ([^\n]*)", 1)), T.words(F.regexp_extract("text", r"A: (.*)", 1))
    return d.select("doc_id", a.alias("a"), b.alias("b")).select("doc_id", F.arrays_overlap("a", "b").alias("overlap"), F.size(F.array_except("a", "b")).alias("unanswered"))


@query("sm_watermark", "select strftime(ingested_at, '%Y-%m') period, count(*) n, max(ingested_at) high_water from research_info group by period")
def sm_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM1: how far each month's deliveries reach."""
    return table(spark, sf_dir, "research_info").groupBy(F.date_format("ingested_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n"), F.max("ingested_at").alias("high_water"))


@query("sm_latest_wins", "select openalex_id, max(updated_date) updated_date, count(*) copies from normalized_works group by openalex_id")
def sm_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM2, ST6, SC27: of copies the latest."""
    return table(spark, sf_dir, "normalized_works").groupBy("openalex_id").agg(F.max("updated_date").alias("updated_date"), F.count("*").alias("copies"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was asked, by conversation: a source's turns of one day, so that no fold runs over all turns of a large source."""
    d = table(spark, sf_dir, "documents").where("source is not null and ingested_at is not null and doc_kind = 'qa_pair' and text is not null")
    return d.select(F.concat_ws("|", "source", F.date_format("ingested_at", "yyyy-MM-dd")).alias("session"), F.col("doc_id").alias("turn"), "text")


_CONV = "cv as (select source || '|' || strftime(ingested_at, '%Y-%m-%d') session, doc_id turn, regexp_extract(text, '^Q: ([^\\n]*)', 1) q, text from documents where source is not null and ingested_at is not null and doc_kind = 'qa_pair' and text is not null), o as (select *, cast(row_number() over (partition by session order by turn) as int) i from cv)"
_HELD = lambda a: f"(contains({_NORM('q')}, {_NORM(a)}) and {_NORM(a)} <> '')"


@query(
    "sm_anchor_states",
    f"""with recursive {_RUN}, {_CONV}, n as (select researcher, count(*) n from run group by researcher),
    x as (select o.*, case when n >= 3 then researcher end v, case when n >= 4 then 0.98 when n = 3 then 0.85 else 0 end::double c, regexp_matches(lower(q), '{T.PRONOUNS}') or regexp_matches(lower(q), '{T.GOING_ON}') fu from o left join n on researcher = regexp_extract(o.text, '^Q: What does (.*) study in', 1)),
    r(session, turn, i, anchor, confidence, action) as (select session, turn, i, case when v is not null and {_HELD('v')} then v end, case when v is not null and {_HELD('v')} then c else 0::double end, case when v is null then 'none' when {_HELD('v')} then 'set_from_dominance' else 'blocked_no_query_overlap' end from x where i = 1
     union all select x.session, x.turn, x.i,
      case when v is null then case when anchor is not null and ({_HELD('anchor')} or fu) then anchor end when anchor is null then case when {_HELD('v')} then v end when anchor = v then anchor when not {_HELD('v')} then anchor when c >= 0.82 then v else anchor end,
      case when v is null then case when anchor is not null and ({_HELD('anchor')} or fu) then confidence else 0 end when anchor is null then case when {_HELD('v')} then c else 0 end when anchor = v then greatest(confidence, c) when not {_HELD('v')} then confidence when c >= 0.82 then c else confidence end,
      case when v is null then case when anchor is null then 'none' when {_HELD('anchor')} then 'kept_no_dominance' when fu then 'kept_followup_coref' else 'cleared_no_query_overlap' end when anchor is null then case when {_HELD('v')} then 'set_from_dominance' else 'blocked_no_query_overlap' end when anchor = v then 'kept_reinforced'
       when not {_HELD('v')} then 'kept_candidate_no_query_overlap' when c >= 0.82 then 'replaced_with_strong_evidence' else 'kept_ambiguous_switch_requires_confirmation' end from r join x on r.session = x.session and x.i = r.i + 1)
    select session, turn, anchor, confidence, action from r""",
)
def sm_anchor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM11, SM13, C8: how the anchor of each conversation moves with its questions; the candidate is the researcher whom the evidence bears out, overlap and going on are read from the question."""
    named = F.regexp_extract("text", "^Q: What does (.*) study in", 1)
    q = conversations(spark, sf_dir).select("session", "turn", F.regexp_extract("text", r"^Q: ([^\n]*)", 1).alias("question"), named.alias("researcher"))
    n = asked_run(spark, sf_dir).groupBy("researcher").agg(F.count("*").alias("n"))
    sure = F.when(F.col("n") >= 4, 0.98).when(F.col("n") == 3, 0.85).otherwise(0.0)
    seen = q.join(n, "researcher", "left").select(
        "session", "turn", "question", F.when(F.col("n") >= 3, F.col("researcher")).alias("value"), sure.alias("confidence"), F.when(F.col("n") >= 3, 1.0).otherwise(0.0).alias("ratio"),
        T.follow_up(F.col("question")).alias("follow_up"), (F.col("researcher") != "").alias("entity"),
    )
    return dialog.anchor_states(seen)


@query(
    "sm_rolling_summary",
    f"""with recursive {_CONV}, w as (select session, i, unnest(regexp_extract_all({_NORM("regexp_extract(text, 'A: (.*)', 1)")}, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1)) word from o), v as (select session, i, word, count(*) n from w group by all having count(*) >= 2), g as (select session, i, list(word order by n desc, word) strong from v group by all),
    x as (select o.session, o.i, o.q, coalesce(strong, []) strong, count(*) over (partition by o.session) turns from o left join g using (session, i)),
    r(session, i, turns, focus, themes, questions) as (select session, i, turns, q[:220], strong[-6:], case when q <> '' then [q] else [] end from x where i = 1
     union all select x.session, x.i, x.turns, x.q[:220], (list_filter(themes, lambda t: not list_contains(strong, t)) || strong)[-6:], (list_filter(questions, lambda t: t <> x.q) || case when x.q <> '' then [x.q] else [] end)[-6:] from r join x on r.session = x.session and x.i = r.i + 1)
    select session, turns, focus, themes, questions from r where i = turns""",
)
def sm_rolling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM8, SM9, and C10 without the voted people: the summary each conversation ends with."""
    q = conversations(spark, sf_dir).select("session", "turn", F.regexp_extract("text", r"^Q: ([^\n]*)", 1).alias("question"), T.words(F.regexp_extract("text", r"A: (.*)", 1)).alias("evidence"))
    return dialog.rolling_summaries(q)


@query(
    "qo_answers",
    f"""with {_RUN}, s as (select researcher, count(*) docs, count(*) filter (contains({_NORM('text')}, {_NORM('topic')}) and coalesce(topic, '') <> '') hits from run group by researcher), l as (select researcher, list(title order by p, title)[:3] titles from (select researcher, title, min(pos) p from run where trim(title) <> '' group by researcher, title) group by researcher),
    q as (select doc_id, regexp_extract(text, '^Q: What does (.*) study in', 1) researcher from documents where doc_kind = 'qa_pair')
    select doc_id, coalesce(case when docs is null then 'none' when docs <= 3 then 'weak' when hits / docs < 0.45 then 'inconsistent' when docs >= 8 then 'high' else 'medium' end, 'none') confidence,
    case when docs is null then 'There is not enough context to answer.' else researcher || ': supported by ' || array_to_string(list_transform(titles, lambda t: '"' || t || '"'), '; ') end answer from q left join s using (researcher) left join l using (researcher)""",
)
def qo_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO1, QO6, QO15, QO16, QO18, QO19: every question of the corpus answered from its evidence, set at a time."""
    q = table(spark, sf_dir, "documents").where("doc_kind = 'qa_pair'").select("doc_id", F.regexp_extract("text", "^Q: What does (.*) study in", 1).alias("researcher"))
    label = ag_support_confidence(spark, sf_dir).select("researcher", "label")
    evidence = ag_researcher_evidence(spark, sf_dir).select("researcher", "titles")
    told = F.concat("researcher", F.lit(": supported by "), F.array_join(F.transform("titles", lambda t: F.concat(F.lit('"'), t, F.lit('"'))), "; "))
    joined = q.join(label, "researcher", "left").join(evidence, "researcher", "left")
    return joined.select("doc_id", F.coalesce("label", F.lit("none")).alias("confidence"), F.when(F.col("label").isNull(), F.lit("There is not enough context to answer.")).otherwise(told).alias("answer"))


@query("qo_embed_search")
def qo_embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO9, QO10, TK1: every fiftieth document searched for among all by the stand-in embedder."""
    d = seams.embed(table(spark, sf_dir, "documents").where("trim(text) <> ''").select("doc_id", "text"), "text").select("doc_id", "embedding")
    return nearest(d.where("doc_id % 50 = 0"), d, "doc_id", "embedding", 5)


@query("qo_summaries", "select id, full_text[:1000] head from works where trim(full_text) <> ''")
def qo_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO30: what a summarizer reads of each text."""
    return table(spark, sf_dir, "works").where("trim(full_text) <> ''").select("id", F.substring("full_text", 1, 1000).alias("head"))


@query("ext_tumbling", "select time_bucket(interval '1 hour', ts) start, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events by hour; the same function runs over a stream."""
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    "ext_sessions",
    "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) start, count(*) n from s group by user_id, k",
)
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of each user, ended by half an hour of silence."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("ext_cube", "select l_returnflag, l_linestatus, count(*) n, cast(sum(l_quantity) as bigint) quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def ext_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a cube."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
