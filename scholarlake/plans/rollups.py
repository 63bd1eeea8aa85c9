"""Queries that roll up evidence and benchmark runs, keep watermarks and memories, and write tables of the graph and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import quality
from scholarlake.operators.vectors import nearest
from scholarlake.plans.retrieval import _RUN, asked_run
from scholarlake.plans.texts import _NORM, _STOP, _STRIP
from scholarlake.sources import files, sinks
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
    "ag_evidence_ranking",
    """with d as (select chunk_id, any_value(researcher) researcher, any_value(topic) topic, any_value(title) title from chunks where trim(researcher) <> '' and trim(topic) <> '' group by chunk_id), n as (select * from (select topic, researcher, count(*) n from d group by topic, researcher) qualify row_number() over (partition by topic order by n desc, researcher) <= 6),
    t as (select topic, researcher, trim(title) title, min(chunk_id) c from d where trim(title) <> '' group by all), s as (select topic, researcher, title, c, row_number() over (partition by topic, researcher order by c, title) k from t qualify k <= 3)
    select topic, researcher, n, cast(row_number() over (partition by topic order by n desc, researcher) as int) k, coalesce((select list(title order by s.k) from s where s.topic = n.topic and s.researcher = n.researcher), []) titles from n""",
)
def ag_evidence_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG14: the six researchers with most chunks on each topic, ties by name, with their first three titles; the first of them is the topic's focus. Counts are made map-side and ranks limited before the join."""
    d = table(spark, sf_dir, "chunks").where("trim(researcher) <> '' and trim(topic) <> ''").select("chunk_id", "researcher", "topic", "title").dropDuplicates(["chunk_id"])
    n = d.groupBy("topic", "researcher").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "researcher"))).where("k <= 6")
    t = d.where("trim(title) <> ''").groupBy("topic", "researcher", F.trim("title").alias("title")).agg(F.min("chunk_id").alias("c"))
    first = t.withColumn("r", F.row_number().over(Window.partitionBy("topic", "researcher").orderBy("c", "title"))).where("r <= 3")
    s = first.groupBy("topic", "researcher").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]).alias("titles"))  # three at most
    return n.join(s, ["topic", "researcher"], "left").select("topic", "researcher", "n", "k", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"))


@query(
    "ag_extreme_titles",
    """with y as (select distinct chunk_id, trim(title) title, try_cast("year" as int) y, work_type from chunks where trim(title) <> ''), b as (select work_type, min(y) lo, max(y) hi from y where y is not null group by work_type), e as (select y.work_type, title, case when y = hi then 'newest' else 'oldest' end kind, y from y join b on y.work_type = b.work_type where y in (lo, hi) union select y.work_type, title, 'oldest', y from y join b on y.work_type = b.work_type where y = lo),
    r as (select *, row_number() over (partition by work_type, kind order by title) k, count(*) over (partition by work_type, kind) n from e) select work_type, kind, y, title, cast(k as int) k, cast(greatest(0, n - 8) as bigint) more from r where k <= 8""",
)
def ag_extreme_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16, AG17: by kind of work the titles of the newest and the oldest year, the first eight of each and how many more there are."""
    y = table(spark, sf_dir, "chunks").where("trim(title) <> ''").select(F.trim("title").alias("title"), F.expr("try_cast(year as int)").alias("y"), "work_type").where("y is not null and work_type is not null").distinct()
    b = y.groupBy("work_type").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    kinds = F.array_compact(F.array(F.when(F.col("y") == F.col("hi"), F.lit("newest")), F.when(F.col("y") == F.col("lo"), F.lit("oldest"))))
    e = y.join(b, "work_type").select("work_type", "title", "y", F.explode(kinds).alias("kind")).distinct()
    n = e.groupBy("work_type", "kind").agg(F.count("*").alias("n"))
    r = e.withColumn("k", F.row_number().over(Window.partitionBy("work_type", "kind").orderBy("title"))).where("k <= 8")
    return r.join(n, ["work_type", "kind"]).select("work_type", "kind", "y", "title", "k", F.greatest(F.lit(0), F.col("n") - 8).cast("long").alias("more"))


_BENCH = """b as (select 'm' || user_id % 4 model, 'd' || event_id % 3 db, cast(event_id % 31 as int) ord, value gen, length(props) words, case when user_id % 5 = 0 then 0 else value / 2 end load, event_type = 'error' failed, case event_type when 'purchase' then 'high' when 'signup' then 'medium' when 'error' then 'weak' else 'low' end conf from events)"""


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "signup", "medium").when(F.col("event_type") == "error", "weak").otherwise("low")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), F.col("user_id") % 4).alias("model"), F.concat(F.lit("d"), F.col("event_id") % 3).alias("db"), (F.col("event_id") % 31).cast("int").alias("ord"), F.col("value").alias("gen"), F.length("props").alias("words"),
        F.when(F.col("user_id") % 5 == 0, 0.0).otherwise(F.col("value") / 2).alias("load"), (F.col("event_type") == "error").alias("failed"), conf.alias("conf"),
    )


_CONFIDENCE = ("high", "low", "medium", "weak")


@query("ag_bench_models", f"with {_BENCH} select model, count(*) runs, round(avg(words), 4) words, round(avg(gen), 4) gen, count(*) filter (failed) errors, round(avg(load) filter (load > 0), 4) load, {', '.join(f'''count(*) filter (conf = '{c}') {c}''' for c in _CONFIDENCE)} from b group by model")
def ag_bench_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18: the benchmark by model: words, seconds, errors, loads above none, and how often each confidence; events stand for its runs."""
    kinds = [F.count_if(F.col("conf") == c).alias(c) for c in _CONFIDENCE]
    return _bench(spark, sf_dir).groupBy("model").agg(F.count("*").alias("runs"), F.round(F.avg("words"), 4).alias("words"), F.round(F.avg("gen"), 4).alias("gen"), F.count_if("failed").alias("errors"), F.round(F.avg(F.when(F.col("load") > 0, F.col("load"))), 4).alias("load"), *kinds)


@query("ag_bench_databases", f"with {_BENCH} select db, count(*) runs, round(avg(words), 4) words, round(avg(gen), 4) retrieval, count(distinct ord) questions, '| ' || db || ' | ' || count(*) || ' | ' || count(*) filter (failed) || ' |' line from b group by db")
def ag_bench_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19, QO25: the benchmark by database, with its line of the report."""
    a = _bench(spark, sf_dir).groupBy("db").agg(F.count("*").alias("runs"), F.round(F.avg("words"), 4).alias("words"), F.round(F.avg("gen"), 4).alias("retrieval"), F.count_distinct("ord").alias("questions"), F.count_if("failed").alias("errors"))
    return a.select("db", "runs", "words", "retrieval", "questions", F.concat(F.lit("| "), "db", F.lit(" | "), "runs", F.lit(" | "), "errors", F.lit(" |")).alias("line"))


# ---- sessions and state


# The words by which a sentence is kept as a decision, a preference or a task; others are facts.
_CATEGORIES = {"decisions": "\\b(decided?|agreed|chose|chosen|will use)\\b", "preferences": "\\b(prefers?|likes?|rather|favou?rs?)\\b", "tasks": "\\b(should|must|need to|to do|next)\\b"}


@query(
    "sm_memory_categories",
    f"""with s as (select source session, doc_id, unnest(list_filter(string_split(regexp_replace({_STRIP('text')}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) s, unnest(generate_series(1, len(list_filter(string_split(regexp_replace({_STRIP('text')}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')))) i from documents where doc_kind in ('answer', 'summary') and source is not null and trim(text) <> ''),
    c as (select session, doc_id, i, s[:220] item, {_NORM('s[:220]')} key, case {' '.join(f"when regexp_matches(lower(s), '{p}') then '{k}'" for k, p in _CATEGORIES.items())} else 'facts' end category, length(s) // 60 sal from s),
    d as (select session, category, key, min(struct_pack(doc_id := doc_id, i := i, item := item)) x, max(sal) sal from c group by all), r as (select *, row_number() over (partition by session, category order by x.doc_id, x.i) k from d qualify k <= 20)
    select session, category, x.item item, cast(least(5, greatest(1, case when sal = 0 then 3 else sal end)) as int) salience, cast(k as int) k from r""",
)
def sm_memory_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM6: what a session remembers of what was said: four categories of twenty items each, 220 characters long, each once whatever its case, salience held within 1 and 5."""
    d = table(spark, sf_dir, "documents").where("doc_kind in ('answer', 'summary') and source is not null and trim(text) <> ''")
    s = d.select(F.col("source").alias("session"), "doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "s"))
    category = F.coalesce(*(F.when(F.lower("s").rlike(p), F.lit(k)) for k, p in _CATEGORIES.items()), F.lit("facts"))
    c = s.select("session", "doc_id", "i", F.substring("s", 1, 220).alias("item"), T.norm(F.substring("s", 1, 220)).alias("key"), category.alias("category"), F.floor(F.length("s") / 60).alias("sal"))
    u = c.groupBy("session", "category", "key").agg(F.min(F.struct("doc_id", "i", "item")).alias("x"), F.max("sal").alias("sal"))
    r = u.withColumn("k", F.row_number().over(Window.partitionBy("session", "category").orderBy("x.doc_id", "x.i"))).where("k <= 20")
    return r.select("session", "category", "x.item", F.least(F.lit(5), F.greatest(F.lit(1), F.when(F.col("sal") == 0, 3).otherwise(F.col("sal")))).cast("int").alias("salience"), "k")


@query("sm_increment", "with s as (select max(updated_date) mark from normalized_works where length(openalex_id) % 2 = 0 or openalex_id like '%1' or openalex_id like '%3'), n as (select count(*) n, max(updated_date) latest from normalized_works, s where updated_date > coalesce(mark, '')), o as (select count(*) n from normalized_works, s where updated_date <= coalesce(mark, '') ) select coalesce(mark, '') mark, o.n known, n.n fresh, o.n + n.n total, greatest(coalesce(latest, ''), coalesce(mark, '')) next_mark from s, n, o")
def sm_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM1, SC2: what is newer than the watermark kept by the last run, the counters added up, and the watermark kept for the next; the filter on the date reaches the scan."""
    w = table(spark, sf_dir, "normalized_works")
    mark = w.where("length(openalex_id) % 2 = 0 or openalex_id like '%1' or openalex_id like '%3'").agg(F.max("updated_date")).first()[0] or ""
    a = w.where(F.col("updated_date").isNotNull()).agg(F.count_if(F.col("updated_date") <= mark).alias("known"), F.count_if(F.col("updated_date") > mark).alias("fresh"), F.max("updated_date").alias("latest"))
    return a.select(F.lit(mark).alias("mark"), "known", "fresh", (F.col("known") + F.col("fresh")).alias("total"), F.greatest(F.coalesce("latest", F.lit("")), F.lit(mark)).alias("next_mark"))


@query(
    "tk_session_memory",
    """with s as (select q.vec_id query, c.vec_id key, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) similarity from embeddings q, embeddings c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and q.label = c.label), n as (select *, row_number() over (partition by query order by similarity desc, key) pos from s qualify pos <= 12),
    c as (select *, sum(key % 50 + 1) over (partition by query order by pos) used from n) select query, key, cast(pos as int) pos, cast(used as bigint) used from c where used <= 200""",
)
def tk_session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK9, PF18: the twelve most similar memories of the same session, packed into a budget; labels stand for sessions."""
    e = table(spark, sf_dir, "embeddings")
    n = nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 12, group="label")
    c = n.withColumn("used", F.sum(F.col("key") % 50 + 1).over(Window.partitionBy("query").orderBy("pos")))
    return c.where("used <= 200").select("query", "key", "pos", F.col("used").cast("long").alias("used"))


@query(
    "tk_choice_splice",
    f"""with {_RUN}, m as (select *, row_number() over (partition by researcher order by length("text") desc, pos) l from run), c as (select *, case when l <= 3 then l end chosen from m) select researcher, chunk_id, cast(row_number() over (partition by researcher order by coalesce(chosen, 100), pos) as int) place, chosen is not null chosen from c qualify place <= 12""",
)
def tk_choice_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK5: what a model chose first (the stand-in takes the three longest texts), the rest as they stand, twelve in all."""
    by = Window.partitionBy("researcher")
    c = asked_run(spark, sf_dir).withColumn("l", F.row_number().over(by.orderBy(F.length("text").desc(), "pos"))).withColumn("chosen", F.when(F.col("l") <= 3, F.col("l")))
    return c.withColumn("place", F.row_number().over(by.orderBy(F.coalesce("chosen", F.lit(100)), "pos"))).where("place <= 12").select("researcher", "chunk_id", "place", F.col("chosen").isNotNull().alias("chosen"))


@query(
    "st_union_docs",
    f"with {_RUN}, a as (select researcher, chunk_id, pos p from run where pos <= 20), b as (select researcher, chunk_id, 1000 + row_number() over (partition by researcher order by \"year\" desc nulls last, chunk_id) p from run qualify p <= 1020), u as (select researcher, chunk_id, min(p) p from (select * from a union all select * from b) group by all) select researcher, chunk_id, cast(row_number() over (partition by researcher order by p) as int) place from u",
)
def st_union_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: two lists of chunks, by citations and by year, one after the other, each chunk where it is seen first."""
    run = asked_run(spark, sf_dir)
    by = Window.partitionBy("researcher")
    a = run.where("pos <= 20").select("researcher", "chunk_id", F.col("pos").alias("p"))
    b = run.select("researcher", "chunk_id", (F.row_number().over(by.orderBy(F.col("year").desc_nulls_last(), "chunk_id")) + 1000).alias("p")).where("p <= 1020")
    u = a.unionByName(b).groupBy("researcher", "chunk_id").agg(F.min("p").alias("p"))
    return u.select("researcher", "chunk_id", F.row_number().over(by.orderBy("p")).alias("place"))


@query("st_done_union", "with done as (select openalex_id, min(updated_date) d from normalized_works where cited_by_count > 10 group by 1), fresh as (select openalex_id, max(updated_date) d from normalized_works group by 1) select openalex_id, d, 'done' state from done union all select openalex_id, d, 'new' from fresh where openalex_id not in (select openalex_id from done)")
def st_done_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, JN17: what earlier runs did, then what they lack."""
    w = table(spark, sf_dir, "normalized_works")
    done = w.where("cited_by_count > 10").groupBy("openalex_id").agg(F.min("updated_date").alias("d"))
    fresh = w.groupBy("openalex_id").agg(F.max("updated_date").alias("d")).join(done, "openalex_id", "left_anti")
    return done.withColumn("state", F.lit("done")).unionByName(fresh.withColumn("state", F.lit("new")))


# ---- tables of the store and the graph


@query(
    "gr_authored_edges",
    "with w as (select openalex_id wid, arg_max_null(all_authors, coalesce(updated_date, '')) a from normalized_works group by openalex_id), e as (select wid, unnest(a) p from w), ok as (select p.id aid, wid, min(p.position) pos, bool_or(p.is_corresponding) corr from e where p.id <> '' and trim(p.name) <> '' group by all) select aid, wid, pos, corr from ok",
)
def gr_authored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, PF2: who wrote what, with position and correspondence, both ends being nodes of the graph: authors without an id or a name are none."""
    w = table(spark, sf_dir, "normalized_works").groupBy(F.col("openalex_id").alias("wid")).agg(F.max_by("all_authors", F.coalesce("updated_date", F.lit(""))).alias("a"))
    e = w.select("wid", F.explode("a").alias("p"))
    nodes = e.where("p.id <> '' and trim(p.name) <> ''").select(F.col("p.id").alias("aid")).distinct()
    edges = e.where("p.id <> '' and trim(p.name) <> ''").groupBy(F.col("p.id").alias("aid"), "wid").agg(F.min("p.position").alias("pos"), F.bool_or("p.is_corresponding").alias("corr"))
    return edges.join(nodes, "aid", "left_semi").join(w.select("wid"), "wid", "left_semi").select("aid", "wid", "pos", "corr")


@query(
    "gr_hits",
    f"with {_RUN}, h as (select researcher, work_id, min(pos) p, arg_min_null(title, pos) title, arg_min_null(topic, pos) topic, arg_min_null(\"year\", pos) \"year\", arg_min_null(chunk_type, pos) kind, count(*) chunks from run group by researcher, work_id) select * from h qualify row_number() over (partition by researcher order by p, work_id) <= 40",
)
def gr_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF3: what the graph of evidence is built of: of each of forty works a researcher the first chunk's fields, its rank and how many chunks there are."""
    first = lambda c, n=None: F.min_by(c, "pos").alias(n or c)
    h = asked_run(spark, sf_dir).groupBy("researcher", "work_id").agg(F.min("pos").alias("p"), first("title"), first("topic"), first("year"), first("chunk_type", "kind"), F.count("*").alias("chunks"))
    return h.withColumn("r", F.row_number().over(Window.partitionBy("researcher").orderBy("p", "work_id"))).where("r <= 40").drop("r")


@query("sc_vector_store", "with c as (select chunk_id, any_value(chunk_type) chunk_type, any_value(text) text from chunks group by chunk_id) select chunk_type, count(*) n, count(*) filter (hash_ok) changed from (select chunk_type, chunk_id like '%1' hash_ok from c) group by chunk_type")
def sc_vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC27, SC28, SC29: a store of chunks rebuilt, then some of it written over by id (the last wins), read back and counted by kind."""
    path = sinks.fresh_folder(spark, "store")
    c = table(spark, sf_dir, "chunks").select("chunk_id", "chunk_type", files.metadata_value(F.col("text")).alias("document")).dropDuplicates(["chunk_id"])
    c.write.parquet(f"{path}/0")
    changes = c.where("chunk_id like '%1'").select("chunk_id", "chunk_type", F.lit("changed").alias("document"))
    files.upserted(spark.read.parquet(f"{path}/0"), changes, "chunk_id").write.parquet(f"{path}/1")
    return spark.read.parquet(f"{path}/1").groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if(F.col("document") == "changed").alias("changed"))


@query("sc_qa_sink", "select id, k, case k when 0 then 'Who studies ' || work_title || '?' else 'When was ' || work_title || ' published?' end prompt, case k when 0 then coalesce(nullif(trim(researcher_name), ''), 'Unknown') else coalesce(nullif(trim(publication_date), ''), 'Unknown') end target from research_info, (select unnest([0, 1]) k) where trim(work_title) <> ''")
def sc_qa_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC37: pairs of questions and answers written as a table and read again."""
    r = table(spark, sf_dir, "research_info").where("trim(work_title) <> ''")
    told = lambda c: F.coalesce(T.blank_to_null(F.trim(c)), F.lit("Unknown"))
    pairs = F.array(F.struct(F.concat(F.lit("Who studies "), "work_title", F.lit("?")).alias("prompt"), told("researcher_name").alias("target")), F.struct(F.concat(F.lit("When was "), "work_title", F.lit(" published?")).alias("prompt"), told("publication_date").alias("target")))
    path = sinks.fresh_folder(spark, "pairs")
    r.select("id", F.posexplode(pairs).alias("k", "p")).select("id", "k", "p.prompt", "p.target").write.parquet(path)
    return spark.read.parquet(path)


@query("dm_insert_works", "select id, paper_id, file_name, full_text is not null has_text, coalesce(nullif(trim(summary_status), ''), 'unsummarized') summary_status, coalesce(progress, 0) progress, 'untagged' topics_status from works union all select null, paper_id, null, false, 'unsummarized', 0, 'untagged' from (select distinct paper_id from papers where paper_id not in (select paper_id from works where paper_id is not null))")
def dm_insert_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM12, DM15, DM17: a work with defaults for each paper that has none, and the columns a tagger needs."""
    w = table(spark, sf_dir, "works").select("id", "paper_id", "file_name", F.col("full_text").isNotNull().alias("has_text"), F.coalesce(T.blank_to_null(F.trim("summary_status")), F.lit("unsummarized")).alias("summary_status"), F.coalesce("progress", F.lit(0)).alias("progress"))
    full = quality.add_missing_rows(w, table(spark, sf_dir, "papers").select("paper_id"), "paper_id", {"has_text": F.lit(False), "summary_status": F.lit("unsummarized"), "progress": F.lit(0)})
    return quality.with_columns(full, {"topics_status": F.lit("untagged")})


@query("sc_institution", "select count(*) > 0 known, count(*) filter (p.is_su) members from (select unnest(all_authors) p from normalized_works) where p.is_su")
def sc_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4: whether the institution is known at all, asked before anything is fetched."""
    p = table(spark, sf_dir, "normalized_works").select(F.explode("all_authors").alias("p")).where("p.is_su")
    return p.agg((F.count("*") > 0).alias("known"), F.count("*").alias("members"))


@query(
    "fn_topic_tokens",
    f"""with t as (select doc_id, unnest(regexp_extract_all({_NORM('text')}, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1)) w from documents where doc_kind in ('abstract', 'summary') and trim(text) <> ''), c as (select doc_id, w, count(*) n from t where length(w) >= 4 and not list_contains([{_STOP}], w) group by all) select doc_id, w token, n, cast(row_number() over (partition by doc_id order by n desc, w) as int) k from c qualify k <= 6""",
)
def fn_topic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN69, FN72: the six words a text says most often, stop words and short ones left out."""
    d = table(spark, sf_dir, "documents").where("doc_kind in ('abstract', 'summary') and trim(text) <> ''").select("doc_id", F.explode(T.words(F.col("text"))).alias("token"))
    c = d.where((F.length("token") >= 4) & ~F.col("token").isin(T.STOPWORDS)).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "token"))).where("k <= 6")
