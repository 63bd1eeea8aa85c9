"""Queries that search, rank, diversify and weigh evidence, and those on graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators.chunks import chunked_works, packed_sentences
from scholarlake.operators.vectors import diversified, laddered, nearest
from scholarlake.plans.texts import _NORM
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


# ---- vectors

_KNN = "with s as (select q.vec_id query, c.vec_id key, c.label, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) similarity from embeddings q, embeddings c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id"


@query("tk_knn", f"{_KNN}) select query, key, round(similarity, 6) similarity, cast(row_number() over (partition by query order by similarity desc, key) as int) pos from s qualify pos <= 10")
def tk_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK1, JN19, QO9: the ten nearest vectors of every fiftieth."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 6))


@query("tk_knn_filtered", f"{_KNN} and c.label = 3) select query, key, round(similarity, 6) similarity, cast(row_number() over (partition by query order by similarity desc, key) as int) pos from s qualify pos <= 10")
def tk_knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK1, PF15, TK9: the same within one label; the filter reaches the scan."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e.where("vec_id % 50 = 0"), e.where("label = 3"), "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 6))


@query(
    "tk_mmr",
    _KNN.replace("with s as", "with recursive s as")
    + """), n as (select query, key, similarity from s qualify row_number() over (partition by query order by similarity desc, key) <= 30), c as (select query, list(struct_pack(key := key, sim := similarity, e := embedding::double[]) order by similarity desc, key) cs from n join embeddings on vec_id = key group by query),
    r(query, cs, chosen) as (select query, cs, [cs[1].key] from c union all select query, cs, list_append(chosen, cs[list_position(sc, list_max(sc))].key) from (select *, list_transform(cs, lambda x: case when list_contains(chosen, x.key) then -9 else round(0.6::double * x.sim - 0.4::double * list_max(list_transform(list_filter(cs, lambda d: list_contains(chosen, d.key)), lambda d: list_cosine_similarity(x.e, d.e))), 9) end) sc from r where len(chosen) < least(12, len(cs))))
    select query, unnest(chosen) key, cast(unnest(generate_series(1, len(chosen))) as int) "rank" from r where len(chosen) = least(12, len(cs))""",
)
def tk_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK2, C3: twelve of the thirty nearest, diversified."""
    e = table(spark, sf_dir, "embeddings")
    return diversified(nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 30), e, "vec_id", "embedding", 12)


@query("tk_label_vote", f"""{_KNN}), n as (select *, row_number() over (partition by query order by similarity desc, key) pos from s qualify pos <= 10)
  select query, label, count(*) n from n group by query, label qualify row_number() over (partition by query order by count(*) desc, label) = 1""")
def tk_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19, AG14: the label most of a vector's neighbours bear."""
    e = table(spark, sf_dir, "embeddings")
    near = nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 10).join(e.select(F.col("vec_id").alias("key"), "label"), "key")
    votes = near.groupBy("query", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("query").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"))
    return best.select("query", (-F.col("b.l")).alias("label"), F.col("b.n").alias("n"))


_WANTED = "case when vec_id % 100 = 0 then label else label + 1000 end"


@query(
    "tk_ladder",
    f"""with q as (select vec_id, embedding, {_WANTED} wanted from embeddings where vec_id % 50 = 0), s as (select q.vec_id query, c.vec_id key, c.label = q.wanted own, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) similarity from q, embeddings c where c.vec_id <> q.vec_id),
    a as (select query, key, similarity, cast(row_number() over (partition by query order by similarity desc, key) as int) pos, 'filtered' stage from s where own qualify pos <= 30), b as (select query, key, similarity, cast(row_number() over (partition by query order by similarity desc, key) as int) pos, 'unfiltered' stage from s where query not in (select query from a) qualify pos <= 12)
    select query, key, round(similarity, 6) similarity, pos, stage from a union all select query, key, round(similarity, 6), pos, stage from b""",
)
def tk_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK3: thirty neighbours under a filter, and twelve without it where the filter leaves none, with the rung each came from; every other query asks for a label there is none of. The rungs a failing index needs have no counterpart."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").withColumn("label", F.expr(_WANTED))
    return laddered(q, e, "vec_id", "embedding", "label", 30, 12).withColumn("similarity", F.round("similarity", 6))


# ---- chunks


_PACKED = """p as (select id, ss, list_transform(ss, lambda x: cast(floor(len(list_filter(regexp_split_to_array(x, '[ \\t\\r\\n\\f\\x0B]+'), lambda w: w <> '')) * 1.3::double) as bigint)) ts from s where len(ss) > 0),
 r(id, i, a, tok, k, done) as (select id, 1, 1, ts[1], 0, null::varchar from p union all
  select r.id, i + 1, case when full_ then least(i + 1, b) else a end, case when full_ then list_sum(ts[b:i] || [0::bigint]) + ts[i + 1] else tok + ts[i + 1] end, k + case when full_ then 1 else 0 end, case when full_ then array_to_string(ss[a:i], ' ') end
  from (select r.*, p.ss, p.ts, r.tok + p.ts[r.i + 1] > 512 full_, coalesce(list_min(list_filter(generate_series(r.a, r.i), lambda j: list_sum(ts[j:r.i]) <= 128)), r.i + 1) b from r join p using (id) where r.i < len(p.ss)) r),
 made as (select id, k - 1 chunk, done text from r where done is not null union all select r.id, r.k, array_to_string(p.ss[r.a:], ' ') from r join p using (id) where r.i = len(p.ss))"""
_SPLIT = lambda c: f"list_filter(string_split(regexp_replace(regexp_replace({c}, '^[ \\t\\r\\n\\f\\x0B]+|[ \\t\\r\\n\\f\\x0B]+$', '', 'g'), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


@query("wn_pack_sentences", f"with recursive s as (select id, {_SPLIT('full_text')} ss from works where full_text is not null), {_PACKED} select id, cast(count(*) over (partition by id) as int) chunks_total, cast(chunk as int) chunk, text from made")
def wn_pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5, WN6, TF2, C1: full texts packed into overlapping chunks."""
    w = table(spark, sf_dir, "works").where("full_text is not null").select("id", packed_sentences(F.col("full_text")).alias("c"))
    return w.select("id", F.size("c").alias("chunks_total"), F.posexplode("c").alias("chunk", "text"))


_FIRST = lambda works: f"""w as (select *, concat_ws(' ', case when trim(primary_researcher) <> '' then 'Research by ' || primary_researcher end, case when trim(topics[1].name) <> '' then 'in ' || topics[1].name end, case when publication_year is not null then '(' || publication_year || ')' end) p,
      list_filter(list_transform(topics[:5], lambda t: t.name), lambda n: coalesce(n <> '', false)) tn, list_filter(list_transform(topics[:5], lambda t: t.field), lambda n: coalesce(n <> '', false)) tf from {works}),
    x as (select openalex_id, case when p <> '' then p || '. ' else '' end prefix, 'title_abstract' chunk_type, 0 chunk_index, case when trim(abstract) <> '' then title || chr(10) || chr(10) || abstract else title end text from w where trim(title) <> ''
      union all select openalex_id, case when p <> '' then p || '. ' else '' end, 'keywords', 1, concat_ws('. ', title, case when len(keywords) > 0 then 'Keywords: ' || array_to_string(keywords[:15], ', ') end, case when len(tn) > 0 then 'Research topics: ' || array_to_string(tn, ', ') end,
        case when len(tf) > 0 then 'Fields: ' || array_to_string(list_filter(tf, lambda f, i: list_position(tf, f) = i), ', ') end) from w where len(keywords) > 0 or len(topics) > 0)"""
_AS_CHUNKS = "select openalex_id || '_' || chunk_type || '_' || chunk_index chunk_id, openalex_id work_id, chunk_type, chunk_index, text, prefix || text embed_text from"


@query("tf_first_chunks", f"with {_FIRST('normalized_works')} {_AS_CHUNKS} x")
def tf_first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF1, FN40, FN41, PF5, PF6: the chunks of title, abstract, keywords and topics of each work."""
    w = table(spark, sf_dir, "normalized_works")
    none = spark.createDataFrame([], "work_id string, pos int, heading string, body string, element_type string")
    return chunked_works(w, none)


_NEWEST = "nw as (select openalex_id, x.* from (select openalex_id, arg_max(struct_pack(title := title, abstract := abstract, primary_researcher := primary_researcher, topics := topics, publication_year := publication_year, keywords := keywords), coalesce(updated_date, '')) x from normalized_works group by openalex_id))"


@query(
    "tf_section_chunks",
    f"""with recursive {_NEWEST}, {_FIRST('nw')}, b as (select openalex_id, unnest(ps) body, unnest(generate_series(0, len(ps) - 1)) pos from (select openalex_id, list_filter(regexp_split_to_array(abstract, '\\n[ \\t]*\\n'), lambda q: length(q) > 10) ps from nw where abstract is not null)),
    s as (select openalex_id || '|' || pos id, {_SPLIT('body')} ss from b where length(regexp_replace(body, '^[ \\t\\r\\n\\f\\x0B]+|[ \\t\\r\\n\\f\\x0B]+$', '', 'g')) >= 30), {_PACKED},
    n as (select split_part(id, '|', 1) openalex_id, text, row_number() over (partition by split_part(id, '|', 1) order by cast(split_part(id, '|', 2) as int), chunk) + 99 chunk_index from made),
    y as (select * from x union all select n.openalex_id, case when w.p <> '' then w.p || '. ' else '' end, 'section', n.chunk_index, concat_ws(' — ', w.title, 'Full Text: ' || n.text) from n join w using (openalex_id)) {_AS_CHUNKS} y""",
)
def tf_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF1, SC19, SC21-SC23: the same of the latest copy of each work, with the abstract's paragraphs as sections."""
    fields = ["title", "abstract", "primary_researcher", "topics", "publication_year", "keywords"]
    w = table(spark, sf_dir, "normalized_works").groupBy("openalex_id").agg(F.max_by(F.struct(*fields), F.coalesce("updated_date", F.lit(""))).alias("x")).select("openalex_id", "x.*")
    paragraphs = F.filter(F.split("abstract", r"\n[ \t]*\n"), lambda p: F.length(p) > 10)
    sections = w.where("abstract is not null").select(F.col("openalex_id").alias("work_id"), F.posexplode(paragraphs).alias("pos", "body"))
    return chunked_works(w, sections.select("work_id", "pos", F.lit("Full Text").alias("heading"), "body", F.lit("section").alias("element_type")))


# ---- evidence: for each researcher asked about, the chunks that bear the name

_RUN = """d as (select chunk_id, any_value(work_id) work_id, any_value(chunk_type) chunk_type, any_value(researcher) researcher, any_value(year) "year", any_value(topic) topic, any_value(work_type) work_type, any_value(title) title, any_value(cited_by_count) cited, any_value("text") "text" from chunks where researcher is not null group by chunk_id),
asked as (select distinct regexp_extract(text, '^Q: What does (.*) study in', 1) researcher from documents where doc_kind = 'qa_pair'),
run as (select d.*, cast(row_number() over (partition by researcher order by coalesce(cited, 0) desc, chunk_id) as int) pos from d join asked using (researcher) qualify pos <= 60)"""


def asked_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixty chunks of each researcher asked about: first-seen by id, most cited first; ranks are limited before the shuffle."""
    fields = ["work_id", "chunk_type", "researcher", "year", "topic", "work_type", "title", F.col("cited_by_count").alias("cited"), "text"]
    seen = table(spark, sf_dir, "chunks").where("researcher is not null").select("chunk_id", *fields).dropDuplicates(["chunk_id"])
    asked = table(spark, sf_dir, "documents").where("doc_kind = 'qa_pair'").select(F.regexp_extract("text", "^Q: What does (.*) study in", 1).alias("researcher")).distinct()
    order = Window.partitionBy("researcher").orderBy(F.coalesce("cited", F.lit(0)).desc(), "chunk_id")
    return seen.join(asked, "researcher").withColumn("pos", F.row_number().over(order)).where("pos <= 60")


@query("wn_first_seen", f"with {_RUN} select researcher, chunk_id, pos from run")
def wn_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1, WN3, SM2: chunks once each, ranked for each researcher asked about."""
    return asked_run(spark, sf_dir).select("researcher", "chunk_id", "pos")


@query(
    "wn_budget_pack",
    f"with {_RUN}, t as (select researcher, chunk_id, pos, greatest(1, (length(title) + least(length(text), 500) + 3) // 4) tok from run), c as (select *, sum(tok) over (partition by researcher order by pos) cum from t) select researcher, chunk_id, pos, cast(tok as bigint) tok, cast(cum as bigint) cum from c where pos <= 8 or cum <= 2000",
)
def wn_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN4, C4, FN38: the first chunks that fit a budget of tokens, eight at least."""
    tok = F.greatest(F.lit(1), F.floor((F.length("title") + F.least(F.length("text"), F.lit(500)) + 3) / 4)).cast("long")
    t = asked_run(spark, sf_dir).select("researcher", "chunk_id", "pos", tok.alias("tok"))
    c = t.withColumn("cum", F.sum("tok").over(Window.partitionBy("researcher").orderBy("pos")))
    return c.where((F.col("pos") <= 8) | (F.col("cum") <= 2000))


_PAIRS = "p as (select researcher, work_id, k, v from (select researcher, work_id, unnest(['topic', 'work_type', 'year']) k, unnest([topic, work_type, year]) v from run) where length(trim(v)) >= 3 and not regexp_matches(v, '^[0-9 .-]+$') group by all), n as (select researcher, k, v, count(*) n from p group by all), dd as (select researcher, count(distinct work_id) docs from run group by researcher)"


def _pairs(run: DataFrame) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("topic", "work_type", "year")))
    long = run.select("researcher", "work_id", F.explode(cells).alias("c")).select("researcher", "work_id", "c.k", "c.v")
    return long.where((F.length(F.trim("v")) >= 3) & ~F.col("v").rlike("^[0-9 .-]+$")).distinct()


@query(
    "ag_dominant_value",
    f"""with {_RUN}, {_PAIRS}, b as (select *, row_number() over (partition by researcher order by n desc, k, v) r from n), s as (select researcher, max(n) runner from b x where r > 1 and v <> (select v from b y where y.researcher = x.researcher and y.r = 1) group by researcher)
    select b.researcher, k, v, n, round(n / docs, 6) ratio, round((n - coalesce(runner, 0)) / docs, 6) margin, round(least(1.0, 0.85 * n / docs + 0.15 * greatest(0, (n - coalesce(runner, 0)) / docs)), 6) confidence from b join dd using (researcher) left join s using (researcher) where r = 1""",
)
def ag_dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, FN100, PF19, PF20, SM12: what most of a researcher's works have in common, and by what margin."""
    run = asked_run(spark, sf_dir)
    docs = run.groupBy("researcher").agg(F.count_distinct("work_id").alias("docs"))
    n = _pairs(run).groupBy("researcher", "k", "v").agg(F.count("*").alias("n"))
    ranked = n.groupBy("researcher").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "k", "v"))).alias("a")).withColumn("b", F.element_at("a", 1))
    runner = F.coalesce(-F.get(F.filter("a", lambda x: x["v"] != F.col("b.v")), F.lit(0))["m"], F.lit(0))
    x = ranked.select("researcher", "b.k", "b.v", (-F.col("b.m")).alias("n"), runner.alias("runner")).join(docs, "researcher")
    ratio, margin = F.col("n") / F.col("docs"), (F.col("n") - F.col("runner")) / F.col("docs")
    confidence = F.least(F.lit(1.0), 0.85 * ratio + 0.15 * F.greatest(F.lit(0.0), margin))
    return x.select("researcher", "k", "v", "n", F.round(ratio, 6).alias("ratio"), F.round(margin, 6).alias("margin"), F.round(confidence, 6).alias("confidence"))


@query(
    "ag_support_confidence",
    f"""with {_RUN}, s as (select researcher, count(*) docs, count(*) filter (contains({_NORM('text')}, {_NORM('topic')}) and coalesce(topic, '') <> '') hits, count(distinct topic) topics from run group by researcher)
    select researcher, docs, round(hits / docs, 6) support, case when docs <= 3 then 'weak' when hits / docs < 0.45 then 'inconsistent' when docs >= 8 then 'high' when docs >= 4 then 'medium' else 'low' end label, topics > 3 and topics * 2 > docs diverse from s""",
)
def ag_support_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15, AG23, FN19, C8: how far the chunks bear out their topic, and the label of confidence that follows."""
    hit = F.contains(T.norm(F.col("text")), T.norm(F.col("topic"))) & (F.coalesce("topic", F.lit("")) != "")
    s = asked_run(spark, sf_dir).groupBy("researcher").agg(F.count("*").alias("docs"), F.count_if(hit).alias("hits"), F.count_distinct("topic").alias("topics"))
    support = F.col("hits") / F.col("docs")
    label = F.when(F.col("docs") <= 3, "weak").when(support < 0.45, "inconsistent").when(F.col("docs") >= 8, "high").when(F.col("docs") >= 4, "medium").otherwise("low")
    return s.select("researcher", "docs", F.round(support, 6).alias("support"), label.alias("label"), ((F.col("topics") > 3) & (F.col("topics") * 2 > F.col("docs"))).alias("diverse"))


@query(
    "ag_balance",
    f"with {_RUN}, g as (select topic, researcher, chunk_id, row_number() over (partition by topic order by coalesce(cited, 0) desc, chunk_id) r, count(*) over (partition by topic) n from run where topic is not null), t as (select count(distinct topic) k from g) select topic, chunk_id, cast(r as int) r from g, t where r <= greatest(2, 400 // k)",
)
def ag_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: as many chunks from each topic, two at least, within four hundred."""
    run = asked_run(spark, sf_dir).where("topic is not null")
    cap = run.agg(F.greatest(F.lit(2), F.floor(F.lit(400) / F.count_distinct("topic"))).alias("cap"))
    ranked = run.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.coalesce("cited", F.lit(0)).desc(), "chunk_id")))
    return ranked.join(F.broadcast(cap), F.col("r") <= F.col("cap")).select("topic", "chunk_id", "r")


@query(
    "ag_researcher_evidence",
    f"with {_RUN}, t as (select researcher, title, min(pos) p from run where trim(title) <> '' group by researcher, title), l as (select researcher, list(title order by p, title)[:3] titles from t group by researcher) select researcher, count(*) n, any_value(titles) titles from run join l using (researcher) group by researcher",
)
def ag_researcher_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, QO15, QO16, FN95: for each researcher the number of chunks and the first three titles."""
    run = asked_run(spark, sf_dir)
    titles = run.where("trim(title) <> ''").groupBy("researcher", "title").agg(F.min("pos").alias("p")).groupBy("researcher").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("p", "title"))), lambda x: x["title"]), 1, 3).alias("titles"))
    return run.groupBy("researcher").agg(F.count("*").alias("n")).join(titles, "researcher").select("researcher", "n", "titles")


@query(
    "wn_context_breaks",
    f"with {_RUN}, o as (select topic, researcher, chunk_id, lag(researcher) over (partition by topic order by researcher, chunk_id) before from run where topic is not null) select topic, researcher, chunk_id, before is distinct from researcher header from o",
)
def wn_context_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN10, QO14: where a compact context begins a new researcher."""
    before = F.lag("researcher").over(Window.partitionBy("topic").orderBy("researcher", "chunk_id"))
    return asked_run(spark, sf_dir).where("topic is not null").select("topic", "researcher", "chunk_id", (~before.eqNullSafe(F.col("researcher"))).alias("header"))


@query(
    "pf_citations",
    """select openalex_id, concat_ws('. ', nullif(trim(authors_str), ''), '(' || coalesce(cast(publication_year as varchar), 'n.d.') || ')', '*' || coalesce(nullif(trim(title), ''), 'Untitled') || '*', nullif(trim(doi), '')) citation from normalized_works""",
)
def pf_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF25, PF26: citations of all works."""
    year = F.concat(F.lit("("), F.coalesce(F.col("publication_year").cast("string"), F.lit("n.d.")), F.lit(")"))
    title = F.concat(F.lit("*"), T.or_default(F.col("title"), "Untitled"), F.lit("*"))
    blank = lambda c: T.blank_to_null(F.trim(c))
    return table(spark, sf_dir, "normalized_works").select("openalex_id", F.concat_ws(". ", blank("authors_str"), year, title, blank("doi")).alias("citation"))


@query("pf_keyword_any", "select chunk_id, contains(text, 'lidar') lidar, contains(text, 'kriging') kriging from chunks where contains(text, 'lidar') or contains(text, 'kriging')")
def pf_keyword_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF17, FN8: chunks that hold a keyword; the filter is pushed to the scan."""
    has = {k: F.contains("text", F.lit(k)) for k in ("lidar", "kriging")}
    return table(spark, sf_dir, "chunks").where(has["lidar"] | has["kriging"]).select("chunk_id", *(v.alias(k) for k, v in has.items()))


@query(
    "pf_person_or_coauthor",
    "select chunk_id, researcher from chunks where researcher in ('Theodora Ingrid Sirasakek', 'Theodora Sirasakek', 'T. Sirasakek') or contains(su_researchers, 'Sirasakek')",
)
def pf_person_or_coauthor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF16, QO7, QO8: chunks by any variant of a name, or that list it among their people."""
    variants = ["Theodora Ingrid Sirasakek", "Theodora Sirasakek", "T. Sirasakek"]
    return table(spark, sf_dir, "chunks").where(F.col("researcher").isin(variants) | F.contains("su_researchers", F.lit("Sirasakek"))).select("chunk_id", "researcher")


# The questions that the hybrid ranking answers here.
QUESTIONS = {1: "Which studies of glacier erosion use lidar?", 2: "Who compares methane exposure by kriging?", 3: "What is known about vaccine policy and fieldwork?"}
_Q = "(values " + ", ".join(f"({k}, [{', '.join(repr(w) for w in ws)}])" for k, ws in {1: ["studies", "glacier", "erosion", "use", "lidar"], 2: ["compares", "methane", "exposure", "kriging"], 3: ["known", "vaccine", "policy", "fieldwork"]}.items()) + ") q(qid, toks)"


@query(
    "tk_hybrid_rank",
    f"""with d as (select chunk_id, any_value(chunk_type) chunk_type, any_value({_NORM("concat_ws(' ', title, topic, text)")}) hay from chunks group by chunk_id), h as (select chunk_id, chunk_type, regexp_extract_all(hay, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1) w from d),
    s as (select qid, chunk_id, round(len(list_filter(toks, lambda t: list_contains(w, t))) / len(toks) + 0.5 * case chunk_type when 'title_abstract' then 1.0 when 'keywords' then 0.3 else 0 end, 6) score from h, {_Q})
    select qid, chunk_id, score, cast(row_number() over (partition by qid order by score desc, chunk_id) as int) pos from s qualify pos <= 30""",
)
def tk_hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF22, FN9, and of TK4 and C2 the terms of words and chunk types only: the thirty chunks that answer each question best; words of a chunk are taken once for all questions."""
    chunks = table(spark, sf_dir, "chunks").select("chunk_id", "chunk_type", "title", "topic", "text").dropDuplicates(["chunk_id"])
    words = F.array_distinct(T.words(F.concat_ws(" ", "title", "topic", "text")))
    asked = spark.createDataFrame(list(QUESTIONS.items()), "qid int, question string").select("qid", T.relevance_tokens(F.col("question")).alias("toks"))
    bonus = F.when(F.col("chunk_type") == "title_abstract", 1.0).when(F.col("chunk_type") == "keywords", 0.3).otherwise(0.0)
    scored = chunks.select("chunk_id", words.alias("w"), bonus.alias("b")).crossJoin(F.broadcast(asked))  # three questions
    score = F.round(F.size(F.array_intersect("toks", "w")) / F.size("toks") + 0.5 * F.col("b"), 6)
    ranked = scored.select("qid", "chunk_id", score.alias("score")).withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")))
    return ranked.where("pos <= 30")


@query(
    "fn_person_strength",
    """with c as (select distinct researcher from chunks where trim(researcher) <> ''), p as (select distinct a.name from (select unnest(all_authors) a from normalized_works) where trim(a.name) <> ''),
    k as (select name, lower(string_split(name, ' ')[1]) f, lower(string_split(name, ' ')[-1]) l from p), r as (select researcher, lower(string_split(researcher, ' ')[1]) f, lower(string_split(researcher, ' ')[-1]) l from c)
    select name, researcher, case when k.f = r.f then 3 when k.f[1:1] = r.f[1:1] then 2 else 1 end strength from k join r using (l)""",
)
def fn_person_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN29, FN30: how strongly each author's name matches each researcher's; surnames are equi-joined, not all pairs compared."""
    part = lambda df, c: df.select(F.col(c), F.lower(F.element_at(F.split(c, " "), 1)).alias(f"f_{c}"), F.lower(F.element_at(F.split(c, " "), -1)).alias("l"))
    r = part(table(spark, sf_dir, "chunks").where("trim(researcher) <> ''").select("researcher").distinct(), "researcher")
    k = part(table(spark, sf_dir, "normalized_works").select(F.explode("all_authors.name").alias("name")).where("trim(name) <> ''").distinct(), "name")
    strength = F.when(F.col("f_name") == F.col("f_researcher"), 3).when(F.substring("f_name", 1, 1) == F.substring("f_researcher", 1, 1), 2).otherwise(1)
    return k.join(r, "l").select("name", "researcher", strength.alias("strength"))


# ---- graph

_WORK = "w as (select openalex_id, arg_max_null(struct_pack(a := all_authors, t := topics, r := referenced_works, title := title, y := publication_year, c := cited_by_count), struct_pack(u := updated_date, n := cited_by_count)) x from normalized_works group by openalex_id)"


def current_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest copy of each work."""
    n = table(spark, sf_dir, "normalized_works")
    x = F.struct(F.col("all_authors").alias("a"), F.col("topics").alias("t"), F.col("referenced_works").alias("r"), "title", F.col("publication_year").alias("y"), F.col("cited_by_count").alias("c"))
    return n.groupBy("openalex_id").agg(F.max_by(x, F.struct("updated_date", "cited_by_count")).alias("x")).select("openalex_id", "x.*")


def authored(works: DataFrame) -> DataFrame:
    return works.select("openalex_id", F.explode("a").alias("p")).where("p.id <> ''").select(F.col("p.id").alias("aid"), F.col("openalex_id").alias("wid"), F.col("p.name").alias("name"), F.col("p.is_su").alias("member")).dropDuplicates(["aid", "wid"])


@query("gr_authored", f"with {_WORK} select distinct a.id aid, openalex_id wid from (select openalex_id, unnest(x.a) a from w) where a.id <> ''")
def gr_authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, SC30, PF2: who wrote what."""
    return authored(current_works(spark, sf_dir)).select("aid", "wid")


@query("gr_has_topic", f"with {_WORK} select openalex_id wid, t.id tid, max(t.score) score from (select openalex_id, unnest(x.t) t from w) where t.id <> '' group by all")
def gr_has_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, PF5: topics of works, with their score."""
    t = current_works(spark, sf_dir).select(F.col("openalex_id").alias("wid"), F.explode("t").alias("t")).where("t.id <> ''")
    return t.groupBy("wid", F.col("t.id").alias("tid")).agg(F.max("t.score").alias("score"))


@query(
    "gr_collaborations",
    f"with {_WORK}, e as (select distinct a.id aid, openalex_id wid from (select openalex_id, unnest(x.a) a from w) where a.id <> '') select x.aid a1, y.aid a2, count(*) shared_works from e x join e y using (wid) where x.aid < y.aid group by all",
)
def gr_collaborations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: pairs of authors and the works they share; pairs stream out of a work's author list one by one and are counted map-side."""
    ids = current_works(spark, sf_dir).select(F.array_sort(F.array_distinct(F.filter(F.transform("a", lambda p: p["id"]), lambda i: i != ""))).alias("ids"))
    firsts = ids.select("ids", F.posexplode("ids").alias("i", "a1"))
    return firsts.select("a1", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("a2")).groupBy("a1", "a2").agg(F.count("*").alias("shared_works"))


@query(
    "gr_nodes",
    f"""with {_WORK} select 'Work' label, openalex_id oid, title "name", cast(coalesce(x.c, 0) as bigint) weight from (select openalex_id, x.title title, x from w) union all
    select 'Author', a.id, min(a.name), count(distinct openalex_id) from (select openalex_id, unnest(x.a) a from w) where a.id <> '' group by a.id union all select 'Topic', t.id, min(t.name), count(distinct openalex_id) from (select openalex_id, unnest(x.t) t from w) where t.id <> '' group by t.id""",
)
def gr_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM18-DM20: nodes of the graph, one a key, with their counts kept over all upserts."""
    w = current_works(spark, sf_dir)
    works = w.select(F.lit("Work").alias("label"), F.col("openalex_id").alias("oid"), F.col("title").alias("name"), F.coalesce("c", F.lit(0)).cast("long").alias("weight"))
    from_list = lambda c, label: w.select("openalex_id", F.explode(c).alias("p")).where("p.id <> ''").groupBy(F.col("p.id").alias("oid")).agg(F.min("p.name").alias("name"), F.count_distinct("openalex_id").alias("weight")).select(F.lit(label).alias("label"), "oid", "name", "weight")
    return works.unionByName(from_list("a", "Author")).unionByName(from_list("t", "Topic"))


@query(
    "gr_evidence_edges",
    f"""with {_RUN}, h as (select researcher, work_id, min(pos) p, arg_min_null(title, pos) title, arg_min_null(topic, pos) topic from run group by researcher, work_id qualify row_number() over (partition by researcher order by p, work_id) <= 40)
    select distinct 'WROTE' kind, researcher source, work_id target from h union all select distinct 'HAS_TOPIC', work_id, topic from h where coalesce(lower(trim(topic)), '') not in ('', 'n/a')""",
)
def gr_evidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF3, QO34, FN28: the edges WROTE and HAS_TOPIC of the graph of evidence (gr_evidence_graph has all of it): the first chunk of each of forty works a researcher, as typed edges."""
    first = asked_run(spark, sf_dir).groupBy("researcher", "work_id").agg(F.min("pos").alias("p"), F.min_by("topic", "pos").alias("topic"))
    hits = first.withColumn("r", F.row_number().over(Window.partitionBy("researcher").orderBy("p", "work_id"))).where("r <= 40")
    wrote = hits.select(F.lit("WROTE").alias("kind"), F.col("researcher").alias("source"), F.col("work_id").alias("target")).distinct()
    topics = hits.where(~F.coalesce(F.lower(F.trim("topic")), F.lit("")).isin("", "n/a")).select(F.lit("HAS_TOPIC").alias("kind"), F.col("work_id").alias("source"), F.col("topic").alias("target")).distinct()
    return wrote.unionByName(topics)


MOST_AUTHORS = 12  # of a paper in the graph of evidence, as in the surveyed system


def evidence_graph(hits: DataFrame, works: DataFrame) -> DataFrame:
    """(part, kind, source, target, label): nodes (source is the id) and edges of `hits`, each once; the least (p, researcher, work_id) gives a node its label.

    Hits have researcher, work_id, p, title and topic; authors are those of `works` (openalex_id, a), the first MOST_AUTHORS different
    names of each. Names that differ only in case are one node.
    """
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    names = F.filter(F.transform(F.coalesce("a", F.array()), lambda x: F.trim(x["name"])), lambda n: F.coalesce(n != "", F.lit(False)))
    lower = F.transform("names", lambda n: F.lower(n))
    first = F.filter("names", lambda n, i: F.array_position(lower, F.lower(n)) == i + 1)
    authors = works.select(F.col("openalex_id").alias("work_id"), names.alias("names")).select("work_id", F.slice(first, 1, MOST_AUTHORS).alias("authors"))
    h = hits.where(said("work_id") != "").join(authors, "work_id", "left").withColumn("researcher", said("researcher")).withColumn("topic", said("topic"))
    h = h.withColumn("paper", F.concat(F.lit("paper:"), "work_id")).withColumn("at", F.struct("p", "researcher", "work_id"))
    wrote = h.where("researcher <> ''").select("at", "paper", "researcher")
    topics = h.where("topic <> '' and lower(topic) <> 'n/a'").select("at", "paper", "topic")
    by = h.select("at", "paper", F.posexplode("authors").alias("n", "author"))
    node = lambda d, kind, key, label, n=F.lit(0): d.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), F.lower(key)).alias("source"), F.col(label).alias("label"), "at", n.alias("n"))
    title = F.when(said("title") != "", said("title")).otherwise(F.concat(F.lit("paper "), "work_id"))
    papers = h.select(F.lit("paper").alias("kind"), F.col("paper").alias("source"), title.alias("label"), "at", F.lit(0).alias("n"))
    nodes = papers.unionByName(node(wrote, "researcher", "researcher", "researcher")).unionByName(node(by, "author", "author", "author", F.col("n"))).unionByName(node(topics, "topic", "topic", "topic"))
    nodes = nodes.groupBy("kind", "source").agg(F.min_by("label", F.struct("at", "n")).alias("label"))
    edge = lambda d, kind, source, target: d.select(F.lit("edge").alias("part"), F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"), F.lit(None).cast("string").alias("label"))
    typed = lambda kind: F.concat(F.lit(f"{kind}:"), F.lower(F.col(kind)))
    edges = edge(wrote, "WROTE", typed("researcher"), F.col("paper")).unionByName(edge(by, "AUTHORED", typed("author"), F.col("paper"))).unionByName(edge(topics, "HAS_TOPIC", F.col("paper"), typed("topic"))).distinct()
    return nodes.select(F.lit("node").alias("part"), "kind", "source", F.lit(None).cast("string").alias("target"), "label").unionByName(edges)


@query(
    "gr_evidence_graph",
    f"""with {_RUN}, {_WORK}, h as (select trim(researcher) researcher, work_id, min(pos) p, trim(coalesce(arg_min_null(title, pos), '')) title, trim(coalesce(arg_min_null(topic, pos), '')) topic from run where trim(coalesce(work_id, '')) <> '' group by researcher, work_id qualify row_number() over (partition by researcher order by p, work_id) <= 40),
    a as (select openalex_id work_id, list_filter(list_transform(x.a, lambda y: trim(y.name)), lambda y: coalesce(y <> '', false)) ns from w), b as (select work_id, list_filter(ns, lambda y, i: list_position(list_transform(ns, lambda z: lower(z)), lower(y)) = i)[:{MOST_AUTHORS}] ns from a),
    au as (select h.*, unnest(ns) author, unnest(generate_series(0, len(ns) - 1)) n from h join b using (work_id)),
    e as (select p, researcher, work_id, 0 n, 'paper' kind, 'paper:' || work_id source, case when title <> '' then title else 'paper ' || work_id end label from h union all select p, researcher, work_id, 0, 'researcher', 'researcher:' || lower(researcher), researcher from h where researcher <> ''
      union all select p, researcher, work_id, 0, 'topic', 'topic:' || lower(topic), topic from h where topic <> '' and lower(topic) <> 'n/a' union all select p, researcher, work_id, n, 'author', 'author:' || lower(author), author from au)
    select 'node' part, kind, source, null target, first(label order by p, researcher, work_id, n) label from e group by kind, source
    union all select distinct 'edge', 'WROTE', 'researcher:' || lower(researcher), 'paper:' || work_id, null from h where researcher <> '' union all select distinct 'edge', 'AUTHORED', 'author:' || lower(author), 'paper:' || work_id, null from au
    union all select distinct 'edge', 'HAS_TOPIC', 'paper:' || work_id, 'topic:' || lower(topic), null from h where topic <> '' and lower(topic) <> 'n/a'""",
)
def gr_evidence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF3-TF5, QO34, FN28: the whole graph of evidence: nodes, and edges WROTE, AUTHORED and HAS_TOPIC, of forty works a researcher."""
    first = asked_run(spark, sf_dir).groupBy("researcher", "work_id").agg(F.min("pos").alias("p"), F.min_by("topic", "pos").alias("topic"), F.min_by("title", "pos").alias("title"))
    hits = first.withColumn("r", F.row_number().over(Window.partitionBy("researcher").orderBy("p", "work_id"))).where("r <= 40")
    return evidence_graph(hits, current_works(spark, sf_dir))
