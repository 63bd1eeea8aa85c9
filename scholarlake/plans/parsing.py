"""Queries that read structure out of texts, labels and file names, and fill tables from what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import parse as P
from scholarlake.functions import text as T
from scholarlake.operators import quality
from scholarlake.plans.relational import _BLANK, _PAPERS, current_papers
from scholarlake.plans.texts import _DOI, _REPAIR, _STRIP
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


_ARXIV = lambda c: f"regexp_replace(regexp_replace(regexp_replace(coalesce({_REPAIR(c)}, ''), '(?i)^https?://arxiv\\.org/(abs|pdf)/|^[ \\t]*arxiv[ \\t]*:[ \\t]*', '', 'g'), '(?i)\\.pdf[ \\t]*$', ''), '[ .,;:\\])}}>\"'']+$', '')"
_WORDS = lambda c: f"len(list_filter(regexp_split_to_array({c}, '[ \\t\\r\\n\\f\\x0B]+'), lambda w: w <> ''))"
_DIGITS = lambda c: f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"
_DUMMY = lambda c: f"({c} = '' or length({c}) > 240 or regexp_matches({c}, '{P.DUMMY_PREFIX}') or regexp_matches({c}, '{P.BAD_TITLE}') or {_WORDS(c)} < 4 or {_DIGITS(c)} > 12)"
_TITLEISH = lambda c: f"length({c}) between 10 and 240 and {_WORDS(c)} between 4 and 50 and not {_DUMMY(c)}"
_AUTHORISH = lambda c: (
    f"length({c}) between 6 and 280 and not regexp_matches({c}, '{P.ABSTRACT}') and not regexp_matches({c}, '{P.SECTION}') and not regexp_matches(lower({c}), '{P.PLACES}') and {_DIGITS(c)} <= 6 "
    f"and regexp_matches(lower({c}), '[,;]| and ') and len(list_filter(regexp_split_to_array({c}, '[;,]'), lambda t: trim(t) <> '')) >= 2"
)
_LINES = f"""l as (select id, file_name, full_text, list_filter(list_transform(string_split(full_text[:80000], chr(10))[:800], lambda x: {_REPAIR(f"regexp_replace({_REPAIR('x')}, '{P.NO_LINE}', '')")}),
  lambda x: x <> '' and not regexp_matches(x, '{P.EMAIL}') and not regexp_matches(lower(x), '{P.LINK_LINE}')) ls from works where trim(full_text) <> ''),
 a as (select *, coalesce(nullif(coalesce(list_position(list_transform(ls[:600], lambda x: regexp_matches(x, '{P.ABSTRACT}')), true), 0), 0), coalesce(list_position(list_transform(ls[:600], lambda x: regexp_matches(x, '{P.SECTION}')), true), 0)) mark from l),
 w as (select *, case when mark > 0 then ls[greatest(1, mark - 20):mark + 4] else ls[:200] end win from a),
 t as (select *, coalesce(list_filter(win[:80], lambda x: {_TITLEISH('x')})[1], list_filter(ls[:120], lambda x: {_TITLEISH('x')})[1], '') title from w),
 u as (select *, case when title <> '' then list_position(ls, title) else 0 end pos from t),
 f as (select id, file_name, full_text, title, coalesce(case when pos > 0 then list_filter(ls[pos + 1:pos + 59], lambda x: {_AUTHORISH('x')})[1] end, list_filter(win[:60], lambda x: {_AUTHORISH('x')})[1], '') authors from u)"""
_FIELDS = f"""g as (select id, title, authors, {_DOI(f"coalesce(nullif(regexp_extract(full_text[:40000], '{P.DOI}', 1), ''), regexp_extract(full_text[:40000], '{P.DOI_LINK}', 1))")} doi,
  coalesce(nullif({_ARXIV(f"coalesce(nullif(regexp_extract(full_text[:60000], '{P.ARXIV}', 1), ''), regexp_extract(full_text[:60000], '{P.ARXIV_LINK}', 1))")}, ''), '') arxiv_id,
  coalesce(nullif(regexp_extract(full_text[:20000], '{P.YEAR_BESIDE}', 1), ''), cast(list_max(list_transform(regexp_extract_all(full_text[:20000], '{T.YEAR}', 1), lambda y: cast(y as int))) as varchar), '') "year" from f)"""


@query(
    "fn_fulltext_fields",
    f"""with {_LINES}, {_FIELDS} select *, case when authors <> '' and length(trim(string_split(authors, ',')[1])) between 2 and 80 then trim(string_split(authors, ',')[1]) else '' end researcher,
    concat_ws(' | ', case when doi <> '' then 'DOI: ' || doi end, case when arxiv_id <> '' then 'arXiv: ' || arxiv_id end, case when "year" <> '' then 'Date: ' || "year" end) info from g""",
)
def fn_fulltext_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN49, FN50, FN51, FN52, FN53, FN54, FN55: title, authors, identifiers and year read from each full text, line by line."""
    return P.fulltext_fields(table(spark, sf_dir, "works"))


@query(
    "fn_header_extract",
    f"""with l as (select id, full_text, list_filter(string_split(full_text, chr(10)), lambda x: trim(x) <> '') ls from works where trim(full_text) <> ''), m as (select *, list_transform(ls[:20], lambda x: trim(regexp_extract(x, '{P.AUTHOR_LINE}', 1))) a, list_transform(ls[:3], lambda x: trim(regexp_extract(x, '{P.BY_LINE}', 1))) b from l)
    select id, trim(ls[1]) title, coalesce(list_filter(a, lambda x: x <> '')[1], list_filter(b, lambda x: x <> '')[1], '') authors, full_text[:1000] info from m where len(ls) > 0""",
)
def fn_header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN43: first line, authors by `Author(s):` in twenty lines, else `By …` in three, and the first thousand characters."""
    ls = F.filter(F.split("full_text", "\n"), lambda x: F.trim(x) != "")
    named = lambda n, pattern: F.get(F.filter(F.transform(F.slice("ls", 1, n), lambda x: F.trim(F.regexp_extract(x, pattern, 1))), lambda x: x != ""), F.lit(0))
    w = table(spark, sf_dir, "works").where("trim(full_text) <> ''").select("id", "full_text", ls.alias("ls")).where("size(ls) > 0")
    return w.select("id", F.trim(F.get("ls", F.lit(0))).alias("title"), F.coalesce(named(20, P.AUTHOR_LINE), named(3, P.BY_LINE), F.lit("")).alias("authors"), F.substring("full_text", 1, 1000).alias("info"))


_FILE_ID = _ARXIV(f"coalesce(nullif(regexp_extract(s, '{P.ARXIV}', 1), ''), s)")


@query(
    "fn_file_ids",
    f"""with s as (select id, replace(replace(regexp_replace(string_split(replace({_REPAIR('file_name')}, '\\', '/'), '/')[-1], '\\.[A-Za-z0-9]{{1,5}}$', ''), '_', ' '), '-', ' ') s from works where file_name is not null), a as (select id, s, {_FILE_ID} a from s)
    select id, s stem, case when regexp_matches(a, '{P.ARXIV_WHOLE}') then a else '' end arxiv_id from a""",
)
def fn_file_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN48: preprint ids in file names."""
    w = table(spark, sf_dir, "works").where("file_name is not null").select("id", P.file_stem(F.col("file_name")).alias("stem"))
    found = T.arxiv(F.coalesce(F.nullif(F.regexp_extract("stem", P.ARXIV, 1), F.lit("")), F.col("stem")))
    return w.select("id", "stem", F.when(found.rlike(P.ARXIV_WHOLE), found).otherwise("").alias("arxiv_id"))


# ---- filling


@query(
    "dm_fill_records",
    f"""with {_PAPERS} select r.id, case when trim(r.work_title) <> '' then r.work_title else nullif(trim(p.title), '') end work_title, case when trim(r.authors) <> '' then r.authors else nullif(trim(p.authors), '') end authors,
    case when trim(r.doi) <> '' then r.doi else nullif(trim(p.doi), '') end doi, case when trim(r.publication_date) <> '' then r.publication_date else nullif(trim(p.publication_date), '') end publication_date from research_info r left join papers_now p using (paper_id)""",
)
def dm_fill_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM2, DM3, SC26: blanks of records filled from their papers, the other way round of dm_fill_papers."""
    columns = ["work_title", "authors", "doi", "publication_date"]
    p = current_papers(spark, sf_dir).select("paper_id", *(T.blank_to_null(F.trim(c)).alias(n) for c, n in zip(["title", "authors", "doi", "publication_date"], columns)))
    return quality.fill_blank(table(spark, sf_dir, "research_info").select("id", "paper_id", *columns), p, "paper_id", columns).select("id", *columns)


@query(
    "dm_unique_arxiv",
    f"""with {_PAPERS}, {_LINES}, {_FIELDS}, x as (select w.paper_id, min(g.arxiv_id) a from g join works w using (id) where g.arxiv_id <> '' and w.paper_id is not null group by w.paper_id), taken as (select distinct trim(arxiv_id) v from papers_now where trim(arxiv_id) <> ''),
    claims as (select a, min(x.paper_id) paper_id from x join papers_now p using (paper_id) where {_BLANK('p.arxiv_id')} and a not in (select v from taken) group by a), one as (select paper_id, min(a) a from claims group by paper_id)
    select p.paper_id, case when trim(p.arxiv_id) <> '' then p.arxiv_id else one.a end arxiv_id from papers_now p left join one using (paper_id)""",
)
def dm_unique_arxiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, JN11, DM4: preprint ids read from full texts, filled in where blank and held by no other paper; case counts."""
    read = fn_fulltext_fields(spark, sf_dir).where("arxiv_id <> ''").select("id", "arxiv_id")
    offers = read.join(table(spark, sf_dir, "works").where("paper_id is not null").select("id", "paper_id"), "id").groupBy("paper_id").agg(F.min("arxiv_id").alias("arxiv_id"))
    return quality.fill_unique(current_papers(spark, sf_dir).select("paper_id", "arxiv_id"), offers, "paper_id", "arxiv_id", cased=True)


@query(
    "dm_parse_fill",
    f"""with {_PAPERS}, {_LINES}, {_FIELDS}, m as (select w.paper_id, arg_min(struct_pack(t := g.title, a := g.authors, y := g."year"), g.id) x from g join works w using (id) where w.paper_id is not null group by w.paper_id),
    c as (select paper_id, case when {_DUMMY('x.t')} then null else x.t end t, case when regexp_matches(x.a, '{P.EMAIL}') then null else nullif(x.a, '') end a, case when regexp_matches(x.y, '^(19|20)[0-9]{{2}}$') then x.y end y from m)
    select p.paper_id, case when trim(title) <> '' then title else t end title, case when trim(authors) <> '' then authors else a end authors, case when trim(publication_date) <> '' then publication_date else y end publication_date from papers_now p left join c using (paper_id)""",
)
def dm_parse_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM4, DM5, PF23: papers filled from what their full texts say; dummy titles, mail addresses for authors and what is no year are dropped."""
    works = table(spark, sf_dir, "works").where("paper_id is not null").select("id", "paper_id")
    one = fn_fulltext_fields(spark, sf_dir).join(works, "id").groupBy("paper_id").agg(F.min_by(F.struct("title", "authors", "year"), "id").alias("x")).select("paper_id", "x.*")
    clean = one.select(
        "paper_id", F.when(~P.dummy_title(F.col("title")), F.col("title")).alias("title"), F.when(~F.col("authors").rlike(P.EMAIL), F.nullif("authors", F.lit(""))).alias("authors"),
        F.when(F.col("year").rlike("^(19|20)[0-9]{2}$"), F.col("year")).alias("publication_date"),
    )
    columns = ["title", "authors", "publication_date"]
    return quality.fill_blank(current_papers(spark, sf_dir).select("paper_id", *columns), clean, "paper_id", columns)


@query(
    "dm_external_fill",
    f"""with {_PAPERS}, x as (select {_DOI('doi')} k, arg_max(struct_pack(t := title, d := publication_date, a := list_transform(all_authors[:20], lambda p: p.name)), coalesce(updated_date, '') || openalex_id) x from normalized_works where trim(doi) <> '' group by k),
    j as (select p.*, x.x.t xt, x.x.d xd, array_to_string(x.x.a, ', ') xa from papers_now p left join x on {_DOI('p.doi')} = x.k and trim(p.doi) <> '')
    select paper_id, case when trim(title) <> '' then title else nullif(trim(xt), '') end title, case when trim(authors) <> '' then authors else nullif(trim(xa), '') end authors, case when trim(publication_date) <> '' then publication_date else nullif(trim(xd), '') end publication_date from j""",
)
def dm_external_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM6, DM7, SC42: papers filled from another source's record of their DOI, with twenty authors at most; a join with the lookup table in place of requests."""
    key = T.doi(F.col("doi"))
    latest = F.max_by(F.struct("title", "publication_date", F.transform(F.slice("all_authors", 1, 20), lambda p: p["name"]).alias("people")), F.concat(F.coalesce("updated_date", F.lit("")), "openalex_id"))
    lookup = table(spark, sf_dir, "normalized_works").where("trim(doi) <> ''").groupBy(key.alias("k")).agg(latest.alias("x"))
    told = lookup.select("k", T.blank_to_null(F.trim("x.title")).alias("title"), T.blank_to_null(F.trim(F.array_join("x.people", ", "))).alias("authors"), T.blank_to_null(F.trim("x.publication_date")).alias("publication_date"))
    columns = ["title", "authors", "publication_date"]
    p = current_papers(spark, sf_dir).withColumn("k", F.when(F.trim("doi") != "", key))
    return quality.fill_blank(p.select("paper_id", "k", *columns), told, "k", columns).select("paper_id", *columns)


@query(
    "dm_model_fill",
    f"""with {_PAPERS}, w as (select paper_id, arg_min(full_text[:12000], id) t from works where paper_id is not null and trim(full_text) <> '' group by paper_id),
    j as (select p.paper_id, title, authors, 'Give title, authors and date as JSON.' || chr(10) || t prompt, {{'title': {_STRIP("string_split(t, chr(10))[1]")}[:200]}}::json answer from papers_now p join w using (paper_id) where {_BLANK('title')} or {_BLANK('authors')})
    select paper_id, cast(length(prompt) as bigint) n_prompt, case when trim(title) <> '' then title else nullif(json_extract_string(answer, '$.title'), '') end title from j""",
)
def dm_model_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM8, DM9, FN56, FN57: only papers that still lack something are asked about; of the answer the first object's fields are read. The stand-in for the model gives the first line as the title."""
    w = table(spark, sf_dir, "works").where("paper_id is not null and trim(full_text) <> ''").groupBy("paper_id").agg(F.min_by(F.substring("full_text", 1, 12_000), "id").alias("t"))
    j = current_papers(spark, sf_dir).where(T.missing(F.col("title")) | T.missing(F.col("authors"))).join(w, "paper_id")
    prompt = F.concat(F.lit("Give title, authors and date as JSON.\n"), "t")
    answer = F.concat(F.lit("Sure: "), F.to_json(F.struct(F.substring(T.strip(F.get(F.split("t", "\n"), F.lit(0))), 1, 200).alias("title"))))
    read = F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), "title string")["title"]
    return j.select("paper_id", F.length(prompt).cast("long").alias("n_prompt"), F.coalesce(T.blank_to_null(F.col("title")), F.nullif(read, F.lit(""))).alias("title"))


@query(
    "dm_absent_files",
    "with k as (select distinct file_name from works where file_name is not null and summary_status = 'summarized') select id, file_name from works where file_name is not null and file_name not in (select file_name from k)",
)
def dm_absent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DM13, JN18, SC8: texts whose file isn't among those done already, by file name."""
    w = table(spark, sf_dir, "works").where("file_name is not null")
    return w.select("id", "file_name").join(w.where("summary_status = 'summarized'").select("file_name").distinct(), "file_name", "left_anti")


# ---- labels and records


@query(
    "fn_topic_labels",
    """with t as (select openalex_id, updated_date, unnest(topics) t from normalized_works), l as (select distinct openalex_id, updated_date, coalesce(regexp_extract(t.id, '([0-9]+)', 1), '') || ': ' || t.name label, t.score score from t where t.name is not null),
    r as (select *, row_number() over (partition by openalex_id, updated_date order by score desc, label) k from l qualify k <= 10)
    select openalex_id, updated_date, cast(k as int) k, try_cast(nullif(regexp_extract(label, '^[ \\t]*([0-9]+)[ \\t]*:', 1), '') as int) num, trim(regexp_replace(label, '^[ \\t]*[0-9]*[ \\t]*:[ \\t]*', '')) name, round(score, 4) score from r""",
)
def fn_topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN62, FN63, FN65, TK6: labels `number: name` ranked by score, ten a work, packed to JSON and read back, and taken apart."""
    t = table(spark, sf_dir, "normalized_works").select("openalex_id", "updated_date", F.explode("topics").alias("t")).where("t.name is not null")
    label = F.concat(F.coalesce(F.regexp_extract("t.id", "([0-9]+)", 1), F.lit("")), F.lit(": "), "t.name")
    order = F.struct((-F.col("t.score")).alias("down"), label.alias("label"), F.col("t.score").alias("score"))
    ranked = t.groupBy("openalex_id", "updated_date").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list(order))), 1, 10).alias("top"))  # the topics of one work
    packed = F.to_json(F.transform("top", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))))
    back = ranked.select("openalex_id", "updated_date", F.posexplode(F.from_json(packed, "array<struct<label:string,score:double>>")).alias("i", "x"))
    return back.select(
        "openalex_id", "updated_date", (F.col("i") + 1).alias("k"), F.nullif(F.regexp_extract("x.label", r"^[ \t]*([0-9]+)[ \t]*:", 1), F.lit("")).cast("int").alias("num"),
        F.trim(F.regexp_replace("x.label", r"^[ \t]*[0-9]*[ \t]*:[ \t]*", "")).alias("name"), F.round("x.score", 4).alias("score"),
    )


_LABELLED = [("Title", "title"), ("Researcher", "researcher_name"), ("Authors", "authors"), ("Date", "publication_date"), ("DOI", "doi"), ("Topic", "primary_topic"), ("Info", "info")]


@query(
    "pf_labelled_documents",
    f"""with {_PAPERS}, j as (select r.id, r.paper_id, coalesce(nullif(trim(r.work_title), ''), nullif(trim(p.title), '')) title, r.researcher_name, r.authors, r.publication_date, r.doi, r.primary_topic, r.info from research_info r left join papers_now p using (paper_id))
    select id, cast(paper_id as varchar) paper_id, coalesce(title, '') title, coalesce(regexp_extract(publication_date, '{T.YEAR}', 1), '') "year", coalesce(trim(researcher_name), '') researcher, concat_ws(chr(10), {", ".join(f"case when trim({c}) <> '' then '{n}: ' || trim({c}) end" for n, c in _LABELLED)}) document
    from j where paper_id is not null and (title is not null or trim(info) <> '')""",
)
def pf_labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF27, SC29, PF30: records as labelled documents with their metadata; those without an id, a title or a text are none."""
    p = current_papers(spark, sf_dir).select("paper_id", F.col("title").alias("paper_title"))
    j = table(spark, sf_dir, "research_info").join(p, "paper_id", "left").withColumn("title", F.coalesce(T.blank_to_null(F.trim("work_title")), T.blank_to_null(F.trim("paper_title"))))
    lines = [F.when(F.trim(c) != "", F.concat(F.lit(f"{n}: "), F.trim(c))) for n, c in _LABELLED]
    return j.where("paper_id is not null and (title is not null or trim(info) <> '')").select(
        "id", F.col("paper_id").cast("string").alias("paper_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.regexp_extract("publication_date", T.YEAR, 1), F.lit("")).alias("year"),
        F.coalesce(F.trim("researcher_name"), F.lit("")).alias("researcher"), F.concat_ws("\n", *lines).alias("document"),
    )


_SECTION_NAMES = {"title": "Title", "researcher": "Researcher", "doi": "DOI", "link": "Link", "summary": "Summary", "abstract": "Summary"}


@query(
    "fn_summary_sections",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, unnest(generate_series(1, len(string_split(text, chr(10))))) i from documents where doc_kind = 'record' and trim(text) <> ''), m as (select doc_id, i, trim(line) line, lower(regexp_extract(trim(line), '^([A-Za-z ]+):', 1)) k from l where trim(line) <> ''),
    s as (select *, sum(case when regexp_matches(line, '^[A-Za-z ]+:') then 1 else 0 end) over (partition by doc_id order by i) g from m), h as (select doc_id, g, max(case k {' '.join(f"when '{a}' then '{b}'" for a, b in _SECTION_NAMES.items())} end) section from s where regexp_matches(line, '^[A-Za-z ]+:') group by all),
    v as (select s.doc_id, h.section, s.i, trim(ltrim(case when regexp_matches(line, '^[A-Za-z ]+:') then regexp_replace(line, '^[A-Za-z ]+:[ \\t]*', '') else line end, '- ')) val from s join h using (doc_id, g) where section is not null)
    select doc_id, section, section || ': ' || array_to_string(list(val order by i), ' | ') said from v where val <> '' group by doc_id, section""",
)
def fn_summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN79, FN80: `Label:` lines with their aliases and the lines below them, section by section, and written out again."""
    d = table(spark, sf_dir, "documents").where("doc_kind = 'record' and trim(text) <> ''")
    m = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "i", F.trim("line").alias("line")).where("line <> ''")
    head = F.col("line").rlike("^[A-Za-z ]+:")
    order = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = F.create_map(*(F.lit(x) for kv in _SECTION_NAMES.items() for x in kv))
    s = m.withColumn("section", F.last(F.when(head, F.coalesce(F.get(F.array(names[F.lower(F.regexp_extract("line", "^([A-Za-z ]+):", 1))]), F.lit(0)), F.lit(""))), ignorenulls=True).over(order)).where("section <> ''")
    val = F.trim(F.ltrim(F.when(head, F.regexp_replace("line", r"^[A-Za-z ]+:[ \t]*", "")).otherwise(F.col("line")), F.lit("- ")))
    v = s.select("doc_id", "section", "i", val.alias("val")).where("val <> ''")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "val"))), lambda x: x["val"]), " | ")  # the lines of one section
    return v.groupBy("doc_id", "section").agg(F.concat(F.col("section"), F.lit(": "), said).alias("said"))


def _first(c: Column, n: int) -> Column:
    return F.slice(c, 1, n)


@query(
    "fn_summary_keywords",
    """with w as (select openalex_id, updated_date, list_filter(list_transform(keywords, lambda k: trim(k)), lambda k: length(k) >= 4) ks from normalized_works), d as (select *, list_filter(ks, lambda k, i: list_position(list_transform(ks, lambda x: lower(x)), lower(k)) = i)[:4] four from w)
    select openalex_id, updated_date, rtrim(array_to_string(four, ' ')[:180], ' ') themes from d""",
)
def fn_summary_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN81: up to four themes of four letters or more, each once whatever its case, 180 characters at most."""
    ks = F.filter(F.transform("keywords", lambda k: F.trim(k)), lambda k: F.length(k) >= 4)
    w = table(spark, sf_dir, "normalized_works").select("openalex_id", "updated_date", ks.alias("ks")).withColumn("low", F.transform("ks", lambda k: F.lower(k)))
    once = F.filter("ks", lambda k, i: F.array_position(F.col("low"), F.lower(k)) == i + 1)
    return w.select("openalex_id", "updated_date", F.rtrim(F.substring(F.array_join(_first(once, 4), " "), 1, 180)).alias("themes"))


@query(
    "fn_summary_query",
    """with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') ls from documents where doc_kind in ('record', 'summary') and trim(text) <> ''), t as (select doc_id, array_to_string(ls[-3:], ' ') tail from l where len(ls) > 0)
    select doc_id, case when length(tail) > 320 then rtrim(tail[:319], ' ') || '…' else tail end asked from t""",
)
def fn_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN82: the last three lines of a summary as a query, 320 characters at most."""
    ls = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = table(spark, sf_dir, "documents").where("doc_kind in ('record', 'summary') and trim(text) <> ''").select("doc_id", ls.alias("ls")).where("size(ls) > 0")
    tail = F.array_join(F.slice("ls", F.greatest(F.size("ls") - 2, F.lit(1)), F.lit(3)), " ")
    return d.select("doc_id", tail.alias("tail")).select("doc_id", F.when(F.length("tail") > 320, F.concat(F.rtrim(F.substring("tail", 1, 319)), F.lit("…"))).otherwise(F.col("tail")).alias("asked"))
