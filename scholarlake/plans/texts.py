"""Queries on single texts: cleaning, extraction and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.functions import parse as P
from scholarlake.functions import text as T
from scholarlake.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_SP = r"[ \t\r\n\f\x0B]+"
_NORM = lambda c: f"coalesce(regexp_replace(regexp_replace(lower({c}), '{_SP}', ' ', 'g'), '^ | $', '', 'g'), '')"
_STRIP = lambda c: f"regexp_replace({c}, '^{_SP}|{_SP}$', '', 'g')"
_COLL = lambda c: f"regexp_replace(regexp_replace({c}, '{_SP}', ' ', 'g'), '^ | $', '', 'g')"
_QUESTION = "regexp_extract(text, '^Q: ([^\\n]*)', 1)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_kind = 'qa_pair'").select("doc_id", F.regexp_extract("text", r"^Q: ([^\n]*)", 1).alias("question"))


@query("fn_norm_text", f"select id, {_NORM('work_title')} normed, {_COLL('work_title')} collapsed from research_info")
def fn_norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1, FN2: titles normalised, and with white space collapsed."""
    return table(spark, sf_dir, "research_info").select("id", T.norm(F.col("work_title")).alias("normed"), T.collapse(F.col("work_title")).alias("collapsed"))


@query("fn_clean_html", "select id, regexp_replace(work_title, '</?[a-zA-Z][^>]*>', '', 'g') untagged, regexp_replace(work_title, '<[^>]+>', '', 'g') bare from research_info where work_title like '%<%'")
def fn_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN3, FN4: marked-up titles without their tags."""
    marked = table(spark, sf_dir, "research_info").where(F.col("work_title").contains("<"))
    return marked.select("id", T.without_tags(F.col("work_title")).alias("untagged"), T.without_any_tags(F.col("work_title")).alias("bare"))


@query(
    "fn_title_case",
    f"""with r as (select id, {_STRIP("regexp_replace(work_title, '</?[a-zA-Z][^>]*>', '', 'g')")} raw from research_info where work_title is not null)
    select id, case when regexp_matches(raw[2:], '[A-Z]') and regexp_matches(raw, '[a-z]') then raw
      else array_to_string(list_transform(regexp_extract_all(raw, '([A-Za-z]+|[^A-Za-z]+)', 1), lambda x: upper(x[1:1]) || lower(x[2:])), '') end titled from r""",
)
def fn_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN5: titles in title case unless in mixed case already."""
    return table(spark, sf_dir, "research_info").where("work_title is not null").select("id", T.title_case(F.col("work_title")).alias("titled"))


@query(
    "fn_top_terms",
    f"""with w as (select unnest(regexp_extract_all({_NORM('text')}, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1)) term from chunks)
    select term, count(*) n from w where length(term) >= 4 group by term order by n desc, term limit 100""",
)
def fn_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN6, AG10: the hundred most frequent words of four letters or more; counted map-side before the shuffle."""
    terms = table(spark, sf_dir, "chunks").select(F.explode(T.words(F.col("text"))).alias("term")).where(F.length("term") >= 4)
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(100)


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = lambda c: f"list_filter(regexp_extract_all({_COLL(f'''regexp_replace(lower({c}), '{T.INSTITUTION_WORDS}', '', 'g')''')}, '([a-z0-9-]{{2,}})', 1), lambda x: length(x) >= 3 and not list_contains([{_STOP}], x))"


@query("fn_relevance_tokens", f"with t as (select id, {_TOKENS('info')} a from research_info where info is not null) select id, list_filter(a, lambda x, i: list_position(a, x) = i) tokens from t")
def fn_relevance_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN7, FN103: the telling words of each record's description."""
    return table(spark, sf_dir, "research_info").where("info is not null").select("id", T.relevance_tokens(F.col("info")).alias("tokens"))


@query(
    "fn_sentences",
    f"""with s as (select chunk_id, text, list_filter(string_split(regexp_replace({_STRIP('text')}, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') ss from chunks where text is not null)
    select chunk_id, cast(len(ss) as int) n_sentences, cast(floor(len(list_filter(regexp_split_to_array(text, '{_SP}'), lambda x: x <> '')) * 1.3::double) as bigint) tokens,
      greatest(1, cast(floor((length(text) + 3) / 4) as bigint)) fast_tokens from s""",
)
def fn_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN37, FN38, FN39: sentences and estimated tokens of each chunk."""
    c = F.col("text")
    return table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", F.size(T.sentences(c)).alias("n_sentences"), T.token_estimate(c).alias("tokens"), T.fast_token_estimate(c).alias("fast_tokens"))


@query(
    "fn_truncate",
    f"""with h as (select chunk_id, text, text[:200] head from chunks where text is not null), c as (select *, {_STRIP("regexp_replace(head, '(?s)[.][^.]*$', '')")} cut from h)
    select chunk_id, case when length(text) <= 200 then text when cut <> '' then cut || '...' else rtrim(head, ' ') || '...' end short from c""",
)
def fn_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11: chunks cut to 200 characters at a full stop."""
    return table(spark, sf_dir, "chunks").where("text is not null").select("chunk_id", T.truncated(F.col("text"), 200).alias("short"))


@query(
    "fn_ids_years",
    """select openalex_id, trim(string_split(doi, '/')[-1]) tail, try_cast(nullif(regexp_extract(publication_date, '\\b((?:19|20)[0-9]{2})\\b', 1), '') as int) year_named,
    coalesce(nullif(trim(primary_researcher), ''), 'N/A') researcher from normalized_works""",
)
def fn_ids_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN34, FN35, FN36, PF28, PF30: last part of a link, year of a date, default for what is blank."""
    w = table(spark, sf_dir, "normalized_works")
    return w.select("openalex_id", T.id_tail(F.col("doi")).alias("tail"), T.year_of(F.col("publication_date")).alias("year_named"), T.or_default(F.col("primary_researcher"), "N/A").alias("researcher"))


@query(
    "fn_summary_section",
    f"""with a as (select doc_id, regexp_extract(text, '(?is)(?:^|\\n)Summary:[ \\t\\r\\n]*(.*)', 1) s from documents where doc_kind = 'record' and text is not null)
    select doc_id, {_COLL("lower(regexp_replace(regexp_replace(s, '(?is)(?:^|\\n)[A-Za-z][A-Za-z _]*(?:\\([^)]*\\))?[ \\t]*:.*', ''), '</?[a-zA-Z][^>]*>', '', 'g'))")} summary from a""",
)
def fn_summary_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN13: the summary inside record texts."""
    records = table(spark, sf_dir, "documents").where("doc_kind = 'record' and text is not null")
    return records.select("doc_id", T.summary_section(F.col("text")).alias("summary"))


_REPAIR = lambda c: _COLL(f"regexp_replace(regexp_replace(regexp_replace(replace({c}, chr(0), ''), '(?is)<math[^>]*>.*?</math>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g')")
_DOI = lambda c: (
    f"lower(regexp_replace(regexp_replace(regexp_replace(coalesce({_REPAIR(c)}, ''), '(?i)^https?://(dx\\.)?doi\\.(org|example)/', ''), '(?i)^[ \\t]*doi[ \\t]*:[ \\t]*', ''), '[ .,;:\\])}}>\"'']+$', ''))"
)


@query(
    "fn_identifiers",
    f"select id, {_DOI('doi')} doi_norm, {_REPAIR('work_title')} title_norm from research_info",
)
def fn_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN44, FN45, FN47, FN58: DOIs and titles in normal form."""
    return table(spark, sf_dir, "research_info").select("id", T.doi(F.col("doi")).alias("doi_norm"), T.repair_norm(F.col("work_title")).alias("title_norm"))


@query(
    "fn_arxiv_ids",
    f"""with a as (select paper_id, ingested_at, arxiv_id, regexp_replace(regexp_replace(regexp_replace(coalesce({_REPAIR('arxiv_id')}, ''), '(?i)^https?://arxiv\\.org/(abs|pdf)/|^[ \\t]*arxiv[ \\t]*:[ \\t]*', '', 'g'), '(?i)\\.pdf[ \\t]*$', ''), '[ .,;:\\])}}>\"'']+$', '') x from papers)
    select paper_id, ingested_at, x arxiv_norm, regexp_matches(x, '^(?:[0-9]{{4}}\\.[0-9]{{4,5}}(?:v[0-9]+)?|[a-z-]+(?:\\.[A-Z]{{2}})?/[0-9]{{7}}(?:v[0-9]+)?)$') valid from a""",
)
def fn_arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN46, PF24: preprint ids in normal form, and whether they are valid."""
    return table(spark, sf_dir, "papers").select("paper_id", "ingested_at", T.arxiv(F.col("arxiv_id")).alias("arxiv_norm"), T.valid_arxiv(F.col("arxiv_id")).alias("valid"))


@query(
    "fn_fulltext_parse",
    """with w as (select id, full_text t, full_text[:40000] slab, full_text[:20000] head from works where full_text is not null),
    y as (select id, slab, regexp_extract(head, '(?is)\\b(?:published|accepted|received|copyright)\\b.{0,60}?\\b((?:19|20)[0-9]{2})\\b', 1) ctx, list_max(list_transform(regexp_extract_all(head, '\\b((?:19|20)[0-9]{2})\\b', 1), lambda x: cast(x as int))) top from w)
    select id, coalesce(try_cast(nullif(ctx, '') as int), top) pub_year, lower(regexp_replace(regexp_extract(slab, '(10\\.[0-9]{4,9}/[^ \\t\\r\\n"''<>]+)', 1), '[.,;:\\])}]+$', '')) doi_found from y""",
)
def fn_fulltext_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN51: publication year and DOI read from full texts."""
    w = table(spark, sf_dir, "works").where("full_text is not null").select("id", F.col("full_text").alias("t"))
    head, slab = F.substring("t", 1, 20_000), F.substring("t", 1, 40_000)
    context = F.regexp_extract(head, r"(?is)\b(?:published|accepted|received|copyright)\b.{0,60}?\b((?:19|20)[0-9]{2})\b", 1)
    top = F.array_max(F.transform(F.regexp_extract_all(head, F.lit(T.YEAR), F.lit(1)), lambda y: y.cast("int")))
    found = F.regexp_extract(slab, "(10\\.[0-9]{4,9}/[^ \\t\\r\\n\"'<>]+)", 1)
    return w.select("id", F.coalesce(F.nullif(context, F.lit("")).cast("int"), top).alias("pub_year"), F.lower(F.regexp_replace(found, r"[.,;:\])}]+$", "")).alias("doi_found"))


@query(
    "fn_header_parse",
    f"""with l as (select id, list_filter(string_split(full_text, chr(10)), lambda x: trim(x) <> '') ls from works where full_text is not null)
    select id, trim(ls[1]) first_line, trim(regexp_extract(array_to_string(ls[:20], chr(10)), '(?i)(?:^|\\n)Author\\(?s?\\)?:[ \\t]*([^\\n]*)', 1)) authors_line from l where len(ls) > 0""",
)
def fn_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN43 in part: first line and author line of full texts."""
    lines = F.filter(F.split("full_text", "\n"), lambda x: F.trim(x) != "")
    w = table(spark, sf_dir, "works").where("full_text is not null").select("id", lines.alias("ls")).where("size(ls) > 0")
    top = F.array_join(F.slice("ls", 1, 20), "\n")
    return w.select("id", F.trim(F.element_at("ls", 1)).alias("first_line"), F.trim(F.regexp_extract(top, r"(?i)(?:^|\n)Author\(?s?\)?:[ \t]*([^\n]*)", 1)).alias("authors_line"))


_PLACE = ", ".join(f"'{w}'" for w in T.PLACEHOLDERS)


@query(
    "fn_title_checks",
    f"""with t as (select id, work_title, coalesce({_STRIP('work_title')}, '') s, regexp_replace(lower(coalesce(work_title, '')), '[^a-z0-9]+', '', 'g') c from research_info)
    select id, s = '' or length(s) > 240 or regexp_matches(s, '{P.DUMMY_PREFIX}') or regexp_matches(s, '{P.BAD_TITLE}')
      or len(list_filter(regexp_split_to_array(s, '{_SP}'), lambda x: x <> '')) < 4 or length(regexp_replace(s, '[^0-9]', '', 'g')) > 12 dummy, c = '' or c in ({_PLACE}) placeholder from t""",
)
def fn_title_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF20, PF21, PF23: titles that are none, and values that stand for a missing one."""
    return table(spark, sf_dir, "research_info").select("id", P.dummy_title(F.col("work_title")).alias("dummy"), T.placeholder(F.col("work_title")).alias("placeholder"))


@query(
    "fn_name_variants",
    """with p as (select distinct authors from papers where trim(authors) <> ''), n as (select distinct unnest(list_filter(list_transform(regexp_split_to_array(authors, '[ \\t]*[;,][ \\t]*|[ \\t]+and[ \\t]+'), lambda x: regexp_replace(trim(x), '[ \\t\\r\\n]+', ' ', 'g')), lambda x: length(x) >= 2)) name from p),
    t as (select name, regexp_extract_all(name, '([A-Za-z]+)', 1) k from n), m as (select *, k[1] f, k[-1] l, k[2:-2] mid from t where len(k) >= 2),
    v as (select name, (case when len(mid) > 0 then [f || ' ' || array_to_string(mid, ' ') || ' ' || l, f || ' ' || array_to_string(list_transform(mid, lambda x: x[1:1] || '.'), ' ') || ' ' || l, f[1:1] || '. ' || array_to_string(list_transform(mid, lambda x: x[1:1] || '.'), ' ') || ' ' || l] else [] end) || [f || ' ' || l, f[1:1] || '. ' || l, f[1:1] || ' ' || l] a from m)
    select name, list_filter(a, lambda x, i: list_position(a, x) = i) variants from v""",
)
def fn_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN25, FN26, FN27, C7: every author with the ways to write the name."""
    names = table(spark, sf_dir, "papers").where("trim(authors) <> ''").select("authors").distinct().select(F.explode(T.split_authors(F.col("authors"))).alias("name")).distinct()
    return names.withColumn("k", T.name_tokens(F.col("name"))).where("size(k) >= 2").select("name", T.name_variants(F.col("k")).alias("variants"))


@query("fn_short_hash", f"select id, sha256({_NORM('work_title')})[1:12] hash, regexp_replace(trim(researcher_name), '(''s|’s|''|’)$', '') owner from research_info")
def fn_short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN24, FN32: a short hash of the normalised title; names without a possessive ending."""
    return table(spark, sf_dir, "research_info").select("id", T.short_hash(F.col("work_title")).alias("hash"), T.without_possessive(F.col("researcher_name")).alias("owner"))


@query(
    "fn_topics_json",
    """select id, json_extract_string(topics_json, '$[0].topic') top_topic, try_cast(json_extract_string(topics_json, '$[0].score') as double) top_score, cast(coalesce(json_array_length(topics_json), 0) as int) n_topics,
      concat(upper(coalesce(nullif(regexp_extract(subject, '([A-Za-z0-9]+)', 1), ''), 'Unknown')[1:1]), coalesce(nullif(regexp_extract(subject, '([A-Za-z0-9]+)', 1), ''), 'Unknown')[2:]) subject_word from research_info where topics_json is not null""",
)
def fn_topics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN64, FN66: topics unpacked from JSON; unreadable JSON gives none."""
    parsed = F.from_json("topics_json", "array<struct<topic:string,score:double>>")
    word = F.coalesce(F.nullif(F.regexp_extract("subject", "([A-Za-z0-9]+)", 1), F.lit("")), F.lit("Unknown"))
    r = table(spark, sf_dir, "research_info").where("topics_json is not null").select("id", parsed.alias("p"), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1000)).alias("subject_word"))
    return r.select("id", F.get("p", F.lit(0))["topic"].alias("top_topic"), F.get("p", F.lit(0))["score"].alias("top_score"), F.coalesce(F.size("p"), F.lit(0)).alias("n_topics"), "subject_word")


@query("fn_json_props", "select event_id, try_cast(json_extract_string(props, '$.k') as int) k from events")
def fn_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN56, FN66: one property of each event."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("fn_pdf_clean", f"select id, {_COLL(f'''regexp_replace(regexp_replace(full_text, '{_SP}', ' ', 'g'), '[^A-Za-z0-9 .,;:()%-]', '', 'g')''')} cleaned from works where full_text is not null")
def fn_pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN42: full texts reduced to letters, digits and basic punctuation."""
    w = table(spark, sf_dir, "works").where("full_text is not null")
    return w.select("id", T.collapse(F.regexp_replace(F.regexp_replace("full_text", _SP, " "), "[^A-Za-z0-9 .,;:()%-]", "")).alias("cleaned"))


@query(
    "fn_tagger_input",
    """with p as (select paper_id, arg_max_null(title, ingested_at) title from papers group by paper_id), w as (select paper_id, arg_min_null(summary, id) summary, arg_min_null(full_text, id) full_text from (select * from works where paper_id is not null) group by paper_id),
    x as (select w.paper_id, coalesce(nullif(trim(title), ''), '') t, coalesce(nullif(trim(summary), ''), full_text[:3000], '') a from w left join p using (paper_id))
    select paper_id, case when t <> '' and a <> '' then '<TITLE> ' || t || ' <ABSTRACT> ' || a when t <> '' then '<TITLE> ' || t when a <> '' then '<ABSTRACT> ' || a else '' end input from x""",
)
def fn_tagger_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN59, FN60, FN61, JN3: what a tagger reads of each work: title and summary, else the start of the text."""
    titles = table(spark, sf_dir, "papers").groupBy("paper_id").agg(F.max_by("title", "ingested_at").alias("title"))
    one = table(spark, sf_dir, "works").where("paper_id is not null").groupBy("paper_id").agg(F.min_by("summary", "id").alias("summary"), F.min_by(F.substring("full_text", 1, 3000), "id").alias("start"))
    t, a = F.coalesce(T.blank_to_null(F.trim("title")), F.lit("")), F.coalesce(T.blank_to_null(F.trim("summary")), F.col("start"), F.lit(""))
    x = one.join(titles, "paper_id", "left").select("paper_id", t.alias("t"), a.alias("a"))
    return x.select("paper_id", F.concat_ws(" ", F.when(F.col("t") != "", F.concat(F.lit("<TITLE> "), "t")), F.when(F.col("a") != "", F.concat(F.lit("<ABSTRACT> "), "a"))).alias("input"))


@query(
    "fn_intents",
    f"""with q as (select doc_id, coalesce(lower({_QUESTION}), '') q from documents where doc_kind = 'qa_pair')
    select doc_id, case when regexp_matches(q, '{T.COMPARISON}') then 'comparison' when regexp_matches(q, '{T.TIME_RANGE}') then 'time_range' when regexp_matches(q, '{T.LISTING}') then 'list' else 'default' end intent,
      case when regexp_matches(q, '{T.COUNT_QUESTION}') then 'corpus_count' when regexp_matches(q, '{T.NEWEST_QUESTION}') then 'most_recent' when regexp_matches(q, '{T.OLDEST_QUESTION}') then 'oldest' else '' end meta,
      regexp_matches(q, '{T.PRONOUNS}') or regexp_matches(q, '{T.GOING_ON}') follow_up, regexp_matches(q, '{T.SUMMARY_QUESTION}') summary from q""",
)
def fn_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF31, PF33, PF35, PF37: how the questions of the corpus are to be answered."""
    q = F.col("question")
    return _questions(spark, sf_dir).select("doc_id", T.intent(q).alias("intent"), T.meta_query(q).alias("meta"), T.follow_up(q).alias("follow_up"), T.summary_intent(q).alias("summary"))
