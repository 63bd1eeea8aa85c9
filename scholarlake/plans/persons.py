"""Queries on the people that questions name: found by form and by lexicons of the corpus, matched to evidence, weighed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.plans.cluster import cut
from scholarlake.plans.texts import _COLL, _NORM, _STOP, _questions
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


# Words no name holds, endings of words that are no names, and words too general to search by.
NO_NAME = (
    "and but for nor yet not with without the from into onto upon over under about between through during before after above below studies study research using based toward towards within across among along "
    "new old how why what when where which does did has had was were are been"
).split()
NO_NAME_ENDING = "(?:tion|sion|ment|ness|ity|ship|isms?|ence|ance|ing|ed|ers?|ial|ive|ory|ics|ent|ular|ior|ary|ical|ise|ize|ous|ated|ised|ized)$"
GENERIC = "about again also anything anyone can could does else field give help him her it its know me more need other others please tell that them they those this what which who whom why work".split()
SPLITTERS = r"(?i)\b(?:and|vs\.?|versus|compared[ \t]+(?:to|with)|with)\b"
TOKEN = "([A-Za-z][A-Za-z.'-]*)"

_SQL_TOKEN = TOKEN.replace("'", "''")
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_LEXICON = """names as (select distinct unnest(regexp_extract_all(lower(authors), '([a-z]{2,})', 1)) token from papers where authors is not null), said as (select distinct token from (select regexp_replace(unnest(regexp_split_to_array("text", '[ \\t\\r\\n\\f\\x0B]+')), '[,.;:)?!]+$', '') token from chunks where "text" is not null) where regexp_matches(token, '^[a-z]{3,}$')),
lex as (select token, n.token is not null is_name, s.token is not null is_word from names n full join said s using (token))"""


@query("fn_lexicons", f"with {_LEXICON} select * from lex")
def fn_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN104, FN105: the words the corpus says in small letters, and the parts of its authors' names; distinct map-side before the shuffle."""
    each = lambda t, words: table(spark, sf_dir, t).select(F.explode(F.array_distinct(words)).alias("token"))
    names = each("papers", F.regexp_extract_all(F.lower("authors"), F.lit("([a-z]{2,})"), F.lit(1))).distinct().withColumn("n", F.lit(True))
    bare = F.transform(F.split("text", T.SPACE), lambda w: F.regexp_replace(w, "[,.;:)?!]+$", ""))
    said = each("chunks", F.filter(bare, lambda w: w.rlike("^[a-z]{3,}$"))).distinct().withColumn("w", F.lit(True))
    return names.join(said, "token", "full").select("token", F.col("n").isNotNull().alias("is_name"), F.col("w").isNotNull().alias("is_word"))


_TITLED = "case when regexp_matches(x, '^[A-Za-z][.]$') then upper(x) when x = lower(x) then upper(x[1:1]) || x[2:] else x end"
_PEOPLE = (
    lambda asked: f"""tk as (select qid, unnest(list_transform(list_transform(regexp_extract_all(q, '{_SQL_TOKEN}', 1), lambda y: regexp_replace(y, '(''s|'')$', '')), lambda x: {_TITLED})) tok, unnest(generate_series(1, len(regexp_extract_all(q, '{_SQL_TOKEN}', 1)))) i from {asked}),
 tl as (select qid, i, tok, lower(rtrim(tok, '.')) low, regexp_matches(tok, '^[A-Z][.]$') ini from tk),
 tf as (select tl.*, length(low) > 1 lexical, coalesce(is_name, false) nm, coalesce(is_word, false) wd, list_contains([{_LIST(NO_NAME)}, {_STOP}], low) or length(low) > 1 and (length(low) < 3 or list_contains([{_LIST(GENERIC)}], low)) or length(low) > 2 and tok = upper(tok) or length(low) > 3 and regexp_matches(tok, '^[a-z]') bad,
   length(low) >= 2 and regexp_matches(tok, '^[A-Z]') real, regexp_matches(low, '{NO_NAME_ENDING}') suf, case when list_contains([{_STOP}, {_LIST(GENERIC)}], low) or length(low) between 1 and 2 and length(low) > 0 and list_contains([{_STOP}], low) or length(low) = 0 then 2 when length(low) <= 2 then 1 else 0 end nb from tl left join lex on low = token),
 g as (select qid, list(struct_pack(tok := tok, low := low, ini := ini, lexical := lexical, nm := nm, wd := wd, bad := bad, "real" := real, suf := suf, nb := nb) order by i) ts from tf group by qid),
 wi as (select qid, ts, w, unnest(generate_series(1, len(ts) - w + 1)) s from g, (select unnest([2, 3, 4]) w) where len(ts) >= w),
 wv as (select qid, w, s, ts[s:s + w - 1] v, case when s > 1 then ts[s - 1].nb else 2 end + case when s + w <= len(ts) then ts[s + w].nb else 2 end nb, len(ts) between 2 and 4 and w = len(ts) whole from wi),
 wx as (select *, list_filter(v, lambda t: t.lexical) l, len(list_filter(v, lambda t: t.ini)) > 0 ini from wv),
 wy as (select *, len(l) n, len(list_filter(l, lambda t: t.nm)) n_nm, len(list_filter(l, lambda t: not t.nm and t.wd)) n_cm, len(list_filter(l, lambda t: not t.nm and not t.wd)) n_un, len(list_filter(l, lambda t: t.suf)) n_suf, len(list_filter(v, lambda t: t."real")) n_real, len(list_filter(v, lambda t: t.bad)) n_bad from wx),
 ok as (select *, array_to_string(list_transform(v, lambda t: t.tok), ' ') name from wy where n_bad = 0 and n > 0 and (n_real >= 2 or n_real = 1 and ini) and not (not ini and n_suf >= greatest(2, n - 1)) and not (not ini and n >= 2 and right(l[-1].low, 1) = 's' and n_suf > 0)
   and (ini or not (n_cm > 0 and n_nm = 0) and not (n_nm = 0 and n_un = 0) and not (n_nm = 1 and n_un = 0 and n >= 2 and not l[1].nm))),
 who as (select qid, name, cast(case w when 2 then 6 when 3 then 4 else 2 end + nb + case when ini then 1 else 0 end as int) score from ok qualify row_number() over (partition by qid order by whole desc, case w when 2 then 6 when 3 then 4 else 2 end + nb + case when ini then 1 else 0 end desc, w, s) = 1)"""
)


def people_named(questions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(qid, name, score): the likeliest name of a person in each question (qid, q), where it holds one.

    Windows of two to four words are judged by form and by votes of the lexicon, and ranked by width, what stands beside them and
    initials. Words are joined to the lexicon, so that it may be of any size; what is gathered is one question's words.
    """
    tidy = lambda x: F.regexp_replace(x, "('s|')$", "")
    titled = lambda x: F.when(x.rlike("^[A-Za-z][.]$"), F.upper(x)).when(x == F.lower(x), F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000))).otherwise(x)
    tk = questions.select("qid", F.posexplode(F.transform(F.regexp_extract_all("q", F.lit(TOKEN), F.lit(1)), lambda x: titled(tidy(x)))).alias("i", "tok"))
    low = F.lower(F.rtrim("tok", F.lit(".")))
    tl = tk.withColumn("low", low).join(lexicon.withColumnRenamed("token", "low"), "low", "left")
    n, stop, generic = F.length("low"), F.col("low").isin(T.STOPWORDS), F.col("low").isin(GENERIC)
    bad = F.col("low").isin(NO_NAME) | stop | ((n > 1) & ((n < 3) | generic)) | ((n > 2) & (F.col("tok") == F.upper("tok"))) | ((n > 3) & F.col("tok").rlike("^[a-z]"))
    word = F.struct(
        "i", "tok", "low", F.col("tok").rlike("^[A-Z][.]$").alias("ini"), (n > 1).alias("lexical"), F.coalesce("is_name", F.lit(False)).alias("nm"), F.coalesce("is_word", F.lit(False)).alias("wd"), bad.alias("bad"),
        ((n >= 2) & F.col("tok").rlike("^[A-Z]")).alias("real"), F.col("low").rlike(NO_NAME_ENDING).alias("suf"), F.when(stop | generic | (n == 0), 2).when(n <= 2, 1).otherwise(0).alias("nb"),
    )
    g = tl.groupBy("qid").agg(F.array_sort(F.collect_list(word)).alias("ts"))
    wi = g.select("qid", "ts", F.explode(F.array(*(F.lit(w) for w in (2, 3, 4)))).alias("w")).where(F.size("ts") >= F.col("w"))
    wi = wi.select("qid", "ts", "w", F.explode(F.sequence(F.lit(1), F.size("ts") - F.col("w") + 1)).alias("s"))
    beside = lambda i, there: F.when(there, F.get("ts", i - 1)["nb"]).otherwise(2)
    wv = wi.select(
        "qid", "w", "s", F.slice("ts", F.col("s"), F.col("w")).alias("v"), (beside(F.col("s") - 1, F.col("s") > 1) + beside(F.col("s") + F.col("w"), F.col("s") + F.col("w") <= F.size("ts"))).alias("nb"),
        (F.size("ts").between(2, 4) & (F.col("w") == F.size("ts"))).alias("whole"),
    )
    wx = wv.select("*", F.filter("v", lambda t: t["lexical"]).alias("l"), F.exists("v", lambda t: t["ini"]).alias("ini"))
    many = lambda a, test: F.size(F.filter(a, test))
    wy = wx.select(
        "*", F.size("l").alias("n"), many("l", lambda t: t["nm"]).alias("n_nm"), many("l", lambda t: ~t["nm"] & t["wd"]).alias("n_cm"), many("l", lambda t: ~t["nm"] & ~t["wd"]).alias("n_un"), many("l", lambda t: t["suf"]).alias("n_suf"),
        many("v", lambda t: t["real"]).alias("n_real"), many("v", lambda t: t["bad"]).alias("n_bad"), (F.lit(8) - 2 * F.col("w").cast("int") + 2 + F.col("nb") + F.col("ini").cast("int")).alias("score"),
    )
    form = "n_bad = 0 and n > 0 and (n_real >= 2 or n_real = 1 and ini) and not (not ini and n_suf >= greatest(2, n - 1)) and not (not ini and n >= 2 and right(element_at(l, -1).low, 1) = 's' and n_suf > 0)"
    votes = "(ini or not (n_cm > 0 and n_nm = 0) and not (n_nm = 0 and n_un = 0) and not (n_nm = 1 and n_un = 0 and n >= 2 and not l[0].nm))"
    ok = wy.where(form).where(votes).select("qid", F.struct("whole", "score", (-F.col("w")).alias("w"), (-F.col("s")).alias("s"), F.array_join(F.transform("v", lambda t: t["tok"]), " ").alias("name")).alias("x"))
    return ok.groupBy("qid").agg(F.max("x").alias("x")).select("qid", "x.name", "x.score")


_Q = "qq as (select doc_id qid, regexp_extract(text, '^Q: ([^\\n]*)', 1) q from documents where doc_kind = 'qa_pair' and text is not null)"


@query("fn_person_names", f"with {_LEXICON}, {_Q}, {_PEOPLE('qq')} select qid doc_id, name, score from who")
def fn_person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN23, FN73, FN15, PF39, TK8, C6: the person each question names, by form, lexicon and rank of the windows of its words."""
    q = _questions(spark, sf_dir).where("question is not null").select(F.col("doc_id").alias("qid"), F.col("question").alias("q"))
    return people_named(q, fn_lexicons(spark, sf_dir)).select(F.col("qid").alias("doc_id"), "name", "score")


_PARTS = f"""pp as (select doc_id, unnest(regexp_split_to_array(regexp_extract(text, '^Q: ([^\\n]*)', 1), '{SPLITTERS}')) q, unnest(generate_series(0, len(regexp_split_to_array(regexp_extract(text, '^Q: ([^\\n]*)', 1), '{SPLITTERS}')) - 1)) k from documents where doc_kind = 'qa_pair' and text is not null),
 qp as (select doc_id || '|' || k qid, q from pp)"""


@query("fn_comparison_people", f"with {_LEXICON}, {_PARTS}, {_PEOPLE('qp')} select cast(split_part(qid, '|', 1) as bigint) doc_id, cast(split_part(qid, '|', 2) as int) part, name from who where length(name) > 3")
def fn_comparison_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN74: questions split at and, versus and the like, and the person of each part."""
    parts = _questions(spark, sf_dir).where("question is not null").select("doc_id", F.posexplode(F.split("question", SPLITTERS)).alias("k", "q"))
    named = people_named(parts.select(F.concat_ws("|", "doc_id", "k").alias("qid"), "q"), fn_lexicons(spark, sf_dir)).where(F.length("name") > 3)
    id_ = F.split("qid", "[|]")
    return named.select(F.get(id_, F.lit(0)).cast("long").alias("doc_id"), F.get(id_, F.lit(1)).cast("int").alias("part"), "name")


# ---- evidence for a person

MOST_ASKED = 20_000  # persons asked about up to which they are broadcast

_GAP = r"(?: +[a-z][.]? *)* +"
_HAY = lambda c: _COLL(f"regexp_replace(lower(coalesce({c}, '')), '[,()\\[\\]]+', ' ', 'g')")
_FULL = f"(?:\\b' || f || '{_GAP}' || l || '\\b|\\b' || l || '{_GAP}' || f || '\\b)"
_INIT = f"(?:\\b' || f[1:1] || '[.]?{_GAP}' || l || '\\b|\\b' || l || '{_GAP}' || f[1:1] || '\\b)"
_STRENGTH = lambda h: f"case when regexp_matches({h}, '{_FULL}') or contains({h}, v1) or contains({h}, v2) then 3 when regexp_matches({h}, '{_INIT}') or contains({h}, v3) then 2 when regexp_matches({h}, '\\b' || l || '\\b') then 1 else 0 end"
_ASKED = """asked as (select distinct name, lower(k[1]) f, lower(k[-1]) l, lower(array_to_string(k, ' ')) v1, lower(k[1] || ' ' || array_to_string(list_transform(k[2:-2], lambda x: x[1:1] || '.'), ' ') || ' ' || k[-1]) v2, lower(k[1][1:1] || '. ' || array_to_string(list_transform(k[2:-2], lambda x: x[1:1] || '.'), ' ') || ' ' || k[-1]) v3 from (select name, regexp_extract_all(name, '([A-Za-z]+)', 1) k from (select distinct regexp_extract(text, '^Q: What does (.*) study in', 1) name from documents where doc_kind = 'qa_pair' and text is not null)) where len(k) >= 2 and len(regexp_extract_all(name, '[^\\x00-\\x7F]')) = 0)"""
_SCORED = f"""{_ASKED}, d as (select chunk_id, any_value(researcher) researcher, any_value(su_researchers) authors, any_value("text") "text", any_value(work_id) work_id from chunks group by chunk_id),
 h as (select chunk_id, work_id, {_HAY('researcher')} hr, {_HAY('authors')} ha, {_HAY('"text"')} ht from d), x as (select *, list_distinct(regexp_extract_all(hr || ' ' || ha || ' ' || ht, '([a-z]+)', 1)) ws from h), e as (select chunk_id, work_id, hr, ha, ht, unnest(ws) l from x),
 m as (select name, chunk_id, work_id, {_STRENGTH('hr')} r, {_STRENGTH('ha')} a, {_STRENGTH('ht')} c from e join asked using (l)),
 sc as (select name, chunk_id, work_id, cast(case when r = 3 then 4.0 when a = 3 then 3.0 when r = 2 then 2.0 when a = 2 then 1.5 when c = 3 then 1.2 when c = 2 then 1.0 when r = 1 then 0.3 when a = 1 then 0.2 when c = 1 then 0.15 else 0 end as double) score from m)"""


def _strength(hay: str) -> Column:
    """3 with the first name, 2 with its initial, 1 the surname alone, 0: how well a text (lower-case, punctuation blanked) names the person f, l.

    Other given names stand between as they are, or as initials (v1, v2 with the first name, v3 with its initial).
    """
    lit = F.lit
    f, l = F.col("f"), F.col("l")
    begin, end = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"  # of words of ASCII, as in the SQL
    full = F.concat(lit(f"(?:{begin}"), f, lit(_GAP), l, lit(f"{end}|{begin}"), l, lit(_GAP), f, lit(f"{end})"))
    i = F.substring("f", 1, 1)
    initial = F.concat(lit(f"(?:{begin}"), i, lit(r"[.]?" + _GAP), l, lit(f"{end}|{begin}"), l, lit(_GAP), i, lit(f"{end})"))
    h = F.col(hay)
    return F.when(F.rlike(h, full) | F.contains(h, "v1") | F.contains(h, "v2"), 3).when(F.rlike(h, initial) | F.contains(h, "v3"), 2).when(F.rlike(h, F.concat(lit(begin), l, lit(end))), 1).otherwise(0)


def person_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, chunk_id, work_id, score) of the chunks that name somebody asked about; candidates meet by their surnames, not all by all.

    Only keys and single words are joined to the surnames; texts come back, by key, for the chunks that have one. Of chunks of one
    id each field is the greatest, so that both readings see the same.
    """
    asked = _questions(spark, sf_dir).select(F.regexp_extract(F.concat(F.lit("Q: "), "question"), "^Q: What does (.*) study in", 1).alias("name")).distinct()
    k = T.name_tokens(F.col("name"))
    between = F.array_join(F.transform(F.slice(k, 2, F.greatest(F.size(k) - 2, F.lit(0))), lambda x: F.concat(F.substring(x, 1, 1), F.lit("."))), " ")
    asked = asked.where(~F.col("name").rlike(r"[^\x00-\x7F]") & (F.size(k) >= 2)).select(
        "name", F.lower(F.element_at(k, 1)).alias("f"), F.lower(F.element_at(k, -1)).alias("l"), F.lower(F.array_join(k, " ")).alias("v1"),
        F.lower(F.concat_ws(" ", F.element_at(k, 1), between, F.element_at(k, -1))).alias("v2"), F.lower(F.concat(F.substring(F.element_at(k, 1), 1, 1), F.lit(". "), F.concat_ws(" ", between, F.element_at(k, -1)))).alias("v3"),
    )
    hay = lambda c: T.collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[,()\[\]]+", " "))
    asked = cut(asked)
    few = asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED
    known = F.coalesce(F.concat(F.lit("="), "chunk_id"), F.lit("")).alias("key")  # chunks without an id are one
    one = table(spark, sf_dir, "chunks").groupBy(known).agg(*(F.max(c).alias(c) for c in ("chunk_id", "work_id", "researcher", "su_researchers", "text")))
    d = one.select("key", "chunk_id", "work_id", hay(F.col("researcher")).alias("hr"), hay(F.col("su_researchers")).alias("ha"), hay(F.col("text")).alias("ht"))
    words = d.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "hr", "ha", "ht"), F.lit("([a-z]+)"), F.lit(1)))).alias("l"))
    met = words.join(F.broadcast(asked) if few else asked, "l")
    m = d.join(met, "key").select("name", "chunk_id", "work_id", _strength("hr").alias("r"), _strength("ha").alias("a"), _strength("ht").alias("c"))
    ladder = [("r", 3, 4.0), ("a", 3, 3.0), ("r", 2, 2.0), ("a", 2, 1.5), ("c", 3, 1.2), ("c", 2, 1.0), ("r", 1, 0.3), ("a", 1, 0.2), ("c", 1, 0.15)]
    score = F.coalesce(*(F.when(F.col(c) == n, F.lit(s)) for c, n, s in ladder), F.lit(0.0))
    return m.select("name", "chunk_id", "work_id", score.alias("score"))


@query("tk_person_evidence", f"""with {_SCORED}, n as (select name, bool_or(score >= 2) strong, bool_or(score >= 1) matched from sc group by name)
  select name, chunk_id, round(score, 2) score, cast(row_number() over (partition by name order by case when strong and score >= 2 then 0 when (strong or matched) and score >= 1 then 1 else 2 end, score desc, work_id, chunk_id) as int) k from sc join n using (name) qualify k <= 12""")
def tk_person_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN29, FN30, FN31, WN13, WN14, JN20, QO8, TK7, C5: chunks scored by how they name a person, the strong before the matched before the weak, twelve each."""
    order = Window.partitionBy("name").orderBy(F.desc("score"), "work_id", "chunk_id")  # 2 or more is strong and 1 or more matched, so that tiers stand as scores do
    return person_scores(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k <= 12").select("name", "chunk_id", F.round("score", 2).alias("score"), "k")


_DOWN = "case {0} when 'high' then 'medium' when 'medium' then 'low' when 'low' then 'weak' else {0} end"


@query("ag_person_support", f"""with {_SCORED}, s as (select name, count(*) total, count(*) filter (score >= 2) strong, count(*) filter (score >= 1) matched from sc group by name),
  a as (select *, case when total <= 3 then 'weak' when total >= 8 then 'high' else 'medium' end first_label from s), b as (select *, case when matched = 0 then 'weak' when first_label = 'high' and matched < 4 and (strong / total < 0.3 or matched / total < 0.5) then 'medium' else first_label end x from a),
  c as (select *, case when x in ('high', 'medium') and strong < 2 and strong / total < 0.1 and matched / total < 0.3 and matched > 0 then {_DOWN.format('x')} else x end y from b)
  select name, total, strong, matched, first_label, case when y in ('medium', 'low') and matched < 2 and matched / total < 0.15 and matched > 0 then {_DOWN.format('y')} else y end label from c""")
def ag_person_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN19, FN20, FN21: the confidence in the evidence for a person, stepped down where little of it names that person well."""
    s = person_scores(spark, sf_dir).groupBy("name").agg(F.count("*").alias("total"), F.count_if(F.col("score") >= 2).alias("strong"), F.count_if(F.col("score") >= 1).alias("matched"))
    down = lambda c: F.when(c == "high", "medium").when(c == "medium", "low").when(c == "low", "weak").otherwise(c)
    first = F.when(F.col("total") <= 3, "weak").when(F.col("total") >= 8, "high").otherwise("medium")
    strong, matched = F.col("strong") / F.col("total"), F.col("matched") / F.col("total")
    a = s.withColumn("first_label", first)
    b = a.withColumn("x", F.when(F.col("matched") == 0, "weak").when((F.col("first_label") == "high") & (F.col("matched") < 4) & ((strong < 0.3) | (matched < 0.5)), "medium").otherwise(F.col("first_label")))
    c = b.withColumn("y", F.when(F.col("x").isin("high", "medium") & (F.col("strong") < 2) & (strong < 0.1) & (matched < 0.3) & (F.col("matched") > 0), down(F.col("x"))).otherwise(F.col("x")))
    last = F.when(F.col("y").isin("medium", "low") & (F.col("matched") < 2) & (matched < 0.15) & (F.col("matched") > 0), down(F.col("y"))).otherwise(F.col("y"))
    return c.select("name", "total", "strong", "matched", "first_label", last.alias("label"))


# ---- what a question is about

_SHIFTS = "switch topic|different topic|new topic|unrelated|change subject|another area|instead let's discuss"
_QWORDS = lambda q: f"regexp_extract_all({_NORM(q)}, '([a-z0-9]+(?:[''.-][a-z0-9]+)?)', 1)"
_SIGNALS = f"""sg as (select qid, q, {_QWORDS('q')} ws, len(regexp_extract_all(q, '"[^"]{{3,120}}"')) > 0 quoted, len(regexp_extract_all(q, '(?:^|[ (])([A-Z]{{2,6}}[0-9]*)(?:[ ,.;)?]|$)', 1)) > 0 acronym from qq),
 st as (select *, list_filter(ws, lambda w: length(w) >= 4 and not list_contains([{_STOP}, {_LIST(GENERIC)}], w)) tw from sg), sd as (select *, list_filter(tw, lambda w, i: list_position(tw, w) = i) topics from st)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir).where("question is not null").select(F.col("doc_id").alias("qid"), F.col("question").alias("q"))
    telling = lambda w: (F.length(w) >= 4) & ~w.isin(T.STOPWORDS + GENERIC)
    return q.select(
        "qid", "q", T.words(F.col("q")).alias("ws"), (F.size(F.regexp_extract_all("q", F.lit('("[^"]{3,120}")'), F.lit(1))) > 0).alias("quoted"),
        (F.size(F.regexp_extract_all("q", F.lit("(?:^|[ (])([A-Z]{2,6}[0-9]*)(?:[ ,.;)?]|$)"), F.lit(1))) > 0).alias("acronym"),
    ).withColumn("topics", F.array_distinct(F.filter("ws", telling)))


_SHORT = f"(len(ws) < 8 or regexp_matches(lower(q), '{T.PRONOUNS}') or regexp_matches(lower(q), '{T.GOING_ON}'))"


@query(
    "fn_question_focus",
    f"""with {_LEXICON}, {_Q}, {_PEOPLE('qq')}, {_SIGNALS}, f as (select sd.*, name, array_to_string(topics[:4], ' ') focus from sd left join who using (qid))
    select qid doc_id, focus, focus = '' or len(topics) = 0 invalid, name is not null or quoted or acronym or len(topics) >= 2 entity, {_SHORT} short, case when name is not null and len(ws) <= greatest(6, len(regexp_extract_all(lower(name), '([a-z]+)', 1)) + 3) then '' else focus end topic,
      cast(case when {_SHORT} then 120 else 60 end as int) k, cast(case when {_SHORT} then 300 else 150 end as int) fetch_k from f""",
)
def fn_question_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN77, FN78, FN101, PF36, SM16, TK10: what a question is about, whether that will do, whether it names anything, and how wide to search."""
    people = fn_person_names(spark, sf_dir).select(F.col("doc_id").alias("qid"), "name")
    f = _signals(spark, sf_dir).join(people, "qid", "left").withColumn("focus", F.array_join(F.slice("topics", 1, 4), " "))
    short = (F.size("ws") < 8) | T.follow_up(F.col("q"))
    named = F.col("name").isNotNull()
    only = named & (F.size("ws") <= F.greatest(F.lit(6), F.size(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]+)"), F.lit(1))) + 3))
    return f.select(
        F.col("qid").alias("doc_id"), "focus", (F.col("focus") == "").alias("invalid"), (named | F.col("quoted") | F.col("acronym") | (F.size("topics") >= 2)).alias("entity"), short.alias("short"),
        F.when(only, "").otherwise(F.col("focus")).alias("topic"), F.when(short, 120).otherwise(60).alias("k"), F.when(short, 300).otherwise(150).alias("fetch_k"),
    )


_CONV = "cv as (select source || '|' || strftime(ingested_at, '%Y-%m-%d') session, doc_id qid from documents where source is not null and ingested_at is not null and doc_kind = 'qa_pair' and text is not null)"


@query(
    "qo_context",
    f"""with {_LEXICON}, {_Q}, {_PEOPLE('qq')}, {_SIGNALS}, {_CONV}, j as (select session, qid, q, ws, topics, name, last_value(name ignore nulls) over (partition by session order by qid rows between unbounded preceding and 1 preceding) anchor, lag(q) over (partition by session order by qid) previous from cv join sd using (qid) left join who using (qid)),
    s as (select *, regexp_matches(lower(q), '{T.RESET_COMMAND.replace("'", "''")}') or regexp_matches(lower(q), '{_SHIFTS.replace("'", "''")}') or anchor is not null and name is not null and lower(anchor) <> lower(name) shift from j)
    select session, qid doc_id, coalesce(shift, false) shift, case when shift then null else anchor end anchor,
      (case when not coalesce(shift, false) and anchor is not null and name is null and (regexp_matches(lower(q), '{T.PRONOUNS}') or regexp_matches(lower(q), '{T.GOING_ON}')) then rtrim(q, '?') || ' for ' || anchor || '?' when len(topics) = 0 and previous is not null and not coalesce(shift, false) then q || ' ' || previous else q end)[:220] resolved,
      name is null and (shift or anchor is null) and regexp_matches(lower(q), '\\b(he|she|they|him|her|them|his|hers|their|theirs)\\b') and len(topics) < 2 dangling from s""",
)
def qo_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QO2, QO3, QO4, QO5, SM14, PF38: each question in its conversation: whether it shifts the topic, whom it goes on about, how it reads by itself (the stand-in for a model leaves it as it is), whether a pronoun is left hanging.

    Windows run inside a conversation, a source's questions of one day.
    """
    d = table(spark, sf_dir, "documents").where("source is not null and ingested_at is not null and doc_kind = 'qa_pair' and text is not null")
    cv = d.select(F.concat_ws("|", "source", F.date_format("ingested_at", "yyyy-MM-dd")).alias("session"), F.col("doc_id").alias("qid"))
    people = fn_person_names(spark, sf_dir).select(F.col("doc_id").alias("qid"), "name")
    order = Window.partitionBy("session").orderBy("qid")
    j = cv.join(_signals(spark, sf_dir), "qid").join(people, "qid", "left")
    j = j.withColumn("anchor", F.last("name", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("previous", F.lag("q").over(order))
    q = F.lower("q")
    other = F.col("anchor").isNotNull() & F.col("name").isNotNull() & (F.lower("anchor") != F.lower("name"))
    s = j.withColumn("shift", F.coalesce(T.meta_command(F.col("q")) | q.rlike(_SHIFTS) | other, F.lit(False)))
    carried = ~F.col("shift") & F.col("anchor").isNotNull() & F.col("name").isNull() & T.follow_up(F.col("q"))
    resolved = F.when(carried, F.concat(F.rtrim("q", F.lit("?")), F.lit(" for "), "anchor", F.lit("?"))).when((F.size("topics") == 0) & F.col("previous").isNotNull() & ~F.col("shift"), F.concat_ws(" ", "q", "previous")).otherwise(F.col("q"))
    hanging = F.col("name").isNull() & (F.col("shift") | F.col("anchor").isNull()) & q.rlike(r"\b(he|she|they|him|her|them|his|hers|their|theirs)\b") & (F.size("topics") < 2)
    return s.select("session", F.col("qid").alias("doc_id"), "shift", F.when(~F.col("shift"), F.col("anchor")).alias("anchor"), F.substring(resolved, 1, 220).alias("resolved"), hanging.alias("dangling"))
