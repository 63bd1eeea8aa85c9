"""Column functions on text. All stay on the JVM and inside whole-stage code generation where Spark allows it.

Character classes are written out in ASCII, so that results don't depend on a dialect's idea of words and digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words, generic question words, and words that stand for a missing value.
STOPWORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with you your"
).split()
PLACEHOLDERS = ["na", "nslasha", "unknown", "none", "null", "nil", "empty", "unspecified", "notavailable", "notapplicable", "notprovided", "tbd", "untitled", "notitle", "notitled", "unnamed"]
INSTITUTION_WORDS = r"\b(university|faculty|professor|researcher|department|college|school|campus|institute)\b"

# The patterns by which questions are told apart, over text in small letters.
COUNT_QUESTION = r"\b(how many|number of|count of|total)\b.{0,40}\b(papers?|documents?|records?|articles?|corpus|entries|items)\b"
NEWEST_QUESTION = r"\b(most recent|newest|latest|last)\b.{0,30}\b(paper|document|record|article|publication)\b"
OLDEST_QUESTION = r"\b(oldest|earliest|first)\b.{0,30}\b(paper|document|record|article|publication)\b"
RESET_COMMAND = r"^[ \t]*(switch topic|change (?:the )?(?:subject|topic)|new topic|different topic|start over|let'?s? (?:talk|discuss) (?:about )?something else|never ?mind|forget (?:it|that)|reset|clear (?:context|history|conversation)|move on|next topic)[ \t]*[.!?]?[ \t]*$"
COMPARISON = r"\b(compar[a-z]*|differ[a-z]*|versus|vs|similarit[a-z]*)\b"
TIME_RANGE = r"\b(when +(did|was|were|is)|(what|which) +(year|time period|date range|time range|time frame))\b"
LISTING = r"\b(who|what|which) +else\b|^(identify|list|name|find|suggest|show)\b|\b(who|what) +(are|were|study|studies|work +on|works? +in)\b|\bshow +me\b|^which\b"
PRONOUNS = r"\b(he|she|they|him|her|them|his|hers|their|theirs|it|its|this|that|these|those)\b"
GOING_ON = "what about|how about|tell me more|anything else|who else|what else"
SUMMARY_QUESTION = (
    r"\b(summarize|summarise|summary|summaries|abstract|overview|describe|what (does|do|did|is|are) .{0,40} (research|study|work|paper|finding|mechanism|about)|"
    r"mechanisms? described|findings? (in|from)|what (mechanisms?|findings?))\b"
)
ESCAPE_QUESTION = (
    r"\b(who else|what else|other (researchers?|faculty|people|authors?|scientists?)|others|besides|apart from|different (from|researcher|faculty)|not .{0,30} but|"
    r"also (stud(y|ies)|work|research)|anyone else|somebody else|someone else|studies this (topic|area|field|subject)|works on this)\b"
)

SPACE = r"[ \t\r\n\f\x0B]+"
YEAR = r"\b((?:19|20)[0-9]{2})\b"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def norm(c: Column) -> Column:
    """Trimmed, in small letters, each run of white space one blank; null gives ''."""
    return F.coalesce(collapse(F.lower(c)), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def missing(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def or_default(c: Column, default: str = "") -> Column:
    return F.coalesce(blank_to_null(F.trim(c)), F.lit(default))


def without_tags(c: Column) -> Column:
    """Without tags whose name starts with a letter."""
    return F.regexp_replace(c, "</?[a-zA-Z][^>]*>", "")


def without_any_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def title_case(c: Column) -> Column:
    """Mixed-case text as it stands, other text with each run of letters capitalised."""
    raw = strip(without_tags(c))
    runs = F.regexp_extract_all(raw, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    made = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 100_000)))), "")
    return F.when(F.substring(raw, 2, 100_000).rlike("[A-Z]") & raw.rlike("[a-z]"), raw).otherwise(made)


def words(c: Column) -> Column:
    return F.regexp_extract_all(norm(c), F.lit(r"([a-z0-9]+(?:['.-][a-z0-9]+)?)"), F.lit(1))


def relevance_tokens(c: Column, least: int = 3) -> Column:
    """Distinct words that tell something about what is asked, in their order."""
    q = collapse(F.regexp_replace(F.lower(c), INSTITUTION_WORDS, ""))
    found = F.regexp_extract_all(q, F.lit(r"([a-z0-9-]{2,})"), F.lit(1))
    stop = F.array(*(F.lit(w) for w in STOPWORDS))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t)))


def sentences(c: Column) -> Column:
    """Split after . ! or ? and white space; blank parts are left out."""
    return F.filter(F.split(strip(c), r"(?<=[.!?])[ \t\r\n]+"), lambda s: F.trim(s) != "")


def token_estimate(c: Column) -> Column:
    """Words times 1.3, cut to a whole number."""
    return F.floor(F.size(F.filter(F.split(c, SPACE), lambda w: w != "")) * F.lit(1.3)).cast("long")


def fast_token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor((F.length(c) + 3) / 4))


def truncated(c: Column, limit: int) -> Column:
    """At most `limit` characters, ended after the last full stop where there is one, with an ellipsis."""
    head = F.substring(c, 1, limit)
    stop = F.length(head) - F.locate(".", F.reverse(head))
    upto = F.when(F.instr(head, ".") > 0, head.substr(F.lit(1), stop)).otherwise(head)
    return F.when(F.length(c) <= limit, c).when(strip(upto) != "", F.concat(strip(upto), F.lit("..."))).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def id_tail(c: Column) -> Column:
    return F.trim(F.substring_index(c, "/", -1))


def year_of(c: Column) -> Column:
    """The first year of the 20th or 21st century named, as a number; null where there is none."""
    return F.nullif(F.regexp_extract(c, YEAR, 1), F.lit("")).cast("int")


def repair_norm(c: Column) -> Column:
    """Without NULs, markup and characters beyond ASCII; white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(c, "\\x00", ""), "(?is)<math[^>]*>.*?</math>", " ")
    return collapse(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"[^\x00-\x7F]+", " "))


def doi(c: Column) -> Column:
    """A DOI without resolver, label and trailing punctuation, in small letters; '' where there is nothing."""
    t = F.regexp_replace(F.coalesce(repair_norm(c), F.lit("")), "(?i)^https?://(dx\\.)?doi\\.(org|example)/", "")
    t = F.regexp_replace(t, "(?i)^[ \t]*doi[ \t]*:[ \t]*", "")
    return F.lower(F.regexp_replace(t, r"[ .,;:\])}>\"']+$", ""))


def arxiv(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(repair_norm(c), F.lit("")), "(?i)^https?://arxiv\\.org/(abs|pdf)/|^[ \t]*arxiv[ \t]*:[ \t]*", "")
    return F.regexp_replace(F.regexp_replace(t, "(?i)\\.pdf[ \t]*$", ""), r"[ .,;:\])}>\"']+$", "")


def valid_arxiv(c: Column) -> Column:
    return arxiv(c).rlike(r"^(?:[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)$")


def placeholder(c: Column) -> Column:
    compact = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    return (compact == "") | compact.isin(PLACEHOLDERS)


def split_authors(c: Column) -> Column:
    """On ; , and the word and; parts of under two characters are left out."""
    parts = F.transform(F.split(c, r"[ \t]*[;,][ \t]*|[ \t]+and[ \t]+"), collapse)
    return F.filter(parts, lambda n: F.length(n) >= 2)


def without_possessive(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "(['’]s|['’])$", "")


def name_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1))


def name_variants(tokens: Column) -> Column:
    """The ways to write a name of two words or more, the fullest first, each once."""
    first, last = F.element_at(tokens, 1), F.element_at(tokens, -1)
    middle = F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    letter = lambda x: F.concat(F.substring(x, 1, 1), F.lit("."))
    initials = F.array_join(F.transform(middle, letter), " ")
    full = F.when(F.size(middle) > 0, F.array(F.concat_ws(" ", first, F.array_join(middle, " "), last), F.concat_ws(" ", first, initials, last), F.concat_ws(" ", letter(first), initials, last))).otherwise(F.array().cast("array<string>"))
    short = F.array(F.concat_ws(" ", first, last), F.concat_ws(" ", letter(first), last), F.concat_ws(" ", F.substring(first, 1, 1), last))
    return F.when(F.size(tokens) < 2, tokens).otherwise(F.array_distinct(F.concat(full, short)))


def short_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(norm(c), 256), 1, max(6, length))


def summary_section(c: Column) -> Column:
    """What stands after a line `Summary:` up to the next labelled line."""
    after = F.regexp_extract(c, r"(?is)(?:^|\n)Summary:[ \t\r\n]*(.*)", 1)
    return collapse(F.lower(without_tags(F.regexp_replace(after, r"(?is)(?:^|\n)[A-Za-z][A-Za-z _]*(?:\([^)]*\))?[ \t]*:.*", ""))))


def meta_query(c: Column) -> Column:
    """corpus_count, most_recent, oldest or '': what a question asks about the corpus itself."""
    q = F.coalesce(F.lower(c), F.lit(""))
    return (
        F.when(q.rlike(COUNT_QUESTION), "corpus_count").when(q.rlike(NEWEST_QUESTION), "most_recent").when(q.rlike(OLDEST_QUESTION), "oldest").otherwise("")
    )


def meta_command(c: Column) -> Column:
    """Whether a turn resets the conversation instead of asking something."""
    return F.coalesce(F.lower(c), F.lit("")).rlike(RESET_COMMAND)


def intent(c: Column) -> Column:
    """comparison, time_range, list or default, by the form of the question alone; the first that applies."""
    q = F.coalesce(F.lower(strip(c)), F.lit(""))
    return (
        F.when(q.rlike(COMPARISON), "comparison").when(q.rlike(TIME_RANGE), "time_range").when(q.rlike(LISTING), "list").otherwise("default")
    )


def follow_up(c: Column) -> Column:
    """Whether a question refers back by pronoun or by a phrase of going on."""
    q = F.coalesce(F.lower(c), F.lit(""))
    return q.rlike(PRONOUNS) | q.rlike(GOING_ON)


def summary_intent(c: Column) -> Column:
    return F.coalesce(F.lower(c), F.lit("")).rlike(SUMMARY_QUESTION)


def anchor_escape(c: Column) -> Column:
    return F.coalesce(F.lower(c), F.lit("")).rlike(ESCAPE_QUESTION)
