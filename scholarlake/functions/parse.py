"""Column functions that read bibliographic fields from the lines of a text. Patterns are written so that SQL engines agree on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.functions import text as T

# Identifiers in running text, words before a year of publication, lines that are no title or no authors.
DOI = r"(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]+)\b"
DOI_LINK = r"(?i)https?://(?:dx\.)?doi\.org/(10\.[0-9]{4,9}/[^ \t\r\n\"<>]+)"
ARXIV = r"(?i)\barxiv[ \t]*:[ \t]*([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)\b"
ARXIV_LINK = r"(?i)https?://arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)"
ARXIV_WHOLE = r"(?i)^(?:[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)$"
YEAR_BESIDE = r"(?is)\b(?:published|accepted|received|revised|copyright|conference|proceedings)\b.{0,60}\b((?:19|20)[0-9]{2})\b"
EMAIL = r"(?i)\b[a-z0-9_.-]+@[a-z0-9_.-]+\.[a-z0-9_]+\b"
DUMMY_PREFIX = r"(?i)^(arxiv|cms[ \t]+paper|european[ \t]+organization|cern|preprint)"
BAD_TITLE = r"(?i)^(abstract|introduction|keywords|contents|table[ \t]+of[ \t]+contents)$"
ABSTRACT = r"(?i)^[ \t]*(abstract|summary|keywords)[ \t]*$"
SECTION = r"(?i)^[ \t]*(introduction|contents|table[ \t]+of[ \t]+contents)[ \t]*$"
PLACES = "university|institute|department|laboratory|collaboration|faculty|school of"
LINK_LINE = r"^https?://|(?:dx\.)?doi\.org/|arxiv\.org/|^doi:|^arxiv ?:"
NO_LINE = r"(?i)^(?:[0-9]+[ \t]*|[ \t]*pages?[ \t]+[0-9]+[ \t]*(?:of[ \t]+[0-9]+)?[ \t]*)$"
AUTHOR_LINE = r"(?i)^[ \t]*Author\(?s?\)?:[ \t]*(.*)$"
BY_LINE = r"^[ \t]*By[ \t]+(.*)$"


def dummy_title(c: Column) -> Column:
    """Blank, too long, a heading or a series name, of under four words, or mostly digits."""
    t = F.coalesce(T.strip(c), F.lit(""))
    return (t == "") | (F.length(t) > 240) | t.rlike(DUMMY_PREFIX) | t.rlike(BAD_TITLE) | (n_words(t) < 4) | (n_digits(t) > 12)


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, T.SPACE), lambda w: w != ""))


def n_digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def titleish(c: Column) -> Column:
    return F.length(c).between(10, 240) & n_words(c).between(4, 50) & ~dummy_title(c)


def authorish(c: Column) -> Column:
    """Two names or more between commas, semicolons or the word and; no address and no heading."""
    parts = F.filter(F.split(c, "[;,]"), lambda t: F.trim(t) != "")
    return F.length(c).between(6, 280) & ~c.rlike(ABSTRACT) & ~c.rlike(SECTION) & ~F.lower(c).rlike(PLACES) & (n_digits(c) <= 6) & F.lower(c).rlike("[,;]| and ") & (F.size(parts) >= 2)


def file_stem(c: Column) -> Column:
    base = F.element_at(F.split(F.replace(T.repair_norm(c), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.replace(F.replace(F.regexp_replace(base, r"\.[A-Za-z0-9]{1,5}$", ""), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))


def fulltext_fields(works: DataFrame) -> DataFrame:
    """(id, title, authors, doi, arxiv_id, year, researcher, info) of works (id, full_text) with a text; lines are normalised one by one.

    The title is the first likely line around the abstract's heading, else of the first 120; the authors the first likely line
    after it. Everything is an expression: no row leaves the JVM.
    """
    first = lambda a, test: F.get(F.filter(a, test), F.lit(0))
    clean = lambda x: T.repair_norm(F.regexp_replace(T.repair_norm(x), NO_LINE, ""))
    ls = F.filter(F.transform(F.slice(F.split(F.substring("full_text", 1, 80_000), "\n"), 1, 800), clean), lambda x: (x != "") & ~x.rlike(EMAIL) & ~F.lower(x).rlike(LINK_LINE))
    w = works.where("trim(full_text) <> ''").select("id", "full_text", ls.alias("ls"))
    found = lambda pattern: F.array_position(F.transform(F.slice("ls", 1, 600), lambda x: x.rlike(pattern)), True)
    w = w.withColumn("mark", F.coalesce(F.nullif(found(ABSTRACT), F.lit(0)), found(SECTION)).cast("int"))
    lo = F.greatest(F.lit(1), F.col("mark") - 20)
    w = w.withColumn("win", F.when(F.col("mark") > 0, F.slice("ls", lo, F.col("mark") + 4 - lo + 1)).otherwise(F.slice("ls", 1, 200)))
    w = w.withColumn("title", F.coalesce(first(F.slice("win", 1, 80), titleish), first(F.slice("ls", 1, 120), titleish), F.lit("")))
    at = F.array_position("ls", F.col("title")).cast("int")
    after = F.when((F.col("title") != "") & (at > 0), first(F.slice("ls", at + 1, F.lit(59)), authorish))
    w = w.withColumn("authors", F.coalesce(after, first(F.slice("win", 1, 60), authorish), F.lit("")))
    one = lambda n, *patterns: F.coalesce(*(F.nullif(F.regexp_extract(F.substring("full_text", 1, n), p, 1), F.lit("")) for p in patterns), F.lit(""))
    years = F.transform(F.regexp_extract_all(F.substring("full_text", 1, 20_000), F.lit(T.YEAR), F.lit(1)), lambda y: y.cast("int"))
    w = w.select("id", "title", "authors", T.doi(one(40_000, DOI, DOI_LINK)).alias("doi"), T.arxiv(one(60_000, ARXIV, ARXIV_LINK)).alias("arxiv_id"), F.coalesce(F.nullif(one(20_000, YEAR_BESIDE), F.lit("")), F.array_max(years).cast("string"), F.lit("")).alias("year"))
    lead = F.trim(F.get(F.split("authors", ","), F.lit(0)))
    told = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), c))
    return w.select("*", F.when(F.length(lead).between(2, 80), lead).otherwise("").alias("researcher"), F.concat_ws(" | ", told("DOI: ", "doi"), told("arXiv: ", "arxiv_id"), told("Date: ", "year")).alias("info"))
