"""Bibliographic values as they are typed: which state something usable, and in what normal form."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from urllib.parse import unquote

# What stands in a title field where no title is known, in normal form.
TITLE_STAND_INS = {"", "n a", "na", "untitled", "untitled document", "unknown", "unknown title", "abstract", "table of contents", "contents", "title missing", "missing title", "no title", "title", "none", "null", "tbd", "pending", "nan", "document", "new document"}
# Month names by their first three letters.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_CUT = re.compile(r"(?:…|\.\.\.|\[\s*(?:\.\.\.|…)\s*\])\s*$")
_FILE = re.compile(r"^\s*(?:[a-z]+[_-]\d{2,}(?:[_-]\d+)*(?:\.\w{2,4})?|\S+\.(?:pdf|docx?|txt|tex|rtf|odt)|draft\S*(?:\s+final)?(?:\.\w+)?|.*\.(?:pdf|docx?|odt|rtf|tex))\s*$", re.IGNORECASE)


def title_key(title: str | None) -> str:
    """Words of a title in small letters, without markup, entities and punctuation."""
    if title is None:
        return ""
    t = _TAG.sub("", title).replace("&amp;", " and ").replace("&lt;", "<").replace("&gt;", ">").replace("&", " and ")
    t = re.sub(r"\bw/\s*", "with ", t)
    return " ".join(re.findall(r"\w+", t.lower()))


def usable_title(title: str | None) -> bool:
    """Whether the value states a whole title: no stand-in, file name or cut-off start; misspelt or marked up is usable."""
    if title is None or not title.strip():
        return False
    key = title_key(title)
    return key not in TITLE_STAND_INS and not _CUT.search(title) and not _FILE.match(title) and any(c.isalpha() for c in key)


def doi_key(doi: str | None) -> str | None:
    """The DOI in normal form, or None where the value holds no whole DOI."""
    if doi is None:
        return None
    v = unquote(doi.strip())
    if "…" in v or v.endswith("..."):
        return None
    m = re.search(r"10\.\d{4,9}/\S+", v)
    if m is None:
        return None
    d = m[0].lower()
    while d and (d[-1] in ".,;:\"'>]}" or d[-1] == ")" and d.count("(") < d.count(")")):
        d = d[:-1]
    prefix, _, suffix = d.partition("/")
    return d if suffix and any(c.isdigit() for c in suffix) else None


def parse_date(text: str | None) -> tuple[int, int, int] | None:
    """(year, month, day) with 0 for what isn't stated; None where it is no date that exists."""
    if text is None:
        return None
    t = text.strip()
    y = m = d = 0
    if (x := re.fullmatch(r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[T ]\d{2}:\d{2}.*)?", t)) or (x := re.fullmatch(r"(\d{4})(\d{2})(\d{2})", t)):
        y, m, d = map(int, x.groups())
        if not (m and d):
            return None
    elif x := re.fullmatch(r"(\d{4})[-/.](\d{1,2})", t):
        y, m = map(int, x.groups())
        if not m:
            return None
    elif x := re.fullmatch(r"(?:c|ca\.?|©|\()?\s*(\d{4})\)?", t):
        y = int(x[1])
    elif x := re.fullmatch(r"(\d{1,2})\.?\s+([A-Za-z]+)\.?,?\s+(\d{4})", t):
        d, m, y = int(x[1]), MONTHS.get(x[2][:3].lower(), 13), int(x[3])
    elif x := re.fullmatch(r"([A-Za-z]+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", t):
        d, m, y = int(x[2]), MONTHS.get(x[1][:3].lower(), 13), int(x[3])
    elif x := re.fullmatch(r"([A-Za-z]+)\.?,?\s+(\d{4})", t):
        m, y = MONTHS.get(x[1][:3].lower(), 13), int(x[2])
    else:
        return None
    if not 1000 <= y <= 9998 or m > 12 or d and not 1 <= d <= calendar.monthrange(y, m)[1]:
        return None
    return y, m, d


def usable_date(text: str | None, arrived: dt.datetime | None) -> tuple[int, int, int] | None:
    """parse_date(), or None where the date's earliest day lies after `arrived` (a null arrival rules nothing out)."""
    p = parse_date(text)
    if p is None or arrived is not None and dt.date(p[0], p[1] or 1, p[2] or 1) > arrived.date():
        return None
    return p
