"""Grammar for fields that pack several names into one string.

A parsing expression grammar over the raw text, with ordered alternatives and backtracking:

    Field     <- JsonList / Numbered / List
    JsonList  <- '[' JsonString (',' JsonString)* ','? ']' End
    Numbered  <- (Marker Element Sep?)+          # (1) [1] 1) counting upward from 1
    List      <- Element? (Sep Element?)*
    Element   <- Quoted &(Sep / End) / Bare      # a quote that never closes, or closes inside a word, is backtracked into Bare
    Sep       <- Strong / Comma / And
    Name      <- Surname ',' Given / Name ',' Degree / Element

A comma is part of a name where the element before it is a lone surname (particles aside) or the one after it a degree.
"""

from __future__ import annotations

import json
import re

STRONG = ";；|/·•\n\r\t"
COMMA = ",，、"
# Academic degrees and generation marks that may follow a name after a comma.
DEGREES = {"phd", "ph.d", "ph. d", "md", "m.d", "msc", "m.sc", "ma", "m.a", "mba", "mph", "dphil", "dsc", "jr", "sr", "ii", "iii", "iv", "esq", "habil"}
# Particles that belong to a surname.
PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "da", "di", "du", "dos", "la", "le", "ter", "ten", "zu", "zur", "af", "av", "bin", "al", "el"}

_AND = re.compile(r"\s+(?:and|&amp;|&)\s+|\s*&amp;\s*|^\s*(?:and|&)\s+", re.IGNORECASE)
_ORG_TAIL = re.compile(r"\s*[^\W\d]+\s+[^\W\d]+\.?\s*\d+\s*(?=[;；|/·•\n\r\t,，\"\[\(]|and\b|&|et\b|$)", re.IGNORECASE)
_MARKER = re.compile(r"(?:^|(?<=[\s;,|]))(?:\((\d{1,3})\)|\[(\d{1,3})\]|(\d{1,3})\)|(\d{1,3})\.(?=\s))\s*")
_ET_AL = re.compile(r"[\s,;|]*\b(?:et\.?\s+al\b\.?|and\s+others)\s*(?:\(\s*\d+\s+\w+\s*\))?\s*$", re.IGNORECASE)
_ONLY_REMARK = re.compile(r"\(?\s*(?:et\.?\s+al\b\.?|and\s+others|others)\s*(?:\(\s*\d+\s+\w+\s*\))?\s*\)?$|\(\s*\d+\s+authors?\s*\)$", re.IGNORECASE)


def _quoted(text: str, at: int) -> tuple[str, int] | None:
    """Quoted <- '"' ('""' / '\\"' / !'"' .)* '"' &(ws (Sep / End)); None makes the caller try Bare."""
    i, out, n = at + 1, [], len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n and text[i + 1] in '"\\':
            out.append(text[i + 1])
            i += 2
        elif c == '"' and i + 1 < n and text[i + 1] == '"' and not (not out and (i + 2 >= n or text[i + 2] in STRONG + COMMA)):
            out.append('"')
            i += 2
        elif c == '"':
            j = i + 1
            while j < n and text[j] in "  ":
                j += 1
            if j >= n or text[j] in STRONG + COMMA or _AND.match(text, i + 1) or _ET_AL.match(text, i + 1):
                return "".join(out), i + 1
            return None
        else:
            out.append(c)
            i += 1
    return None


def _elements(text: str) -> list[tuple[str, int, int, str, str]]:
    """List, as (kind, start, end, value, flag); kind is one of quoted, bare, strong, comma, and."""
    out: list[tuple[str, int, int, str, str]] = []
    i, n, begin, flag = 0, len(text), 0, ""

    def bare(end: int) -> None:
        nonlocal flag
        if text[begin:end].strip():
            out.append(("bare", begin, end, "", flag))
        flag = ""

    while i < n:
        c = text[i]
        if c == '"':
            if not text[begin:i].strip():
                if (q := _quoted(text, i)) is not None:
                    out.append(("quoted", i, q[1], q[0], ""))
                    i = begin = q[1]
                    continue
                flag = "malformed_quote"
                i += 1
                continue
            close = text.find('"', i + 1)  # a nickname inside a name is passed over as one
            if close > 0 and not any(x in text[i:close] for x in STRONG + COMMA):
                i = close + 1
            else:
                flag = "malformed_quote"
                i += 1
            continue
        if c in COMMA or (c in STRONG and not (c == ";" and text[max(0, i - 4) : i].lower() == "&amp")):
            bare(i)
            out.append(("comma" if c in COMMA else "strong", i, i + 1, c, ""))
            i += 1
            begin = i
            continue
        if (c.isspace() or c == "&" or (i == begin and c in "aA")) and (m := _AND.match(text, i)) and m.end() > i:
            if not (text[begin:i].strip() and _ORG_TAIL.match(text, m.end())):
                bare(i)
                out.append(("and", i, m.end(), "and", ""))
                i = begin = m.end()
                continue
            i = m.end()
            continue
        i += 1
    bare(n)
    return out


def _lone_surname(part: str) -> bool:
    words = part.split()
    if not words or "." in part or any(c.isdigit() for c in part):
        return False
    shouted, titled = part == part.upper(), words[-1][:1].isupper()
    # a word in small letters before a capitalised surname is a particle even where misspelt; capitals count as one only among capitals
    return all(w.lower() in PARTICLES and (w != w.upper() or shouted) or titled and w.islower() for w in words[:-1])


def _is_degree(part: str) -> bool:
    return part.strip().strip(".").lower() in DEGREES


def _names(text: str) -> list[tuple[str, str]]:
    """Name over the elements: commas that belong to a name are taken back into it."""
    out: list[list] = []  # start, end, value or None, flag, may take a given name
    last_sep = ""
    for kind, start, end, value, flag in _elements(text):
        if kind in ("strong", "comma", "and"):
            last_sep = "strong" if kind == "strong" or last_sep == "strong" else kind
            continue
        if kind == "bare":
            part = text[start:end].strip()
            if last_sep == "comma" and out and out[-1][2] is None:
                if _is_degree(part):
                    out[-1][1] = end
                    out[-1][4] = False
                    last_sep = ""
                    continue
                if out[-1][4] and not any(c.isdigit() for c in part) and len(part.split()) <= 3 and not _ONLY_REMARK.match(part):
                    out[-1][1] = end
                    out[-1][4] = False
                    last_sep = ""
                    continue
            out.append([start, end, None, flag, _lone_surname(part)])
        else:
            out.append([start, end, value, flag, False])
        last_sep = ""
    values = []
    for start, end, value, flag, _ in out:
        v = (text[start:end] if value is None else value).strip()
        if v and not _ONLY_REMARK.match(v):
            values.append((v, flag))
    return values


def _json_list(text: str) -> list[tuple[str, str]] | None:
    """JsonList; None where the text isn't one. Brackets that don't parse as JSON are read as a plain quoted list and flagged."""
    if not text.startswith("[") or re.match(r"\[\d+\]", text) or not ('"' in text or text.endswith("]")):
        return None
    try:
        loaded = json.loads(text)
        if isinstance(loaded, list):
            return [(v.strip(), "") for x in loaded if x is not None and (v := str(x)).strip() and not _ONLY_REMARK.match(v.strip())]
    except ValueError:
        pass
    return [(v, f or "malformed_list") for v, f in _names(text.strip("[]"))]


def _numbered(text: str) -> list[tuple[str, str]] | None:
    """Numbered; markers must count upward from 1, otherwise the text is read as a List."""
    marks = list(_MARKER.finditer(text))
    if not marks or text[: marks[0].start()].strip():
        return None
    kept, want = [], 1
    for m in marks:
        if int(next(g for g in m.groups() if g)) == want:
            kept.append(m)
            want += 1
    if not kept or kept[0].start() != marks[0].start():
        return None
    out = []
    for k, m in enumerate(kept):
        item = text[m.end() : kept[k + 1].start() if k + 1 < len(kept) else len(text)]
        out += _names(item)
    return out


def split_packed(text: str | None) -> list[tuple[str, str]]:
    """The values packed in `text` in order, each with an error flag ('' where the grammar held).

    Null, empty and blank texts give no values. Empty elements and remarks on authors left out ("et al.") are no values.
    Repeated values stay repeated: position is part of the result.
    """
    if text is None or not (body := text.strip()):
        return []
    if (found := _json_list(body)) is not None:
        return found
    body = _ET_AL.sub("", body)
    if (found := _numbered(body)) is not None:
        return found
    return _names(body)
