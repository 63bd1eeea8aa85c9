"""Typed names of people and organisations, taken apart, and the comparison of two of them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Titles and degrees around names; particles of surnames; what stands in for a missing name.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "rev", "phd", "md", "msc", "ma", "mba", "dphil", "jr", "sr", "esq", "habil", "dipl", "ing"}
PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "da", "di", "du", "dos", "la", "le", "ter", "ten", "zu", "zur", "af", "av", "bin", "al", "el"}
STAND_INS = {"", "na", "unknown", "none", "null", "nan", "anonymous", "anon", "notavailable", "unknownauthor", "noauthor", "tbd", "pending", "various", "missing", "author", "nn"}
# Words that mark an organisation.
ORG_WORDS = {"group", "grp", "team", "party", "pty", "collective", "consortium", "consort", "institute", "inst", "university", "univ", "society", "soc", "observatory", "obs", "laboratory", "lab", "centre", "center", "council", "agency", "survey", "network", "committee", "department", "dept", "association", "project", "programme", "initiative"}

SAME, PART, NONE = 2, 1, 0


@lru_cache(200_000)
def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("’", "'").replace("ß", "ss").replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@lru_cache(200_000)
def ratio(a: str, b: str) -> float:
    """Longest common subsequence over the mean length."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


@lru_cache(200_000)
def _letters(word: str) -> int:
    mask = 0
    for c in word:
        mask |= 1 << ord(c) % 64
    return mask


def close(a: str, b: str) -> bool:
    """Whether two words may be one word with a slip or two: all but one letter of each in common order, or two swapped."""
    if a == b:
        return True
    m, n = len(a), len(b)
    if m > n:
        m, n = n, m
    if n - m > 2 or m < 4:
        return False
    lost = 2 if m >= 8 and m != n else 1
    x, y = _letters(a), _letters(b)  # each letter the other word hasn't is lost at least
    if len(a) - (x & ~y).bit_count() < n - lost or len(b) - (y & ~x).bit_count() < n - lost:
        return False
    return lcs(a, b) >= n - lost


def words_of(name: str) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?|\d+|&|,|\"", name)


def is_stand_in(name: str) -> bool:
    return re.sub(r"[^a-z0-9]+", "", fold(name)) in STAND_INS and not re.search(r"[A-Z]\.", name)


def is_organisation(name: str) -> bool:
    """Digits, or a word that marks one."""
    ws = [fold(w).strip(".") for w in words_of(name)]
    return any(w.isdigit() for w in ws) or len(ws) > 2 and any(w in ORG_WORDS for w in ws)


def organisation(name: str) -> dict:
    """kind, surname (the acronym), given (the words, none of an acronym) and number."""
    text = re.sub(r"-", "", fold(name).replace("&", " and "))
    ws = [w.strip(".") for w in re.findall(r"[^\W\d_]+\.?|\d+", text)]
    number = "".join(w for w in ws if w.isdigit())
    plain = [w for w in ws if not w.isdigit() and w not in ("the", "and", "of", "for")]
    short = len(plain) == 1 and len(plain[0]) <= 6 and re.search(r"\b[A-Z]{2,6}\b", name) is not None
    return {"kind": "o", "surname": plain[0] if short else "".join(w[0] for w in plain), "given": [] if short else plain, "number": number}


def _initials(word: str, shouted: bool) -> str:
    """The letters of an initial or packed initials, else ''."""
    bare = word.replace(".", "")
    if len(bare) == 1 or "." in word and len(bare) <= 3 and bare.isupper():
        return fold(bare)
    return fold(bare) if not shouted and len(bare) <= 3 and bare.isupper() else ""


_WORD = re.compile(r"[^\W\d_.]+(?:['’][^\W\d_.]+)*(?:\.(?:[^\W\d_]\.)*)?(?:-[^\W\d_]+(?:['’][^\W\d_]+)*)?")


def _is_title(word: str) -> bool:
    w = word.strip(".")
    return fold(w) in TITLES and (not w.isupper() or len(w) > 2)


def _without_particles(ws: list[str]) -> list[str]:
    titled, shouted = any(w[:1].isupper() and not w.isupper() for w in ws), len(ws) > 1 and all(w.isupper() for w in ws)
    kept = [w for i, w in enumerate(ws) if i == len(ws) - 1 or not (fold(w) in PARTICLES and (w.islower() or shouted) or titled and w.islower() and len(w) <= 5)]
    return kept or ws[-1:]


def person(name: str, givens: set[str], tails: set[str] = frozenset()) -> dict | None:
    """kind, surname and given: the given names in the order typed, single letters for initials; None where there is no surname."""
    text = re.sub(r'"[^"]*"', " ", name)
    text = re.sub(r"\b(van|von|de|der|den)(?=[A-Z])", r"\1 ", re.sub(r"\bvan ?der(?=[A-Z])", "van der ", text))
    head, _, tail = text.partition(",")
    if not tail.strip() or _is_title(tail.strip()) and fold(tail).strip(" .") in ("phd", "jr", "sr", "esq"):
        tail = ""
    front, back = ([w for w in _WORD.findall(s) if not _is_title(w)] for s in (head, tail))
    shouted = all(w.replace(".", "").isupper() for w in front + back)
    if back and front:
        surname, given = _without_particles(front), back
        given = surname[:-1] + given
        last = surname[-1]
    else:
        ws = _without_particles(front or back)
        if len(ws) < 2:
            return None
        known = lambda w: fold(w.split("-")[0]) in givens or _initials(w, shouted) != ""
        if known(ws[-1]) and not known(ws[0]):
            last, given = ws[0], ws[1:]
        else:
            last, given = ws[-1], ws[:-1]
            if len(ws) > 2 and fold(last) in tails and fold(ws[-2]) not in givens:  # a compound surname without its hyphen
                last, given = ws[-2] + ws[-1], ws[:-2]
    names: list[str] = []
    for w in given:
        if letters := _initials(w, shouted):
            names += list(letters)
        else:
            names += [fold(x) for x in w.strip(".").split("-") if x and fold(x) not in PARTICLES]
    s = re.sub(r"[^a-z]", "", fold(last)) or fold(last)
    return {"kind": "p", "surname": s, "given": names} if s and names else None


def _slip(a: str, b: str, givens: set[str]) -> bool:
    return close(a, b) and not (a in givens and b in givens)


def is_short(given: str, givens: set[str], memo: dict[str, bool] | None = None) -> bool:
    """Whether a written given name may be a short form the corpus doesn't explain: none it knows, nor a slip of one.

    `memo` keeps what was found, for one set of known names.
    """
    if not 3 <= len(given) <= 5 or given in givens:
        return False
    if memo is None:
        return not any(close(given, g) for g in givens)
    if given not in memo:
        memo[given] = not any(close(given, g) for g in givens)
    return memo[given]


def _given_match(a: str, b: str, givens: set[str], nicks: dict[str, list[str]], memo: dict[str, bool] | None = None) -> int:
    """3: the same name, 2: with a slip, or a nickname the corpus gives; 1: an initial, or a likely short form; 0: another name."""
    if a == b:
        return 3 if len(a) > 1 else 1
    if len(a) == 1 or len(b) == 1:
        x, y = sorted((a, b), key=len)
        return int(len(y) > 1 and (y[0] == x or any(n[0] == x for n in nicks.get(y, ()))))
    if _slip(a, b, givens) or b in nicks.get(a, ()) or a in nicks.get(b, ()):
        return 2
    x, y = sorted((a, b), key=len)
    return int(x not in nicks and is_short(x, givens, memo) and len(y) > 5 and x[0] == y[0])


def compare_people(a: dict, b: dict, givens: set[str], nicks: dict[str, list[str]], memo: dict[str, bool] | None = None) -> int:
    """SAME: the same given names, as far written; PART: one says less than the other; NONE: they conflict."""
    exact = a["surname"] == b["surname"]
    if not exact and not close(a["surname"], b["surname"]):
        return NONE
    ga, gb = a["given"], b["given"]
    got = [_given_match(x, y, givens, nicks, memo) for x, y in zip(ga, gb)]
    if not all(got) and len(ga) == len(gb) == 2:
        got = [_given_match(x, y, givens, nicks, memo) for x, y in zip(ga, reversed(gb))]
        if min(got) < 2:
            return NONE
    if not all(got):
        return NONE
    if not exact and not any(g == 3 for g in got):
        return PART if all(g == 1 for g in got) and len(ga) == len(gb) > 1 else NONE
    letters = all(len(x) == 1 for x in ga), all(len(x) == 1 for x in gb)
    if len(ga) == len(gb) and (max(got) > 1 or all(letters)):
        return SAME
    return PART


def compare_organisations(a: dict, b: dict) -> int:
    """The same number, and each word of the one is the word of the other, a slip of it or a shortening; or one is the other's acronym."""
    if a["number"] != b["number"]:
        return NONE
    fa, fb = a["given"], b["given"]
    if not fa or not fb:
        return SAME if a["surname"] == b["surname"] and a["number"] else NONE
    if len(fa) != len(fb):
        return SAME if ratio("".join(fa), "".join(fb)) >= 0.92 else NONE
    for x, y in zip(fa, fb):
        s, t = sorted((x, y), key=len)
        if not (x == y or close(x, y) or s[0] == t[0] and len(s) >= 2 and lcs(s, t) == len(s)):
            return NONE
    return SAME
