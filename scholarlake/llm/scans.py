"""Noise in text from scanned pages: found, and repaired into continuous paragraphs.

Page numbers and running headers are told from the text by where they stand and how they run on. What is left is one stream of
characters without line ends. It is decoded jointly into words: the cheapest way through a lattice whose arcs read a character
as it stands, as a listed confusion, drop a stray space, a line end or a break with its hyphen or without, or put in a space that is
missing, along the prefixes of corpus words only; a word costs what its frequency says, and what no way leads through stays as it
is. The lattice falls into parts wherever dropping a blank costs more than all the words that could gain by it, and units that cost
less than half a dropped blank are parts of their own; so what stands is passed over and the way found is still the cheapest of
all. Paragraphs are then cut where a dynamic programme over the lines finds it cheapest.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What optical recognition takes for what (seen, meant), ligatures, and the characters that break a word at a line end.
CONFUSIONS = (
    ("c", "e"), ("l", "i"), ("0", "o"), ("@", "a"), ("f", "t"), ("1", "l"), ("1", "i"), ("5", "s"), ("rn", "m"), ("b", "h"), ("ii", "u"), ("cl", "d"), ("9", "g"), ("m", "in"), ("6", "b"), ("h", "li"),
    ("vv", "w"), ("m", "rn"), ("d", "cl"), ("|", "l"), ("|", "i"), ("!", "l"), ("!", "i"), ("8", "b"), ("$", "s"), ("e", "c"), ("i", "l"), ("t", "f"), ("h", "b"), ("m", "nn"), ("q", "g"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("n", "ri"), ("ri", "n"), ("o", "0"),
    ("I", "l"), ("o", "a"), ("f", "e"), ("¢", "c"), ("€", "e"), ("£", "l"), ("«", "a"),
)
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ſ": "s"}
BREAKS = "-­‐¬"

LEAST = 3  # texts a word must stand in to be a corpus word, however many texts there are
LEAST_SHARE = 0.0003  # of all texts a word must stand in for it to be no likely misreading itself
CONFUSED, SPLIT, MERGED, UNKNOWN = 2.5, 14.0, 12.0, 25.0  # the k-th confusion of a word costs k times CONFUSED
PER_LETTER, SHORT_PART = 2.0, 4.0  # of an unknown word each letter over ten; of a space put in beside a part of under three letters

_WORD = re.compile(r"[^\W_]\w*(?:[!¢€]*[\w@|$]+)*(?:[-'’][\w@|!$]+)*|[@|!$][\w@|!$]+(?:[-'’][\w@|!$]+)*")
_UNIT = re.compile(rf"(?:{_WORD.pattern})(?:[{BREAKS}][^\S\n]*\n\s*(?=[^\W\d_]|[@0156|9])(?:{_WORD.pattern}))*")
_UNITS = re.compile(f"({_UNIT.pattern})")
BROKEN = "\n"  # what stands for a break inside a unit
_BROKEN = re.compile(rf"[{BREAKS}][^\S\n]*\n\s*")
_SOFT = re.compile(r" |[^\S\n\f]*\n[^\S\n\f]*")
_LIGATURE = re.compile("[" + "".join(LIGATURES) + "]")
_N = r"[0-9OolISB]*[0-9][0-9OolISB]*|[Ol][0-9OolI]+"
_ROMAN = r"[ivxlc]{1,7}|[IVXLC]{1,7}"
_SURE = re.compile(rf"\s*(?:[-–—]\s*({_N}|{_ROMAN})\s*[-–—]|\[\s*({_N})\s*\]|(?:Page|page|PAGE|P\.|p\.|Seite)\s*({_N})(?:\s*(?:of|/|von)\s*(?:{_N}))?|({_N})\s*(?:/|of)\s*(?:{_N}))\s*")
_BARE = re.compile(rf"\s*({_N}|{_ROMAN})\s*")
_NUMBERED = re.compile(rf"\s*(?:(?P<a>{_N}|{_ROMAN})\s{{2,}}(?P<t>[^\W\d].*?)|(?P<u>[^\W\d].*?)\s{{2,}}(?P<b>{_N}|{_ROMAN}))\s*")
_MARKS = re.compile("[a-z][0-9@|][a-z]|[" + "".join(LIGATURES) + "]")
_ODD = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n\f"]
_TABLE = re.compile(r"\S\s{2,}\S.*\S?\s{2,}\S")


def _number(text: str) -> int | None:
    t = text.strip()
    if re.fullmatch(_ROMAN, t):
        value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
        n = [value[c] for c in t.lower()]
        return sum(-a if a < b else a for a, b in zip(n, n[1:] + [0]))
    t = t.translate(str.maketrans("OolISB", "001158"))
    return int(t) if t.isdigit() else None


@dataclass
class Page:
    """What the lines of a text are: kind by line is text, blank, header or pageno."""

    lines: list[str]
    kind: list[str]
    feeds: set[int] = field(default_factory=set)  # lines that begin after a form feed
    odd: bool = True  # whether there is other white space in them than blanks

    def gapped(self, line: str) -> bool:
        """Whether there may be white space of two or more in a line."""
        return self.odd or "  " in line


def _lines(text: str) -> tuple[list[str], set[int]]:
    lines, feeds = [], set()
    for part in text.split("\f"):
        if lines:
            feeds.add(len(lines))
        lines += part.split("\n")
    return lines, feeds


class _PlainTable(dict):
    """By code point: ligatures taken apart, what is no part of a word a blank; line feeds stay."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = told = LIGATURES.get(c) or (c if c == "_" or c == "\n" or c.isalnum() else " ")
        return told


_PLAIN = _PlainTable()


def _plain(text: str) -> list[str]:
    """Each line in small letters, its words with one blank between."""
    return [" ".join(line.split()) for line in text.lower().translate(_PLAIN).split("\n")]


def _near(a: str, b: str) -> bool:
    """Equal but for a few misread characters."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or len(a) < 8:
        return False
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= max(1, len(a) // 12)


def structure(text: str) -> Page:
    """Page numbers and running headers among the lines of `text`; lines end at line feeds and form feeds."""
    lines, feeds = _lines(text)
    kind = ["text" if l.strip() else "blank" for l in lines]
    page = Page(lines, kind, feeds, any(c in text for c in _ODD))
    full = [i for i, k in enumerate(kind) if k == "text"]
    if not full:
        return page
    plain = _plain("\n".join(lines))
    width = sorted(len(lines[i].rstrip()) for i in full)[int(0.9 * (len(full) - 1))]
    before = {b: a for a, b in zip(full, full[1:])}

    bare: list[tuple[int, int]] = []
    for i in full:
        if _SURE.fullmatch(lines[i]):
            kind[i] = "pageno"
        elif (m := _BARE.fullmatch(lines[i])) and (n := _number(m[1])) is not None:
            label = lines[before[i]].strip() if i in before and i - before[i] == 1 else ""
            if not re.fullmatch(r"[A-Z][a-z]{0,7}|[a-zA-Z]", label):  # the figure under a label of a table
                bare.append((i, n))
    # the longest chain of numbers counting up, a misread one passed over: of each number the longest chain that ends with it
    ends: dict[int, tuple[int, int]] = {}  # number -> (length of the chain, less its place in `bare`)
    came: list[int] = []
    for k, (_, n) in enumerate(bare):
        long, at = max((ends[m] for m in (n - 1, n - 2, n - 3) if m in ends), default=(0, 1))
        came.append(-at if at <= 0 else -1)
        ends[n] = max(ends.get(n, (0, 1)), (long + 1, -k))
    chain, k = [], -max(ends.values(), default=(0, 1))[1]
    while k >= 0:
        chain.append(bare[k])
        k = came[k]
    chain.reverse()
    edge = lambda i: i == full[-1] or i + 1 in feeds or any(j in feeds for j in range(i + 1, min(i + 4, len(lines))) if all(kind[x] == "blank" for x in range(i + 1, j)))
    if len(chain) >= 2:
        for i, _ in chain:
            kind[i] = "pageno"
        gaps = {chain[0][1] - 1, chain[-1][1] + 1}
        for i, n in bare:
            if kind[i] == "text" and edge(i) and n in gaps:
                kind[i] = "pageno"
    elif not any(k == "pageno" for k in kind):
        for i, _ in bare:
            if edge(i) or lines[i].startswith("      "):
                kind[i] = "pageno"

    numbered: list[tuple[int, int, str]] = []
    for i in full:
        if kind[i] == "text" and page.gapped(lines[i].strip()) and not _TABLE.search(lines[i].strip()) and (m := _NUMBERED.fullmatch(lines[i])):
            words = m["t"] or m["u"]
            n = _number(m["a"] or m["b"])
            if n is not None and len(told := _plain(words)[0]) >= 5 and len(re.findall(r"\d", words)) <= 2 and len(words.split()[0]) > 1 and not re.match(r"(?:Plot|Site|Table|Fig)", words):
                numbered.append((i, n, told))
    counts = Counter(w for _, _, w in numbered)
    known: set[str] = set()
    steps = Counter(d for k, (_, n, _) in enumerate(numbered) for d in (("up", n - k), ("down", n + k)))
    for k, (i, n, w) in enumerate(numbered):
        chained = steps["up", n - k] > 1 or steps["down", n + k] > 1  # numbers that run on with the lines
        if chained or counts[w] > 1 or i in feeds or i == full[0] or edge(before.get(i, -2)):
            kind[i] = "header"
            known.add(w)

    starts = []
    for i in full:
        if kind[i] != "text":
            continue
        p = before.get(i)
        fed = any(j in feeds for j in range((p if p is not None else -1) + 1, i + 1))
        if p is None or kind[p] == "pageno" or fed:
            starts.append(i)
    tops = Counter(plain[i] for i in starts)
    anywhere = Counter(plain[i] for i in full if kind[i] == "text")
    digits = lambda s: bool(re.search(r"\d", s))
    for i in starts:
        s = lines[i].strip()
        w = plain[i]
        alone = i + 1 < len(lines) and kind[i + 1] == "blank"
        like = any(x != w and _near(w, x) for x in tops) or any(_near(w, x) for x in known)
        if re.search(r"[.;?!]$" if alone else r"[.;:,?!]$", s) and not tops[w] > 1 or digits(w) and tops[w] < 2 and not like or len(s) > 0.97 * max(width, 30) and tops[w] < 2 or len(w) < 3 or _TABLE.search(s):
            continue
        p = before.get(i)
        if tops[w] > 1 or anywhere[w] > 2 and not digits(w) or like:
            kind[i] = "header"
        elif p is not None and alone and s[:1].isupper():
            kind[i] = "header"
        else:
            continue
        known.add(w)
    scanned = any(k in ("header", "pageno") for k in kind) or any(l.rstrip()[-1:] in BREAKS and l.rstrip()[-2:-1].isalpha() for l in lines if l.strip()) or _MARKS.search(text)
    if full[0] in starts and kind[full[0]] == "text" and scanned:
        s, nxt = lines[full[0]].strip(), next((i for i in full if i > full[0]), None)
        follow = lines[nxt].strip() if nxt is not None else ""
        indented = lines[full[0]][:1].isspace() and nxt is not None and not lines[nxt][:1].isspace()
        if s and s[0].isupper() and not indented and not re.search(r"[.;?!]$", s) and len(s) < 0.85 * width and follow[:1].isupper() and not re.match(r"(?:Author|DOI|By )", follow):
            kind[full[0]] = "header"
    for i in full:  # the same header again where no page break was seen
        if kind[i] == "text" and known and plain[i] in known and not re.search(r"[.;:,?!]$", lines[i].strip()):
            kind[i] = "header"
    return page


def running_words(text: str) -> set[str]:
    """Words of the running text in small letters, without those broken at a line end."""
    page = structure(text)
    out: set[str] = set()
    for line, k in zip(page.lines, page.kind):
        if k == "text":
            low = line.lower()
            words = _WORD.findall(low)
            if words and low.rstrip()[-1] in BREAKS:
                words.pop()
            out.update(words)
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    texts = 0
    for pdf in batches:
        for t in pdf["text"]:
            if t and t.strip():
                texts += 1
                counts.update(running_words(t))
        if len(counts) > 200_000:
            yield pd.DataFrame(counts.items(), columns=["word", "n"])
            counts = Counter()
    counts[""] = texts
    yield pd.DataFrame(counts.items(), columns=["word", "n"])


class Word(NamedTuple):
    """A word of a way through the lattice, and the place where it begins."""

    word: str
    at: int
    misread: bool
    broken: bool


class Reading(NamedTuple):
    """What stands for so many units."""

    cost: float
    words: list[Word]
    changed: bool
    units: int = 1


def _characters(read: str) -> tuple[str, str, set[int]]:
    """What is read in small letters with its ligatures taken apart and its breaks single characters; the same as written; the places of ligatures."""
    as_read = _BROKEN.sub(BROKEN, read)
    if not _LIGATURE.search(as_read):
        low = as_read.lower()
        return low, as_read if len(low) == len(as_read) else low, set()
    out, places = "", set()
    for c in as_read:
        if told := LIGATURES.get(c):
            places.update(range(len(out), len(out) + len(told)))
        out += told or c
    low = out.lower()
    return low, out if len(low) == len(out) else low, places


def _figure(low: str) -> bool:
    """Whether something read is a number rather than a word."""
    letters = sum(c.isalpha() for c in low)
    return letters < 1 or letters == 1 and len(low) > 2 and sum(c.isdigit() for c in low) > 1


class Decoder:
    """The cheapest reading of a stretch of characters as corpus words."""

    def __init__(self, counts: dict[str, int], texts: int) -> None:
        self.counts = counts
        self.texts = max(1, texts)
        self.common = LEAST_SHARE * texts
        self.sorted = sorted(counts)
        self.hyphened = min((self.cost(w) for w in counts if "-" in w), default=math.inf)  # the least a word with a hyphen costs
        self.memo: dict[str, tuple[str, int] | None] = {}
        self.settled: set[str] = set()  # words as read that stand and cost no more than half a dropped blank: two of them are never one word
        self.begun: dict[str, bool] = {}
        self.units: dict[str, Reading] = {}
        self.read: dict[str, list[Reading]] = {}
        self.meant: dict[str, list[str]] = {}
        for seen, meant in CONFUSIONS:
            self.meant.setdefault(seen, []).append(meant)

    def begins(self, prefix: str) -> bool:
        """Whether some corpus word begins so."""
        if (known := self.begun.get(prefix)) is None:
            if len(self.begun) > 500_000:
                self.begun.clear()
            i = bisect_left(self.sorted, prefix)
            known = self.begun[prefix] = i < len(self.sorted) and self.sorted[i].startswith(prefix)
        return known

    def cost(self, word: str) -> float:
        n = self.counts.get(word, 0)
        return math.log((self.texts + 1) / n) if n else UNKNOWN

    def stands(self, word: str) -> float:
        """The cost of a word as it is read; a rare one may be a misreading that came more than once."""
        return self.cost(word) if self.counts.get(word, 0) >= self.common else UNKNOWN

    def correction(self, word: str) -> tuple[str, int] | None:
        """The likeliest corpus word `word` is a confusion of, with the number of confusions; None where it stands as it is."""
        if word not in self.memo:
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = self._correction(word)
        return self.memo[word]

    def _correction(self, word: str) -> tuple[str, int] | None:
        low = word.lower()
        plain = _LIGATURE.sub(lambda m: LIGATURES[m[0]], low)
        if plain != low:
            own = self.counts.get(plain, 0)
            further = None if own else self._search(plain, 0)
            return further if further else (plain, 1)
        letters = sum(c.isalpha() for c in low)
        if letters < 1 or len(low) < 2 or letters == 1 and len(low) > 2 and sum(c.isdigit() for c in low) > 1:
            return None
        return self._search(low, self.counts.get(low, 0))

    def _search(self, low: str, own: int) -> tuple[str, int] | None:
        """Best first through the readings of one word, as far as they cost less than what is read."""
        stands, rare = self.stands(low), self.cost(low)
        common_own = own if own >= self.common else 0
        most = max(stands, rare)
        n, heap, seen = len(low), [(0.0, 0, "", 0)], set()
        while heap:
            spent, pos, prefix, k = heapq.heappop(heap)
            if pos > n:
                return prefix, k
            if (pos, prefix) in seen:
                continue
            seen.add((pos, prefix))
            if pos == n:
                if k and prefix != low and (count := self.counts.get(prefix, 0)):
                    least, bound = (common_own, stands) if count >= self.common else (own, rare)  # a rare word must beat what is read by its own count
                    if count >= 8 * least and (c := spent + self.cost(prefix)) < bound:
                        heapq.heappush(heap, (c, n + 1, prefix, k))
                continue
            if self.begins(v := prefix + low[pos]):
                heapq.heappush(heap, (spent, pos + 1, v, k))
            if (c := spent + CONFUSED * (k + 1)) < most:
                for width in (1, 2):
                    if pos + width <= n:
                        for meant in self.meant.get(low[pos : pos + width], ()):
                            if self.begins(v := prefix + meant):
                                heapq.heappush(heap, (c, pos + width, v, k + 1))
        return None

    def unknown(self, word: str) -> float:
        return UNKNOWN + PER_LETTER * max(0, len(word) - 10)

    def unit(self, read: str) -> Reading:
        """The cheapest reading of a stretch without blanks, taken alone; one broken at a line end is read across its break."""
        if (known := self.units.get(read)) is None:
            if len(self.units) > 200_000:
                self.units.clear()
            known = self.units[read] = self._unit(read)
            if known.cost <= MERGED / 2 and not known.changed and read not in self.settled:
                if len(self.settled) > 300_000:
                    self.settled.clear()
                self.settled.add(read)
        return known

    def _unit(self, read: str) -> Reading:
        s, _, odd = _characters(read)
        if _figure(s):
            return Reading(0.0, [Word(s, 0, False, False)], False)
        if BROKEN in s and (plain := s.replace(BROKEN, "")) in self.counts and self.stands(plain) <= CONFUSED + self.hyphened and s.replace(BROKEN, "-") not in self.counts and self.correction(plain) is None:
            cost, word, misread = self.cost(plain), plain, bool(odd)  # a word with a hyphen, being a confusion, can't be cheaper
        elif BROKEN in s:
            known = [self.cost(w) for w in (plain, s.replace(BROKEN, "-")) if w in self.counts and self._arc(w, w, 0) is not None]
            whole = [w for w in self._words(s, 0, [min(known, default=UNKNOWN)], 0.0, [0] * (len(s) + 1)) if w[0] == len(s)]
            cost, word, misread = whole[0][1:] if whole else (self.unknown(s), self._unheard(read), False)
            misread = misread or bool(odd)
        elif fixed := self.correction(read):
            word, k = fixed
            misread = True
            cost = self.cost(word) + CONFUSED * k * (k + 1) / 2 * (word != s) if word in self.counts else self.unknown(s)
        else:
            cost, word, misread = (self.cost(s) if s in self.counts else self.unknown(s)), s, False
        alone = Reading(cost, [Word(word, 0, misread, BROKEN in s)], misread or BROKEN in s)
        return self._through(s, [alone], odd)[0] if cost > SPLIT else alone

    def _unheard(self, read: str) -> str:
        """What a word broken at a line end is taken for where no corpus word is found for it."""
        parts = _BROKEN.split(read)
        kept = all(self.counts.get(x.lower(), 0) for p in parts for x in p.split("-")) or all(p[:1].isupper() for p in parts[1:])
        return ("-" if kept else "").join(parts).lower()

    def stretch(self, units: list[str]) -> list[Reading]:
        """The cheapest way through the lattice of units with blanks or line ends between; each reading is of as many units as `units` says."""
        told = " ".join(units)
        if (known := self.read.get(told)) is None:
            if len(self.read) > 100_000:
                self.read.clear()
            s, _, odd = _characters(told)
            known = self._through(s, [self.unit(u) for u in units], odd)
            if len(units) < 20:
                self.read[told] = known
        return known

    def _through(self, s: str, alone: list[Reading], odd: set[int]) -> list[Reading]:
        """From place to place in order, each with the cheapest way to it: one word further, or one unit as it reads alone.

        A way that costs as much as the units it has touched do alone, together with what dropping the next blanks could yet save,
        is left: no cheapest way is lost by that.
        """
        n = len(s)
        starts = [0, *(k + 1 for k, c in enumerate(s) if c == " "), n + 1]
        owner = [x for x, (a, b) in enumerate(zip(starts, starts[1:])) for _ in range(b - a)]
        summed = [0.0]
        for r in alone:
            summed.append(summed[-1] + r.cost)
        saved = [0.0] * len(alone)
        for x in range(len(alone) - 2, -1, -1):
            saved[x] = max(0.0, alone[x + 1].cost - MERGED + saved[x + 1])
        room = [a + b for a, b in zip(summed[1:], saved)]
        best: dict[int, tuple[float, int, Word | None]] = {0: (0.0, -1, None)}  # place -> (cost of the way, place before, the word between)
        places = [0]
        entry = 0.0

        def reach(to: int, cost: float, before: int, word: Word | None) -> None:
            if to not in best:
                heapq.heappush(places, to)
            if to not in best or cost < best[to][0]:
                best[to] = (cost, before, word)

        while (i := heapq.heappop(places)) <= n:
            cost, x = best[i][0], owner[i]
            if starts[x] == i:
                entry = cost
                reach(starts[x + 1], cost + alone[x].cost, i, None)
            base = entry - summed[x] - cost
            for at, c, word, misread in self._words(s, i, room, base, owner):
                told = Word(word, i, misread or not odd.isdisjoint(range(i, at)), BROKEN in s[i:at])
                if at == n or s[at] == " ":
                    if owner[at - 1] > x or starts[x] != i:  # else that unit alone
                        reach(at + 1, cost + c, i, told)
                    continue
                y = owner[at]
                c += SPLIT + SHORT_PART * (len(word) < 3) + SHORT_PART * (starts[y + 1] - 1 - at < 3)
                if c < room[y] + base:
                    reach(at, cost + c, i, told)
        way = []
        i = n + 1
        while i > 0:
            _, before, word = best[i]
            way.append((before, i, word))
            i = before
        out: list[Reading] = []
        words: list[Word] = []
        for before, i, word in reversed(way):
            if word is None:
                out.append(alone[owner[before]])
                continue
            if not words:
                begun = before
            words.append(word._replace(at=before - begun))
            if i > n or s[i - 1] == " ":
                units = owner[i - 2] - owner[begun] + 1
                changed = units > 1 or len(words) > 1 or words[0].misread or words[0].broken
                out.append(Reading(best[i][0] - best[begun][0], words, changed, units))
                words = []
        return out

    def _words(self, s: str, i: int, room: list[float], base: float, owner: list[int]) -> list[tuple[int, float, str, bool]]:
        """(end, cost, word, whether misread) of the cheapest word from place `i` of `s` to each place where one may end.

        A character stands, is a listed confusion, a blank is dropped, a break falls away or is a hyphen; by unit, `room`
        and `base` together are what a word may cost there. A rare word that is taken for another as it is read does not stand.
        """
        n = len(s)
        ends: dict[int, tuple[float, int, str, bool]] = {}
        todo = [(i, "", "", 0, 0)]
        seen = set(todo)
        while todo:
            pos, prefix, raw, k, dropped = todo.pop()
            spent = CONFUSED * k * (k + 1) / 2
            if prefix and (pos == n or s[pos] != BROKEN) and s[pos - 1] not in " " + BROKEN and prefix in self.counts and (c := self._arc(prefix, raw, k)) is not None:
                c += MERGED * dropped
                if pos not in ends or (c, len(prefix)) < ends[pos][:2]:
                    ends[pos] = (c, len(prefix), prefix, k > 0)
            if pos >= n:
                continue
            ahead: list[tuple[int, str, str, int, int]] = []
            here = s[pos]
            if here == " ":
                if prefix:
                    ahead.append((pos + 1, prefix, raw, k, dropped + 1))
            elif here == BROKEN:
                if prefix:
                    ahead.append((pos + 1, prefix, raw, k, dropped))
                    if self.begins(v := prefix + "-"):
                        ahead.append((pos + 1, v, raw + "-", k, dropped))
            else:
                if self.begins(v := prefix + here):
                    ahead.append((pos + 1, v, raw + here, k, dropped))
                if spent + CONFUSED * (k + 1) < UNKNOWN:
                    for width in (1, 2):
                        for meant in self.meant.get(s[pos : pos + width], ()) if pos + width <= n else ():
                            if self.begins(v := prefix + meant):
                                ahead.append((pos + width, v, raw + s[pos : pos + width], k + 1, dropped))
            for state in ahead:
                if state not in seen and MERGED * state[4] + CONFUSED * state[3] * (state[3] + 1) / 2 < room[owner[min(state[0], n - 1)]] + base:
                    seen.add(state)
                    todo.append(state)
        return [(at, c, word, misread) for at, (c, _, word, misread) in ends.items()]

    def _arc(self, word: str, raw: str, k: int) -> float | None:
        """What `word` costs where `raw` is read, with `k` confusions; None where it is no reading of it."""
        own, count = self.counts.get(raw, 0), self.counts[word]
        if not k:
            return None if own < self.common and self.correction(raw) is not None else self.cost(word)
        if word == raw:
            return None
        least, bound = (own if own >= self.common else 0, self.stands(raw)) if count >= self.common else (own, self.cost(raw))
        c = self.cost(word) + CONFUSED * k * (k + 1) / 2
        return c if count >= 8 * least and c < bound else None

    def joined(self, head: str, tail: str) -> tuple[str, float]:
        """The word that `head` and `tail`, broken at a line end, make, in small letters, and its cost."""
        r = self.unit(f"{head}-{BROKEN}{tail}")
        return r.words[0].word, r.cost


def _broken(line: str) -> re.Match | None:
    """The last word of a line, where it is broken at the end."""
    bare = line.rstrip()
    if not bare or bare[-1] not in BREAKS:
        return None
    last = None
    for last in _WORD.finditer(bare, max(0, bare.rfind(" ") + 1)):
        pass
    return last if last is not None and last.end() >= len(bare) - 1 else None


def settle(page: Page, decoder: Decoder) -> None:
    """Where a word broken at a line end makes none with the next line but does with one soon after, what lies between is no running text."""
    text = [i for i, k in enumerate(page.kind) if k == "text"]
    for k, i in enumerate(text[:-1]):
        if page.kind[i] != "text" or (head := _broken(page.lines[i])) is None:
            continue
        for far in range(k + 1, min(k + 5, len(text))):
            line = page.lines[text[far]]
            first = _WORD.search(line)
            if first and first.start() == len(line) - len(line.lstrip()) and decoder.joined(head[0], first[0])[1] < UNKNOWN:
                for x in text[k + 1 : far]:
                    page.kind[x] = "pageno" if _SURE.fullmatch(page.lines[x]) or _BARE.fullmatch(page.lines[x]) else "header"
                break


def _cased(word: str, as_read: str) -> str:
    return word[:1].upper() + word[1:] if as_read[:1].isupper() else word


def decode(page: Page, decoder: Decoder) -> tuple[list[tuple[str, str]], list[str]]:
    """(kind, item) of all repairs, and the lines of running text as they read after them ('' for all others).

    The running text is one stream: a line end is a blank that may be dropped as well, or a break where a hyphen stands before it.
    """
    settle(page, decoder)
    text = [i for i, k in enumerate(page.kind) if k == "text"]
    out = [""] * len(page.lines)
    apart = {b for a, b in zip(text, text[1:]) if b - a > 1 and all(k == "blank" for k in page.kind[a + 1 : b])}
    stream = "\n".join("\f" + page.lines[i] if i in apart else page.lines[i] for i in text)
    found: list[tuple[str, str]] = []
    stream = _decoded(stream, decoder, found)
    for i, line in zip(text, stream.split("\n")):
        out[i] = line.lstrip("\f")
    return found, out


def _decoded(stream: str, decoder: Decoder, found: list[tuple[str, str]]) -> str:
    """`stream` as it reads by the cheapest way through the lattice; its line ends stay, behind the words that went over them.

    No way that drops a blank between two units is cheaper where what they and their neighbours cost alone is less than that: there
    the lattice falls into parts, each decoded for itself.
    """
    pieces = _UNITS.split(stream)  # units at the odd places, what stands between them at the even ones
    words = pieces[1::2]
    settled, unit = decoder.settled, decoder.unit
    hot = [k for k, w in enumerate(words) if w not in settled]
    if not hot:
        return stream
    costs = [MERGED / 2] * len(words)  # of a settled one the most it may cost
    for k in hot:
        costs[k] = unit(words[k]).cost
    soft = lambda k: _SOFT.fullmatch(pieces[2 * k]) is not None  # noqa: E731  whether unit k follows the one before at a blank
    parts: list[str] = []
    done = pending = at = 0

    def literal(till: int) -> None:
        nonlocal pending
        chunk = "".join(pieces[done:till])
        if pending and (m := re.search(r"\s", chunk)):
            chunk = chunk[: m.start()] + "\n" * pending + chunk[m.start() :].lstrip(" \t")
            pending = 0
        parts.append(chunk)

    for h in hot:
        if h < at:
            continue
        # on either side as far as dropping blanks may pay
        first, gain = h, costs[h] - MERGED
        while first > at and gain + costs[first - 1] > 0 and soft(first):
            first -= 1
            gain = max(gain, 0.0) + costs[first] - MERGED
        last, gain = first, costs[first] - MERGED
        while last + 1 < len(words) and (last < h or gain + costs[last + 1] > 0 and soft(last + 1)):
            last += 1
            gain = max(gain, 0.0) + costs[last] - MERGED
        at = last + 1
        k = first
        for r in [unit(words[h])] if first == last else decoder.stretch(words[first:at]):
            own = words[k : k + r.units]
            begin, k = k, k + r.units
            if not r.changed:
                continue
            literal(2 * begin + 1)
            done = 2 * k
            pending += sum(p.count("\n") for p in pieces[2 * begin + 1 : done])
            as_read = _characters(" ".join(own))[1]
            parts.append(" ".join(_cased(w.word, as_read[w.at :]) for w in r.words))
            over, blank = [], -1  # the blanks that are line ends
            for n, w in enumerate(own[:-1], begin + 1):
                blank += len(_characters(w)[0]) + 1
                if "\n" in pieces[2 * n]:
                    over.append(blank)
            for w, end in zip(r.words, [*(w.at for w in r.words[1:]), len(as_read)]):
                found += [("hyphen", w.word)] * (w.broken or any(w.at < p < end for p in over)) + [("misread", w.word)] * w.misread
    literal(len(pieces))
    return "".join(parts) + "\n" * pending


def paragraphs(page: Page, lines: list[str]) -> list[str]:
    """The running text as paragraphs: between two lines a break costs or earns by blank lines, indents, short lines and sentence ends."""
    text = [i for i, k in enumerate(page.kind) if k == "text" and lines[i].strip()]
    if not text:
        return []
    width = max(len(page.lines[i].rstrip()) for i in text)
    gains = []
    tabular = {i: page.gapped(lines[i]) and _TABLE.search(lines[i].strip()) is not None for i in text}
    for a, b in zip(text, text[1:]):
        skipped = page.kind[a + 1 : b]
        only_blank = bool(skipped) and all(k == "blank" for k in skipped)
        end, begin = lines[a].rstrip()[-1:], lines[b].strip()[:1]
        g = -2.0 + 3.0 * only_blank + 2.0 * (page.lines[b][:2] == "  " and page.lines[a][:2] != "  ") + 1.0 * (len(page.lines[a].rstrip()) < 0.75 * width) + (0.5 if end in ".?!\"”’" else -2.5) + (0.2 if begin.isupper() else -2.5)
        gains.append(g + (3.0 if tabular[a] or tabular[b] else 0.0))
    # state: whether a break was just made; two breaks in a row cost extra
    open_, closed, back = 0.0, -math.inf, []
    for g in gains:
        stay = max(open_, closed)
        cut = max(open_ + g, closed + g - 0.5)
        back.append((open_ >= closed, open_ + g >= closed + g - 0.5))
        open_, closed = stay, cut
    cuts, state = [False] * len(gains), closed > open_
    for k in range(len(gains) - 1, -1, -1):
        cuts[k] = state
        state = not back[k][1 if state else 0]
    out, current = [], [lines[text[0]].strip()]
    for k, i in enumerate(text[1:]):
        if cuts[k]:
            out.append(" ".join(current))
            current = []
        current.append(lines[i].strip())
    return [*out, " ".join(current)]


def vocabulary(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Corpus words with the number of texts they stand in, and the number of texts; counted over all texts."""
    counted = texts.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).cache()
    total = counted.where("word = ''").agg(F.sum("n")).first()[0] or 0
    words = {r["word"]: r["n"] for r in counted.where((F.col("word") != "") & (F.col("n") >= LEAST)).collect()}
    counted.unpersist()
    return words, total


def repaired(works: DataFrame, key: str, text: str) -> DataFrame:
    """(key, found array<struct<kind, item>>, paragraphs array<string>) of every text that has something in it.

    `found` holds each distinct item once; a text in which nothing is found keeps its own lines as they stand, in one piece. Null
    and blank texts have no row. Words are judged by the whole corpus: every word of LEAST texts is sent to the
    workers. Rows are independent afterwards.
    """
    todo = works.select(F.col(key).alias("key"), F.col(text).alias("text")).where("trim(text) <> ''")
    words, total = vocabulary(todo.select("text"))
    shared = works.sparkSession.sparkContext.broadcast(Decoder(words, total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = shared.value  # what it remembers serves the next tasks of the worker
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"]):
                if not t.strip():
                    continue
                page = structure(t)
                found, lines = decode(page, decoder)
                found += [(kind, line.strip()) for kind, line in zip(page.kind, page.lines) if kind in ("header", "pageno")]
                items = list(dict.fromkeys(found))
                out.append((k, [{"kind": a, "item": b} for a, b in items], paragraphs(page, lines) if items else [t]))
            yield pd.DataFrame(out, columns=["key", "found", "paragraphs"])

    return todo.mapInPandas(run, f"key {works.schema[key].dataType.simpleString()}, found array<struct<kind:string,item:string>>, paragraphs array<string>").withColumnRenamed("key", key)
