"""Garbled text from a wrong character encoding: find it, and restore the original where it can still be had.

Adjacent character pairs are scored over the whole corpus; pairs of a text that the corpus makes improbable are gathered into
runs by maximum-scoring segments; inverse mappings (text -> bytes by the codec wrongly used -> text by the right one) are tried
on the characters of those runs only, and the one that raises the pair score most is kept, layer by layer. A mapping that holds
in the runs makes runs of the other stretches it would better as well. Pairs inside what reads as misread UTF-8 are counted
apart, under the character they would stand for: where that is the commoner thing in the corpus, they attest nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Codecs UTF-8 is commonly misread by, and single-byte codecs commonly taken for each other (wrong, right).
UTF8_MISREAD_AS = ("cp1252", "latin_1", "cp1251", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_2", "iso8859_15", "cp1253", "cp1254", "cp1257", "koi8_r", "cp866", "cp852", "mac_cyrillic", "iso8859_5", "iso8859_7")
MISREAD_SINGLE = tuple(
    (wrong, right)
    for wrong in ("cp1252", "latin_1", "cp1251", "mac_roman", "cp437", "cp850")
    for right in ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp1250", "iso8859_2", "cp852", "cp1253", "iso8859_7", "cp1254", "cp1257", "cp437", "cp850", "mac_roman", "cp1252")
    if wrong != right
)
DULL = -2.8  # mean log P of a text's pairs below which it is looked at as a whole
MIN_GAIN = 2.0  # nats a restoration must gain over the text as it stands
_WIDE = "　"  # stands for all wide scripts, whose characters no single-byte codec has


def _bytes_of(codec: str) -> dict[str, int]:
    """Character -> byte of the upper half; bytes a Windows codec leaves undefined stand for themselves, as readers do it."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


class _Utf8Inverse:
    def __init__(self, codec: str) -> None:
        self.table = _bytes_of(codec)
        self.known: dict[str, str] = {}
        at = lambda lo, hi: _class([c for c, b in self.table.items() if lo <= b <= hi])
        if self.table.get("\xa0") == 0xA0:  # white space is often made plain after the misreading
            self.table[" "] = 0xA0
        cont = at(0x80, 0xBF)
        self.pattern = re.compile(f"{at(0xC2, 0xDF)}{cont}|{at(0xE0, 0xEF)}{cont}{{2}}|{at(0xF0, 0xF4)}{cont}{{3}}")

    def decoded(self, m: re.Match) -> str:
        seen = m[0]
        if (c := self.known.get(seen)) is None:
            try:
                c = bytes(self.table[x] for x in seen).decode("utf-8")
            except UnicodeDecodeError:
                c = seen
            self.known[seen] = c  # as many as there are characters
        return c

    def __call__(self, text: str) -> str:
        return self.pattern.sub(self.decoded, text)


def _single_inverse(wrong: str, right: str) -> dict[int, str]:
    out = {}
    for c, b in _bytes_of(wrong).items():
        try:
            out[ord(c)] = bytes([b]).decode(right)
        except UnicodeDecodeError:
            pass
    return {k: v for k, v in out.items() if chr(k) != v}


_UTF8 = {c: _Utf8Inverse(c) for c in UTF8_MISREAD_AS}
_SINGLE = {pair: _single_inverse(*pair) for pair in MISREAD_SINGLE}
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile("�")


class _Folded(dict):
    """Characters as pairs are counted: wide scripts are one symbol, digits are one."""

    def __missing__(self, o: int) -> str:
        if o >= 0x2E80:
            c = _WIDE if unicodedata.category(chr(o))[0] in "LPSN" else chr(o)
        elif 48 <= o <= 57:
            c = "0"
        else:
            c = chr(o)
        self[o] = c
        return c


_FOLD = _Folded()


_COUNTED = ("cp1252", "cp1251", "cp437", "cp850", "mac_roman")  # alphabets under which misread UTF-8 is looked for when pairs are counted


def _misread(text: str) -> list[tuple[int, int, str]] | None:
    """Stretches (begin, end, character) that read as misread UTF-8; None where a text is kept out of the counts: it holds much of that, or control or replacement characters."""
    if re.search("[\x80-\x9f�]", text):
        return None
    total, out = -1, []
    for codec in _COUNTED:
        inverse = _UTF8[codec]
        hits = [(m.start(), m.end(), c) for m in inverse.pattern.finditer(text) if " " not in m[0] and (c := inverse.decoded(m)) != m[0]]
        if hits:
            if total < 0:
                total = sum(len(m) for m in _NON_ASCII.findall(text))
            if sum(e - b for b, e, _ in hits) >= 0.2 * total and codec != "mac_roman" or codec == "cp1252" and len(hits) > 1:
                return None
            out += hits
    return out


@lru_cache(50_000)
def _stretch_pairs(stretch: str) -> tuple[tuple[str, str], ...]:
    s = stretch.translate(_FOLD)
    return tuple(zip(s, s[1:]))


def _pair_counts(text: str) -> Counter:
    """Folded pairs with a character beyond ASCII; equal stretches are folded once."""
    out: Counter = Counter()
    for stretch, n in Counter(text[max(0, m.start() - 1) : m.end() + 1] for m in _NON_ASCII.finditer(text)).items():
        for p in _stretch_pairs(stretch):
            out[p] += n
    out.pop((_WIDE, _WIDE), None)
    return out


def _counted(text: str, hits: list[tuple[int, int, str]]) -> set[tuple[str, str, str]]:
    """(a, b, '') of the text's pairs; those in and beside a stretch that reads as misread UTF-8 as (a, b, what it would be)."""
    if not hits:
        return {(a, b, "") for a, b in _pair_counts(text)}
    out, bare, at = set(), [], 0
    for begin, end, c in sorted(hits):
        folded = text[max(0, begin - 1) : end + 1].translate(_FOLD)
        out |= {(a, b, c) for a, b in zip(folded, folded[1:]) if a >= "\x80" or b >= "\x80"}
        bare.append(text[at : max(at, begin)])
        at = max(at, end)
    return out.union(*({(a, b, "") for a, b in _pair_counts(t)} for t in [*bare, text[at:]]))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            if text and not text.isascii() and (hits := _misread(text)) is not None:
                counts.update(_counted(text, hits))
    yield pd.DataFrame([(a, b, c, n) for (a, b, c), n in counts.items()], columns=["a", "b", "instead", "n"])


def pair_counts(docs: DataFrame, text: str) -> DataFrame:
    """(a, b, instead, n): in how many texts the character b follows a, where either isn't ASCII; counted over all texts that aren't mostly misread.

    Wide scripts count as one symbol, so the result is bounded by the alphabets whatever the corpus's size.
    """
    return docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]")).mapInPandas(_count, "a string, b string, instead string, n long").groupBy("a", "b", "instead").agg(F.sum("n").alias("n"))


class _Remembered(dict):
    """A function of pairs whose values are kept."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, pair: tuple[str, str]):
        value = self[pair] = self.of(*pair)
        return value


class PairModel:
    """log P(b | a) of adjacent characters, and their mutual information, from pair_counts()."""

    def __init__(self, rows: list[tuple[str, str, str, int]]) -> None:
        self.n = {(a, b): n for a, b, c, n in rows if not c}
        common: Counter = Counter()
        for (_, b), n in self.n.items():
            common[b] += n
        for a, b, c, n in rows:
            if c and common[c.translate(_FOLD)] < n:  # what it would stand for is rarer than what stands here
                self.n[a, b] = self.n.get((a, b), 0) + n
        self.left: Counter = Counter()
        self.right: Counter = Counter()
        for (a, b), n in self.n.items():
            self.left[a] += n
            self.right[b] += n
        self.total = max(1, sum(self.n.values()))
        self.kinds = max(1, len(self.right))
        self.arrays()
        self.log, self.odd = _Remembered(self.log_p), _Remembered(self.improbable)  # as many as there are pairs of characters

    def log_p(self, a: str, b: str) -> float:
        if a < "\x80" and b < "\x80":
            return 0.0 if (a, b) != (_WIDE, _WIDE) else -0.5
        if a == b == _WIDE:
            return -0.5
        back = (self.right[b] + 0.05) / (self.total + 0.05 * self.kinds)
        return math.log((self.n.get((a, b), 0) + 0.5 * back) / (self.left[a] + 0.5))

    def information(self, a: str, b: str) -> float:
        """Pointwise mutual information of the pair; a pair the corpus never shows has the least there is."""
        n = self.n.get((a, b), 0)
        return math.log(n * self.total / (self.left[a] * self.right[b])) if n else -8.0

    def score(self, text: str) -> float:
        """Sum of log P over the pairs of `text` that hold a character beyond ASCII."""
        return self.sum_of(_pair_counts(text))

    def sum_of(self, pairs: Counter) -> float:
        logs = self.log
        return sum([n * logs[p] for p, n in pairs.items()])

    def improbable(self, a: str, b: str) -> bool:
        n = self.n.get((a, b), 0)
        return n * 2000 < self.left[a] or not n

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbability, each widened to whole stretches of characters that aren't ASCII."""
        s, out, best, begin, total, end = text.translate(_FOLD), [], 0.0, 0, 0.0, 0
        for i in range(len(s) - 1):
            a, b = s[i], s[i + 1]
            plain = a < "\x80" and b < "\x80"
            gain = -0.4 if plain else -1.0 if a == b == _WIDE else max(-3.0, min(4.0, -self.information(a, b) if self.improbable(a, b) else -1.0))
            if total <= 0 and gain > 0:
                begin, total, best, end = i, 0.0, 0.0, i
            total += gain
            if total > best:
                best, end = total, i + 2
            if (total <= 0 or total < best - 6) and best > 0:
                out.append((begin, end))
                total = best = 0.0
        if best > 0:
            out.append((begin, end))
        return out


    def arrays(self) -> None:
        """Frequencies and single-byte inverses over one numbering of all their characters, made once."""
        chars = sorted({c for p in self.n for c in p} | {x for t in _SINGLE.values() for k, v in t.items() for x in (chr(k), v)})
        self.at = {c: i for i, c in enumerate(chars)}
        self.size = len(chars) + 1  # the last stands for every other character
        coded = sorted((self.at[a] * self.size + self.at[b], n) for (a, b), n in self.n.items())
        self.codes, self.logs = np.array([c for c, _ in coded] or [-1]), np.log(np.array([n for _, n in coded] or [0]) + 0.05)
        self.common = np.log(np.array([self.right.get(c, 0) for c in chars] + [0]) + 0.5)
        self.tables = list(_SINGLE.values())
        self.moves = np.tile(np.arange(self.size), (len(self.tables), 1))
        for row, table in zip(self.moves, self.tables):
            for k, v in table.items():
                row[self.at[chr(k)]] = self.at[v]

    def _log(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[i] == code, self.logs[i], math.log(0.05))

    def better(self, pairs: Counter) -> np.ndarray:
        """By single-byte inverse: how much commoner, in logarithms of their own frequencies, the pairs would be under it."""
        last = self.size - 1
        a, b = (np.array([self.at.get(p[k], last) for p in pairs], dtype=np.int64) for k in (0, 1))
        n = np.fromiter(pairs.values(), dtype=float, count=len(pairs))
        return (self._log(self.moves[:, a], self.moves[:, b]) - self._log(a, b)) @ n

    def moved(self, chars: Counter) -> tuple[np.ndarray, np.ndarray]:
        """By single-byte inverse: how many of the characters it changes, and how much commoner they would be."""
        c = np.array([self.at.get(x, self.size - 1) for x in chars], dtype=np.int64)
        n = np.fromiter(chars.values(), dtype=float, count=len(chars))
        return (self.moves[:, c] != c) @ n, (self.common[self.moves[:, c]] - self.common[c]) @ n

    def dull_runs(self, text: str, pairs: Counter) -> list[tuple[int, int]]:
        """The whole text as one run, where one single-byte alphabet may be taken for another: its pairs are attested, but rare on
        the whole, or its characters would be far more common ones by some inverse mapping."""
        if not pairs:
            return []
        if self.sum_of(pairs) < DULL * sum(pairs.values()):
            return [(0, len(text))]
        chars = Counter(c for c in text if "\x80" <= c < _WIDE)
        return [(0, len(text))] if chars and self.moved(chars)[1].max() > max(2.0, 0.7 * sum(chars.values())) else []

    def further(self, text: str, runs: list[tuple[int, int]], inverse: _Utf8Inverse) -> tuple[float, list[tuple[int, int]]]:
        """Stretches outside the runs that the mapping decodes to something likelier, with what they gain together."""
        gained, out, at = 0.0, [], 0
        for begin, end in [*runs, (len(text), len(text))]:
            for m in inverse.pattern.finditer(text, at, begin):
                before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
                gain = self.score(before + inverse.decoded(m) + after) - self.score(before + m[0] + after)
                if gain > 0:
                    gained += gain
                    out.append((m.start(), m.end()))
            at = end
        return gained, out

    def held(self, text: str, table: dict[int, str]) -> list[tuple[int, int]]:
        """The runs of a text for a mapping: all of it but for the maximum-scoring segments of what the mapping would make much rarer."""
        s, t = text.translate(_FOLD), text.translate(table).translate(_FOLD)
        out, begin, worst, total, end, at = [], 0, 0.0, 0.0, 0, 0
        log = lambda a, b: math.log(self.n.get((a, b), 0) + 0.05)
        for i in range(len(s) - 1):
            if s[i] < "\x80" and s[i + 1] < "\x80" or s[i] == s[i + 1] == _WIDE:
                continue
            loss = log(s[i], s[i + 1]) - log(t[i], t[i + 1])
            if total <= 0 and loss > 0:
                begin, total, worst, end = i, 0.0, 0.0, i
            total += loss
            if total > worst:
                worst, end = total, i + 2
            if total <= 0 or total < worst - 6:
                if worst > 6:
                    out.append((at, begin))
                    at = end
                total = worst = 0.0
        if worst > 6:
            out.append((at, begin))
            at = end
        return [(b, e) for b, e in [*out, (at, len(text))] if e > b]


def _widened(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs widened to whole stretches of characters that aren't ASCII, in order and apart."""
    out, at = [], 0
    for begin, end in runs:
        while begin > at and text[begin - 1] >= "\x80":
            begin -= 1
        while end < len(text) and text[end] >= "\x80":
            end += 1
        begin = max(begin, at)
        if end > begin:
            out.append((begin, end))
            at = end
    return out


def _apply(text: str, runs: list[tuple[int, int]], inverse) -> str:
    out, at = [], 0
    for begin, end in runs:
        out += [text[at:begin], inverse(text[begin:end])]
        at = end
    return "".join(out) + text[at:]


def _single(now: str, runs: list[tuple[int, int]], pairs: Counter, model: PairModel) -> tuple[float, str] | None:
    """What the best single-byte inverse makes of the text, with its gain: it must better the runs and, with all it holds for, the text."""
    chars = Counter(c for b, e in runs for c in now[b:e] if c >= "\x80")
    if not chars:
        return None
    changed, _ = model.moved(chars)
    inside: Counter = Counter()
    for b, e in runs:
        inside.update(_pair_counts(now[max(0, b - 1) : e + 1]))
    gains = np.where((changed > 0) & (model.better(inside) > 0), model.better(pairs), -np.inf)
    k = int(gains.argmax())
    everywhere, _ = model.moved(Counter(c for c in now if c >= "\x80"))
    if not gains[k] > MIN_GAIN + 1 or not gains[k] > 0.8 * everywhere[k]:
        return None
    table = model.tables[k]
    return float(gains[k]), _apply(now, model.held(now, table), lambda t: t.translate(table))


def restore(text: str | None, model: PairModel) -> tuple[bool, str | None]:
    """(whether the text is garbled, the original or None where it can't be had in full).

    Null, empty and ASCII texts are never garbled. A text with replacement characters is garbled for good. Of several inverse
    mappings with the same score the first in the lists above holds.
    """
    if not text or text.isascii():
        return False, None
    if _LOST.search(text):
        return True, None
    now, found = text, False
    while True:
        pairs = _pair_counts(now)
        odd = model.odd
        runs = model.runs(now) if any([odd[p] for p in pairs]) else []
        if not runs and not (runs := model.dull_runs(now, pairs)):
            break
        runs = _widened(now, runs)
        # what stands between the runs' ends is the same for all mappings, so that only differences of these scores say something
        score = lambda inverse, runs=runs, now=now: model.score("\0".join([now[max(0, b - 1) : b] + inverse(now[b:e]) + now[e : e + 1] for b, e in runs]))
        best = _single(now, runs, pairs, model) if not found else None
        if best is not None:  # on the scale of the scores below
            best = max(MIN_GAIN, model.score(best[1]) - model.score(now)), best[1]
        stands, tried = None, set()
        for inverse in _UTF8.values():
            if not any(inverse.pattern.search(now, b, e) for b, e in runs):
                continue
            new = _apply(now, runs, inverse)
            if new == now or new in tried:
                continue
            tried.add(new)
            stands = score(str) if stands is None else stands
            if (gain := score(inverse) - stands) <= MIN_GAIN:
                continue
            if (more := model.further(now, runs, inverse))[0] > 0:  # where the mapping holds in the runs, what else it betters is a run too
                gain, new = gain + more[0], _apply(now, sorted(runs + more[1]), inverse)
            if best is None or gain > best[0]:
                best = gain, new
        if best is None:
            break
        now, found = best[1], True
    held = re.search("[\x80-\x9f]", now) is not None
    return (True, None if held else now) if found else (held, None)


def garbled_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, restored_md5, restored) of every garbled text of `docs`; restored_md5 is '' and restored null where the original can't be had.

    The pair counts are gathered by one aggregation whose result is bounded by the alphabets; the texts themselves aren't moved.
    """
    rows = [(r["a"], r["b"], r["instead"], r["n"]) for r in pair_counts(docs, text).collect()]  # bounded by the alphabets
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    held: dict[str, PairModel] = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.setdefault("model", PairModel(shared.value))
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"]):
                garbled, original = restore(t, model)
                if garbled:
                    out.append((k, hashlib.md5(original.encode("utf-8", "surrogatepass")).hexdigest() if original is not None else "", original))
            yield pd.DataFrame(out, columns=["key", "restored_md5", "restored"])

    kind = docs.schema[key].dataType.simpleString()
    todo = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    return todo.mapInPandas(run, f"key {kind}, restored_md5 string, restored string").withColumnRenamed("key", key)
