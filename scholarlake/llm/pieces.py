"""Splitting oversized items at natural boundaries, by ranges.

A text is cut into ranges with halos, so that one giant text is spread over many tasks. Workers find the boundaries of their range
and follow the pieces through it from every place a piece may enter it; each place comes out with the place where the next range is
entered and the number of pieces between. Of a range only that small table is gathered: stitched from range to range it gives
the true entries, the counts add up to the numbers of the pieces, and each range emits its own pieces by offset.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.plans.cluster import cut

LIMIT = 2_048
OVERLAP = 256
RANGE = 65_536

# level 4: paragraph or page, 3: sentence, 2: clause or line, 1: word
_BOUNDARIES = re.compile(
    r"(?P<p>\n[ \t]*\n\s*|\f\s*)|(?P<s>(?<=[.!?…])[\"'”’)\]]*\s+|(?<=[。！？；])[”’」』）]*)|(?P<c>\n\s*|(?<=[,;:])\s+|(?<=[，、：]))|(?P<w>\s+)"
)
_LEVEL = {"p": 4, "s": 3, "c": 2, "w": 1}
_LEFT = 64  # characters before a boundary that decide its level

_RANGES = "tbl string, item_key string, n long, range_no int, base long, slice string, ways array<struct<entry:long,leave:long,n:int,again:int>>"


def ranges_of(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """The ranges of every text over `limit` as slices that run from `base`, halos included, with their ways: where the pieces go that enter at `entry`.

    `leave` is the first start in a later range, -1 where the text ends before, `n` the pieces that start in this one, and `again` what
    the piece at `leave` repeats.
    """
    size = max(size, 2 * limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tbl, key, text in zip(pdf["tbl"], pdf["item_key"], pdf["text"]):
                for k, at in enumerate(range(0, len(text), size)):
                    base = max(0, at - _LEFT)
                    part = text[base : at + size + 2 * limit + _LEFT]
                    ways = Stretch(part, base, len(text), at, at + size, limit, overlap).ways()
                    out.append((tbl, key, len(text), k, base, part, [{"entry": e, "leave": x, "n": n, "again": r} for e, (x, n, r) in ways.items()]))
                    if len(out) >= 64:
                        yield pd.DataFrame(out, columns=["tbl", "item_key", "n", "range_no", "base", "slice", "ways"])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=["tbl", "item_key", "n", "range_no", "base", "slice", "ways"])

    return items.where(F.length("text") > limit).select("tbl", "item_key", "text").mapInPandas(run, _RANGES)


def _local_level(before: str) -> int:
    """The level of a boundary by the _LEFT characters before it, for one whose white space may begin further left."""
    bare = before.rstrip()
    gap = before[len(bare) :]
    if "\f" in gap or gap.count("\n") > 1:
        return 4
    if re.search(r"[.!?…][\"'”’)\]]*$", bare):
        return 3
    return 2 if "\n" in gap or bare[-1:] in ",;:" else 1


def boundaries(text: str, base: int, low: int, high: int, ended: bool = True) -> tuple[list[int], list[int]]:
    """Offsets in [low, high) of the whole text before which it may be cut, with their levels.

    What a boundary is depends on the _LEFT characters before it and the one after, so that ranges that see the same place agree;
    `ended` says that the text ends with this slice.
    """
    at, levels = [], []
    for m in _BOUNDARIES.finditer(text):
        p = base + m.end()
        if p >= high or m.end() == len(text) and not ended:
            break
        if p >= low and p > 0 and (not at or at[-1] != p):
            at.append(p)
            far = m.start() == 0 and base > 0 or m.end() - m.start() >= _LEFT
            levels.append(_local_level(text[max(0, m.end() - _LEFT) : m.end()]) if far else _LEVEL[m.lastgroup])
    return at, levels


class Stretch:
    """The boundaries of one range, and the pieces that start in it.

    A piece ends at the highest boundary in its second half, the last of several; without any, at the limit. The next one begins
    at the first sentence, else clause, else word, within `overlap` before that end; without any at the last multiple of `overlap`
    before it, so that whatever the range before does a piece enters at a boundary or a multiple.
    """

    def __init__(self, text: str, base: int, n: int, low: int, high: int, limit: int = LIMIT, overlap: int = OVERLAP) -> None:
        self.n, self.low, self.high, self.limit, self.overlap = n, low, high, limit, overlap
        self.at, levels = boundaries(text, base, low, high + 2 * limit, base + len(text) >= n)
        self.ends = [[p for p, x in zip(self.at, levels) if x == level] for level in (4, 3, 2, 1)]
        self.starts = [[p for p, x in zip(self.at, levels) if x >= 3], self.ends[2], self.ends[3]]
        self.memo: dict[int, tuple[int, int]] = {}

    def piece(self, start: int) -> tuple[int, int]:
        """(end of the piece that starts here, start of the next or -1)."""
        if self.n - start <= self.limit:
            return self.n, -1
        if start not in self.memo:
            end = start + self.limit
            for level in self.ends:
                i = bisect_right(level, start + self.limit) - 1
                if i >= 0 and level[i] > start + self.limit // 2:
                    end = level[i]
                    break
            after = (end - 1) // self.overlap * self.overlap
            for level in self.starts:
                i = bisect_left(level, end - self.overlap)
                if i < len(level) and level[i] < end:
                    after = level[i]
                    break
            self.memo[start] = end, after
        return self.memo[start]

    def follow(self, entry: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces from `entry` on that start in this range."""
        out, start = [], entry
        while 0 <= start < self.high:
            end, after = self.piece(start)
            out.append((start, end))
            start = after
        return out

    def ways(self) -> dict[int, tuple[int, int, int]]:
        """entry -> (leave, pieces, again) for every place at which a piece may enter; later places are followed first, and shared."""
        if self.low == 0:
            entries = [0]
        else:
            first = -(-self.low // self.overlap) * self.overlap
            entries = sorted({*self.at[: bisect_left(self.at, self.low + self.limit)], *range(first, self.low + self.limit, self.overlap)})
        known: dict[int, tuple[int, int, int]] = {}
        for e in reversed(entries):
            passed, start = [], e
            while start not in known and 0 <= start < self.high:
                passed.append(start)
                start = self.piece(start)[1]
            leave, n, again = known.get(start, (start, 0, 0))
            for s in reversed(passed):
                if n == 0:
                    again = self.piece(s)[0] - leave if leave >= 0 else 0
                n += 1
                known[s] = leave, n, again
        return {e: known[e] for e in entries if e < self.n}


def stitched(ranges: DataFrame) -> DataFrame:
    """(tbl, item_key, range_no, entry, first_no, again): where the pieces of a text enter each of its ranges, the number of the first there and what it repeats.

    Of each range only its ways come together, a hundredth of it; a text is one fold over its ranges in order.
    """

    @F.pandas_udf("array<struct<range_no:int,entry:long,first_no:int,again:int>>")
    def fold(tables: pd.Series) -> pd.Series:
        out = []
        for rows in tables:
            at, number, again, entered = 0, 0, 0, []
            for r in rows:
                way = next((w for w in r["ways"] if w["entry"] == at), None) if at >= 0 else None
                if way is not None:
                    entered.append({"range_no": r["range_no"], "entry": at, "first_no": number, "again": again})
                    at, number, again = way["leave"], number + way["n"], way["again"]
            out.append(entered)
        return pd.Series(out, index=tables.index)

    tables = ranges.groupBy("tbl", "item_key").agg(F.array_sort(F.collect_list(F.struct("range_no", "ways"))).alias("tables"))
    return tables.select("tbl", "item_key", F.explode(fold("tables")).alias("e")).select("tbl", "item_key", "e.range_no", "e.entry", "e.first_no", "e.again")


def piece_table(ranges: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, texts: bool = False) -> DataFrame:
    """(tbl, item_key, piece_no, start, end, repeated): the pieces of every text of ranges_of(), as offsets; with `texts` also the piece."""
    size = max(size, 2 * limit)
    entered = ranges.drop("ways").join(stitched(ranges), ["tbl", "item_key", "range_no"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for tbl, key, n, k, base, part, entry, number, again in zip(*(pdf[c] for c in ("tbl", "item_key", "n", "range_no", "base", "slice", "entry", "first_no", "again"))):
                last = None
                for i, (a, b) in enumerate(Stretch(part, base, n, k * size, (k + 1) * size, limit, overlap).follow(entry)):
                    out.append((tbl, key, number + i, a, b, again if last is None else last - a, part[a - base : b - base] if texts else None))
                    last = b
            yield pd.DataFrame(out, columns=["tbl", "item_key", "piece_no", "start", "end", "repeated", "piece"])

    made = entered.mapInPandas(emit, "tbl string, item_key string, piece_no int, start long, end long, repeated int, piece string")
    return made if texts else made.drop("piece")


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """(tbl, item_key, piece_no, start, end, repeated, piece) of every item of `items` (tbl, item_key unique within it, text) over `limit`.

    Lengths are in code points. No piece is over `limit`; each after the first begins with `repeated` <= `overlap` characters of
    the end of the one before, and the rest, joined, is the text. Null, empty and short texts give no pieces. The slices are
    written once and read twice, so that nothing before them is done again.
    """
    return piece_table(cut(ranges_of(items, limit, overlap, size)), limit, overlap, size, texts=True)


def newest_texts(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per (tbl, item_key) of the texts over `limit`: of copies, the one with the greatest `version`, then the longest."""
    return items.where(F.length("text") > limit).groupBy("tbl", "item_key").agg(F.max_by("text", F.struct("version", F.length("text"), "text")).alias("text"))
