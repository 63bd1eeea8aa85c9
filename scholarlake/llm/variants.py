"""Variant spellings of names typed by people and organisations, linked.

Spellings are taken apart; the different surnames are indexed by what is left of them without one letter (of long ones also two),
which two surnames that are close always share wherever the slip stands, and close surnames are refined at once by the first
letter of a given name (organisations are by number, or acronym), so that nothing common has to be discarded. Pairs are compared
once, by longest common subsequence. Spellings that say the same are joined into components first; those that say less join the
only component they fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.names import NONE, PART, SAME, close, compare_organisations, compare_people, fold, is_organisation, is_short, is_stand_in, organisation, person
from scholarlake.plans.cluster import cut

LONG = 40  # letters from which a surname is indexed by runs of letters
LEXICON_SHARE = 0.0005  # of all spellings a word must lead to count as a given name
EVIDENCE = 100  # spellings it must lead at most, however many there are
RARER = 20  # times rarer than a name it is close to: then it is a slip of that name, and none itself
_PARTS = "name string, n long, kind string, surname string, given array<string>, number string, keys array<string>, weak int"


def _word_roles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for name in pdf["name"]:
            if is_stand_in(name) or is_organisation(name):
                continue
            if m := re.match(r'\s*(?:(?:Dr|Prof)\.?\s+)?([^\W\d_]+)[^",]*"([^"]+)"', name):
                out.append((fold(m[1]), fold(m[2]).strip(), 0, 0, 0))
            if "," not in name and '"' not in name:
                ws = [fold(w.strip(".")) for w in name.split() if len(w.strip(".")) > 2]
                ws = [w for w in ws if w not in ("prof", "phd", "der", "van")]
                if len(ws) > 1:
                    out += [(ws[0].split("-")[0], "", 1, 0, 0), (ws[-1].rpartition("-")[2], "", 0, 1, int("-" in ws[-1]))]
        yield pd.DataFrame(out, columns=["word", "nick", "first", "last", "tail"])


def lexicons(spellings: DataFrame) -> tuple[set[str], dict[str, list[str]], set[str]]:
    """Given names, nicknames with what they stand for, and last parts of compound surnames, as the spellings themselves show them.

    A given name leads LEXICON_SHARE of all spellings, or EVIDENCE of them in a large corpus, and is no slip of a far commoner one;
    last parts alike. Nicknames are those typed in quotes beside a given name. What is gathered are the different given names of
    the world, not spellings.
    """
    total = spellings.count()
    roles = spellings.select("name").mapInPandas(_word_roles, "word string, nick string, first int, last int, tail int").groupBy("word", "nick").agg(F.sum("first").alias("first"), F.sum("last").alias("last"), F.sum("tail").alias("tail"), F.count("*").alias("n"))
    roles = roles.cache()
    least = min(max(3, LEXICON_SHARE * total), EVIDENCE)
    givens = without_slips({r["word"]: r["first"] for r in roles.where((F.col("nick") == "") & (F.col("first") >= least) & (F.col("first") > 2 * F.col("last"))).select("word", "first").collect()})
    tails = {r["word"] for r in roles.where((F.col("tail") >= least) & (F.col("tail") * 2 > F.col("last"))).select("word").collect()}
    nicks: dict[str, list[str]] = {}
    if givens:
        told = roles.where((F.col("nick") != "") & (F.col("word") != "")).collect()
        for r in sorted(told, key=lambda r: (-r["n"], r["nick"], r["word"])):
            if r["word"] not in givens:
                continue
            nicks.setdefault(r["nick"], []).append(r["word"])
    roles.unpersist()
    return givens, nicks, tails


def without_slips(led: dict[str, int]) -> set[str]:
    """The words of `led` (with the spellings each leads) that aren't close to another that leads RARER times as many."""
    index: dict[str, list[str]] = {}
    for w in led:
        for r in rests(w):
            index.setdefault(r, []).append(w)
    return {w for w, n in led.items() if not any(led[x] >= RARER * n and close(w, x) for r in rests(w) for x in index[r])}


def _keys(x: dict, nicks: dict[str, list[str]]) -> list[str]:
    """What a spelling must share with another besides a close surname; for organisations all of it."""
    if x["kind"] == "o":
        return [f"o|{x['number']}" if x["number"] else f"o|{x['surname'][:6]}"]
    return sorted({g[0] for g in x["given"][:2]} | {f[0] for g in x["given"][:2] for f in nicks.get(g, ())})


def rests(word: str) -> set[str]:
    """The word itself and without each one letter, from nine letters on also without each two: two words that are close() share one.

    Very long words have their runs of eight letters instead, as three slips leave some whole; around the bound both, as lengths differ by two.
    """
    if len(word) < 4:
        return {word}
    runs = {f"~{word[i : i + 8]}" for i in range(len(word) - 7)} if len(word) > LONG - 2 else set()
    if len(word) > LONG:
        return runs
    once = {word[:i] + word[i + 1 :] for i in range(len(word))}
    return {word} | runs | once | ({w[:i] + w[i + 1 :] for w in once for i in range(len(w))} if len(word) >= 9 else set())


def close_surnames(surnames: DataFrame) -> DataFrame:
    """(surname_a, surname_b): the different values of `surnames` that are equal, or close and at most two edits apart, both ways round.

    The words that share a rest are as many as there are ways to put a letter or two back, however large the corpus.
    """

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r, s) for s in pdf["surname"] for r in rests(s)], columns=["rest", "surname"])

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[close(a, b) for a, b in zip(pdf["surname_a"], pdf["surname_b"])]]

    index = cut(surnames.select("surname").distinct().mapInPandas(left, "rest string, surname string"))
    a, b = (index.select("rest", F.col("surname").alias(f"surname_{x}")) for x in "ab")
    met = a.join(b, "rest").where("surname_a < surname_b and levenshtein(surname_a, surname_b, 2) >= 0").select("surname_a", "surname_b").distinct()
    found = cut(met.mapInPandas(judged, "surname_a string, surname_b string"))
    same = surnames.select(F.col("surname").alias("surname_a"), F.col("surname").alias("surname_b")).distinct()
    return same.union(found).union(found.select("surname_b", "surname_a"))


def take_apart(spellings: DataFrame, givens: set[str], nicks: dict[str, list[str]], tails: set[str]) -> DataFrame:
    """The spellings that are names, with their parts and block keys.

    weak: 0 with a written given name beside another or an initial, 1 with one, 2 where that may be a short form, 3 with initials only.
    """
    shared = spellings.sparkSession.sparkContext.broadcast((givens, nicks, tails))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, short, ends = shared.value
        memo: dict[str, bool] = {}
        for pdf in batches:
            out = []
            for name, n in zip(pdf["name"], pdf["n"]):
                if is_stand_in(name):
                    continue
                x = organisation(name) if is_organisation(name) else person(name, known, ends)
                if x is None:
                    continue
                full = [g for g in x["given"] if len(g) > 1]
                weak = 0 if x["kind"] == "o" or full and len(x["given"]) > 1 else 3 if not full else 2 if full[0] in short or is_short(full[0], known, memo) else 1
                out.append((name, n, x["kind"], x["surname"], x["given"], x.get("number", ""), _keys(x, short), weak))
            yield pd.DataFrame(out, columns=["name", "n", "kind", "surname", "given", "number", "keys", "weak"])

    return spellings.mapInPandas(run, _PARTS)


def compared(parts: DataFrame, givens: set[str], nicks: dict[str, list[str]]) -> DataFrame:
    """(a, b, level, exact, weak_a, weak_b): pairs of a block that don't conflict, each once."""
    shared = parts.sparkSession.sparkContext.broadcast((givens, nicks))
    keyed = parts.select(F.explode("keys").alias("key"), "name", "kind", "surname", "given", "number", "keys", "weak")
    left, right = (keyed.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("name", "kind", "surname", "given", "number", "keys", "weak"))) for x in "ab")
    beside = right.where("kind_b = 'p'").join(close_surnames(parts.where("kind = 'p'").select("surname")), "surname_b")
    people = left.where("kind_a = 'p'").join(beside, ["surname_a", "key"])
    bodies = left.where("kind_a = 'o'").join(right.where("kind_b = 'o'"), "key")
    pairs = people.unionByName(bodies).where((F.col("name_a") < F.col("name_b")) & (F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, short = shared.value
        memo: dict[str, bool] = {}
        for pdf in batches:
            out = []
            for na, nb, kind, sa, sb, ga, gb, xa, xb, wa, wb in zip(*(pdf[c] for c in cols)):
                a, b = {"surname": sa, "given": list(ga), "number": xa}, {"surname": sb, "given": list(gb), "number": xb}
                level = compare_organisations(a, b) if kind == "o" else compare_people(a, b, known, short, memo)
                if level != NONE:
                    out.append((na, nb, level, sa == sb, wa, wb))
            yield pd.DataFrame(out, columns=["a", "b", "level", "exact", "weak_a", "weak_b"])

    cols = ["name_a", "name_b", "kind_a", "surname_a", "surname_b", "given_a", "given_b", "number_a", "number_b", "weak_a", "weak_b"]
    return pairs.select(*cols).mapInPandas(run, "a string, b string, level int, exact boolean, weak_a int, weak_b int")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, label) and the other columns of `nodes`: the least name of the component of each node; edges are (a, b).

    Labels spread, and then point where the label's own label points, until none changes; each round is cut.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    labels = cut(nodes.select("name", F.col("name").alias("label")))
    while True:
        seen = both.join(labels, both["a"] == labels["name"]).groupBy("b").agg(F.min("label").alias("seen"))
        step = labels.join(seen, labels["name"] == seen["b"], "left").select("name", F.col("label").alias("was"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        up = labels.select(F.col("name").alias("via"), F.col("label").alias("up"))
        new = cut(step.join(up, F.col("label") == F.col("via"), "left").select("name", "was", F.least("label", "up").alias("label")))
        labels = new.select("name", "label")
        if new.where("was <> label").isEmpty():
            return labels


def _attach(labels: DataFrame, edges: DataFrame, weak: int) -> DataFrame:
    """Components whose strongest spelling is of this weakness join the only stronger component they fit, exact surnames first."""
    strength = labels.groupBy("label").agg(F.min("weak").alias("rank"))
    at = labels.select("name", "label").join(strength, "label")
    sides = [edges.select(F.col(x).alias("a"), F.col(y).alias("b"), "exact", F.col(f"weak_{x}").alias("weak")) for x, y in ("ab", "ba")]
    both = sides[0].union(sides[1]).where(F.col("weak") == weak).drop("weak")
    fits = (
        both.join(at.where(F.col("rank") == weak).select(F.col("name").alias("a"), F.col("label").alias("weaker")), "a")
        .join(at.where(F.col("rank") < weak).select(F.col("name").alias("b"), F.col("label").alias("stronger")), "b")
        .groupBy("weaker", "exact").agg(F.min("stronger").alias("lo"), F.max("stronger").alias("hi"))
    )
    best = fits.groupBy("weaker").agg(F.max_by(F.struct("lo", "hi"), "exact").alias("f")).where("f.lo = f.hi").select("weaker", F.col("f.lo").alias("to"))
    return cut(labels.join(best, labels["label"] == best["weaker"], "left").select("name", "weak", F.coalesce("to", "label").alias("label")))


def linked_spellings(spellings: DataFrame) -> DataFrame:
    """(name, label) for every spelling of `spellings` (name, n) that is a name; equal labels mean the same person or organisation.

    Stand-ins and names without a surname have no row. A spelling that fits two persons equally stays with neither.
    """
    parts = cut(spellings.groupBy("name").agg(F.sum("n").alias("n")))
    givens, nicks, tails = lexicons(parts)
    parts = cut(take_apart(parts, givens, nicks, tails))
    edges = cut(compared(parts, givens, nicks))
    labels = components(parts, edges.where(F.col("level") == SAME)).join(parts.select("name", "weak"), "name")
    part = cut(edges.where(F.col("level") == PART))
    for weak in (1, 2, 3):
        labels = _attach(labels, part, weak)
    return labels.select("name", "label")


def variant_pairs(labels: DataFrame) -> DataFrame:
    """(name_a, name_b): the different spellings of each label in pairs, the smaller by code points first."""
    a, b = labels.select("label", F.col("name").alias("name_a")), labels.select("label", F.col("name").alias("name_b"))
    return a.join(b, "label").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
