"""Conversations: turns, the anchor a conversation holds on to, and its rolling summary."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What sessions keep, and from when an anchor is stable, replaced or cleared.
KEEP_TURNS = 24
MOST_CHARS, TARGET_CHARS = 32_000, 24_000
MEMORY_MOST, MEMORY_KEPT = 500, 420
REPLACE_AT, STRONG_RATIO = 0.82, 0.82
SUMMARY_CHARS = 1_400


def trimmed_turns(turns: DataFrame) -> DataFrame:
    """The turns (session, turn, role, text) that a session keeps: of its last KEEP_TURNS those with a role and a text.

    Where they exceed MOST_CHARS the oldest go until TARGET_CHARS or two are left. Only KEEP_TURNS rows a session reach the
    second window: ranks are limited before the shuffle.
    """
    back = Window.partitionBy("session").orderBy(F.desc("turn"))
    last = turns.withColumn("_r", F.row_number().over(back)).where(F.col("_r") <= KEEP_TURNS).drop("_r")
    valid = last.where(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    sized = valid.withColumn("_k", F.row_number().over(back)).withColumn("_sum", F.sum(F.length("text")).over(back)).withColumn("_all", F.sum(F.length("text")).over(Window.partitionBy("session")))
    return sized.where((F.col("_all") <= MOST_CHARS) | (F.col("_sum") <= TARGET_CHARS) | (F.col("_k") <= 2)).drop("_k", "_sum", "_all")


def pruned_memory(memory: DataFrame) -> DataFrame:
    """Memories (session, id, ...): of a session with over MEMORY_MOST only the MEMORY_KEPT latest."""
    n = memory.groupBy("session").agg(F.count("*").alias("_n"))
    ranked = memory.withColumn("_r", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("id"))))
    return ranked.join(n, "session").where((F.col("_n") <= MEMORY_MOST) | (F.col("_r") <= MEMORY_KEPT)).drop("_n", "_r")


def next_anchor(anchor: dict | None, seen: dict, stable: float = 0.72) -> tuple[dict | None, str]:
    """The anchor after one more question, and the label of the transition.

    `seen` has value, confidence and ratio of what dominates the evidence (value None where nothing does), overlap (whether the
    question names the anchor), names_candidate (whether it names what dominates), follow_up and entity (whether it names any).
    """
    value = seen["value"] if seen["value"] and seen["confidence"] >= stable else None
    if value is None:
        if anchor is None:
            return None, "none"
        if seen["overlap"]:
            return anchor, "kept_no_dominance"
        return (anchor, "kept_followup_coref") if seen["follow_up"] else (None, "cleared_no_query_overlap")
    candidate = {"value": value, "confidence": seen["confidence"]}
    if anchor is None:
        return (candidate, "set_from_dominance") if seen["names_candidate"] else (None, "blocked_no_query_overlap")
    if anchor["value"] == value:
        return {"value": value, "confidence": max(anchor["confidence"], seen["confidence"])}, "kept_reinforced"
    if not seen["names_candidate"]:
        return anchor, "kept_candidate_no_query_overlap"
    if seen["confidence"] >= REPLACE_AT and (seen["entity"] or seen["ratio"] >= STRONG_RATIO):
        return candidate, "replaced_with_strong_evidence"
    return anchor, "kept_ambiguous_switch_requires_confirmation"


def named_in(value: str | None, text: str | None) -> bool:
    """Whether a text holds a value, or all of its words of three letters or more where there are two at least."""
    a, t = (re.sub(r"\s+", " ", (x or "").strip().lower()) for x in (value, text))
    if not a or not t:
        return False
    words = [w for w in re.findall(r"[a-z0-9]+(?:['.-][a-z0-9]+)?", a) if len(w) >= 3]
    return a in t or len(words) >= 2 and set(words) <= set(re.findall(r"[a-z0-9]+(?:['.-][a-z0-9]+)?", t))


def anchor_path(rows: Iterable[dict]) -> list[tuple[str | None, float, str]]:
    """next_anchor() folded over the questions of one session in their order; what a row doesn't say of its question is read from it."""
    anchor, out = None, []
    for r in rows:
        if "question" in r:
            r = {**r, "overlap": bool(anchor) and named_in(anchor["value"], r["question"]), "names_candidate": named_in(r["value"], r["question"])}
        anchor, label = next_anchor(anchor, r)
        out.append((anchor["value"] if anchor else None, anchor["confidence"] if anchor else 0.0, label))
    return out


ANCHOR_SCHEMA = "session string, turn long, anchor string, confidence double, action string"


def anchor_states(turns: DataFrame) -> DataFrame:
    """The anchor after every question of every session; `turns` has session, turn and what next_anchor() reads.

    The fold needs a session's questions in order: a group is one session, a conversation of people and so bounded.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        path = anchor_path(pdf.where(pdf.notna(), None).to_dict("records"))
        return pd.DataFrame({"session": pdf["session"].to_numpy(object), "turn": pdf["turn"].to_numpy(), "anchor": [p[0] for p in path], "confidence": [p[1] for p in path], "action": [p[2] for p in path]})

    return turns.groupBy("session").applyInPandas(run, ANCHOR_SCHEMA)


def next_summary(summary: dict, question: str, evidence: list[str]) -> dict:
    """The rolling summary after one more question: its focus, the last themes voted for by the evidence, the last questions."""
    votes = Counter(e.strip() for e in evidence if e and e.strip())
    strong = [v for v, n in sorted(votes.items(), key=lambda x: (-x[1], x[0])) if n >= 2]
    merge = lambda old, new, most: [*dict.fromkeys([*(x for x in old if x not in new), *new])][-most:]
    out = {"focus": (question or "")[:220], "themes": merge(summary.get("themes", []), strong, 6), "questions": merge(summary.get("questions", []), [question] if question else [], 6)}
    size = lambda: sum(len(v) if isinstance(v, str) else sum(map(len, v)) for v in out.values())
    for part in ("themes", "questions"):
        while size() > SUMMARY_CHARS and out[part]:
            out[part].pop(0)
    out["focus"] = out["focus"][:SUMMARY_CHARS]
    return out


SUMMARY_SCHEMA = "session string, turns long, focus string, themes array<string>, questions array<string>"


def rolling_summaries(turns: DataFrame) -> DataFrame:
    """The summary each session ends with; `turns` has session, turn, question and evidence (array of values)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        summary: dict = {}
        for q, e in pdf.sort_values("turn")[["question", "evidence"]].itertuples(index=False):
            summary = next_summary(summary, q, list(e) if e is not None else [])
        return pd.DataFrame([{"session": pdf["session"].iloc[0], "turns": len(pdf), **summary}])

    return turns.groupBy("session").applyInPandas(run, SUMMARY_SCHEMA)
