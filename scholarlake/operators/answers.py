"""Answers made fit to be shown: lines of process dropped, near repetitions folded, citations held against the titles at hand.

What SQL has no expression for, the ratio of matching blocks, runs over Arrow batches of answers; each answer is judged by itself.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of lines that belong to the making of an answer, phrases of closing, labels before an answer.
MARKERS = ("detected intent:", "retrieval count:", "pipeline_json", "chroma_retrieval", "metadata filter:", "session_id:", "turn_count:", "please provide the answer in the requested format", "note: the user-facing answer", "the final answer is", "prompt_max_docs", "prompt_doc_text_limit", "retrieval_confidence")
CLOSING = (
    "please let me know if you need", "if you need any further assistance", "i can help with anything else", "let me know if you need anything else", "let me know if you have any further requests", "i have revised the answer", "i've revised the response",
    "i made some minor changes", "please provide the next question", "i am ready to help", "i'm ready to help", "i am ready when you are", "let me know if you would like me to proceed", "let me know if you'd like me to proceed", "i'm here to assist you",
    "i'm here to help", "best regards", "[assistant]", "i can help with the next question",
)
LABEL = r"(?i)^[ \t\r\n]*(summary|final summary|answer|response|final response|the final answer is)[ \t\r\n]*:[ \t\r\n]*"
SAME_PARAGRAPH, SAME_TITLE = 0.80, 0.5
LAST_SENTENCES = 6
TAIL_WORDS = 14  # of an unfinished last sentence, up to which it is left out

_LABEL = re.compile(LABEL)
_ENDS = re.compile(r"(?<=[.!?])\s+")
_QUOTED = re.compile(r'["“]([^"“”]{30,200})["”]')


def matching_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all characters."""
    return SequenceMatcher(None, a, b).ratio()


def plain(text: str) -> str:
    return re.sub(r"[^a-z0-9 ]", "", re.sub(r"\s+", " ", text.strip().lower()))


def unlabelled(text: str) -> str:
    """Without labels before it, three of them at most."""
    for _ in range(3):
        text, before = _LABEL.sub("", text.strip(), count=1).strip(), text.strip()
        if text == before:
            break
    return text


def is_process(text: str) -> bool:
    low = re.sub(r"\s+", " ", text.strip().lower())
    return low.startswith("confidence level") or low.startswith("note:") and any(m in low for m in (*MARKERS, "format", "revised")) or any(m in low for m in CLOSING)


def tidied(text: str | None) -> str | None:
    """An answer without lines and sentences of process, paragraphs nearly the same as one before, sentences just said, and an unfinished end.

    What would leave nothing keeps the answer without its labels; a null, empty or blank answer stays as it is.
    """
    if not text or not text.strip():
        return text
    kept = [x for x in text.strip().splitlines() if not any(m in x.lower() for m in MARKERS)]
    start = unlabelled("\n".join(kept)) or unlabelled(text) or text.strip()
    parts = [p for p in re.split(r"\n\s*\n+", start) if p.strip()]
    if len(parts) < 2:
        parts = [p for p in start.splitlines() if p.strip()]
    seen: list[str] = []
    paragraphs = []
    for p in parts:
        p = unlabelled(re.sub(r"\s+", " ", p))
        key = plain(p)
        if not key or is_process(p) or any(key == s or matching_ratio(key, s) >= SAME_PARAGRAPH for s in seen):
            continue
        seen.append(key)
        paragraphs.append(p)
    last: list[str] = []
    said = []
    for s in _ENDS.split("\n\n".join(paragraphs)):
        key = plain(s)
        if s.strip() and not (key and key in last) and not is_process(s):
            said.append(s.strip())
            last = [*last, key][-LAST_SENTENCES:]
    if len(said) > 1 and not re.search(r"[.!?\"')\]]$", said[-1]) and not re.match(r"[-*]|\d+\.", said[-1]) and len(re.findall(r"[A-Za-z0-9]+", said[-1])) <= TAIL_WORDS:
        said.pop()
    return " ".join(said) or start


def without_false_citations(text: str | None, titles: list[str]) -> str | None:
    """An answer without the lines that quote a long title none of `titles` holds, is held by or is like; as it stands where that leaves nothing."""
    known = [t for t in (re.sub(r"\s+", " ", x or "").strip().lower() for x in titles) if t]
    if not text or not known:
        return text

    def false(line: str) -> bool:
        cited = [re.sub(r"\s+", " ", m).strip().lower() for m in _QUOTED.findall(line)]
        return any(c and not any(c in k or k in c or matching_ratio(c, k) >= SAME_TITLE for k in known) for c in cited)

    return "\n".join(x for x in text.split("\n") if not false(x)).strip() or text


def tidied_answers(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tidy) of every row of `answers`."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tidied(t) if isinstance(t, str) else None)

    return answers.select(key, run(text).alias("tidy"))


def checked_citations(answers: DataFrame, key: str, text: str, titles: str) -> DataFrame:
    """(key, checked) of `answers`, whose column `titles` is the list of titles at hand."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([without_false_citations(t if isinstance(t, str) else None, list(k) if k is not None else []) for t, k in zip(texts, known)], index=texts.index, dtype=object)

    return answers.select(key, run(text, titles).alias("checked"))


def clipped(c: Column, sentences: Column, n: int, most: int) -> Column:
    """The first `n` of `sentences`, or the text where there are none, `most` characters at most."""
    head = F.when(F.size(sentences) > 0, F.array_join(F.slice(sentences, 1, n), " ")).otherwise(c)
    return F.when(F.length(head) > most, F.concat(F.rtrim(F.substring(head, 1, most)), F.lit("..."))).otherwise(head)
