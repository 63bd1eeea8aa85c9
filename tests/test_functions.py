from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarlake.functions import text as T
from scholarlake.operators import dialog, quality
from scholarlake.operators.chunks import packed_sentences
from scholarlake.operators.vectors import diversified, nearest


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "column,text,want",
    [
        (T.token_estimate, "a b c d", 5), (T.token_estimate, "a", 1), (T.token_estimate, "a b c d e f g h i j", 13),
        (T.fast_token_estimate, "", 1), (T.fast_token_estimate, "abcd", 1), (T.fast_token_estimate, "abcde", 2),
        (T.doi, "https://doi.org/10.1234/AbC.5).", "10.1234/abc.5"), (T.id_tail, "https://x.org/W12", "W12"), (T.title_case, "o'neil-smith AND", "o'neil-smith AND"),
        (T.title_case, "deep sea-floor", "Deep Sea-Floor"), (T.without_possessive, "Ada’s", "Ada"), (T.year_of, "in 1999 or 2003", 1999),
        (T.intent, "who else studies it", "list"), (T.intent, "who studies dark matter", "list"), (T.intent, "Compare the research areas of A and B", "comparison"), (T.intent, "who is First Last", "default"),
        (T.intent, "List faculty working on climate change", "list"), (T.intent, "who works on artificial intelligence", "default"),
        (T.meta_query, "what is the most recent paper in the database", "most_recent"), (T.meta_query, "how many papers does the corpus contain", "corpus_count"), (T.meta_command, "switch topic", True),
        (T.follow_up, "who else studies it", True), (T.follow_up, "who studies dark matter", False), (T.placeholder, "N/A", True), (T.placeholder, "graphene", False), (T.norm, None, ""),
    ],
)
def test_scalar(spark, column, text, want):
    assert value(spark, column, text) == want


def test_name_variants(spark):
    made = lambda n: value(spark, lambda c: T.name_variants(T.name_tokens(c)), n)
    assert made("Ada Marie Cole") == ["Ada Marie Cole", "Ada M. Cole", "A. M. Cole", "Ada Cole", "A. Cole", "A Cole"]
    assert made("Ada Cole") == ["Ada Cole", "A. Cole", "A Cole"]


def fold(sentences, most, overlap):
    """The packing of sentences, by a plain loop."""
    t = lambda s: int(len(s.split()) * 1.3)
    out, buf = [], []
    for s in sentences:
        if sum(map(t, buf)) + t(s) > most and buf:
            out.append(" ".join(buf))
            keep, used = [], 0
            for b in reversed(buf):
                if used + t(b) > overlap:
                    break
                keep.insert(0, b)
                used += t(b)
            buf = keep
        buf = [*buf, s]
    return out + ([" ".join(buf)] if buf else [])


def test_packing(spark):
    text = "a b c d. e f. g h i. j k l m."
    assert value(spark, lambda c: packed_sentences(c, 10, 4), text) == ["a b c d. e f. g h i.", "g h i. j k l m."]
    assert value(spark, packed_sentences, "   ") == []
    long = " ".join(f"word{i} of sentence number {i} goes on{' and on' * (i % 9)}." for i in range(400))
    import re

    assert value(spark, lambda c: packed_sentences(c, 100, 30), long) == fold(re.split(r"(?<=[.!?])\s+", long), 100, 30)


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    rows = [(i, m[i].tolist(), "x") for i in range(60)] + [(100, None, "x"), (101, [0.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    near = nearest(df.where("vec_id % 20 = 0"), df, "vec_id", "embedding", 5).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        assert [r.key for r in sorted((r for r in near if r.query == q), key=lambda r: r.pos)] == np.lexsort((range(60), -s))[:5].tolist()
    picked = diversified(nearest(df.where("vec_id = 0"), df, "vec_id", "embedding", 20), df, "vec_id", "embedding", 6).collect()
    assert sorted(r["rank"] for r in picked) == [1, 2, 3, 4, 5, 6] and len({r.key for r in picked}) == 6
    assert nearest(df.limit(0), df, "vec_id", "embedding", 5).count() == 0


def test_fill(spark):
    target = spark.createDataFrame([(1, "  ", "z"), (2, "y", "z"), (3, None, "z")], "id long, c string, _c0 string")
    source = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "id long, c string")
    assert [r.c for r in quality.fill_blank(target, source, "id", ["c"]).orderBy("id").collect()] == ["x", "y", "x"]
    offers = spark.createDataFrame([(1, "Y"), (1, "v"), (3, "v")], "id long, c string")
    assert [r.c for r in quality.fill_unique(target, offers, "id", "c").orderBy("id").collect()] == ["v", "y", None]


def test_anchor():
    seen = lambda **k: {"value": None, "confidence": 0.0, "ratio": 0.0, "overlap": False, "names_candidate": False, "follow_up": False, "entity": False} | k
    path = dialog.anchor_path([
        seen(), seen(value="a", confidence=0.9, names_candidate=True), seen(follow_up=True), seen(value="a", confidence=0.8), seen(value="b", confidence=0.8, names_candidate=True),
        seen(value="b", confidence=0.9, names_candidate=True, entity=True), seen(overlap=True), seen(), seen(value="c", confidence=0.9),
    ])
    assert [p[2] for p in path] == [
        "none", "set_from_dominance", "kept_followup_coref", "kept_reinforced", "kept_ambiguous_switch_requires_confirmation", "replaced_with_strong_evidence", "kept_no_dominance", "cleared_no_query_overlap", "blocked_no_query_overlap",
    ]


def test_turns(spark):
    rows = [("s", i, "user" if i % 2 else "assistant", "x" * 10) for i in range(30)] + [("t", i, "user", "y" * 10_000) for i in range(5)] + [("u", 1, "system", "z"), ("u", 2, "user", " ")]
    kept = dialog.trimmed_turns(spark.createDataFrame(rows, "session string, turn long, role string, text string")).groupBy("session").count().collect()
    assert {r.session: r["count"] for r in kept} == {"s": 24, "t": 2}


def test_summary():
    s = dialog.next_summary({}, "what?", ["a", "b", "a", " ", None])
    assert s == {"focus": "what?", "themes": ["a"], "questions": ["what?"]}
    for i in range(50):
        s = dialog.next_summary(s, f"question {i} " + "long " * 60, ["t%d" % i] * 2)
    assert sum(len(v) if isinstance(v, str) else sum(map(len, v)) for v in s.values()) <= dialog.SUMMARY_CHARS
