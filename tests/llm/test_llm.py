from __future__ import annotations

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest

from scholarlake.llm import bpe, containers, garbled, matching, names, pieces, scans, survivors, variants
from scholarlake.llm.biblio import doi_key, parse_date, usable_date, usable_title

AT = dt.datetime(2024, 6, 1)

# ---- p3


def side(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, doi string, authors string, person string, date string, arrived timestamp, key string, people string")


PAPERS = [
    (1, "How elastic cortex shapes pollen emission", "10.5555/abc.2001.123", "Ann Boler, Cyra Domin", None, "2001-02-03", AT, "", ""),
    (2, "How elastic cortex shapes pollen emission: a reply", None, "Edda Fornau", None, "2003", AT, "", ""),
    (3, "Preface", None, "Gita Holmer", None, "1999-05", AT, "", ""),
    (4, None, None, None, None, None, None, "", ""),
    (5, "Towards sparse meadow adoption with transcription and surveys", None, "", None, "2010", AT, "", ""),
]


def test_matching(spark):
    records = [
        (11, "scan_12", "https://doi.org/10.5555/ABC.2001.123.", None, None, None, AT, "", ""),
        (12, "How elastc cortex shapes polen emission", None, "Boler, A.; Domin, C.", None, "2001", AT, "", ""),
        (13, "How elastic cortex shapes pollen emission: a reply", None, "Edda Fornau", None, None, AT, "", ""),
        (14, "Data for: How elastic cortex shapes pollen emission", None, "Ann Boler, Cyra Domin", None, "2001", AT, "", ""),
        (15, "Preface", None, "Gita Holmer", None, "1999-05-07", AT, "", ""),
        (16, "Preface", None, "Ivo Jansen", None, "1999-05-07", AT, "", ""),
        (17, None, None, None, None, None, None, "", ""),
        (18, "Towards sparse meadow adoption w/ transcription & surveys", "n/a", None, "Somebody Else", "c2010", AT, "", ""),
        (19, "How elastic cortex shapes pollen emission", "10.5555/zzz.2001.9", "Ann Boler, Cyra Domin", None, "2001", AT, "", ""),
        (19, "How elastic cortex shapes pollen emission", "10.5555/zzz.2001.9", "Ann Boler, Cyra Domin", None, "2001", AT, "", ""),
        (20, " ".join(["word"] * 5_000), None, "; ".join(["Ann Boler"] * 500), None, "", AT, "", ""),
    ]
    got = {r.record: r.entity for r in matching.matches(side(spark, records), side(spark, PAPERS)).collect()}
    assert got == {11: 1, 12: 1, 13: 2, 15: 3, 18: 5}
    assert matching.matches(side(spark, []), side(spark, PAPERS)).count() == 0
    assert matching.matches(side(spark, records), side(spark, [])).count() == 0


def test_window_finds_what_all_pairs_find(spark):
    rng = random.Random(4)
    words = [f"{a}{b}ing" for a in ("gran", "pol", "mead", "cort", "mor", "tel") for b in ("it", "en", "ow", "ex", "al", "om", "us")]
    papers = [(i, " ".join(rng.sample(words, 7)), None, f"Ann B{'abcdefghij'[i % 10]}ler{'klmnopqrst'[i // 10 % 10]}u", None, str(1990 + i % 30), AT, "", "") for i in range(300)]
    records = []
    for i, p in enumerate(papers):
        t = list(p[1])
        at = rng.randrange(len(t))
        t[at] = "q"
        records.append((1000 + i, "".join(t), None, p[3], None, p[5], AT, "", ""))
    got = {r.record: r.entity for r in matching.matches(side(spark, records), side(spark, papers)).collect()}
    fields = lambda rows, kind: [{"doi": None, "title": matching._title_words(r[1])[0], "cut": False, "people": matching._people(r[3]), "day": [int(r[5]), 0, 0]} for r in rows]
    a, b = fields(records, 1), fields(papers, 0)
    brute = {1000 + i: max(((matching.confidence(x, y), matching.agreement(x, y), -j) for j, y in enumerate(b)), default=None) for i, x in enumerate(a)}
    want = {k: -v[-1] for k, v in brute.items() if v[0] >= matching.ACCEPT}
    assert set(got) == set(want) and sum(got[k] == want[k] for k in want) >= 0.99 * len(want)
    assert sum(got[k] == k - 1000 for k in got) >= 0.99 * len(got)


def test_long_runs_of_equal_titles(spark, monkeypatch):
    monkeypatch.setattr(matching, "RUN", 7, raising=False)
    name = lambda i: "{0}a{1}o{0}i{1}uks".format("bdfgkl"[i // 10], "mnprstvwxz"[i % 10])
    papers = [(i, "Introduction to the special issue of dialects", None, f"Ann Xavor{name(i)}, Bea {name(i)}, Cyd Quor{name(i)}", None, None, AT, "", "") for i in range(60)]
    records = [(1000 + i, p[1], None, f"Bea {name(i)}", None, None, AT, "", "") for i, p in enumerate(papers)]
    records += [(2000 + i, p[1].replace("special", "specal").replace("dialects", "dialect"), None, f"Bea {name(i)}", None, None, AT, "", "") for i, p in enumerate(papers)]
    got = {r.record: r.entity for r in matching.matches(side(spark, records), side(spark, papers)).collect()}
    assert got == {k + i: i for i in range(60) for k in (1000, 2000)}


def test_badly_spelt_titles():
    row = lambda title: {"doi": None, "title": matching._title_words(title)[0], "cut": False, "people": ["ann|boler"], "day": [2001, 2, 3]}
    paper = row("How elastic cortex shapes pollen emission")
    assert matching.confidence(row("Hwo elstick cortekz shps polnen emsion"), paper) >= matching.ACCEPT
    rng, readings = random.Random(2), matching.Readings()
    words = ["elastic", "elstic", "cortex", "kortexs", "pollen", "polln", "emission", "emisn", "of", "shapes", "shps", "reply", "meadow", "granite"]
    readings.add(set(words))
    for _ in range(3_000):
        a, b = (rng.sample(words, rng.randrange(1, 8)) for _ in "ab")
        if matching.too_different(matching.telling(a, readings), set(b)):
            assert matching.title_likeness(a, b, rng.random() < 0.5)[1] == "own"


# ---- p4

CLEAN = "The elastic meadow recovered after long monitoring of granite. We argue that moderate plankton should be sampled before transcription is applied here."
SCAN = "Annals of the Skarn College\nThe elastic rneadow recovered after long moni-\ntoring of gr@nite. We argue that mod-\n          12\n\nAnnals of the Skarn College\n\nerate plankton should be 5ampled before tran-\x0cAnnals of the Skarn College\n\nscription is applied here.\n    13"


def test_scans(spark):
    rows = [(i, CLEAN, "x") for i in range(40)] + [(100, SCAN, "x"), (101, None, "x"), (102, " \n", "x"), (103, CLEAN + " " + CLEAN * 3_000, "x")]
    got = {r.id: r for r in scans.repaired(spark.createDataFrame(rows, "id long, full_text string, key string"), "id", "full_text").collect()}
    assert set(got) == {*range(40), 100, 103}
    found = {(f.kind, f.item) for f in got[100].found}
    assert found == {
        ("header", "Annals of the Skarn College"), ("pageno", "12"), ("pageno", "13"), ("hyphen", "monitoring"), ("hyphen", "moderate"), ("hyphen", "transcription"), ("misread", "meadow"), ("misread", "granite"), ("misread", "sampled"),
    }
    assert got[100].paragraphs == [CLEAN]
    assert got[0].found == [] and got[0].paragraphs == [CLEAN]
    assert scans.repaired(spark.createDataFrame([], "id long, full_text string"), "id", "full_text").count() == 0


def test_joint_reading():
    words = {w: 200 for w in "the soil moisture content has recovered after rain of granite".split()} | {"zasamilin": 5}
    d = scans.Decoder(words, 1_000)
    read = lambda line: scans.decode(scans.structure(line), d)
    for seen, meant in (
        ("the re cov ered soil", "the recovered soil"), ("the mois ture of soil", "the moisture of soil"), ("soil con tent", "soil content"), ("the soilmoisturecontent of granite", "the soil moisture content of granite"),
        ("5oilmoisture of granite", "soil moisture of granite"), ("the rnois tvre of soil", "the rnois tvre of soil"), ("the rnois ture of so1l", "the moisture of soil"), ("zasamllin has recovered", "zasamilin has recovered"), ("Fjordbakken has recovered", "Fjordbakken has recovered"),
    ):
        assert read(seen)[1] == [meant]
    assert read("the rnois ture of so1l")[0] == [("misread", "moisture"), ("misread", "soil")]
    long = "the soil has recovered after rain\n" * 4_000 + "\n".join(map(str, range(4_000)))
    assert read(long)[0] == [] and sum(k == "pageno" for k in scans.structure(long).kind) == 4_000


def test_one_lattice_over_the_stream():
    words = {w: 200 for w in "the soil moisture content has recovered after rain of granite meadow is wet".split()} | {"cont": 30, "con": 20, "ten": 20, "zasamilin": 3, "be": 3, "cause": 3, "because": 30_000, "id": 200, "s5-143": 3, "4": 200}
    d = scans.Decoder(words, 60_000)
    read = lambda text: scans.decode(scans.structure(text), d)
    for seen, meant, found in (
        ("the soil cont ent has recovered", ["the soil content has recovered"], []),  # the first part is a word
        ("the soil con tenf has", ["the soil content has"], [("misread", "content")]),
        ("it is be cause of rain", ["it is because of rain"], []),  # both parts are words, but rare ones
        ("the soilm ois-\nture content", ["the soil moisture", "content"], [("hyphen", "moisture")]),  # missing, stray and broken at once
        ("the rnois-\ntvre of soil", ["the rnoistvre", "of soil"], [("hyphen", "rnoistvre")]),
        ("the rnois-\nture5oil of rain", ["the moisture soil", "of rain"], [("hyphen", "moisture"), ("misread", "moisture"), ("misread", "soil")]),
        ("the soil mois\n  ture), and rain", ["the soil moisture),", "and rain"], [("hyphen", "moisture")]),  # no hyphen at the line end
        ("the soil mois\n\nture of rain", ["the soil mois", "", "ture of rain"], []),  # not over a blank line
        ("the soil re cov\nered, the\nmoi sture.", ["the soil recovered,", "the", "moisture."], [("hyphen", "recovered")]),
        ("Soilmoisture Of Ra in", ["Soil moisture Of Rain"], []),
        ("moi-\nst-\nure of rain", ["moisture", "", "of rain"], [("hyphen", "moisture")]),
        ("the ﬁr granitemeadoﬀ", ["the fir granitemeadoff"], [("misread", "fir"), ("misread", "granitemeadoff")]),
        ("Protocol (ID S5-1434) of rain", ["Protocol (ID S5-1434) of rain"], []),
    ):
        assert read(seen) == (found, meant), seen


def test_cheapest_way_by_hand():
    """The way found, and the parts a stream falls into, against every way there is."""
    counts = {"soil": 900, "so": 40, "il": 3, "moisture": 700, "moist": 60, "rnoist": 3, "ure": 4, "the": 9_000, "in": 8_000, "so-il": 3, "bean": 30, "be": 90, "an": 5_000, "can": 3_000, "a": 9_000}
    rng, seen = random.Random(11), 0

    def by_hand(d, units):
        s = " ".join(u.replace("-\n", "\n") for u in units)
        ends = [i for i, c in enumerate(s) if c == " "] + [len(s)]

        def words_from(i):
            todo, out = [(i, "", "", 0, 0)], {}
            while todo:
                pos, word, raw, k, dropped = todo.pop()
                if word in counts and s[pos - 1] not in " \n" and s[pos : pos + 1] != "\n" and (c := d._arc(word, raw, k)) is not None:
                    split = pos not in ends and scans.SPLIT + scans.SHORT_PART * (len(word) < 3) + scans.SHORT_PART * (next(e for e in ends if e >= pos) - pos < 3)
                    out[pos] = min(out.get(pos, math.inf), c + scans.MERGED * dropped + split)
                if pos == len(s):
                    continue
                if s[pos] in " \n":
                    if word:
                        todo.append((pos + 1, word, raw, k, dropped + (s[pos] == " ")))
                        todo += [(pos + 1, word + "-", raw + "-", k, dropped)] * (s[pos] == "\n")
                    continue
                todo.append((pos + 1, word + s[pos], raw + s[pos], k, dropped))
                todo += [(pos + len(a), word + b, raw + a, k + 1, dropped) for a, b in scans.CONFUSIONS if s.startswith(a, pos)]
                todo = [t for t in todo if any(w.startswith(t[1]) for w in counts)]
            return out

        best = {0: 0.0}
        for i in range(len(s) + 1):
            if i not in best:
                continue
            if i == 0 or s[i - 1] == " ":
                e = next(e for e in ends if e >= i)
                best[e + 1] = min(best.get(e + 1, math.inf), best[i] + d.unknown(s[i:e]))
            for at, c in words_from(i).items() if i < len(s) else ():
                to = at + (at in ends)
                best[to] = min(best.get(to, math.inf), best[i] + c)
        return best[len(s) + 1]

    for texts in (9_000, 400_000):
        d = scans.Decoder(counts, texts)
        for _ in range(400):
            told = "".join(rng.choice([w, w, w + " ", w + " ", w[:2] + " " + w[2:], w[:1] + "-\n" + w[1:], w.replace("m", "rn"), w.replace("l", "1"), "x" + w + " "]) for w in rng.choices(list(counts), k=rng.randrange(1, 6)))
            stream = " ".join(told.split(" ")).strip()
            units = [m[0] for m in scans._UNIT.finditer(stream)]
            if " ".join(units) != stream or any(map(scans._figure, units)):
                continue
            seen += 1
            whole = d.stretch(units)
            assert sum(r.cost for r in whole) == pytest.approx(by_hand(d, units)), stream
            parts = scans._decoded(stream, d, [])
            assert parts.split() == " ".join(w.word for r in whole for w in r.words).split(), stream
    assert seen > 400


def test_rare_words_of_a_large_corpus(spark, monkeypatch):
    monkeypatch.setattr(scans, "LEAST_SHARE", 0.2)  # as if 40 texts were many: a word of four texts is far below
    texts = [f"The elastic meadow recovered after long monitoring of granite number {'abcdefgh'[i % 8]}." for i in range(40)] + ["We thank Zasamilin for the meadow."] * 4 + ["We thank Zasamllin for the rneadow.", "We thank Zasa-\nmilin for the meadow."]
    rows = scans.repaired(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").collect()
    found = {r.doc_id: {(f["kind"], f["item"]) for f in r.found} for r in rows if r.found}
    assert found == {44: {("misread", "zasamilin"), ("misread", "meadow")}, 45: {("hyphen", "zasamilin")}}
    few = scans.Decoder({"zasamilin": 6, "zasamllin": 3}, 150_000)
    assert few.correction("zasamllin") is None


def test_hyphen_kept():
    d = scans.Decoder({"cross-sectional": 9, "monitoring": 9, "cross": 9, "sectional": 9}, 100)
    assert d.joined("cross", "sectional")[0] == "cross-sectional"
    assert d.joined("moni", "toring")[0] == "monitoring"


# ---- p5


@pytest.mark.parametrize("text,want", [("2009 ", (2009, 0, 0)), ("c1999", (1999, 0, 0)), ("2021-13-29", None), ("20000230", None), ("Mar 7, 2014", (2014, 3, 7)), ("31 October 2007", (2007, 10, 31)), ("2015/02", (2015, 2, 0)), ("2000-12-29T00:00:00Z", (2000, 12, 29)), ("in press", None), (None, None), ("", None), ("0000-00-00", None)])
def test_dates(text, want):
    assert parse_date(text) == want


def test_usable():
    assert usable_date("2097-10-01", AT) is None and usable_date("2024", AT) == (2024, 0, 0)
    assert [usable_title(t) for t in ("Untitled", "scan_123", "draft_v3 final.docx", "A whole titel", "A cut tit…", "A cut [...]", None, " ", "orm_2019_73297.pdf", "<i>Marked</i> title")] == [False, False, False, True, False, False, False, False, False, True]
    assert [doi_key(d) for d in ("http://dx.doi.example/10.5555%2Fabc.2003.92", "10.5555/", "10.5555/abc.2007.…", "doi:10.5555/ABC.2007.1).", None)] == ["10.5555/abc.2003.92", None, None, "10.5555/abc.2007.1", None]


def test_survivors(spark):
    schema = "paper_id long, id long, work_title string, doi string, publication_date string, feed string, ingested_at timestamp, trust int, field string"
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [
        (1, 1, "A title here", "n/a", "2001", "good", day(1), 0, ""), (1, 2, "Another title", "10.5555/x.1", "2001-05-06", "bad", day(2), 0, ""), (1, 3, "Cut ti…", "10.5555/x.2", "2001-05-07", None, day(3), 0, ""),
        (2, 4, "Tie one", None, None, "good", day(1), 0, ""), (2, 5, "Tie two", "", "n.d.", "good", day(1), 0, ""), (3, 6, "Alone", "10.5555/x.3", "2001", "good", day(1), 0, ""), (None, 7, "No", None, None, "good", day(1), 0, ""), (0, 8, "No", None, None, "good", day(1), 0, ""),
        (0, 9, "No", None, None, "good", day(1), 0, ""), (4, 10, None, None, None, None, None, 0, ""), (4, 11, " ", None, None, None, None, 0, ""),
    ]
    feeds = spark.createDataFrame([("good", 5, "c"), ("bad", 1, "c"), (None, 9, "c")], "feed string, trust int, channel string")
    won = survivors.survivors(spark.createDataFrame(rows, schema), feeds)
    assert sorted((r.group_id, r.field, r.ri_id) for r in won.collect()) == [(1, "doi", 2), (1, "publication_date", 2), (1, "work_title", 1), (2, "work_title", 5)]
    (g,) = survivors.golden_records(won.where("group_id = 1")).collect()
    assert (g.work_title_value, g.doi_ri_id) == ("A title here", 2)
    assert survivors.survivors(spark.createDataFrame([], schema), feeds).count() == 0


def test_large_group_is_brute_force(spark):
    rng, readings = random.Random(2), matching.Readings()
    rows = [(1, i, f"Title number {rng.randrange(9)} of all", None, rng.choice(["2001", "2001-02", "2001-02-03", "x"]), rng.choice(["a", "b", None]), dt.datetime(2024, 1, rng.randrange(1, 28))) for i in range(3_000)]
    trust = {"a": 2, "b": 1, None: 0}
    won = {r.field: r.ri_id for r in survivors.survivors(spark.createDataFrame(rows, "paper_id long, id long, work_title string, doi string, publication_date string, feed string, ingested_at timestamp"), spark.createDataFrame([("a", 2), ("b", 1)], "feed string, trust int")).collect()}
    assert won["work_title"] == max((trust[r[5]], r[6], r[1]) for r in rows)[2]
    assert won["publication_date"] == max((len(r[4]), trust[r[5]], r[6], r[1]) for r in rows if r[4] != "x")[3]


# ---- p6


def check_pieces(text, rows, limit=pieces.LIMIT, overlap=pieces.OVERLAP):
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(len(rows)))
    assert all(0 < len(r.piece) <= limit and 0 <= r.repeated <= overlap for r in rows)
    assert all(b.piece.startswith(a.piece[len(a.piece) - b.repeated :]) for a, b in zip(rows, rows[1:]))
    assert "".join(r.piece[r.repeated :] for r in rows) == text


def test_pieces(spark):
    rng = random.Random(3)
    prose = " ".join(f"Sentence {i} says {'very ' * rng.randrange(20)}much.{chr(10) * 2 if i % 9 == 0 else ''}" for i in range(3_000))
    texts = {"prose": prose, "wall": "x" * 9_000, "wide": "土壌水分の変動を調べる。" * 900, "emoji": "🙂é" * 3_000, "short": "abc", "exact": "y" * pieces.LIMIT, "none": None, "empty": ""}
    df = spark.createDataFrame([("t", k, v, 1, "z") for k, v in texts.items()], "tbl string, item_key string, text string, n int, slice string")
    got = pieces.pieces(df, size=4_096).collect()
    assert {r.item_key for r in got} == {"prose", "wall", "wide", "emoji"}
    for k in ("prose", "wall", "wide", "emoji"):
        check_pieces(texts[k], [r for r in got if r.item_key == k])
    assert all(r.piece.rstrip().endswith(".") for r in got if r.item_key == "prose")
    assert pieces.pieces(df.limit(0)).count() == 0
    whole = pieces.pieces(df, size=1_000_000).drop("piece").collect()  # ranges change nothing
    assert sorted(map(tuple, whole)) == sorted((r.tbl, r.item_key, r.piece_no, r.start, r.end, r.repeated) for r in got)


def test_ranges_agree():
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "x" * rng.randrange(400), " " * rng.randrange(1, 200), "end. ", "part, ", "\n\n", "\n", "\f", "土。", 'said." ']) for _ in range(rng.randrange(20, 400)))
        limit, overlap, size = 256, 32, 512
        want = pieces.Stretch(text, 0, len(text), 0, len(text) + 1, limit, overlap).follow(0)
        got, at = [], 0
        for k, low in enumerate(range(0, len(text), size)):
            base = max(0, low - 64)
            part = pieces.Stretch(text[base : low + size + 2 * limit + 64], base, len(text), low, low + size, limit, overlap)
            ways = part.ways()
            if at < 0 or at >= low + size:
                continue
            found = part.follow(at)
            got += found
            assert ways[at][1] == len(found)
            at = ways[at][0]
        assert got == want and got[-1][1] == len(text)


def test_newest(spark):
    df = spark.createDataFrame([("t", "k", "a" * 3_000, "1"), ("t", "k", "b" * 2_500, "2"), ("t", "k", "b" * 2_500, "2")], "tbl string, item_key string, text string, version string")
    assert [r.text[0] for r in pieces.newest_texts(df).collect()] == ["b"]


# ---- p7

KNOWN = {"ann", "bertil", "cyra", "dora", "conrad", "solveig", "petra"}
NICKS = {"con": ["conrad"]}


@pytest.mark.parametrize("a,b,want", [
    ("Conrad Tibek", "TIBEK, Conrad", names.SAME), ("Con Tibek", "Conrad Tibek", names.SAME), ("Conrad Tibek", "Conrad Tibeek", names.SAME), ("C. Tibek", "Tibek, C.", names.SAME), ("C. Tibek", "Conrad Tibek", names.PART),
    ("Solveig Petra Coyur", "Petra Solveig Coyur", names.SAME), ("Solveig P. Coyur", "Solveig Petra Coyur", names.SAME), ("Prof Solveig Coyur", "Solveig Petra Coyur", names.PART), ("Petra Coyur", "Solveig Petra Coyur", names.NONE),
    ("Ann Tibek", "Conrad Tibek", names.NONE), ("P. Coyur", "Solveig Petra Coyur", names.NONE), ("Coyur, Solveig P., PhD", "Dr. Solveig Petra Coyur", names.SAME),
])
def test_people(a, b, want):
    assert names.compare_people(names.person(a, KNOWN), names.person(b, KNOWN), KNOWN, NICKS) == want


def test_organisations():
    same = lambda a, b: names.compare_organisations(names.organisation(a), names.organisation(b))
    full = "Dunvarra Tide Survey Group 17"
    assert all(same(full, x) == names.SAME for x in ("DTSG 17", "The Dunvarra Tide Survey Grp. 17", "DUNVARRA TIDE SURVEY GROUP 17", "Dunvara Tide Survey Group 17"))
    assert same(full, "Dunvarra Tide Survey Group 18") == same(full, "Dunvarra Soil Survey Group 17") == names.NONE


def test_lcs():
    rng = random.Random(5)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in "xy")
        assert names.lcs(a, b) == plain(a, b)


def test_slips_anywhere_in_surnames(spark):
    twos = [("Radek Duderezan", "Radek Dudreezan"), ("Frida Vaxabebek", "Frida Vaxaebek"), ("Solveig Yisesuwin", "Solveig Yisseuwin"), ("Ottilie Merun", "Ottilie Mequn"), ("Gerda Lomar", "Gerda Loma"), ("Pavlina Zorikatuben", "Pavlina Zorkatubn")]
    names_ = [(n, 1) for two in twos for n in two] + [(f"{g} {s}", 1) for g in ("Radek", "Frida", "Solveig", "Ottilie", "Gerda", "Pavlina") for s in ("Brokhausen", "Culverton", "Dapplewick")]
    label = {r["name"]: r["label"] for r in variants.linked_spellings(spark.createDataFrame(names_, "name string, n long")).collect()}
    assert len(variants.rests("abcdefghij" * 500)) < 5_000
    assert all(label[a] == label[b] for a, b in twos) and len(set(label.values())) == len(twos) + 18
    rng = random.Random(3)
    for _ in range(5_000):
        a = "".join(rng.choices("abc", k=rng.choice([*range(3, 12), 38, 39, 40, 41, 42, 43])))
        b = list(a)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choices("abc", k=rng.randrange(2))
            if not b:
                break
        b = "".join(b)
        assert not b or not names.close(a, b) or variants.rests(a) & variants.rests(b)


def test_variants(spark):
    base = [(f"{g} {s}", 5, "x") for g in ("Ann", "Bertil", "Cyra", "Dora") for s in ("Tibekon", "Molinar", "Farenos", "Golubek", "Sanirov")]
    rows = base + [("TIBEKON, Ann", 1, "x"), ("A. Tibekon", 1, "x"), ("Ann Tibbekon", 1, "x"), ("Ann Tibekon", 2, "x"), ("N/A", 9, "x"), ("", 9, "x"), ("Unknown", 9, "x"), ("Hill Soil Group 7", 1, "x"), ("HSG 7", 1, "x"), ("x" * 5_000 + " " + "y" * 5_000, 1, "x")]
    labels = variants.linked_spellings(spark.createDataFrame(rows, "name string, n long, label string"))
    pairs = {tuple(r) for r in variants.variant_pairs(labels).collect()}
    a = sorted(["Ann Tibekon", "TIBEKON, Ann", "A. Tibekon", "Ann Tibbekon"])
    assert pairs == {(x, y) for i, x in enumerate(a) for y in a[i + 1 :]} | {("HSG 7", "Hill Soil Group 7")}
    assert variants.variant_pairs(variants.linked_spellings(spark.createDataFrame([], "name string, n long"))).count() == 0


# ---- p8


def test_bpe_is_the_public_encoding(spark):
    from tokenizers import Tokenizer

    public = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    public.encode_special_tokens = True
    texts = ["", None, "hello world", "<|endoftext|> x", "a" * 3_000, "  \n\t x", "naïve Größe 土壌 🙂", "it's 1,234.5!", " ".join(f"w{i}" for i in range(20_000))] + ["tie tie"] * 3
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids int, out string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got == {i: public.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


# ---- p9


def test_containers(spark):
    rng = random.Random(6)
    sizes = [rng.choice([rng.randrange(1, 60), rng.randrange(1, 100), 33]) for _ in range(3_000)] + [0, None, 100, 101, 250, 1_000]
    df = spark.createDataFrame([(i, s, 9) for i, s in enumerate(sizes)], "doc_id long, n int, at int")
    rows = containers.containers(df, "doc_id", "n", 100).collect()
    held: dict[int, list] = {}
    whole: dict[int, int] = {}
    for r in rows:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        held.setdefault(r.container, []).append((r.at, r.length))
        assert sizes[r.doc_id] and sizes[r.doc_id] > 100 or r.part == 0 == r.first_unit
    assert whole == {i: s or 0 for i, s in enumerate(sizes)}
    for spans in held.values():
        at = sorted(s for s in spans if s[1])
        assert all(a + n <= b for (a, n), (b, _) in zip(at, at[1:])) and all(a + n <= 100 for a, n in at)
    total = sum(s or 0 for s in sizes)
    assert sorted(held) == list(range(len(held))) and len(held) <= 1.01 * total / 100 + 2
    assert containers.containers(df.limit(0), "doc_id", "n", 100).count() == 0


def test_price():
    rng = np.random.default_rng(1)
    for _ in range(5):
        v = np.concatenate([[0.0], rng.random(12)])
        best = [0.0] * 13
        for c in range(1, 13):
            best[c] = max(best[c - 1], *(best[c - l] + v[l] for l in range(1, c + 1)))
        got, took = containers.price(v[1:], np.arange(1, 13), 12)
        assert np.allclose(got, best)
        taken = containers._taken(took, 12 - int(took[12]), int(took[12])) if took[12] else ()
        assert not taken or abs(v[list(taken)].sum() - best[12]) < 1e-9 and sum(taken) <= 12


def test_program_where_best_fit_is_not_enough():
    rng = np.random.default_rng(1)
    for low, high, most in ((600, 760, 3_350), (600, 1_100, 4_500)):
        counts = np.zeros(2_049, dtype=np.int64)
        np.add.at(counts, rng.integers(low, high, 10_000), 1)
        plan, least, by_program = containers.solved(counts)
        used = sum(k for _, k in plan)
        assert (sum(k * p for p, k in plan) == counts).all() and all((p * np.arange(2_049)).sum() <= 2_048 for p, _ in plan)
        assert least <= used <= most < sum(k for _, k in containers.best_fit(counts, 2_048)) and by_program > used // 2


# ---- p10

CORPUS = ["Die Prüfung der Strömung erfolgte gemäß Größe in Öfen. Für Hölzer ließ sich kein Einfluss nachweisen.", "L’étude a mesuré la fièvre près de Çaverne. Où la pêche diminue, la forêt réagit déjà.", "Однако влияние почвы не было обнаружено. Мы сравнили диалекты.", "Žádný vliv půdy nebyl v místě zjištěn. Měření trvalo 63 měsíců.", "Plain words only.", "SÃO BRÉVIO: a informação e ÂMBITO DA AÇÃO.", "河川流量と気温の関係は明らかでない。", "It’s the “cultivated” café."]


def sloppy(text: str, codec: str) -> str:
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in text.encode())


GARBLED = {
    100: (sloppy(CORPUS[0], "cp1252"), CORPUS[0]), 101: (CORPUS[1].encode().decode("latin_1"), CORPUS[1]), 102: (CORPUS[2].encode("cp1251").decode("cp1252"), CORPUS[2]), 103: (sloppy(sloppy(CORPUS[0], "cp1252"), "cp1252"), CORPUS[0]),
    104: (CORPUS[1].encode().decode("cp437"), CORPUS[1]), 105: ("Gut: Für Hölzer. " + sloppy(CORPUS[0], "cp1252"), "Gut: Für Hölzer. " + CORPUS[0]), 106: (CORPUS[0].encode("latin_1").decode("utf-8", "replace"), None), 107: (sloppy(CORPUS[6], "cp1252"), CORPUS[6]),
    108: (sloppy(CORPUS[1], "cp1252").replace("\xa0", " "), CORPUS[1]), 109: (CORPUS[2].encode("koi8_r").decode("cp1251"), CORPUS[2]),
}


def test_garbled(spark):
    rows = [(i, CORPUS[i % len(CORPUS)], "x") for i in range(96)] + [(k, v[0], "x") for k, v in GARBLED.items()] + [(200, None, "x"), (201, "", "x"), (202, CORPUS[0] * 500, "x")]
    got = {r.doc_id: (r.restored_md5, r.restored) for r in garbled.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string, key string"), "doc_id", "text").collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in GARBLED.items()}
    assert all(m == (hashlib.md5(t.encode()).hexdigest() if t is not None else "") for m, t in got.values())
    assert garbled.garbled_documents(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
