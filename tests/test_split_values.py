from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from scholarlake.functions.fields import split_packed
from scholarlake.operators.split_values import split_field

CASES = [
    ("Fen, Y. S., Yup, O., and Xaz, B.", ["Fen, Y. S.", "Yup, O.", "Xaz, B."]),
    ('"Saskia de Wa, PhD", Dr. Xenia Ho, Ferdinand B Mu', ["Saskia de Wa, PhD", "Dr. Xenia Ho", "Ferdinand B Mu"]),
    ('["Dorota \\"D\\" Tev", "Saskia Pe"]', ['Dorota "D" Tev', "Saskia Pe"]),
    ("(1) Imogen Ho (2) Bertil Pa (3) Ignace Pe", ["Imogen Ho", "Bertil Pa", "Ignace Pe"]),
    ("[1] A Bo; [2] C Do", ["A Bo", "C Do"]),
    ("Hill Tide and Water Consortium 172 &amp; A Bo; ; ", ["Hill Tide and Water Consortium 172", "A Bo"]),
    ('"Casimir ""Caz"" Xi", BEN RE', ['Casimir "Caz" Xi', "BEN RE"]),
    ("van der Xe, U.; de Su, Nadir I. | A Bo, C Do", ["van der Xe, U.", "de Su, Nadir I.", "A Bo", "C Do"]),
    ("Ann Bo, Cy Do et al. (9 authors)", ["Ann Bo", "Cy Do"]), ("Laba, M., Tira, U. A.", ["Laba, M.", "Tira, U. A."]),
    ("Ann Bo / Cy Do · Ed Fo\nGi Ho\tIk Lo", ["Ann Bo", "Cy Do", "Ed Fo", "Gi Ho", "Ik Lo"]),
    ("", []), ("  ", []), (None, []), (";;,", []), ("[]", []),
    ('"Ann Bo; Cy Do', ['"Ann Bo', "Cy Do"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_values(text, want):
    assert [v for v, _ in split_packed(text)] == want


def test_flags():
    assert split_packed('"Ann Bo; Cy Do')[0][1] == "malformed_quote"
    assert split_packed('["a b", "c d')[0][1] == "malformed_list"


@given(st.text(max_size=200))
def test_never_fails(text):
    for v, _ in split_packed(text):
        assert v.strip() == v and v


@given(st.lists(st.from_regex(r"[A-Z][a-z]{2,8} [A-Z][a-z]{2,8}", fullmatch=True), min_size=1, max_size=8), st.sampled_from(["; ", ", ", " | ", "\n", "/"]))
def test_round_trip(names, sep):
    names = [n for n in names if " And" not in n and "Et Al" not in n]
    assert [v for v, _ in split_packed(sep.join(names))] == names


def test_operator(spark):
    rows = [("a", "X Yo; Z Wo", 1, "v"), ("a", "X Yo; Z Wo", 1, "v"), ("b", None, 2, None), (None, "Q Ro", 3, "v"), ("c", "; ".join(["An Bo"] * 20_000), 4, "v")]
    df = spark.createDataFrame(rows, "k string, f string, pos int, val string")
    out = split_field(df, "k", "f")
    assert out.columns == ["row_key", "pos", "val", "flag"]
    got = [tuple(r)[:3] for r in out.where("row_key is null or row_key <> 'c'").collect()]
    assert sorted(got, key=repr) == sorted([("a", 0, "X Yo"), ("a", 1, "Z Wo")] * 2 + [(None, 0, "Q Ro")], key=repr)
    assert out.where("row_key = 'c'").count() == 20_000
    assert split_field(df.limit(0), "k", "f").count() == 0
