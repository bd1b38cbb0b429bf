import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperweir.operators.packed import AUTHORS, CATEGORIES, split_packed, unpack


def values(text, field=AUTHORS):
    return [v for _, v, _ in split_packed(text, field)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("", []),
        (" \t", []),
        ("[]", []),
        ("Ada Lovelace", ["Ada Lovelace"]),
        ("Ada Lovelace, Alan Turing and Kurt Gödel", ["Ada Lovelace", "Alan Turing", "Kurt Gödel"]),
        ("Ada Lovelace, Alan Turing, and Kurt Gödel", ["Ada Lovelace", "Alan Turing", "Kurt Gödel"]),
        ("Lovelace, Ada and Turing, Alan M.", ["Lovelace, Ada", "Turing, Alan M."]),
        ("Lovelace, Ada; van der Berg, J. K.;", ["Lovelace, Ada", "van der Berg, J. K."]),
        ("Sand, Oskar, Jr. and Fell, Mia", ["Sand, Oskar, Jr.", "Fell, Mia"]),
        ("Oskar Sand, Jr., Mia Fell", ["Oskar Sand, Jr.", "Mia Fell"]),
        ("A B;; C D ; ", ["A B", "C D"]),
        ("A B | C D\nE F / G H · I J、K L；M N\tO P & Q R", ["A B", "C D", "E F", "G H", "I J", "K L", "M N", "O P", "Q R"]),
        ('"Sand, O."; "Reef & Vector Group"', ["Sand, O.", "Reef & Vector Group"]),
        ('"A. ""Plo"" B"; C D', ['A. "Plo" B', "C D"]),
        ('["J\\u00fcrgen A", "B C"]', ["Jürgen A", "B C"]),
        ("['A B', \"C O'D\"]", ["A B", "C O'D"]),
        ('["A B", null, "A B"]', ["A B", "A B"]),
    ],
)
def test_authors(text, want):
    assert values(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Smith, John Paul; Doe, Jane", ["Smith, John Paul", "Doe, Jane"]),
        ("Garcia Marquez, Gabriel; Doe, J.", ["Garcia Marquez, Gabriel", "Doe, J."]),
        ("Khan, M. Tariq | Fell, Mia", ["Khan, M. Tariq", "Fell, Mia"]),
        ("de la Cruz Vega, María del Carmen, Jr.\nDoe, Jane", ["de la Cruz Vega, María del Carmen, Jr.", "Doe, Jane"]),
        ("Vargas Llosa, Jorge Mario; Doe, Jane", ["Vargas Llosa, Jorge Mario", "Doe, Jane"]),
        ("Ada Lovelace, Alan Turing; Kurt Gödel", ["Ada Lovelace", "Alan Turing", "Kurt Gödel"]),
        ("Ada Lovelace, Alan Turing, Kurt Gödel; Mia Fell", ["Ada Lovelace", "Alan Turing", "Kurt Gödel", "Mia Fell"]),
        ("Smith and Sons Ltd; A. Roe", ["Smith and Sons Ltd", "A. Roe"]),
        ("Roe & Co; Ada Lovelace and Alan Turing", ["Roe & Co", "Ada Lovelace", "Alan Turing"]),
        ("{A, B}; C", ["{A, B}", "C"]),
        ("Ada Lovelace, Alan Turing\n", ["Ada Lovelace", "Alan Turing"]),
        ("Ada Lovelace, Alan Turing,\nKurt Gödel", ["Ada Lovelace", "Alan Turing", "Kurt Gödel"]),
    ],
)
def test_surnames_first_between_dividers(text, want):
    assert values(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("cs.AI  cs.CL", ["cs.AI", "cs.CL"]),
        ("cs.AI/cs.CL;stat.ML, hep-th", ["cs.AI", "cs.CL", "stat.ML", "hep-th"]),
        ('"Earth, Ocean and Ice" | cs.DS', ["Earth, Ocean and Ice", "cs.DS"]),
        ("cs.AI,", ["cs.AI"]),
        ("60K35 (Primary, 82B43)", ["60K35", "(Primary, 82B43)"]),
    ],
)
def test_categories(text, want):
    assert values(text, CATEGORIES) == want


def test_malformed_is_flagged_and_kept():
    assert [(v, f) for _, v, f in split_packed('"open, A; B C', AUTHORS)][0][1] == "open_quote"
    assert split_packed('["a", "b"', AUTHORS) == [(1, "a", "broken_bracket"), (2, "b", "broken_bracket")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab ,;"\'[]()\\|&/\n', max_size=40))
def test_any_text_ends_and_loses_no_letter(text):
    for field in (AUTHORS, CATEGORIES):
        got = split_packed(text, field)
        assert [p for p, _, _ in got] == list(range(1, len(got) + 1))
        assert all(v == v.strip() and v for _, v, _ in got)
        if "\\" not in text:  # an escape may stand for another character
            assert sum(v.count("a") + v.count("b") for _, v, _ in got) == text.count("a") + text.count("b")


def test_long_text_is_linear():
    assert len(values("Ada Love; " * 20_000)) == 20_000


def test_long_divided_text_is_linear():
    assert len(values("Love Hill, Ada May; " * 20_000)) == 20_000
    assert values("A " * 20_000 + "a; B C, D") and values("A " * 20_000 + ", " + "B " * 20_000 + "a; C")


def test_unpack_table(spark):
    rows = [("p1", "A B; C D", "x", 1), ("p1", "A B; C D", "x", 1), ("p2", None, "", 2), (None, "E F", None, 3)]
    df = spark.createDataFrame(rows, "paper_id string, authors string, categories string, key int")
    got = sorted((r.key or "", r.field_name, r.pos, r.item) for r in unpack(df, "paper_id", {"authors": AUTHORS, "categories": CATEGORIES}).collect())
    assert got == [("", "authors", 1, "E F"), ("p1", "authors", 1, "A B"), ("p1", "authors", 2, "C D"), ("p1", "categories", 1, "x")]
    assert unpack(df.limit(0), "paper_id", {"authors": AUTHORS}).count() == 0
