import itertools

import pytest

from paperweir.llm.lookalike import SAME_SHAPE, folded, look_classes, looks, lookalikes, normal_form


@pytest.mark.parametrize(
    ("a", "b"),
    [("ABC１２", "ＡＢＣ12"), ("é", "é"), ("a b", "a b"), ("a b", "a　b"), ("abc", "a​b﻿c"), ("coop", "сооp"), ("office", "oﬃce"), ("ΑB", "AB"), ("ガ", "ｶﾞ"), ("é", "е́"), ("soft", "so­ft"), ("ё", "ë")],
)
def test_looks_equal(a, b):
    assert looks(a) == looks(b)


@pytest.mark.parametrize(("a", "b"), [("ρυκ", "puk"), ("ɡ", "g"), ("ⅼ", "l"), ("ѵ", "v"), ("Ꭺ", "A"), ("ꓮ", "A"), ("Ⅷ", "VIII")])
def test_letters_of_one_shape(a, b):
    assert looks(a) == looks(b)


def test_shapes_keep_what_shows():
    for a, b in SAME_SHAPE.items():
        assert a.isalpha() and b.isalpha() and (a.isupper() == b.isupper() or not a.isupper() and not a.islower())


def test_equal_looks_have_equal_normal_forms():
    for c in [*range(0x20, 0xD800), *range(0xE000, 0x20000)]:
        for t in (chr(c), f"a{chr(c)}b"):
            assert folded(looks(t)) == folded(t), hex(c)


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("e", "é"), ("2", "²"), ("O", "0"), ("l", "1"), ("a.", "a"), ("a\nb", "a b"), ("…", "..."), ("α", "a"), ("👩‍🔬", "👩🔬"), ("a  b", "a b")])
def test_looks_different(a, b):
    assert looks(a) != looks(b)


def test_folded(spark):
    assert folded("Ｓtraße  ​X²\r\nY ") == "strasse x2\ny"
    df = spark.createDataFrame([("Ｓ",), (None,), ("",), ("Ｓ",)], "t string")
    assert [r[0] for r in df.select(normal_form("t")).collect()] == ["s", None, "", "s"]


def test_pairs_equal_brute_force(spark):
    texts = ["abc", "аbc", "abс", "ABC", "a b", "a b", "", " ", "​", "abc"]
    rows = [(f"k{i:02}", t, 1) for i, t in enumerate(texts)] + [("k00", "abc", 2), ("k01", "xyz", 3), (None, "abc", 4), ("n", None, 5)]
    df = spark.createDataFrame(rows, "key string, t string, look int")
    got = {tuple(r) for r in lookalikes(df, "key", "t", salt_rows=2).collect()}
    fine = {(k, t) for k, t, _ in rows if k is not None and t is not None}
    want = {(a[0], b[0]) for a, b in itertools.product(fine, fine) if a[0] < b[0] and a[1] != b[1] and looks(a[1]) == looks(b[1])}
    assert got == want and want
    assert lookalikes(df.limit(0), "key", "t").count() == 0
    classes = {tuple(r) for r in look_classes(df, "key", "t").collect()}
    shared = {lk: {(k, t) for k, t in fine if looks(t) == lk} for lk in {looks(t) for _, t in fine}}
    assert classes == {(k, min(x for x, _ in v), len({t for _, t in v}), len({x for x, _ in v})) for v in shared.values() if len({t for _, t in v}) > 1 for k, _ in v}
    assert look_classes(df.limit(0), "key", "t").count() == 0


def test_hot_group_is_spread(spark):
    rows = [(f"k{i:04}", "same text") for i in range(3000)] + [("v1", "same text"), ("v2", "sаme text")]
    got = lookalikes(spark.createDataFrame(rows, "key string, t string"), "key", "t", salt_rows=100)
    assert got.count() == 3000 * 2 + 1
