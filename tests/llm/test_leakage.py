import re

from hypothesis import given, settings
from hypothesis import strategies as st

from paperweir.llm.leakage import Automaton, leaks, words

ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (2, "a b c"), (3, "Über den Ä-Fluß"), (4, "?!"), (5, "a b c")]


def brute(text, items, run):
    have = [w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"[-‐­]\r?\n", "", text))]
    out = set()
    for i, t in items:
        ws = words(t)
        n = min(run, len(ws))
        if n and any(have[k : k + n] == ws[j : j + n] for j in range(len(ws) - n + 1) for k in range(len(have) - n + 1)):
            out.add(i)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "A", "x", "w1", "w2", "w3", "w4", "-\n", ", ", " ", "_", "\n", "²"]), max_size=40))
def test_scan_equals_brute_force(parts):
    text = "".join(parts)
    items = [(1, "w1 w2 w3 w4 a b"), (2, "a b c"), (3, "a"), (4, "")]
    a = Automaton([(i, words(t)) for i, t in items], 4)
    assert {i for i, _, _ in a.scan(text)} == brute(text, items, 4)


def test_table(spark):
    long_ = "Intro. " + ", ".join(f"W{i}" for i in range(3, 17)) + " end"
    rows = [(1, long_, "z"), (2, " ".join(f"w{i}" for i in range(12)), None), (3, "x a\nb C y", None), (4, None, None), (5, "", None), (3, "x a\nb C y", None), (None, "a b c", None), (6, "über den ä fl-\r\nuß", None), (7, "word " * 200_000 + "a b c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, (None, "a"), (6, None)], "item_id long, item_text string")
    for at_once in (10**6, 4):
        got = {(r.k, r.item): (r.start_char, r.end_char) for r in leaks(docs, items, words_at_once=at_once).collect()}
        assert set(got) == {(1, 1), (3, 2), (3, 5), (6, 3), (7, 2), (7, 5)}
        assert long_[slice(*got[(1, 1)])].startswith("W3, W4")
        assert got[(3, 2)] == (2, 7) and got[(6, 3)] == (0, 18)
    assert leaks(docs.limit(0), items).count() == 0
    assert leaks(docs, items.limit(0)).count() == 0
