import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperweir.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def known():
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [r.ids for r in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def ours():
    e = bpe.Encoder(bpe.default_vocabulary())

    def run(texts):
        ids, at = e.encode(texts)
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]

    return run


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(known, ours, texts):
    assert ours(texts) == known(texts)


def test_odd_texts(known, ours):
    rng = random.Random(1)
    texts = ["", " ", "\n\n", "a" * 5000, "ab" * 3000, "ก" * 1000, " " * 3000, "<|endoftext|> x", "👩‍🔬🇦🇶", "".join(rng.choice("abc") for _ in range(4000)), "".join(chr(rng.randint(97, 122)) for _ in range(20_000)), "x" * (bpe.WIDE + 1), "x" * bpe.WIDE]
    assert ours(texts) == known(texts)


def test_cache_starts_afresh(known, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    e = bpe.Encoder(bpe.default_vocabulary())
    for t in ("one two three four five", "six seven", "one two"):
        assert e.encode([t])[0].tolist() == known([t])[0]


def test_table(spark, known):
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", 7), (1, "Hello world", 5), (None, "x", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode_documents(df).collect()), key=repr)
    hello = known(["Hello world"])[0]
    assert got == sorted([(1, hello), (2, []), (3, []), (1, hello), (None, known(["x"])[0])], key=repr)
    assert bpe.encode_documents(df.limit(0)).count() == 0
