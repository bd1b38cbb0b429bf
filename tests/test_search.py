import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperweir.functions import text
from paperweir.operators import chunking, evaluation, fulltext, fusion, vectors

DOCS = ["river delta sediment transport model", "sediment cores from the northern delta", "transport layer protocol design", "glacier melt model for northern basins", "naïve river_model baseline", "quiet meadow", None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS, 1)), "chunk_id long, text string")


def run(spark, docs, question, k=10):
    q = spark.createDataFrame([("q", question)], "query_id string, query string")
    return [(r.chunk_id, r.score, r.mode) for r in fulltext.bm25_topk(q, docs, k).orderBy("rank").collect()]


def fts5(match):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", [(i, t or "") for i, t in enumerate(DOCS, 1)])
    return con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ? ORDER BY bm25(f), rowid", (match,)).fetchall()


@pytest.mark.parametrize(
    ("question", "match", "mode"),
    [
        ("sediment transport model", "(sediment AND transport) AND (model)", "strict"),
        ("sediment transport glacier", "sediment OR transport OR glacier", "relaxed"),
        ("naive", "naive", "strict"),
        ("river_model", '"river model"', "strict"),
        ("model model delta", "model OR model OR delta", "strict"),
    ],
)
def test_bm25_equals_fts5(spark, docs, question, match, mode):
    got, want = run(spark, docs, question), fts5(match)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)
    assert {g[2] for g in got} == {mode}


def test_stored_index(spark, docs):
    old = docs.withColumn("text", F.when(F.col("chunk_id") == 1, "stale words").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(99, "sediment")], docs.schema))
    index = fulltext.refresh(fulltext.index_tables(old, "chunk_id"), docs.where("chunk_id = 1"), "chunk_id", spark.createDataFrame([(99,)], "chunk_id long"))
    for question in ("sediment transport glacier", "river_model"):
        q = spark.createDataFrame([("q", question)], "query_id string, query string")
        got = [(r.chunk_id, round(r.score, 9), r.mode) for r in fulltext.bm25_topk(q, None, 10, index=index).orderBy("rank").collect()]
        assert got == [(i, round(x, 9), m) for i, x, m in run(spark, docs, question)]


def test_bm25_edges(spark, docs):
    assert run(spark, docs, "the of and") == []
    assert run(spark, docs, "?!") == []
    assert len(run(spark, docs, "delta", k=1)) == 1
    assert run(spark, docs.limit(0), "delta") == []
    with pytest.raises(ValueError):
        run(spark, docs, "delta", k=0)


def test_compile(spark):
    q = spark.createDataFrame([("a", "What are typical patterns of Agent design?"), ("b", "entropy of rényi"), ("c", "aaaaaa bbbbbbb cccccccc ddddddddd eeeeee ffffff"), ("d", "cat dog"), ("e", "")], "query_id string, query string")
    got = {r.query_id: (r.required, r.optional) for r in fulltext.compile_queries(q).collect()}
    assert got["a"] == (["typical", "patterns", "design"], ["are", "Agent"][1:])
    assert got["b"] == (["entropy"], ["rényi"])
    assert got["c"] == (["aaaaaa", "bbbbbbb", "cccccccc", "ddddddddd"], ["eeeeee", "ffffff"])
    assert got["d"] == ([], ["cat", "dog"])
    assert got["e"] == ([], [])


def test_exact_topk(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[5] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, [1.0] * 7), (902, None), (903, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = {"cosine": 1 - u @ u.T, "ip": 1 - x @ x.T, "l2": ((x[:, None] - x[None]) ** 2).sum(-1)}
    for metric, d in dist.items():
        got = {}
        for r in vectors.exact_topk(q, df, 5, metric, dim=8, block=64).collect():
            got.setdefault(r.qid, {})[r["rank"]] = r.vec_id
        assert set(got) == set(range(0, 300, 20))
        for i, ranks in got.items():
            assert [ranks[k] for k in range(1, 6)] == sorted(range(300), key=lambda j: (round(d[i, j], 9), j))[:5]
    assert vectors.exact_topk(q.limit(0), df, 5, dim=8).count() == 0


@pytest.mark.parametrize("group", [40, 131_072])
def test_nearest_of_many_steps(spark, monkeypatch, group):
    monkeypatch.setattr(vectors, "GROUP", group)
    monkeypatch.setattr(vectors, "QUERIES", 100)
    rng = np.random.default_rng(41)
    x = rng.standard_normal((40, 8)).repeat(75, axis=0) + 1e-3 * rng.standard_normal((3000, 8)).round(0)  # near and equal ones
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    q = df.where("vec_id % 20 = 0").select(F.concat(F.lit("q"), "vec_id").alias("qid"), F.col("embedding").alias("vector"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for metric, d in {"cosine": 1 - u @ u.T, "ip": 1 - x @ x.T, "l2": ((x[:, None] - x[None]) ** 2).sum(-1)}.items():
        got = {(r.qid, r["rank"]): r.distance for r in vectors.exact_topk(q, df, 5, metric, dim=8, block=64).collect()}
        assert len(got) == 150 * 5
        for i in range(0, 3000, 20):
            assert np.allclose([got[f"q{i}", n] for n in range(1, 6)], np.sort(d[i])[:5], atol=1e-9)


def test_few_rows_leave_a_task(spark, monkeypatch):
    """Not k rows of every question for each Arrow batch or pair of blocks, of which the number grows with both tables."""
    texts = spark.range(0, 2000, 1, 1).select(F.col("id").alias("chunk_id"), F.concat(F.lit("river delta w"), F.col("id") % 7).alias("text"))
    asked = spark.createDataFrame([(f"q{i}", "river delta w3") for i in range(5)], "query_id string, query string")
    vecs = texts.select("chunk_id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("chunk_id") * i)).alias("embedding"))
    near = vecs.where("chunk_id between 1 and 5").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector"))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = []
    plain = type(texts).mapInArrow
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, f, schema, *a: seen.append((schema, plain(self, f, schema, *a))) or seen[-1][1])
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        assert fulltext.bm25_topk(asked, texts, 3).count() == 15
        assert vectors.exact_topk(near, vecs, 3, key="chunk_id", dim=8, block=100).count() == 15
        rows = [df.count() for schema, df in seen if "score" in schema or "distance" in schema]
        assert len(rows) == 2 and max(rows) <= 4 * 15, rows
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


@pytest.mark.parametrize("shard", [64, 65_536])
def test_bm25_equals_fts5_at_random(spark, monkeypatch, shard):
    monkeypatch.setattr(fulltext, "DOCS", shard)
    monkeypatch.setattr(fulltext, "QUESTIONS", 40)
    rng = np.random.default_rng(43)
    words = [f"{a}{b}" for a in ("re", "modela", "transporta", "bas") for b in "abcdefghij"]
    odds = 1 / np.arange(1, 41) ** 1.2
    texts = [" ".join(rng.choice(words, rng.integers(0, 40), p=odds / odds.sum())) for _ in range(700)]
    asked = [" ".join(rng.choice(words, rng.integers(1, 7))) for _ in range(100)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    plans = {r.query_id: r for r in fulltext.compile_queries(q).collect()}
    got = {}
    for r in fulltext.bm25_topk(q, docs, 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score, r.mode))
    find = lambda match: sorted((round(x, 9), i) for i, x in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (match,)))[:8]
    modes = set()
    for i, plan in plans.items():
        must, rest = " AND ".join(plan.required), " OR ".join(plan.optional)
        want, mode = find(f"({must}) AND ({rest})" if must and rest else must or rest), "strict"
        if not want:
            want, mode = find(" OR ".join([*plan.required, *plan.optional])), "relaxed"
        have = got.get(i, [])
        assert np.allclose([s for _, s, _ in have], [s for s, _ in want], atol=1e-8) and len(have) == len(want)
        assert all(abs(a - b) < 2e-9 or c == d for (c, a, _), (b, d) in zip(have, want)) and {m for _, _, m in have} <= {mode}
        modes.add(mode)
    assert modes == {"strict", "relaxed"}


def test_questions_that_differ_in_rare_phrases_are_one_unit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words, names = ["basin", "delta", "glacier", "model", "sediment"], [f"name{i}x" for i in range(40)]
    texts = [" ".join([*rng.choice(words, 4), *rng.choice(names, 1)]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    asked = [(f"q{i}", f"{names[i]} {names[-1 - i]} absent{i} {words[i % 5]} {words[i % 3]} basin") for i in range(40)]
    questions = spark.createDataFrame(asked, "query_id string, query string")
    units, made = [], fulltext.Asked.of.__func__
    monkeypatch.setattr(fulltext.Asked, "of", classmethod(lambda cls, *a: units.append(made(cls, *a)) or units[-1]))
    got = []
    for rare in (0, 12, 100):
        monkeypatch.setattr(fulltext, "RARE", rare)
        got.append({(r.query_id, r["rank"], r.chunk_id, round(r.score, 9), r["mode"]) for r in fulltext.bm25_topk(questions, docs, 5).collect()})
    assert got[0] == got[1] == got[2] and len(got[0]) == 200 and {m for *_, m in got[0]} == {"relaxed"}
    assert len(units[0].block.keys) > 30 and len(units[2].block.keys) <= 15


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_bound_of_some_rows(spark, monkeypatch, metric):
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (600, 8)).astype(float)
    x[300:360] = x[7]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    asked = rows.where("vec_id % 10 = 7").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    near = vectors._nearest
    monkeypatch.setattr(vectors, "FORE", 100)
    bounded = {tuple(r) for r in vectors.exact_topk(asked, rows, 1, metric, dim=8).collect()}
    monkeypatch.setattr(vectors, "FORE", 10_000)
    assert bounded == {tuple(r) for r in vectors.exact_topk(asked, rows, 1, metric, dim=8).collect()} and bounded
    # the k-th of some rows leaves the result as it is
    a, order = x[:50], np.arange(600)
    q, _, d = near(a, x[::3], np.arange(200), 20, metric, 64)
    far = np.maximum.reduceat(d, np.searchsorted(q, np.arange(50)))
    assert all((m == n).all() for m, n in zip(near(a, x, order, 20, metric, 64, far), near(a, x, order, 20, metric, 64)))


def test_context_is_made_once(spark, small):
    from paperweir.plans import search
    from paperweir.session import scratch

    with scratch():
        plan = search.context_diagnostics(spark, small)._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "/context-" in plan  # no list is made again for pages and for uids


def test_vector_bytes_and_distance(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(vectors.from_bytes(vectors.to_bytes("a")).alias("v"), vectors.distance("a", "b", "cosine").alias("c"), vectors.distance("a", "b", "l2").alias("l"), vectors.distance("a", "b", "ip").alias("i")).first()
    assert r.v == [3.0, 4.0] and r.c == pytest.approx(0.4) and r.l == 20.0 and r.i == -2.0


def test_rrf(spark):
    lists = spark.createDataFrame([("q", "fts", 1, "a", -1.0), ("q", "fts", 2, "b", -0.5), ("q", "vector", 1, "b", 0.1), ("q", "vector", 2, "c", 0.2)], "query_id string, backend string, rank int, chunk_id string, raw_score double")
    got = [(r.chunk_id, round(r.score, 10), [p.backend for p in r.provenance]) for r in fusion.rrf(lists, 10, {"fts": 1, "vector": 1}).orderBy("rank").collect()]
    assert got == [("b", 0.0325224749, ["fts", "vector"]), ("a", 0.0163934426, ["fts"]), ("c", 0.0161290323, ["vector"])]
    assert [r.chunk_id for r in fusion.rrf(lists, 1, {"fts": 0, "vector": 1}).collect()] == ["b"]
    for bad in ({"k": 0}, {"rrf_k": 0}, {"weights": {"fts": 0}}, {"weights": {"fts": -1}}):
        with pytest.raises(ValueError):
            fusion.rrf(lists, **{"k": 1, "weights": {"fts": 1}, **bad})


def test_rerank(spark):
    rows = spark.createDataFrame([("q", "river delta flow", 1, "nothing here"), ("q", "river delta flow", 2, "a river in its delta"), ("r", "¿?", 1, "x"), ("r", "¿?", 2, None)], "query_id string, query string, rank int, text string")
    got = {(r.query_id, r["rank"]): (r.new_rank, round(r.rerank_score, 6)) for r in fusion.rerank(rows).collect()}
    assert got[("q", 2)] == (1, 0.616667) and got[("q", 1)] == (2, 0.3)
    assert got[("r", 1)][0] == 1 and got[("r", 2)][0] == 2


def test_windows(spark):
    pages = spark.createDataFrame([(1, 1, " ".join(f"w{i}" for i in range(100))), (2, 1, " ".join("x" * 40)), (3, 1, "  \n"), (4, 1, None), (5, 1, "🙂 ab\tc \n")], "doc_id int, page int, text string")
    got = chunking.chunk_pages(pages, config=chunking.ChunkConfig(40, 10)).orderBy("doc_id", "chunk_index").collect()
    assert [r.token_count for r in got if r.doc_id == 1] == [40, 40, 40]
    assert [r.chunk_index for r in got if r.doc_id == 2] == [0]
    assert not [r for r in got if r.doc_id in (3, 4)]
    source = {r.doc_id: r.text for r in pages.collect()}
    for r in got:
        assert source[r.doc_id][r.char_start : r.char_end] == r.text
    for bad in ((0, 0), (5, -1), (5, 5)):
        with pytest.raises(ValueError):
            chunking.ChunkConfig(*bad)


def test_bpe_windows(spark):
    P = pytest.importorskip("public_tokenizers")
    pages = spark.createDataFrame([(1, 1, "naïve 🙂 " * 60)], "doc_id int, page int, text string")
    got = chunking.chunk_pages_bpe(pages, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, config=chunking.ChunkConfig(40, 10)).orderBy("chunk_index").collect()
    assert got[-1].char_end == len("naïve 🙂 " * 60) and all(a.char_end >= b.char_start for a, b in zip(got, got[1:]))


def test_clean_and_headers(spark):
    df = spark.createDataFrame([("a-\r\nb \t c\r\n\r\n  x  \rend ",)], "t string")
    assert df.select(text.clean_text("t")).first()[0] == "ab c\nx\nend"
    pages = spark.createDataFrame([(1, p, f"HEAD\nbody {p}\nHEAD\nfoot {p}" if p < 4 else "") for p in range(1, 6)], "doc_id int, page int, text string")
    assert [(r.line, r.n) for r in chunking.repeated_lines(pages, "doc_id").collect()] == [("HEAD", 3)]
    got = {r.page: (r.text, r.removed) for r in chunking.strip_repeated_lines(pages, "doc_id").collect()}
    assert got[1] == ("body 1\nfoot 1", 2) and got[5] == ("", 0)


def test_snippet(spark):
    df = spark.createDataFrame([("hello   wonderful\nworld",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.snippet("t", 10)).collect()] == ["hello w...", None, ""]
    assert df.select(text.snippet("t", 3)).first()[0] == "hel"
    with pytest.raises(ValueError):
        text.snippet("t", 0)


def test_metrics(spark):
    items = spark.createDataFrame([("q", ["y", "w", "", None, "y"]), ("n", None), ("e", ["z"])], "query_id string, truth array<string>")
    res = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y"), ("q", 3, "z"), ("n", 1, "x")], "query_id string, rank int, chunk_uid string")
    got = {r.query_id: r for r in evaluation.retrieval_metrics(res, items).collect()}
    assert (got["q"].recall_at_5, got["q"].mrr, got["q"].first_correct_rank) == (0.5, 0.5, 2)
    assert (got["n"].recall_at_5, got["n"].mrr, got["n"].first_correct_rank) == (0.0, 0.0, None)
    assert got["e"].retrieved == []
    f = evaluation.failures(evaluation.retrieval_metrics(res, items)).first()
    assert (f.retrieval_empty, f.recall_at_5_zero, f.mrr_zero) == (1, 2, 2)
    s = evaluation.summarize(evaluation.retrieval_metrics(res, items.limit(0))).first()
    assert (s.n_queries, s.recall_at_5, s.citation_accuracy) == (0, 0.0, None)
    said = evaluation.report_markdown({"mrr": 0.5, "acc": None}, {"x": 1}, ["a", "b", "c", "d", "e", "f"], "2026-01-01")
    assert "| mrr | 0.50 |" in said and "| acc | n/a |" in said and not re.search("- f", said)


def test_reference_like_and_filter(spark):
    refs = "[1] A. In Proceedings of the conference, 2019. [2] B. arXiv preprint 2020."
    df = spark.createDataFrame([(refs,), ("plain prose of 2019",), ("",)], "t string")
    assert [r[0] for r in df.select(text.is_reference_like("t")).collect()] == [True, False, False]
    items = spark.createDataFrame(
        [("1", "What drives the delta?", "sediment transport", "sediment transport drives deltas"), ("2", "what drives the DELTA", "sediment", "sediment"), ("3", "What does this excerpt say?", "x", "x"), ("4", "Why?", "completely different things entirely elsewhere here", "sediment"), ("5", "How so", None, None)],
        "query_id string, question string, answer string, text string",
    )
    got = {r.query_id: r.reason for r in evaluation.question_filter(items).collect()}
    assert got["1"] is None and got["2"].startswith("duplicate") and "standalone" in got["3"] and "grounded" in got["4"] and "grounded" in got["5"]
