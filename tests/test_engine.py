import datetime as dt
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperweir import cli
from paperweir.engine import Engine, SearchConfig
from paperweir.operators import providers
from paperweir.operators.answering import AnswerConfig
from paperweir.operators.chunking import ChunkConfig
from paperweir.streaming.orphans import EVENTS, OrphanStream
from paperweir.streaming.reindex import activity, reindex_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PAGES = "paper_id string, doc_id string, path string, page int, text string, warning string, error string"


class Questions:
    """A stand-in that makes one question of each passage, with the opening it is given."""

    def generate(self, prompt, query):
        words = prompt.rsplit("Passage:", 1)[1].split()
        opening = re.search(r"^1\\. (.+)$", prompt, re.M)
        return '[{"question": "%s about %s?", "expected_answer": "%s", "difficulty": "factual"}]' % (opening.group(1) if opening else "What", words[0], " ".join(words[:6]).replace('"', ""))


class Picky(providers.FirstChunk):
    """A stand-in that answers by the kind of prompt."""

    def generate(self, prompt, query):
        if '"selected"' in prompt:
            return '{"selected": [2]}'
        if '"chunk_index"' in prompt:
            return '{"chunk_index": 1, "quote": "sediment transport"}'
        if "lacks citations" in prompt:
            return 'Mended [arXiv:2311.12022 p.1] *"sediment transport"*'
        return "No citation at all."


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("home")))
    e.upsert_papers(spark.createDataFrame([("2311.12022", "Rivers"), ("2401.00001", "Ice")], "paper_id string, title string"))
    rows = [
        ("2311.12022", "d1", "/x/2311.12022.pdf", 1, "River delta sediment transport model of the northern basin. " * 6, None, None),
        ("2311.12022", "d1", "/x/2311.12022.pdf", 2, "Glacier melt and protocol design for layers. " * 6, None, None),
        ("2401.00001", "d2", "/x/2401.00001.pdf", 1, "Quiet meadows have no sediment at all but many flowers. " * 6, None, None),
        ("2999.99999", "d3", "/x/2999.99999.pdf", 1, "Unknown paper.", None, None),
        ("2401.00002", "d4", "/x/2401.00002.pdf", None, None, None, "broken file"),
    ]
    got = e.ingest(spark.createDataFrame(rows, PAGES), ChunkConfig(30, 5))
    assert got["failed"] == 1 and got["unknown_papers"] == 1 and got["chunks"] > 3
    assert e.index() == got["chunks"]
    return e


def ask(spark, text="sediment transport model"):
    return spark.createDataFrame([("q1", text)], "query_id string, query string")


def test_search_modes(spark, engine):
    for mode in ("fts", "vector", "hybrid"):
        rows, warnings = engine.search(ask(spark), SearchConfig(mode, 3))
        got = rows.orderBy("rank").collect()
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and got[0].paper_id == "2311.12022" and not warnings
    for bad in ({"mode": "x"}, {"top_k": 0}, {"fts_weight": -1}, {"fts_weight": 0, "vector_weight": 0}):
        with pytest.raises(ValueError):
            SearchConfig(**bad)
    assert engine.table("embedding_cache").count() == 1


def test_answers_and_cache(spark, engine):
    rows, _ = engine.search(ask(spark), SearchConfig("fts", 3))
    one = engine.answer(rows).collect()
    assert "[arXiv:2311.12022 p.1]" in one[0].answer
    assert engine.table("answer_cache").count() == 1
    assert engine.answer(rows).collect() == one
    picky = Engine(spark, engine.home, generator=Picky, model="picky")
    got = picky.answer(rows, config=AnswerConfig(select_evidence=True, quote_first=True, repair=True)).collect()
    assert got[0].answer.startswith("Mended [arXiv:2311.12022 p.1]")


def test_versions(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.upsert_papers(spark.createDataFrame([("2311.12022", "A")], "paper_id string, title string"))
    page = lambda doc, text: spark.createDataFrame([("2311.12022", doc, "/p.pdf", 1, text, None, None)], PAGES)
    e.ingest(page("d1", "old words here"))
    e.index()
    e.ingest(page("d2", "new words here"))
    assert {r.doc_id for r in e.table("chunks").collect()} == {"d2"}
    assert e.index(limit=1) == 1 and e.table("vectors").count() == 2
    e.index(["d1", "d2"])
    assert [r.doc_id for r in e.table("vectors").collect()] == ["d2"]
    assert {tuple(r) for r in e.vector_counts(["d1"]).collect()} == {("d1", 0), ("TOTAL", 0)}
    assert e.table("papers").first().doc_id == "d2"
    with pytest.raises(ValueError):
        e.index(limit=0)


class Library:
    def search(self, query, max_results, sort):
        return []

    def fetch(self, ids):
        return [{"paper_id": i + "v1", "title": "T " + i} for i in ids if i != "2401.00009"]


def test_add_papers(spark, tmp_path):
    from paperweir.sources.remote import FetchConfig

    class Body:
        headers = {}

        def __init__(self, text):
            self.status, self.text = (200, text) if text else (404, "")

        def parts(self):
            yield self.text.encode()

    bodies = {"2401.00001": "First page words.\fSecond page words.", "cs.DS/0101001": "Old style words.", "2401.00009": ""}
    e = Engine(spark, str(tmp_path / "home"))
    got = e.add_papers(["2401.00001v2", "cs.DS/0101001", "2401.00009", "nonsense"], Library(), lambda i: Body(bodies[i]), FetchConfig(str(tmp_path / "pdf"), delay_seconds=0))
    assert (got["requested"], got["invalid"], got["unfetched"], got["documents"], got["chunks"], got["indexed"], got["failed"]) == (4, 1, 1, 2, 3, 3, 0)
    assert {(r.paper_id, r.title) for r in e.table("papers").collect()} == {("2401.00001", "T 2401.00001"), ("cs.DS/0101001", "T cs.DS/0101001")}
    (tmp_path / "pdf" / "2401.00001.pdf").write_text("Changed words.")
    again = e.ingest_folder(str(tmp_path / "pdf"))
    assert again["chunks"] == 2 and e.table("vectors").count() == 2
    assert cli.run([e.home, "index", "--rebuild", str(tmp_path / "pdf"), "--limit", "1"], e) == 1
    assert cli.run([e.home, "index", "--force"], e) == 0


def test_evaluation(spark, engine, tmp_path):
    made = Engine(spark, engine.home, generator=Questions)
    items = made.make_eval_set(2, min_chars=50)
    assert [r.query_id for r in items.orderBy("query_id").collect()] == ["q001", "q002"]
    per, summary, failed = engine.evaluate(items, SearchConfig("hybrid", 5), answers=True)
    s = summary.first()
    assert s.n_queries == 2 and 0 < s.recall_at_5 <= s.recall_at_10 <= 1
    assert failed.first().citation_parse_error == 0
    with pytest.raises(Exception, match="asked for 99 questions"):
        made.make_eval_set(99, min_chars=50).collect()


def test_cli(spark, engine, tmp_path, capsys):
    assert cli.run([engine.home, "query", "sediment transport", "--generate"], engine) == 0
    assert "1. [2311.12022 p.1]" in capsys.readouterr().out
    assert engine.table("query_log").count() == 1
    assert cli.run([engine.home, "sources", "sediment"], engine) == 0
    assert cli.run([engine.home, "query", "x", "--mode", "bad"], engine) == 1
    assert cli.run([engine.home, "inspect"], engine) == 0
    assert "TOTAL" in capsys.readouterr().out
    made = Engine(spark, engine.home, generator=Questions)
    out = str(tmp_path / "e.json")
    assert cli.run([engine.home, "eval-generate", out, "--questions", "1", "--min-chars", "50"], made) == 0
    assert cli.run([engine.home, "eval-run", out, "--report", str(tmp_path / "r.md"), "--generate", "--generation-rerank", "lexical", "--generation-select-evidence", "--generation-select-k", "2", "--generation-repair-citations"], engine) == 0
    assert cli.run([engine.home, "eval-run", out, "--generate", "--generation-cite-chunk-index", "--generation-quote-first"], engine) == 1
    assert cli.run([engine.home, "query", "sediment", "--verify", str(tmp_path)], engine) == 1
    assert cli.run([engine.home, "index", "--add-ids", "x.txt"], engine) == 1
    assert "# Evaluation report" in (tmp_path / "r.md").read_text()
    (tmp_path / "ids.txt").write_text("2311.12022v1\nbad\n")
    assert cli.run([engine.home, "check-ids", str(tmp_path / "ids.txt")], engine) == 1
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "2401.00001.pdf").write_text("More on flowers.")
    assert cli.run([engine.home, "parse", str(tmp_path / "pdfs"), str(tmp_path / "parsed")], engine) == 0
    assert cli.run([engine.home, "download", str(tmp_path / "ids.txt"), "--pdf-dir", str(tmp_path / "pdfs")], engine) == 1
    assert cli.run([engine.home, "ingest", str(tmp_path / "pdfs")], engine) == 0
    assert cli.run([engine.home, "index"], engine) == 0


def test_orphan_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 5)
    src = tmp_path / "events"
    batches = [
        [("reference", "log", "1", "a", "chunks", "a", at), ("reference", "log", "2", "b", "chunks", "b", at)],
        [("arrival", None, None, None, "chunks", "a", at), ("removal", None, None, None, "chunks", "b", None)],
        [("departure", None, None, None, "chunks", "a", None)],
    ]
    snaps = []
    for rows in batches:
        s = OrphanStream(spark, f"file://{tmp_path}/state", lambda c, n: snaps.append((n, c.count())), every=1, parts=4)
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(src))
        s.start(spark.readStream.schema(EVENTS).parquet(str(src)), str(tmp_path / "cp")).awaitTermination()
    got = {(r.source_key, r.orphan_kind) for r in s.state.orphans().collect()}
    assert got == {("1", "deleted"), ("2", "deleted")} and len(snaps) == 3


def test_reindex_stream(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "home"))
    e.upsert_papers(spark.createDataFrame([("2311.12022", "A")], "paper_id string, title string"))
    schema = PAGES + ", seen timestamp"
    rows = [("2311.12022", f"d{i}", "/p.pdf", 1, f"words {i}", None, None, dt.datetime(2024, 1, i)) for i in (1, 2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    reindex_stream(e, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert [r.doc_id for r in e.table("vectors").collect()] == ["d2"]
    log = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3), 10), (dt.datetime(2024, 1, 1, 5), 20)], "logged_at timestamp, latency_ms int")
    assert [(r.n, r.latency_ms) for r in activity(log).collect()] == [(2, 15.0)]
    assert e.table("chunks").where(F.col("doc_id") == "d1").count() == 0
