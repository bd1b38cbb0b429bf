import datetime as dt
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from paperweir.operators import evalgen, providers, store
from paperweir.sources import files, remote


def test_upsert(spark):
    old = spark.createDataFrame([("a", "d1", "old", 1), ("b", "d2", "keep", 2)], "paper_id string, doc_id string, title string, n int")
    new = spark.createDataFrame([("a", "dX", None), ("c", "d3", "new")], "paper_id string, doc_id string, title string")
    got = {r.paper_id: (r.doc_id, r.title, r.n) for r in store.upsert(old, new, ["paper_id"], keep=["doc_id"], refresh={"n": F.lit(9)}).collect()}
    assert got == {"a": ("d1", None, 9), "b": ("d2", "keep", 2), "c": (None, "new", 9)}


def test_assign_documents(spark):
    papers = spark.createDataFrame([("a", None, "x"), ("b", "d2", "y")], "paper_id string, doc_id string, pdf_path string")
    out = store.assign_documents(papers, spark.createDataFrame([("a", "d1", None)], "paper_id string, doc_id string, pdf_path string"))
    assert {tuple(r) for r in out.collect()} == {("a", "d1", "x"), ("b", "d2", "y")}
    with pytest.raises(Exception, match="two papers"):
        store.assign_documents(papers, spark.createDataFrame([("a", "d2", "z")], "paper_id string, doc_id string, pdf_path string")).collect()


CH = "chunk_uid string, paper_id string, doc_id string"


def test_versions_and_reindex(spark):
    old = spark.createDataFrame([("1", "a", "d1"), ("2", "a", "d1"), ("3", "b", "d2")], CH)
    papers = spark.createDataFrame([("a", "d1"), ("b", "d2")], "paper_id string, doc_id string")
    new = spark.createDataFrame([("9", "a", "d9")], CH)
    one = store.replace_versions(old, papers, new)
    assert {r.chunk_uid for r in one.collect()} == {"3", "9"}
    again = store.replace_versions(one, spark.createDataFrame([("a", "d9"), ("b", "d2")], "paper_id string, doc_id string"), new)
    assert sorted(r.chunk_uid for r in again.collect()) == ["3", "9"]
    idx = spark.createDataFrame([("1", "d1"), ("2", "d1"), ("3", "d2")], "chunk_uid string, doc_id string")
    now = spark.createDataFrame([("1", "d1"), ("4", "d1")], "chunk_uid string, doc_id string")
    assert {r.chunk_uid for r in store.stale(idx, now).collect()} == {"2"}
    assert sorted(r.chunk_uid for r in store.reindex(idx, now).collect()) == ["1", "3", "4"]
    assert sorted(r.chunk_uid for r in store.reindex(idx, now, deletes=False).collect()) == ["1", "2", "3", "4"]
    asked = spark.createDataFrame([("d2",)], "doc_id string")
    assert sorted(r.chunk_uid for r in store.reindex(idx, now.limit(0), asked).collect()) == ["1", "2"]


def test_counts_paths_cache(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    v = spark.createDataFrame([("d1", "u"), ("d1", "w")], "doc_id string, chunk_uid string")
    assert {tuple(r) for r in store.counts_per_document(docs, v).collect()} == {("d1", 2), ("d2", 0), ("TOTAL", 2)}
    papers = spark.createDataFrame([("p1", "/a/x.pdf"), ("p2", "/b/y.pdf"), ("p3", "/c/z.pdf"), ("p4", "/d/z.pdf")], "paper_id string, pdf_path string")
    paths = spark.createDataFrame([("/a/x.pdf",), ("/q/y.pdf",), ("/q/z.pdf",)], "path string")
    assert {tuple(r) for r in store.matched_papers(paths, papers).collect()} == {("/a/x.pdf", "p1", "path"), ("/q/y.pdf", "p2", "name"), ("/q/z.pdf", "z", "stem")}
    with pytest.raises(Exception, match="blank"):
        store.query_log_rows(spark.createDataFrame([(" ", ["u"])], "query_text string, retrieved_chunks array<string>")).collect()


def test_batches(spark):
    assert providers.token_batches([3, 3, 3, 5, 1], 6, 6) == [0, 0, 1, 2, 2]
    assert providers.token_batches([1, 1, 1], 9, 9, batch_size=2) == [0, 0, 1]
    with pytest.raises(ValueError):
        providers.token_batches([9], 8, 8)
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate([3, 3, 3, 5, 1])] + [("e", 0, None)], "doc_id string, i int, c int")
    got = {(r.doc_id, r.i): r.batch_id for r in providers.assign_batches(df, "doc_id", "i", "c", 6, 6).collect()}
    assert [got[("d", i)] for i in range(5)] == [0, 0, 1, 2, 2] and got[("e", 0)] == 0
    with pytest.raises(Exception, match="token limit"):
        providers.assign_batches(df, "doc_id", "i", "c", 4, 4).collect()


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, " ")], "id int, t string")
    got = {r.id: r.embedding for r in providers.embed(df, "id", "t", providers.HashedWords).collect()}
    assert got[1] == got[3] and got[2] is None and got[4] is None
    cache = spark.createDataFrame([("a b", "m", [1.0, 2.0], None)], "query_text string, embedding_model string, embedding array<double>, created_at timestamp")
    out, fresh = providers.embed_cached(df.where("id in (1, 3)"), "id", "t", cache, "m", providers.HashedWords)
    assert [r.embedding for r in out.collect()] == [[1.0, 2.0]] * 2 and fresh.count() == 0
    waits = []

    def flaky():
        if len(waits) < 2:
            raise OSError("busy")
        return "ok"

    assert providers.with_retries(flaky, wait=waits.append) == "ok" and len(waits) == 2
    with pytest.raises(OSError):
        providers.with_retries(lambda: (_ for _ in ()).throw(OSError("x")), attempts=2, wait=lambda s: None)
    with pytest.raises(ValueError):
        providers.HashedWords().embed([])


def test_files(spark, tmp_path):
    for name, body in (("2311.12022v1.pdf", "one\ftwo-\nx"), ("2311.12022v2.pdf", "new"), ("notes.pdf", "no"), ("2401.00001.pdf", "\ud800".encode("utf-8", "surrogatepass"))):
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    import os

    os.utime(tmp_path / "2311.12022v1.pdf", (1, 1))
    pdfs = files.pdf_files(spark, str(tmp_path))
    assert {r.paper_id: r.path.rsplit("/", 1)[1] for r in pdfs.collect()} == {"2311.12022": "2311.12022v2.pdf", "2401.00001": "2401.00001.pdf"}
    rows = files.extract_pages(pdfs).collect()
    assert {(r.paper_id, r.text) for r in rows if r.error is None} == {("2311.12022", "new")}
    assert [r.paper_id for r in rows if r.error] == ["2401.00001"]
    files.write_parsed(files.parse_pages(files.extract_pages(pdfs)), str(tmp_path / "parsed"))
    assert [(r.page, r.text) for r in files.read_parsed(spark, str(tmp_path / "parsed")).collect()] == [(1, "new")]
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "a.json").write_text('{"doc_id": "d", "pages": [{"page": 1}, {"text": "x"}]}')
    (odd / "b.json").write_text("[1")
    (odd / "c.json").write_text('{"pages": []}')
    got = {(r.doc_id, r.page, r.text, r.error) for r in files.read_parsed(spark, str(odd)).collect()}
    assert got == {("d", 1, "", None), (None, None, None, "invalid_parsed_json"), (None, None, None, "missing_doc_id")}
    with pytest.raises(ValueError):
        files.read_parsed(spark, str(tmp_path / "notes.pdf"))
    assert files.warning_summary(["Font x", "bad a", "bad b", "bad c", "bad d"]) == "bad a; bad b; bad c (+1 more)"
    assert files.warning_summary(["font"]) is None


def test_small_files(spark, tmp_path):
    (tmp_path / "i.txt").write_text("# c\n2311.12022v2\n\n2311.12022\nbad\n")
    (tmp_path / "i.json").write_text('{"ids": ["a ", ""]}')
    assert files.read_ids(str(tmp_path / "i.json")) == ["a"]
    got = [(r.base_id, r.valid) for r in files.normalize_ids(spark, files.read_ids(str(tmp_path / "i.txt"))).orderBy("pos").collect()]
    assert got == [("2311.12022", True), ("bad", False)]
    (tmp_path / "j.json").write_text("[1]")
    for bad in ("j.json", "k.csv"):
        (tmp_path / bad).touch()
        with pytest.raises(ValueError):
            files.read_ids(str(tmp_path / bad))
    with pytest.raises(FileNotFoundError):
        files.read_ids(str(tmp_path / "none.txt"))
    p = tmp_path / "e.json"
    p.write_text(json.dumps({"eval_set": [{"query_id": "q1"}], "metadata": {}}))
    items, meta = files.read_eval_set(spark, str(p))
    r = items.first()
    assert (r.difficulty, r.ground_truth.chunk_uids, meta["n_queries"]) == ("factual", [], 1)
    files.write_eval_set(items, str(tmp_path / "f.json"), "2026-01-01")
    assert files.read_eval_set(spark, str(tmp_path / "f.json"))[0].count() == 1
    p.write_text("{}")
    with pytest.raises(ValueError):
        files.read_eval_set(spark, str(p))
    (tmp_path / "o.txt").write_text("Why\n\n How ")
    assert files.read_openings(str(tmp_path / "o.txt")) == ["Why", "How"]
    assert "{chunks}" in files.read_prompt("generate")
    with pytest.raises(FileNotFoundError):
        files.read_prompt("nope")
    (tmp_path / "blank.txt").write_text(" ")
    with pytest.raises(ValueError):
        files.read_prompt("generate", str(tmp_path / "blank.txt"))
    files.write_id_index(spark.createDataFrame([("b",), ("a",), ("a",)], "paper_id string"), str(tmp_path / "idx"))
    assert sorted(r[0] for r in files.read_id_index(spark, str(tmp_path / "idx")).collect()) == ["a", "b"]


class Client:
    def search(self, query, max_results, sort):
        return [{"paper_id": "2311.12022v3", "title": query, "published_date": dt.date(2023, 11, 1)}][:max_results]

    def fetch(self, ids):
        return [{"paper_id": i} for i in ids]


def test_remote(spark, tmp_path):
    assert remote.search(spark, Client(), "t").first().paper_id == "2311.12022"
    with pytest.raises(ValueError):
        remote.search(spark, Client(), "t", sort="x")
    assert remote.metadata(spark, Client(), ["a", "a", "b"]).count() == 2
    left = remote.pending(spark, ["b", "a", "c", "b"], spark.createDataFrame([("a",)], "paper_id string"))
    assert [r.paper_id for r in left.collect()] == ["b", "c"]

    class R:
        def __init__(self, status, headers=None):
            self.status, self.headers = status, headers or {}

        def parts(self):
            yield b"pdf"

    seen, waits = [], []

    def get(one):
        seen.append(one)
        return {"a/1": R(200), "b": R(429, {"Retry-After": "7"}) if seen.count("b") == 1 else R(200), "c": R(404)}[one]

    out = remote.download(remote.FetchConfig(str(tmp_path), delay_seconds=0), ["a/1", "b", "c", "a/1"], get, waits.append)
    assert out == {"a/1": "fetched", "b": "fetched", "c": "HTTP 404"} and waits == [7.0]
    assert remote.download(remote.FetchConfig(str(tmp_path)), ["b"], get)["b"] == "exists"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a_1.pdf", "b.pdf"]


def test_availability():
    def broken():
        raise OSError("no such service")

    assert providers.available(providers.FirstChunk) and not providers.available(broken)


def test_openings_take_turns():
    plan = evalgen.openings_plan(52, seed=1)
    groups = [next(i for i, g in enumerate(evalgen.OPENINGS) if o in g) for o in plan]
    assert groups[:6] == list(range(6)) and sorted(plan[:26]) == sorted(plan[26:]) and plan[:26] != plan[26:]
    assert evalgen.openings_plan(5, seed=1) == plan[:5] != evalgen.openings_plan(5, seed=2)
    for bad in (0, 53):
        with pytest.raises(ValueError):
            evalgen.openings_plan(bad)


def test_fetcher_uses_its_settings(tmp_path):
    seen = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] = self.headers["User-Agent"]
            self.send_response(200 if self.path == "/a" else 404)
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config, waits = remote.FetchConfig(str(tmp_path), delay_seconds=3, timeout_seconds=5, user_agent="tester"), []
    got = remote.download(config, ["a", "b"], remote.url_fetcher(config, lambda i: f"http://127.0.0.1:{server.server_port}/{i}"), waits.append)
    server.shutdown()
    assert got == {"a": "fetched", "b": "HTTP 404"} and (tmp_path / "a.pdf").read_bytes() == b"body"
    assert waits == [3] and seen == {"/a": "tester", "/b": "tester"}


def test_failing_pages_of_an_extractor(spark):
    def extractor(content):
        if content == b"bad":
            raise ValueError("broken file")
        return ["one", None, "three"], ["odd table", "bogus font"]

    df = spark.createDataFrame([("p", "d", "/p.pdf", bytearray(b"x")), ("q", "e", "/q.pdf", bytearray(b"bad"))], "paper_id string, doc_id string, path string, content binary")
    got = sorted((r.paper_id, r.page, r.text, r.warning, r.error) for r in files.extract_pages(df, extractor).fillna({"page": 0, "text": ""}).collect())
    note = "odd table; page 2 could not be read"
    assert got == [("p", 1, "one", note, None), ("p", 3, "three", note, None), ("q", 0, "", None, "broken file")]
