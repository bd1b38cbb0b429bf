"""Command line: python -m paperweir.cli HOME COMMAND ...; exit codes 0 fine, 1 user error or failed check, 2 system error."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from paperweir.engine import Engine, SearchConfig
from paperweir.functions.text import snippet
from paperweir.operators import evalgen
from paperweir.operators.answering import AnswerConfig
from paperweir.operators.evaluation import report_markdown
from paperweir.operators.chunking import ChunkConfig
from paperweir.operators.providers import available
from paperweir.session import build_session, cut, scratch
from paperweir.sources import files, remote


def _answer_options(q: argparse.ArgumentParser) -> None:
    """How answers are made: which stages run around the model."""
    q.add_argument("--generate", action="store_true")
    q.add_argument("--generation-rerank", choices=("none", "lexical"), default="none")
    q.add_argument("--generation-select-evidence", action="store_true")
    q.add_argument("--generation-select-k", type=int, default=3)
    q.add_argument("--generation-quote-first", action="store_true")
    q.add_argument("--generation-cite-chunk-index", action="store_true")
    q.add_argument("--generation-repair-citations", action="store_true")
    q.add_argument("--generation-repair-max-attempts", type=int, default=1)
    q.add_argument("--generation-concurrency", type=int, default=4)


def _answer_config(a: argparse.Namespace) -> AnswerConfig:
    return AnswerConfig(a.generation_select_evidence, a.generation_select_k, a.generation_quote_first, a.generation_cite_chunk_index, a.generation_repair_citations, a.generation_repair_max_attempts, a.generation_concurrency)


def parser() -> argparse.ArgumentParser:
    """The commands and their options."""
    p = argparse.ArgumentParser(prog="paperweir")
    p.add_argument("home", help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("query", "sources"):
        q = sub.add_parser(name)
        q.add_argument("question")
        q.add_argument("--mode", default="hybrid" if name == "sources" else "fts")
        q.add_argument("--top-k", type=int, default=5)
        q.add_argument("--snippet-chars", type=int, default=240)
        q.add_argument("--rrf-k", type=int, default=60)
        q.add_argument("--fts-weight", type=float, default=1.0)
        q.add_argument("--vector-weight", type=float, default=1.0)
        _answer_options(q)
        q.add_argument("--verify", metavar="PARSED", help="folder of parsed pages to hold the answer against")
        q.add_argument("--no-log", action="store_true", default=name == "sources")
        q.add_argument("--verbose", action="store_true", default=name == "sources")
    g = sub.add_parser("eval-generate")
    g.add_argument("output")
    g.add_argument("--questions", type=int, default=50)
    g.add_argument("--per-chunk", type=int, default=1)
    g.add_argument("--min-chars", type=int, default=200)
    g.add_argument("--seed", type=int, default=0)
    g.add_argument("--openings-path", help="openings of questions, as a JSON list or lines; else a plan of the built-in ones")
    g.add_argument("--prompt-path")
    g.add_argument("--corpus-version", default="")
    r = sub.add_parser("eval-run")
    r.add_argument("eval_set")
    r.add_argument("--mode", default="hybrid")
    r.add_argument("--top-k", type=int, default=10)
    r.add_argument("--rrf-k", type=int, default=60)
    r.add_argument("--fts-weight", type=float, default=1.0)
    r.add_argument("--vector-weight", type=float, default=1.0)
    r.add_argument("--generation-top-k", type=int, default=5)
    _answer_options(r)
    r.add_argument("--report", default=None)
    i = sub.add_parser("ingest")
    i.add_argument("parsed", help="folder of PDFs or of parsed JSON")
    i.add_argument("--target-tokens", type=int, default=512)
    i.add_argument("--overlap-tokens", type=int, default=100)
    x = sub.add_parser("index")
    x.add_argument("--doc-id", action="append")
    x.add_argument("--limit", type=int)
    x.add_argument("--force-delete", action="store_true")
    x.add_argument("--force", action="store_true", help="embed all chunks again")
    x.add_argument("--rebuild", metavar="FOLDER", help="parse, chunk and index the PDFs of a folder")
    x.add_argument("--add-ids", metavar="FILE", help="fetch, parse, chunk and index the papers of a list of identifiers")
    x.add_argument("--pdf-dir", default="pdfs", help="where --add-ids puts PDFs")
    f = sub.add_parser("download")
    f.add_argument("ids", help="file of identifiers")
    f.add_argument("--pdf-dir", default="pdfs")
    f.add_argument("--delay-seconds", type=float, default=10.0)
    f.add_argument("--retries", type=int, default=3)
    f.add_argument("--id-index", help="file of identifiers to bring up to date with the folder")
    s = sub.add_parser("parse")
    s.add_argument("pdf_dir")
    s.add_argument("output", help="folder of parsed JSON")
    s.add_argument("--remove-headers", action="store_true")
    v = sub.add_parser("inspect")
    v.add_argument("--doc-id", action="append")
    c = sub.add_parser("check-ids")
    c.add_argument("file")
    return p


def _query(e: Engine, a: argparse.Namespace) -> int:
    began = time.perf_counter()
    config, stages = SearchConfig(a.mode, a.top_k, a.rrf_k, a.fts_weight, a.vector_weight), _answer_config(a)
    if a.verify and not a.generate:
        raise ValueError("--verify goes with --generate only")
    if a.generate and not available(e.generator):
        raise RuntimeError("the model that answers cannot be set up here")
    asked = e.spark.createDataFrame([("q1", a.question)], "query_id string, query string")
    results, warnings = e.search(asked, config)
    rows = results.withColumn("line", snippet("text", a.snippet_chars)).orderBy("rank").collect()
    for w in warnings:
        print(w, file=sys.stderr)
    for r in rows:
        print(f"{r['rank']}. [{r.paper_id} p.{r.page_number}] {r.score:.4f} {r.line}")
        if a.verbose:
            print(json.dumps([p.asDict() for p in r.provenance]))
    said = e.answer(results, a.top_k, a.generation_rerank == "lexical", stages).first() if a.generate and rows else None
    if said:
        print(said.answer or said.error)
    if not a.no_log:
        ms = int((time.perf_counter() - began) * 1000)
        log = e.spark.createDataFrame([(a.question, [r.chunk_uid for r in rows], said.answer if said else None, ms, e.model)], "query_text string, retrieved_chunks array<string>, answer string, latency_ms int, model string")
        try:
            e.log(log)
        except Exception as err:  # noqa: BLE001
            print(f"not logged: {err}", file=sys.stderr)
    if a.verify and said and said.answer:
        checked = e.verify_parsed(e.spark.createDataFrame([("q1", said.answer)], "answer_id string, answer string"), a.verify).first()
        print(f"verification: {' '.join([checked.status, *checked.codes])}")
        return 0 if checked.status == "pass" else 1
    return 0


def run(argv: list[str], engine: Engine | None = None, client: remote.PaperClient | None = None, get: Callable | None = None) -> int:
    """Runs one command; `client` and `get` reach the service that `index --add-ids` asks."""
    a = parser().parse_args(argv)
    with scratch():
        return _run(a, engine, client, get)


def _run(a: argparse.Namespace, engine: Engine | None, client: remote.PaperClient | None, get: Callable | None) -> int:
    try:
        e = engine or Engine(build_session(), a.home)
        if a.command in ("query", "sources"):
            return _query(e, a)
        if a.command == "eval-generate":
            openings = files.read_openings(a.openings_path) if a.openings_path else evalgen.openings_plan(a.questions, a.seed)
            made = e.make_eval_set(a.questions, per_chunk=a.per_chunk, min_chars=a.min_chars, seed=a.seed, openings=openings, prompt_path=a.prompt_path)
            files.write_eval_set(made, a.output, date.today().isoformat(), a.corpus_version)
        elif a.command == "eval-run":
            items, meta = files.read_eval_set(e.spark, a.eval_set)
            per, summary, failed = e.evaluate(items, SearchConfig(a.mode, a.top_k, a.rrf_k, a.fts_weight, a.vector_weight), a.generate, min(a.generation_top_k, a.top_k), a.generation_rerank == "lexical", _answer_config(a))
            misses = [r.query_id for r in per.where(F.col("recall_at_5") == 0).orderBy("query_id").limit(5).collect()]
            said = report_markdown(summary.first().asDict(), failed.first().asDict(), misses, meta["created"])
            Path(a.report).write_text(said, encoding="utf-8") if a.report else print(said)
        elif a.command == "ingest":
            pdfs = any(Path(a.parsed).glob("*.pdf"))
            if pdfs:
                pages = files.parse_pages(files.extract_pages(files.pdf_files(e.spark, a.parsed)))
            else:
                stem = F.regexp_replace(F.element_at(F.split("pdf_path", "/"), -1), r"\.[^.]*\z", "")
                pages = files.read_parsed(e.spark, a.parsed).withColumn("path", F.col("pdf_path")).withColumn("paper_id", stem).withColumn("warning", F.lit(None).cast("string"))
            counts = e.ingest(pages, ChunkConfig(a.target_tokens, a.overlap_tokens))
            print(json.dumps(counts))
            return 1 if counts["failed"] else 0
        elif a.command == "index":
            if (a.rebuild or a.add_ids) and (a.doc_id or a.limit) or a.rebuild and a.add_ids:
                raise ValueError("--rebuild and --add-ids go with neither --doc-id nor --limit, nor with one another")
            if a.add_ids:
                if client is None or get is None:
                    raise ValueError("no service for papers is set up")
                counts = e.add_papers(files.read_ids(a.add_ids), client, get, remote.FetchConfig(a.pdf_dir))
                print(json.dumps(counts))
                return 1 if counts["failed"] or counts["unfetched"] or counts["invalid"] else 0
            if a.rebuild:
                counts = e.ingest_folder(a.rebuild)
                print(json.dumps(counts))
                return 1 if counts["failed"] else 0
            print(e.index(a.doc_id, a.limit, a.force_delete, a.force))
        elif a.command == "download":
            if get is None:
                raise ValueError("no service for papers is set up")
            good, bad = e.check_ids(files.read_ids(a.ids))
            outcome = remote.download(remote.FetchConfig(a.pdf_dir, a.delay_seconds, a.retries), good, get)
            if a.id_index:
                files.write_id_index(files.pdf_files(e.spark, a.pdf_dir), a.id_index)
            print(json.dumps(outcome))
            return 1 if bad or any(x not in ("exists", "fetched") for x in outcome.values()) else 0
        elif a.command == "parse":
            pages = cut(files.extract_pages(files.pdf_files(e.spark, a.pdf_dir)), "pages")
            files.write_parsed(files.parse_pages(pages, a.remove_headers), a.output)
            failed = pages.where(F.col("error").isNotNull()).select("path", "error").orderBy("path").limit(20).collect()
            for r in failed:
                print(f"{r.path}: {r.error}", file=sys.stderr)
            return 1 if failed else 0
        elif a.command == "inspect":
            for r in e.vector_counts(a.doc_id).orderBy("doc_id").collect():
                print(f"{r.doc_id}\t{r.n}")
        elif a.command == "check-ids":
            good, bad = e.check_ids(files.read_ids(a.file))
            print("\n".join(good))
            for b in bad:
                print(f"invalid: {b}", file=sys.stderr)
            return 1 if bad else 0
        return 0
    except (ValueError, FileNotFoundError) as err:
        print(err, file=sys.stderr)
        return 1
    except Exception as err:  # noqa: BLE001
        print(err, file=sys.stderr)
        return 2

def main() -> None:
    """Entry point of the command."""
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
