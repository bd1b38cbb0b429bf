"""The engine: a folder of stored tables and what can be done with them.

Tables: papers, chunks, vectors, query_log, embedding_cache, answer_cache, and an index of the chunks' words. A change
writes the parts of a table that it touches; readers see one state or the other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir import schemas
from paperweir.operators import answering, chunking, citations, evalgen, evaluation, fulltext, fusion, providers, store, vectors
from paperweir.session import cut, drop_cut, read_text, remove, scratch, write_text
from paperweir.sources import files, remote
from paperweir.sources.stored import StoredTable

#: The key by which each table is divided, and into how many parts.
KEYS = {"papers": ("paper_id", 16), "chunks": ("doc_id", 64), "vectors": ("doc_id", 64), "query_log": ("query_id", 1), "embedding_cache": ("query_text", 16), "answer_cache": ("query_text", 16)}
MODES = ("fts", "vector", "hybrid")


@dataclass(frozen=True)
class SearchConfig:
    """How a search ranks."""

    mode: str = "fts"
    top_k: int = 5
    rrf_k: int = 60
    fts_weight: float = 1.0
    vector_weight: float = 1.0
    candidate_multiplier: int = 2
    metric: str = "cosine"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if self.top_k <= 0 or self.rrf_k <= 0 or self.candidate_multiplier <= 0:
            raise ValueError("numbers of results and candidates, and the constant of the fusion, must be > 0")
        if self.fts_weight < 0 or self.vector_weight < 0:
            raise ValueError("a weight must not be below 0")
        if self.fts_weight == 0 and self.vector_weight == 0:
            raise ValueError("one of the weights must be above 0")


class Engine:
    """Operations over the tables in `home`."""

    def __init__(self, spark: SparkSession, home: str, embedder: Callable = providers.HashedWords, generator: Callable = providers.FirstChunk, dim: int = 64, model: str = "stand-in"):
        self.spark, self.home, self.embedder, self.generator, self.dim, self.model = spark, home.rstrip("/"), embedder, generator, dim, model

    # tables

    def stored(self, name: str) -> StoredTable:
        """A table by its name."""
        key, parts = KEYS[name]
        return StoredTable(self.spark, f"{self.home}/{name}", getattr(schemas, name.upper()), key, parts)

    def table(self, name: str) -> DataFrame:
        """The rows of a table; one that was never written is empty."""
        return self.stored(name).read()

    def _upsert(self, name: str, new: DataFrame, keys: list[str], **how) -> None:
        t = self.stored(name)
        new = cut(new, name)
        parts = t.parts_of(new)
        t.replace(store.upsert(t.read(parts), new, keys, **how), parts)
        drop_cut(new)

    # papers and documents

    @scratch()
    def upsert_papers(self, rows: DataFrame) -> None:
        """New metadata in place of old; documents stay, the time of indexing is now."""
        new = store.latest(schemas.conform(rows, schemas.PAPERS), ["paper_id"], [F.desc_nulls_last("indexed_at"), F.asc_nulls_last("title")])
        self._upsert("papers", new, ["paper_id"], keep=["doc_id"], refresh={"indexed_at": F.current_timestamp()})

    def upsert_known(self, rows: DataFrame, folder: str) -> DataFrame:
        """As `upsert_papers`, for papers whose PDF is in the folder; returns PDFs without metadata (`paper_id`)."""
        have = files.pdf_files(self.spark, folder).select("paper_id")
        self.upsert_papers(rows.join(have, "paper_id", "left_semi"))
        return have.join(self.table("papers").select("paper_id"), "paper_id", "left_anti")

    @scratch()
    def ingest(self, pages: DataFrame, config: chunking.ChunkConfig = chunking.ChunkConfig(), batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Parsed pages (`paper_id, doc_id, path, page, text, warning, error`) to chunks, papers and stage counts.

        Chunks of a paper are replaced when its document changed, those of a document always. Only the parts that hold
        these papers and documents are read and written. Two papers with one document are an error. A `batch`
        `(stream, number)` that went in before changes nothing.
        """
        good = pages.where(F.col("error").isNull() & F.col("page").isNotNull())
        docs = cut(store.latest(good.select("paper_id", "doc_id", F.col("path").alias("pdf_path")).distinct(), ["doc_id"], ["paper_id", "pdf_path"]), "docs")
        kept, stored = self.stored("papers"), self.stored("chunks")
        parts = kept.parts_of(docs)
        papers = cut(kept.read(parts).join(docs.select("paper_id"), "paper_id", "left_semi"), "papers")
        others = kept.read().select("doc_id", F.col("paper_id").alias("other")).join(docs.select("paper_id").withColumnRenamed("paper_id", "other"), "other", "left_anti")
        if clash := others.join(docs.join(papers.select("paper_id"), "paper_id", "left_semi"), "doc_id").first():
            raise ValueError(f"two papers with document {clash.doc_id}")
        made = chunking.chunk_pages(good.select("doc_id", "page", "text"), config=config).join(docs.select("doc_id", "paper_id"), "doc_id")
        known = schemas.conform(made.join(papers.select("paper_id"), "paper_id", "left_semi"), schemas.CHUNKS).withColumn("chunk_id", stored.row_id())
        was = papers.select("doc_id").where("doc_id is not null")
        touched = stored.parts_of(docs.select("doc_id").unionByName(was))
        stored.replace(store.replace_versions(stored.read(touched), papers.select("paper_id", "doc_id"), cut(known, "chunks")), touched, batch)
        kept.replace(store.assign_documents(kept.read(parts), docs), parts, batch)
        unknown = docs.join(papers.select("paper_id"), "paper_id", "left_anti").count()
        return {"documents": docs.count(), "failed": pages.where(F.col("error").isNotNull()).count(), "unknown_papers": unknown, "chunks": self.table("chunks").count()}

    @scratch()
    def index(self, doc_ids: list[str] | DataFrame | None = None, limit: int | None = None, force_delete: bool = False, again: bool = False) -> int:
        """Embeds chunks that have no vector under their uid (all of them if `again`) and drops vectors whose chunks are gone.

        With a limit nothing is dropped unless forced. Returns the number of chunks read. Without a limit only the parts
        of documents that have something to embed or to drop, or were asked for, are written.
        """
        if limit is not None and limit <= 0:
            raise ValueError("limit must be > 0")
        chunks, stored = self.table("chunks"), self.stored("vectors")
        asked = None
        if doc_ids is not None:
            asked = doc_ids if isinstance(doc_ids, DataFrame) else self.spark.createDataFrame([(d,) for d in dict.fromkeys(doc_ids)], "doc_id string")
            chunks = chunks.join(asked, "doc_id", "left_semi")
        if limit is not None:
            chunks = chunks.orderBy("chunk_id").limit(limit)
        parts, old = None, stored.read()
        if limit is None and not again:
            uids = chunks.select("doc_id", "chunk_uid")
            have = old.select("doc_id", "chunk_uid") if asked is None else old.select("doc_id", "chunk_uid").join(asked, "doc_id", "left_semi")
            gone = have.join(uids, "chunk_uid", "left_anti") if asked is not None else have.join(uids, "chunk_uid", "left_anti").join(uids, "doc_id", "left_semi")
            parts = stored.parts_of(uids.join(old.select("chunk_uid"), "chunk_uid", "left_anti").select("doc_id").unionByName(gone.select("doc_id")))
            old = stored.read(parts)
            inside = chunks.where(stored.part().isin(parts))
        else:
            inside = chunks
        if parts != []:
            kept = old.join(inside.select("chunk_uid"), "chunk_uid", "left_semi").select("chunk_uid", "embedding")
            kept = kept.limit(0) if again else kept
            todo = inside.join(kept.select("chunk_uid"), "chunk_uid", "left_anti")
            made = providers.embed(todo, "chunk_uid", "text", self.embedder)
            new = cut(schemas.conform(inside.join(kept.unionByName(made), "chunk_uid"), schemas.VECTORS), "vectors")  # a model is asked once
            wanted = None if asked is None else asked.where(stored.part().isin(parts)) if parts is not None else asked
            stored.replace(store.reindex(old, new, wanted, limit is None or force_delete), parts)
            drop_cut(new)
        return chunks.count()

    @scratch()
    def text_index(self) -> tuple[DataFrame, DataFrame]:
        """The stored index of the chunks' words, brought up to date where chunks came or went since."""
        version, at = self.stored("chunks").version(), f"{self.home}/text_index"
        saved = json.loads(read_text(self.spark, f"{at}/current.json") or "{}")
        if saved.get("chunks") != version:
            chunks = self.table("chunks").select("chunk_id", "text")
            if saved:
                old = fulltext.read_index(self.spark, f"{at}/{saved['at']}")
                gone = old[1].join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id")
                index = fulltext.refresh(old, chunks.join(old[1].select("chunk_id"), "chunk_id", "left_anti"), "chunk_id", gone)
            else:
                index = fulltext.index_tables(chunks, "chunk_id")
            name = f"v{version}-{uuid.uuid4().hex[:8]}"
            fulltext.store_index(index, f"{at}/{name}")
            write_text(self.spark, f"{at}/current.json", json.dumps({"chunks": version, "at": name}))
            if saved:
                remove(self.spark, f"{at}/{saved['at']}")
            saved = {"at": name}
        return fulltext.read_index(self.spark, f"{at}/{saved['at']}")

    @scratch()
    def ingest_folder(self, folder: str, extractor: files.Extractor = files.plain_extractor, config: chunking.ChunkConfig = chunking.ChunkConfig(), remove_headers: bool = False, only: list[str] | None = None) -> dict[str, int]:
        """The newest PDF of each paper in a folder (of `only` these, if given), parsed, chunked and indexed: counts by stage.

        Documents that were there before under the same hash are read again but not embedded again.
        """
        pdfs = files.pdf_files(self.spark, folder)
        if only is not None:
            pdfs = pdfs.join(self.spark.createDataFrame([(i,) for i in only], "paper_id string"), "paper_id", "left_semi")
        pages = cut(files.extract_pages(pdfs, extractor), "pages")
        parsed = files.parse_pages(pages, remove_headers).unionByName(pages.where(F.col("error").isNotNull()).withColumn("removed", F.lit(0)))
        before = cut(self.table("papers").select("paper_id", "doc_id"), "before")
        counts = self.ingest(parsed, config)
        now = pages.where(F.col("doc_id").isNotNull()).select("paper_id", "doc_id").distinct()
        was = before.join(now.select("paper_id"), "paper_id", "left_semi").where(F.col("doc_id").isNotNull())
        docs = cut(now.select("doc_id").unionByName(was.select("doc_id")).distinct(), "docs")
        return {**counts, "warnings": pages.where(F.col("warning").isNotNull()).select("doc_id").distinct().count(), "indexed": self.index(docs)}

    def add_papers(self, ids: list[str], client: remote.PaperClient, get: Callable, fetch: remote.FetchConfig, **options) -> dict[str, int]:
        """Fetches papers by identifier, with metadata, and ingests them: counts by stage; invalid identifiers are counted."""
        good, bad = self.check_ids(ids)
        outcome = remote.download(fetch, good, get)
        self.upsert_known(remote.metadata(self.spark, client, good), fetch.folder)
        got = [i for i in good if outcome[i] in ("exists", "fetched")]
        counts = self.ingest_folder(fetch.folder, only=got, **options)
        return {"requested": len(good) + len(bad), "invalid": len(bad), "unfetched": len(good) - len(got), **counts}

    def vector_counts(self, doc_ids: list[str] | None = None) -> DataFrame:
        """Vectors of each document, and in all."""
        docs = self.table("chunks") if doc_ids is None else self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        return store.counts_per_document(docs, self.table("vectors").select("doc_id", "chunk_uid"))

    # search

    def search(self, questions: DataFrame, config: SearchConfig = SearchConfig()) -> tuple[DataFrame, list[str]]:
        """Ranked chunks of every question (`query_id, query`) and warnings.

        `query_id, query, rank, chunk_uid, chunk_id, paper_id, page_number, text, score, metric, provenance`.
        `metric` says whether lower or higher scores are better.
        """
        chunks, warnings = self.table("chunks"), []
        k = config.top_k * (config.candidate_multiplier if config.mode == "hybrid" else 1)
        lists = []
        if config.mode in ("fts", "hybrid") and config.fts_weight > 0:
            got = fulltext.bm25_topk(questions, None, k, index=self.text_index())
            lists.append(got.select("query_id", F.lit("fts").alias("backend"), "rank", "chunk_id", F.col("score").alias("raw_score")))
        if config.mode in ("vector", "hybrid") and config.vector_weight > 0:
            asked = self.embed_queries(questions).withColumnRenamed("embedding", "vector")
            have = self.table("vectors").join(chunks.select("chunk_uid", "chunk_id"), "chunk_uid")
            near = vectors.exact_topk(asked, have, k, config.metric, "query_id", "vector", "chunk_id", "embedding", self.dim)
            if not have.limit(1).count():
                warnings.append("no stored vector could be searched")
            lists.append(near.select("query_id", F.lit("vector").alias("backend"), "rank", "chunk_id", F.col("distance").alias("raw_score")))
        if config.mode == "hybrid":
            every = lists[0] if len(lists) == 1 else lists[0].unionByName(lists[1])
            top = fusion.rrf(every, config.top_k, {"fts": config.fts_weight, "vector": config.vector_weight}, config.rrf_k, item="chunk_id").withColumn("metric", F.lit("higher"))
        else:
            top = lists[0].select("query_id", "rank", "chunk_id", F.col("raw_score").alias("score"), F.array(F.struct("backend", "rank", "raw_score", (1.0 / F.col("rank")).alias("normalized_score"), F.lit(None).cast("double").alias("rrf_contribution"))).alias("provenance"), F.lit("lower").alias("metric"))
        out = top.join(chunks, "chunk_id").join(questions.select("query_id", "query"), "query_id")
        return out.select("query_id", "query", "rank", "chunk_uid", "chunk_id", "paper_id", "page_number", "text", "score", "metric", "provenance"), warnings

    def embed_queries(self, questions: DataFrame) -> DataFrame:
        """Vectors of questions; what was embedded before comes from the cache."""
        cache = self.table("embedding_cache")
        out, fresh = providers.embed_cached(questions, "query_id", "query", cache, self.model, self.embedder)
        out, fresh = out.select("query_id", "embedding"), fresh
        self._upsert("embedding_cache", fresh, ["query_text", "embedding_model"])
        have = self.table("embedding_cache").where(F.col("embedding_model") == self.model)
        return questions.join(have.select(F.col("query_text").alias("query"), "embedding"), "query").select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))

    def answer(self, results: DataFrame, k: int = 5, rerank: bool = True, config: answering.AnswerConfig = answering.AnswerConfig()) -> DataFrame:
        """Answers to the questions of search results; contexts that were answered before come from the cache."""
        ctx = cut(fusion.generation_context(results, k, rerank).select("query_id", "query", F.col("new_rank").alias("rank"), "chunk_uid", "paper_id", "page_number", "text"), "context")
        keyed = ctx.select("query_id", "query").distinct().join(providers.answer_key(ctx), "query_id").withColumn("version", config.version())
        cache = self.table("answer_cache").where(F.col("generation_model") == self.model).select(F.col("query_text").alias("query"), F.col("prompt_version").alias("version"), "chunk_uids_hash", F.col("answer_text").alias("cached"))
        hits = cut(store.cached(keyed, cache, ["query", "version", "chunk_uids_hash"]), "hits")
        todo = hits.where("not hit")
        got = answering.generate_answers(todo.select("query_id", "query"), ctx.join(todo.select("query_id"), "query_id", "left_semi"), self.generator, config)
        new = todo.join(got, "query_id").where(F.col("answer").isNotNull())
        rows = new.select(F.col("query").alias("query_text"), F.lit(self.model).alias("generation_model"), F.col("version").alias("prompt_version"), "chunk_uids_hash", F.col("answer").alias("answer_text"), F.current_timestamp().alias("created_at"))
        out = hits.where("hit").select("query_id", F.col("cached").alias("answer"), F.lit(None).cast("string").alias("error")).unionByName(got)
        keys = ["query_text", "generation_model", "prompt_version", "chunk_uids_hash"]
        self._upsert("answer_cache", store.latest(rows, keys, ["answer_text"]), keys)
        return out

    def verify(self, answers: DataFrame, pages: DataFrame) -> DataFrame:
        """Whether answers (`answer_id, answer`) stand on the pages (`paper_id, page_number, text`)."""
        return citations.verify(answers, self.table("papers"), pages)

    def verify_parsed(self, answers: DataFrame, folder: str) -> DataFrame:
        """The same against a folder of parsed pages; the pages of stored chunks are those that may be cited."""
        docs = self.table("papers").select("doc_id", "paper_id").where("doc_id is not null")
        rows = files.read_parsed(self.spark, folder)
        pages = rows.where("error is null").join(docs, "doc_id").select("paper_id", F.col("page").alias("page_number"), "text")
        known = self.table("chunks").select("paper_id", "page_number").distinct()
        broken = rows.where("error is not null").join(docs, "doc_id").select("paper_id")
        return citations.verify(answers, self.table("papers"), pages, known_pages=known, broken_files=broken)

    @scratch()
    def log(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Appends to the query log (`query_text, retrieved_chunks, answer, latency_ms, model`), without reading it.

        A `batch` `(stream, number)` that was appended before is not appended again.
        """
        t = self.stored("query_log")
        t.append(store.query_log_rows(rows).withColumn("query_id", t.row_id()).withColumn("timestamp", F.current_timestamp()), batch)

    # evaluation

    def make_eval_set(self, n: int = 50, **options) -> DataFrame:
        """Eval items from stored chunks."""
        return evalgen.generate_eval_set(self.table("chunks"), self.table("papers"), self.generator, n, **options)

    def evaluate(self, items: DataFrame, config: SearchConfig = SearchConfig("hybrid", 10), answers: bool = False, generation_k: int = 5, rerank: bool = True, answering_config: answering.AnswerConfig = answering.AnswerConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(per item, summary, failures) of an eval set (`query_id, query, ground_truth`), with answers if asked."""
        rows = items.withColumn("truth", F.col("ground_truth.chunk_uids"))
        results = cut(self.search(rows.select("query_id", "query"), config)[0], "results")
        per = evaluation.retrieval_metrics(results, rows)
        if answers:
            said = self.answer(results, min(generation_k, config.top_k), rerank, answering_config)
            fine = said.where(F.col("answer").isNotNull() & ~F.coalesce(citations.parse_error("answer"), F.lit(True)))
            cites = citations.parsed(fine, "query_id").select("query_id", "citation_id", "paper_id", "page_number")
            scores = evaluation.citation_scores(rows.join(fine.select("query_id"), "query_id", "left_semi"), cites, self.table("chunks"))
            broken = said.select("query_id", F.when(F.coalesce(citations.parse_error("answer"), F.lit(False)), "malformed").alias("citation_error"), F.col("error").alias("generation_error"))
            per = per.join(scores, "query_id", "left").join(broken, "query_id", "left")
        return per, evaluation.summarize(per), evaluation.failures(per)

    def check_ids(self, ids: list[str]) -> tuple[list[str], list[str]]:
        """(valid, invalid) base identifiers of a list, in order, each once."""
        rows = files.normalize_ids(self.spark, ids).orderBy("pos").collect()
        return [r.base_id for r in rows if r.valid], [r.base_id for r in rows if not r.valid]



