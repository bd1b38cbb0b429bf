"""Queries that run the engine's stored tables, files and caches over the whole tables and return what is stored then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir import schemas
from paperweir.engine import Engine
from paperweir.functions.ids import paper_key
from paperweir.operators import providers
from paperweir.operators.answering import AnswerConfig
from paperweir.plans import base, texts
from paperweir.plans.tables import _PAPER, latest_version
from paperweir.session import cut, scratch_path
from paperweir.sources import files
from paperweir.sources.tables import table
from paperweir.streaming.reindex import activity


def _pages(spark: SparkSession, d: str, prefix: str = "") -> DataFrame:
    """Pages of the last document of every paper, as an extractor gives them."""
    docs = latest_version(spark, d).withColumnRenamed("paper", "paper_id")
    pages = texts._pages(spark, d).join(docs, "doc_id")
    name = F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    none = F.lit(None).cast("string")
    return pages.select("paper_id", name.alias("doc_id"), F.concat(F.lit("/p/"), name).alias("path"), "page", "text", none.alias("warning"), none.alias("error"))


def _engine(spark: SparkSession, d: str) -> Engine:
    """An engine that holds all papers, with the last document of each in chunks."""
    e = Engine(spark, scratch_path(spark, "home"))
    e.upsert_papers(table(spark, d, "papers").select(paper_key("paper_id").alias("paper_id"), "title", "abstract", "source_type", "indexed_at").where("paper_id is not null"))
    e.ingest(cut(_pages(spark, d), "pages"), texts.CONFIG)
    return e


def engine_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the last document of every known paper, as the engine stores them."""
    return _engine(spark, d).table("chunks").select("paper_id", "doc_id", "page_number", "chunk_index", "chunk_uid", "token_count")


def engine_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers and the document that each got."""
    return _engine(spark, d).table("papers").select("paper_id", "doc_id", "pdf_path")


def engine_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and vectors of every document after papers of the removal log came again under another document."""
    e = _engine(spark, d)
    e.index()
    gone = table(spark, d, "removal_log").where("target_table = 'papers'").select(paper_key("target_key").alias("paper_id"))
    e.ingest(cut(_pages(spark, d, "again-").join(gone, "paper_id", "left_semi"), "pages"), texts.CONFIG)
    e.index()
    chunks = e.table("chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_uid").alias("least_uid"))
    vectors = e.table("vectors").groupBy("doc_id").agg(F.count("*").alias("n_vectors"), F.min("chunk_uid").alias("least_vector"))
    return chunks.join(vectors, "doc_id", "full")


def parsed_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as parsed JSON and read again."""
    at = scratch_path(spark, "parsed")
    files.write_parsed(_pages(spark, d), at)
    return files.read_parsed(spark, at).select("doc_id", "pdf_path", "page", F.sha1("text").alias("text_sha1"), "error")


def id_index(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of papers written as an index and read again."""
    at = scratch_path(spark, "ids")
    files.write_id_index(table(spark, d, "papers").select(F.trim("paper_id").alias("paper_id")), at)
    return files.read_id_index(spark, at)


def embedding_misses(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the log, whether the cache of the eval set's questions has their vector, and the size of the vector."""
    cache = providers.embed(base.items(spark, d).select("query").where("query is not null").distinct().withColumn("t", F.col("query")), "query", "t", providers.HashedWords)
    cache = cut(cache.select(F.col("query").alias("query_text"), F.lit("stand-in").alias("embedding_model"), F.col("embedding").cast("array<double>").alias("embedding")), "cache")
    asked = table(spark, d, "query_log").select("query_id", "query_text").where("query_text is not null").distinct()
    out, fresh = providers.embed_cached(asked, "query_id", "query_text", cache, "stand-in", providers.HashedWords)
    new = fresh.select("query_text", F.lit(True).alias("fresh"))
    return out.join(asked, "query_id").join(new, "query_text", "left").select("query_id", F.size("embedding").alias("dims"), F.coalesce("fresh", F.lit(False)).alias("fresh")).distinct()


def chunks_to_embed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without a vector, with the columns that a vector row has."""
    c = base.chunks(spark, d)
    return schemas.conform(c.where("embedding is null"), schemas.VECTORS).drop("embedding")


CONFIGS = {"plain": AnswerConfig(), "evidence": AnswerConfig(select_evidence=True, select_k=2, repair=True), "quote": AnswerConfig(quote_first=True), "numbers": AnswerConfig(cite_chunks=True)}


def prompt_versions(spark: SparkSession, d: str) -> DataFrame:
    """What answers of each configuration are cached under."""
    one = spark.range(1)
    rows = [one.select(F.lit(name).alias("config"), c.version().alias("version")) for name, c in CONFIGS.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def activity_windows(spark: SparkSession, d: str) -> DataFrame:
    """Logged queries of every day and their mean latency; those without a time are in no window."""
    out = activity(table(spark, d, "query_log").withColumn("logged_at", F.col("logged_at").cast("timestamp")))
    return out.select(F.date_format("from_time", "yyyy-MM-dd").alias("day"), "n", F.round("latency_ms", 6).alias("latency_ms"))


def _version_text(c: AnswerConfig) -> str:
    """The text whose digest is the version, put together without Spark."""
    names = ["generate", *(["select_evidence"] if c.select_evidence else []), *(["select_quote", "quote_first"] if c.quote_first else []), *(["cite_chunks"] if c.cite_chunks else []), *(["repair"] if c.repair else [])]
    flags = [f"select={c.select_evidence}", f"select_k={c.select_k}", f"quote_first={c.quote_first}", f"cite_chunks={c.cite_chunks}", f"repair={c.repair}", f"attempts={c.repair_attempts}"]
    parts = [files.read_prompt(n) for n in names]
    return "\n".join([parts[0], *flags, *parts[1:]])


_LAST = f"last AS (SELECT paper, doc_id FROM (SELECT {_PAPER.format('paper_id')} AS paper, doc_id, harvested_at FROM documents WHERE paper_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY paper ORDER BY harvested_at DESC NULLS LAST, doc_id) = 1)"
_KNOWN = f"known AS (SELECT DISTINCT {_PAPER.format('paper_id')} AS paper FROM papers WHERE paper_id IS NOT NULL)"
_WINDOWS = f"""{texts.PAGES}, {_LAST}, {_KNOWN}, t AS (SELECT l.paper, CAST(p.doc_id AS VARCHAR) AS doc_id, page, regexp_extract_all(text, '{texts._TOKEN}') AS ts FROM pages p JOIN last l ON p.doc_id = l.doc_id JOIN known k ON k.paper = l.paper WHERE regexp_matches(text, '[^ \\t\\n\\f\\r]')),
w AS (SELECT *, unnest(range(CASE WHEN len(ts) <= 64 THEN 1 ELSE 1 + CAST(ceil((len(ts) - 64) / 48.0) AS BIGINT) END)) AS i FROM t),
c AS (SELECT paper, doc_id, page, i, length(array_to_string(ts[1 : i * 48], '')) AS b, length(array_to_string(ts[1 : i * 48 + 64], '')) AS e, least(64, len(ts) - i * 48) AS token_count FROM w)"""

SQL = {
    "engine_chunks": f"WITH {_WINDOWS} SELECT paper AS paper_id, doc_id, page AS page_number, i AS chunk_index, sha1(concat_ws(':', doc_id, page, i, b, e)) AS chunk_uid, token_count FROM c",
    "engine_papers": f"WITH {_LAST}, {_KNOWN}, written AS (SELECT doc_id FROM documents WHERE text IS NOT NULL) SELECT k.paper AS paper_id, CAST(l.doc_id AS VARCHAR) AS doc_id, '/p/' || l.doc_id AS pdf_path FROM known k LEFT JOIN (SELECT * FROM last WHERE doc_id IN (SELECT doc_id FROM written)) l ON k.paper = l.paper",
    "engine_reindex": f"""WITH {_WINDOWS}, r AS (SELECT DISTINCT {_PAPER.format('target_key')} AS k FROM removal_log WHERE target_table = 'papers'),
      n AS (SELECT CASE WHEN paper IN (SELECT k FROM r WHERE k IS NOT NULL) THEN 'again-' || doc_id ELSE doc_id END AS doc_id, page, i, b, e FROM c), u AS (SELECT doc_id, sha1(concat_ws(':', doc_id, page, i, b, e)) AS uid FROM n)
      SELECT doc_id, count(*) AS n_chunks, min(uid) AS least_uid, count(*) AS n_vectors, min(uid) AS least_vector FROM u GROUP BY 1""",
    "parsed_files": f"WITH {texts.PAGES}, {_LAST} SELECT CAST(p.doc_id AS VARCHAR) AS doc_id, '/p/' || p.doc_id AS pdf_path, page, sha1(text) AS text_sha1, CAST(NULL AS VARCHAR) AS error FROM pages p JOIN last l ON p.doc_id = l.doc_id",
    "id_index": "SELECT DISTINCT trim(paper_id, ' ') AS paper_id FROM papers WHERE trim(paper_id, ' ') <> ''",
    "embedding_misses": f"WITH {base.SQL_ITEMS} SELECT DISTINCT query_id, CASE WHEN trim(query_text) = '' THEN -1 ELSE 64 END AS dims, query_text NOT IN (SELECT query FROM items WHERE query IS NOT NULL) AS fresh FROM query_log WHERE query_text IS NOT NULL",
    "chunks_to_embed": f"WITH {base.SQL_CHUNKS} SELECT chunk_uid, doc_id, paper_id, page_number, chunk_index, token_count FROM uchunks WHERE embedding IS NULL",
    "prompt_versions": " UNION ALL ".join("SELECT '{}' AS config, sha256('{}') AS version".format(n, _version_text(c).replace("'", "''")) for n, c in CONFIGS.items()),
    "activity_windows": "SELECT strftime(date_trunc('day', logged_at), '%Y-%m-%d') AS day, count(*) AS n, round(avg(latency_ms), 6) AS latency_ms FROM query_log WHERE logged_at IS NOT NULL GROUP BY 1",
}
QUERIES = {
    "engine_chunks": engine_chunks,
    "engine_papers": engine_papers,
    "engine_reindex": engine_reindex,
    "parsed_files": parsed_files,
    "id_index": id_index,
    "embedding_misses": embedding_misses,
    "chunks_to_embed": chunks_to_embed,
    "prompt_versions": prompt_versions,
    "activity_windows": activity_windows,
}
