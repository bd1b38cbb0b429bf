"""Queries on stored tables: upserts, versions, lookups, caches, counts and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions.ids import base_id, chunk_key, outer_trimmed, paper_key
from paperweir.operators import providers, store
from paperweir.operators.evaluation import seeded_sample
from paperweir.plans import base
from paperweir.sources.tables import table


def papers_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first harvest of every paper, brought up to its last; the document stays that of the first."""
    p = table(spark, d, "papers")
    order = [F.asc_nulls_first("indexed_at"), F.asc_nulls_first("title"), F.asc_nulls_first("doc_id"), F.asc_nulls_first("source_type")]
    back = [F.desc_nulls_last("indexed_at"), F.desc_nulls_last("title"), F.desc_nulls_last("doc_id"), F.desc_nulls_last("source_type")]
    out = store.upsert(store.latest(p, ["paper_id"], order), store.latest(p, ["paper_id"], back), ["paper_id"], keep=["doc_id"])
    return out.select("paper_id", "doc_id", "title", "source_type", "indexed_at")


def _removed(spark: SparkSession, d: str, target: str) -> DataFrame:
    norm = paper_key("target_key") if target == "papers" else chunk_key("target_key")
    return table(spark, d, "removal_log").where(F.col("target_table") == target).select(norm.alias("k")).where("k is not null").distinct()


def versioned_replace(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every paper after those in the removal log were parsed again under another document."""
    c = base.chunks(spark, d).select("chunk_uid", outer_trimmed("paper_id").alias("paper_id"), "doc_id", "page_number", "chunk_index", "char_start", "char_end")
    again = c.join(_removed(spark, d, "papers"), paper_key("paper_id") == F.col("k"), "left_semi").withColumn("doc_id", F.sha1("doc_id")).withColumn("chunk_uid", F.lit(None).cast("string"))
    out = store.replace_versions(c, c.select("paper_id", "doc_id").distinct(), store.fill_chunk_uids(again))
    return out.groupBy("paper_id", "doc_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_uid").alias("least_uid"))


def stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors whose chunks are in the removal log, in documents that still have others."""
    c = base.chunks(spark, d).select("chunk_uid", "doc_id")
    left = c.join(_removed(spark, d, "chunks"), chunk_key("chunk_uid") == F.col("k"), "left_anti")
    return store.stale(c, left).select("doc_id", "chunk_uid")


def vector_counts(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors of every document, and in all."""
    c = base.chunks(spark, d)
    return store.counts_per_document(c, c.where(F.col("embedding").isNotNull()).select("doc_id", "chunk_uid"))


def load_by_uid(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved chunks of every logged query, in their order; those that aren't there are left out."""
    log = table(spark, d, "query_log").select("query_id", F.posexplode("retrieved_chunks").alias("i", "chunk_uid")).distinct()
    return log.join(base.chunks(spark, d).select("chunk_uid", "chunk_id", "page_number"), "chunk_uid").select("query_id", (F.col("i") + 1).alias("rank"), "chunk_uid", "chunk_id", "page_number")


def pages_by_paper(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every known paper; those without chunks have none."""
    pages = base.chunks(spark, d).groupBy(paper_key("paper_id").alias("k")).agg(F.array_sort(F.collect_set("page_number")).alias("pages"))
    p = base.papers(spark, d).select("paper_id")
    return p.join(pages, paper_key("paper_id") == F.col("k"), "left").select("paper_id", F.coalesce(F.size("pages"), F.lit(0)).alias("n"), F.coalesce(F.array_join("pages", ","), F.lit("")).alias("pages"))


def uids_by_page(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every page that an eval item names, identifiers compared as they are."""
    z = base.items(spark, d).select(F.explode(F.arrays_zip(F.col("ground_truth.papers").alias("p"), F.col("ground_truth.pages").alias("g"))).alias("z"))
    asked = z.select(F.col("z.p").alias("paper_id"), F.explode("z.g").alias("page_number")).distinct()
    uids = base.chunks(spark, d).groupBy("paper_id", "page_number").agg(F.array_join(F.array_sort(F.collect_list("chunk_uid")), ",").alias("uids"))
    return asked.join(uids, ["paper_id", "page_number"], "left").select("paper_id", "page_number", F.coalesce("uids", F.lit("")).alias("uids"))


def chunk_titles(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with the title of its paper, if that is known."""
    titles = base.papers(spark, d).select(paper_key("paper_id").alias("k"), "title")
    return base.chunks(spark, d).join(titles, paper_key("paper_id") == F.col("k"), "left").select("chunk_id", "title")


def pending_papers(spark: SparkSession, d: str) -> DataFrame:
    """Base identifiers that chunks name and papers lack."""
    asked = base.chunks(spark, d).select(base_id(outer_trimmed("paper_id")).alias("paper_id")).distinct()
    return asked.join(base.papers(spark, d).select("paper_id"), "paper_id", "left_anti")


def path_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The paper of every path that chunks would come from."""
    stored = base.papers(spark, d).select("paper_id", F.concat(F.lit("/store/"), F.translate("paper_id", "/", "_"), F.lit(".pdf")).alias("pdf_path"))
    raw = base.chunks(spark, d).select(base_id(outer_trimmed("paper_id")).alias("p"), "page_number").distinct()
    paths = raw.select(F.concat(F.when(F.col("page_number") % 2 == 0, "/store/").otherwise("/elsewhere/"), F.translate("p", "/", "_"), F.lit(".pdf")).alias("path")).distinct()
    return store.matched_papers(paths, stored)


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The document of every paper that was harvested last; of equal times the least id."""
    docs = table(spark, d, "documents").where("paper_id is not null").select(paper_key("paper_id").alias("paper"), "doc_id", "harvested_at")
    return store.latest(docs, ["paper"], [F.desc_nulls_last("harvested_at"), "doc_id"]).select("paper", "doc_id")


def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    """How many papers, documents, chunks and vectors there are, and how many lack what the next stage needs."""
    c, p = base.chunks(spark, d), base.papers(spark, d)
    docs = table(spark, d, "documents")
    stages = [
        p.groupBy(F.lit("papers").alias("stage"), F.when(F.col("total_pages").isNull(), "unparsed").otherwise("parsed").alias("status")),
        docs.groupBy(F.lit("documents").alias("stage"), F.when(F.coalesce(outer_trimmed("text"), F.lit("")) == "", "blank").otherwise("text").alias("status")),
        c.groupBy(F.lit("chunks").alias("stage"), F.when(F.col("token_count").isNull(), "uncounted").otherwise("counted").alias("status")),
        c.groupBy(F.lit("vectors").alias("stage"), F.when(F.col("embedding").isNull(), "missing").otherwise("embedded").alias("status")),
    ]
    out = [s.agg(F.count("*").alias("n")) for s in stages]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def sample(spark: SparkSession, d: str) -> DataFrame:
    """A hundred documents drawn by seed 0."""
    return seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct logged questions, and whether the eval set's would answer them from a cache."""
    cache = base.items(spark, d).select(F.col("query").alias("query_text")).distinct()
    asked = table(spark, d, "query_log").select("query_text").distinct()
    return store.cached(asked, cache, ["query_text"])


def token_batches(spark: SparkSession, d: str) -> DataFrame:
    """Request batches of every document's chunks, of up to 500 tokens."""
    return providers.assign_batches(base.chunks(spark, d), "doc_id", "chunk_id", "token_count", 500, 500)


def query_log_rows(spark: SparkSession, d: str) -> DataFrame:
    """Log rows as they are appended."""
    rows = store.query_log_rows(table(spark, d, "query_log").select("query_id", "query_text", "retrieved_chunks", "model"))
    return rows.distinct()


_PAPER = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '^([0-9]{{4}}\.[0-9]{{4,5}}|[a-z-]+(?:\.[a-z]{{2}})?/[0-9]{{7}})v[0-9]+$', '\1')"
_CHUNK = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_BASE = r"regexp_replace(regexp_replace(regexp_replace(paper_id, '^\s+|\s+$', '', 'g'), '^(\d{4}\.\d{4,5})v\d+$', '\1'), '(?i)^([a-z-]+(?:\.[A-Z]{2})?/\d{7})v\d+$', '\1')"
_TRIMMED = r"regexp_replace(paper_id, '^\s+|\s+$', '', 'g')"
SQL = {
    "papers_upsert": """WITH f AS (SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY indexed_at NULLS FIRST, title NULLS FIRST, doc_id NULLS FIRST, source_type NULLS FIRST) = 1),
      l AS (SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY indexed_at DESC NULLS LAST, title DESC NULLS LAST, doc_id DESC NULLS LAST, source_type DESC NULLS LAST) = 1)
      SELECT f.paper_id, f.doc_id, l.title, l.source_type, l.indexed_at FROM f JOIN l ON f.paper_id = l.paper_id""",
    "versioned_replace": f"""WITH {base.SQL_CHUNKS}, r AS (SELECT DISTINCT {_PAPER.format('target_key')} AS k FROM removal_log WHERE target_table = 'papers'),
      c AS (SELECT *, {_TRIMMED} AS p, {_PAPER.format('paper_id')} IN (SELECT k FROM r) AS again FROM uchunks),
      n AS (SELECT p AS paper_id, CASE WHEN again THEN sha1(doc_id) ELSE doc_id END AS doc_id, CASE WHEN again THEN sha1(concat_ws(':', sha1(doc_id), page_number, chunk_index, coalesce(char_start, -1), coalesce(char_end, -1))) ELSE chunk_uid END AS u FROM c)
      SELECT paper_id, doc_id, count(*) AS n_chunks, min(u) AS least_uid FROM n GROUP BY ALL""",
    "stale_vectors": f"""WITH {base.SQL_CHUNKS}, r AS (SELECT DISTINCT {_CHUNK.format('target_key')} AS k FROM removal_log WHERE target_table = 'chunks'), m AS (SELECT doc_id, chunk_uid, {_CHUNK.format('chunk_uid')} IN (SELECT k FROM r) AS gone FROM uchunks)
      SELECT doc_id, chunk_uid FROM m WHERE gone AND doc_id IN (SELECT doc_id FROM m WHERE NOT gone)""",
    "vector_counts": f"WITH {base.SQL_CHUNKS} SELECT coalesce(doc_id, 'TOTAL') AS doc_id, count(embedding) AS n FROM uchunks GROUP BY ROLLUP (doc_id)",
    "load_by_uid": f"WITH {base.SQL_CHUNKS}, l AS (SELECT DISTINCT query_id, uid, i FROM (SELECT query_id, unnest(retrieved_chunks) AS uid, unnest(range(len(retrieved_chunks))) AS i FROM query_log)) SELECT query_id, i + 1 AS rank, chunk_uid, chunk_id, page_number FROM l JOIN uchunks c ON l.uid = c.chunk_uid",
    "pages_by_paper": f"WITH {base.SQL_CHUNKS}, {base.SQL_PAPERS}, g AS (SELECT DISTINCT {_PAPER.format('paper_id')} AS k, page_number FROM uchunks), a AS (SELECT k, count(*) AS n, string_agg(page_number, ',' ORDER BY page_number) AS pages FROM g GROUP BY 1) SELECT paper_id, coalesce(n, 0) AS n, coalesce(pages, '') AS pages FROM upapers LEFT JOIN a ON {_PAPER.format('paper_id')} = a.k",
    "uids_by_page": f"WITH {base.SQL_CHUNKS}, {base.SQL_ITEMS}, z AS (SELECT unnest(ground_truth.papers) AS paper_id, unnest(ground_truth.pages) AS g FROM items), a AS (SELECT DISTINCT paper_id, unnest(g) AS page_number FROM z) SELECT a.paper_id, a.page_number, coalesce(string_agg(chunk_uid, ',' ORDER BY chunk_uid), '') AS uids FROM a LEFT JOIN uchunks c ON a.paper_id = c.paper_id AND a.page_number = c.page_number GROUP BY ALL",
    "chunk_titles": f"WITH {base.SQL_CHUNKS}, {base.SQL_PAPERS} SELECT chunk_id, p.title FROM uchunks c LEFT JOIN upapers p ON {_PAPER.format('c.paper_id')} = {_PAPER.format('p.paper_id')}",
    "pending_papers": f"SELECT DISTINCT {_BASE} AS paper_id FROM chunks WHERE {_BASE} NOT IN (SELECT paper_id FROM papers)",
    "path_lookup": f"""WITH n AS (SELECT DISTINCT {_BASE} AS p, page_number FROM chunks), s AS (SELECT DISTINCT CASE WHEN page_number % 2 = 0 THEN '/store/' ELSE '/elsewhere/' END || replace(p, '/', '_') || '.pdf' AS path, replace(p, '/', '_') AS stem FROM n),
      k AS (SELECT DISTINCT paper_id, replace(paper_id, '/', '_') AS stem FROM papers) SELECT path, coalesce(k.paper_id, s.stem) AS paper_id, CASE WHEN k.paper_id IS NULL THEN 'stem' WHEN path LIKE '/store/%' THEN 'path' ELSE 'name' END AS how FROM s LEFT JOIN k ON s.stem = k.stem""",
    "latest_version": f"WITH x AS (SELECT {_PAPER.format('paper_id')} AS paper, doc_id, harvested_at FROM documents WHERE paper_id IS NOT NULL) SELECT paper, doc_id FROM x QUALIFY row_number() OVER (PARTITION BY paper ORDER BY harvested_at DESC NULLS LAST, doc_id) = 1",
    "ingest_summary": rf"""WITH {base.SQL_CHUNKS}, {base.SQL_PAPERS}
      SELECT 'papers' AS stage, CASE WHEN total_pages IS NULL THEN 'unparsed' ELSE 'parsed' END AS status, count(*) AS n FROM upapers GROUP BY ALL
      UNION ALL SELECT 'documents', CASE WHEN coalesce(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '') = '' THEN 'blank' ELSE 'text' END AS status, count(*) FROM documents GROUP BY ALL
      UNION ALL SELECT 'chunks', CASE WHEN token_count IS NULL THEN 'uncounted' ELSE 'counted' END AS status, count(*) FROM uchunks GROUP BY ALL
      UNION ALL SELECT 'vectors', CASE WHEN embedding IS NULL THEN 'missing' ELSE 'embedded' END AS status, count(*) FROM uchunks GROUP BY ALL""",
    "sample": "SELECT doc_id FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 100",
    "cache_lookup": f"WITH {base.SQL_ITEMS} SELECT DISTINCT query_text, query_text IN (SELECT query FROM items WHERE query IS NOT NULL) AS hit FROM query_log",
    "token_batches": f"""WITH RECURSIVE {base.SQL_CHUNKS}, o AS (SELECT doc_id, chunk_id, coalesce(token_count, 0) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS i FROM uchunks),
      b AS (SELECT doc_id, chunk_id, i, CAST(0 AS BIGINT) AS batch_id, CAST(c AS BIGINT) AS t FROM o WHERE i = 1
        UNION ALL SELECT o.doc_id, o.chunk_id, o.i, CASE WHEN b.t + o.c > 500 THEN b.batch_id + 1 ELSE b.batch_id END, CASE WHEN b.t + o.c > 500 THEN o.c ELSE b.t + o.c END FROM b JOIN o ON o.doc_id = b.doc_id AND o.i = b.i + 1)
      SELECT doc_id, chunk_id, batch_id FROM b""",
    "query_log_rows": "SELECT DISTINCT query_id, query_text, CAST(to_json(retrieved_chunks) AS VARCHAR) AS retrieved_chunks, model FROM query_log",
}
QUERIES = {
    "papers_upsert": papers_upsert,
    "versioned_replace": versioned_replace,
    "stale_vectors": stale_vectors,
    "vector_counts": vector_counts,
    "load_by_uid": load_by_uid,
    "pages_by_paper": pages_by_paper,
    "uids_by_page": uids_by_page,
    "chunk_titles": chunk_titles,
    "pending_papers": pending_papers,
    "path_lookup": path_lookup,
    "latest_version": latest_version,
    "ingest_summary": ingest_summary,
    "sample": sample,
    "cache_lookup": cache_lookup,
    "token_batches": token_batches,
    "query_log_rows": query_log_rows,
}
