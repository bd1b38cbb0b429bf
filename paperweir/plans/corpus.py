"""Queries on orphan references (p1) and packed fields (p2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions.ids import chunk_key, paper_key
from paperweir.operators import orphans, packed
from paperweir.sources.tables import table

#: Ends of the steps in which p1 takes the tables in; any choice gives the same p1_found, and p1_snapshots counts after each.
PERIODS = ["2024-07-01 00:00:00", "2025-03-01 00:00:00"]


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "chunks").select("chunk_id", "chunk_uid", "paper_id", "ingested_at")
    refs = orphans.project_refs(chunks, table(spark, d, "query_log"), table(spark, d, "eval_set"))
    came = (
        orphans.arrivals(table(spark, d, "papers"), "papers", paper_key("paper_id"), "indexed_at")
        .unionByName(orphans.arrivals(chunks, "chunks", chunk_key("chunk_uid"), "ingested_at"))
        .unionByName(orphans.removals(table(spark, d, "removal_log"), "target_table", "target_key"))
    )
    return refs, came


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference whose target is missing, was removed or came in only later."""
    return orphans.last_state(*_inputs(spark, d), PERIODS).orphans()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of orphan references by table, month and kind."""
    return orphans.last_state(*_inputs(spark, d), PERIODS).counts()


def p1_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The counts as they stood after each step: `up_to` (the end of its period), then as p1_counts."""
    each = [state.counts().withColumn("up_to", F.lit(until)) for until, state in orphans.track(*_inputs(spark, d), PERIODS)]
    return reduce(DataFrame.unionByName, each)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Single authors and categories of every paper, with their place."""
    return p2_flags(spark, d).drop("flag")


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    """As p2_found, with what was malformed about a value."""
    return packed.unpack(table(spark, d, "papers"), "paper_id", {"authors": packed.AUTHORS, "categories": packed.CATEGORIES}).withColumnRenamed("key", "paper_id")


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PAPER = "regexp_replace(lower(" + _TRIM + r"), '^([0-9]{{4}}\.[0-9]{{4,5}}|[a-z-]+(?:\.[a-z]{{2}})?/[0-9]{{7}})v[0-9]+$', '\1')"
_CHUNK = "lower(" + _TRIM + ")"
P1_SQL = f"""
WITH refs AS (
  SELECT 'chunks' AS source_table, CAST(chunk_id AS VARCHAR) AS source_key, paper_id AS ref_key, 'papers' AS target, ingested_at AS t FROM chunks
  UNION ALL SELECT 'query_log', CAST(query_id AS VARCHAR), u, 'chunks', logged_at FROM (SELECT query_id, logged_at, unnest(retrieved_chunks) AS u FROM query_log)
  UNION ALL SELECT 'eval_set', query_id, u, 'chunks', created_at FROM (SELECT query_id, created_at, unnest(ground_truth.chunk_uids) AS u FROM eval_set)
), keyed AS (
  SELECT DISTINCT *, CASE target WHEN 'papers' THEN {_PAPER.format('ref_key')} ELSE {_CHUNK.format('ref_key')} END AS k
  FROM refs WHERE ref_key IS NOT NULL AND {_TRIM.format('ref_key')} <> ''
), parents AS (
  SELECT 'papers' AS target, {_PAPER.format('paper_id')} AS k, min(indexed_at) AS first_seen FROM papers WHERE paper_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'chunks', {_CHUNK.format('chunk_uid')}, min(ingested_at) FROM chunks WHERE chunk_uid IS NOT NULL GROUP BY 2
), gone AS (
  SELECT DISTINCT target_table AS target, CASE target_table WHEN 'papers' THEN {_PAPER.format('target_key')} ELSE {_CHUNK.format('target_key')} END AS k FROM removal_log
), judged AS (
  SELECT r.*, CASE WHEN p.k IS NOT NULL AND p.first_seen > r.t THEN 'late' WHEN p.k IS NOT NULL THEN NULL WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind
  FROM keyed r LEFT JOIN parents p ON r.target = p.target AND r.k = p.k LEFT JOIN gone g ON r.target = g.target AND r.k = g.k
), found AS (
  SELECT DISTINCT source_table, source_key, ref_key, coalesce(strftime(t, '%Y-%m'), 'unknown') AS ref_month, orphan_kind FROM judged WHERE orphan_kind IS NOT NULL
)
"""

# As above for what was known before the end of each period; what has no time was known from the start.
P1_SNAPSHOTS = f"""
WITH ends AS (SELECT * FROM (VALUES {", ".join(f"('{p}', TIMESTAMP '{p}')" for p in PERIODS)}, ('end', NULL)) v(up_to, before)),
refs AS (
  SELECT 'chunks' AS source_table, CAST(chunk_id AS VARCHAR) AS source_key, paper_id AS ref_key, 'papers' AS target, ingested_at AS t FROM chunks
  UNION ALL SELECT 'query_log', CAST(query_id AS VARCHAR), u, 'chunks', logged_at FROM (SELECT query_id, logged_at, unnest(retrieved_chunks) AS u FROM query_log)
  UNION ALL SELECT 'eval_set', query_id, u, 'chunks', created_at FROM (SELECT query_id, created_at, unnest(ground_truth.chunk_uids) AS u FROM eval_set)
), keyed AS (
  SELECT DISTINCT *, CASE target WHEN 'papers' THEN {_PAPER.format('ref_key')} ELSE {_CHUNK.format('ref_key')} END AS k
  FROM refs WHERE ref_key IS NOT NULL AND {_TRIM.format('ref_key')} <> ''
), seen AS (
  SELECT 'papers' AS target, {_PAPER.format('paper_id')} AS k, indexed_at AS came FROM papers WHERE paper_id IS NOT NULL
  UNION ALL SELECT 'chunks', {_CHUNK.format('chunk_uid')}, ingested_at FROM chunks WHERE chunk_uid IS NOT NULL
), parents AS (
  SELECT up_to, target, k, min(came) AS first_seen FROM seen, ends WHERE before IS NULL OR came IS NULL OR came < before GROUP BY ALL
), gone AS (
  SELECT DISTINCT target_table AS target, CASE target_table WHEN 'papers' THEN {_PAPER.format('target_key')} ELSE {_CHUNK.format('target_key')} END AS k FROM removal_log
), judged AS (
  SELECT e.up_to, r.*, CASE WHEN p.k IS NOT NULL AND p.first_seen > r.t THEN 'late' WHEN p.k IS NOT NULL THEN NULL WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind
  FROM keyed r JOIN ends e ON e.before IS NULL OR r.t IS NULL OR r.t < e.before
  LEFT JOIN parents p ON p.up_to = e.up_to AND r.target = p.target AND r.k = p.k LEFT JOIN gone g ON r.target = g.target AND r.k = g.k
)
SELECT up_to, source_table, ref_month, orphan_kind, count(*) AS n_refs FROM (
  SELECT DISTINCT up_to, source_table, source_key, ref_key, coalesce(strftime(t, '%Y-%m'), 'unknown') AS ref_month, orphan_kind FROM judged WHERE orphan_kind IS NOT NULL)
GROUP BY ALL
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_snapshots": p1_snapshots, "p2_found": p2_found, "p2_flags": p2_flags}
SQL = {
    "p1_found": P1_SQL + "SELECT * FROM found",
    "p1_snapshots": P1_SNAPSHOTS,
    "p1_counts": P1_SQL + "SELECT source_table, ref_month, orphan_kind, count(*) AS n_refs FROM found GROUP BY ALL",
}
