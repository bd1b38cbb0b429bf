"""Views of the project's tables that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.operators.store import latest
from paperweir.sources.tables import table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk once, under its least id."""
    return latest(table(spark, d, "chunks"), ["chunk_uid"], ["chunk_id"])


def papers(spark: SparkSession, d: str) -> DataFrame:
    """Each paper once, as last harvested."""
    return latest(table(spark, d, "papers"), ["paper_id"], [F.desc_nulls_last("indexed_at"), F.asc_nulls_last("title")])


def items(spark: SparkSession, d: str) -> DataFrame:
    """Each eval item once, with `truth`, the uids that are right."""
    return latest(table(spark, d, "eval_set"), ["query_id"], [F.asc_nulls_last("created_at"), "query"]).withColumn("truth", F.col("ground_truth.chunk_uids"))


SQL_CHUNKS = "uchunks AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_uid ORDER BY chunk_id) = 1)"
SQL_PAPERS = "upapers AS (SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY indexed_at DESC NULLS LAST, title ASC NULLS LAST) = 1)"
SQL_ITEMS = "items AS (SELECT *, ground_truth.chunk_uids AS truth FROM eval_set QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at ASC NULLS LAST, query) = 1)"
