"""Streams of parsed pages, metadata and log rows into the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperweir.engine import Engine
from paperweir.operators.chunking import ChunkConfig
from paperweir.operators.store import latest


def reindex_stream(engine: Engine, pages: DataFrame, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Pages (`paper_id, doc_id, path, page, text, warning, error, seen`) as they come: the last document of a paper wins
    within a batch, chunks are replaced by version and only touched documents are embedded anew. A batch that comes again
    changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        last = latest(batch.select("paper_id", "doc_id", "seen").distinct(), ["paper_id"], [F.desc_nulls_last("seen"), "doc_id"])
        rows = batch.join(last.select("paper_id", "doc_id"), ["paper_id", "doc_id"], "left_semi")
        engine.ingest(rows, config, (checkpoint, number))
        engine.index()

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_stream(engine: Engine, rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Log rows (`query_text, retrieved_chunks, answer, latency_ms, model`) as they come, each batch once."""
    return rows.writeStream.foreachBatch(lambda batch, number: engine.log(batch, (checkpoint, number))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(rows: DataFrame, at: str = "logged_at", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Logged queries and their mean latency in windows of time, as a watermarked aggregate of a stream or a table."""
    w = rows.withWatermark(at, late) if rows.isStreaming else rows
    return w.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms")).select(F.col("w.start").alias("from_time"), "n", "latency_ms")
