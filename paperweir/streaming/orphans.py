"""Orphan references as a stream: each micro-batch is a step of the state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperweir.operators.orphans import LAYERS, OrphanState, drop_layers, step
from paperweir.session import cut, drop_cut

#: One stream of events: references, arrivals and departures.
EVENTS = "kind string, source_table string, source_key string, ref_key string, target string, key string, at timestamp_ntz"


class OrphanStream:
    """Keeps an OrphanState in the folder `at` from a stream of EVENTS (`kind` is reference, arrival, removal or departure).

    The state is saved with the number of its micro-batch after each of them and read again by every new object, so a
    driver that starts anew goes on from the last batch that was saved; a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, at: str, snapshot: Callable[[DataFrame, int], None] | None = None, every: int = 10, parts: int = 64):
        self.state, self.snapshot, self.every = OrphanState.load(spark, at, parts), snapshot, every

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch; every so many of them the counts are handed to `snapshot`."""
        if number <= self.state.batch:
            return
        keyed = cut(batch.where(F.col("key").isNotNull()), "batch")
        refs = keyed.where("kind = 'reference'").withColumnRenamed("at", "ref_time")
        came = keyed.where("kind in ('arrival', 'removal')").select("target", "key", F.when(F.col("kind") == "arrival", F.col("at")).alias("first_seen"), (F.col("kind") == "arrival").alias("present"), (F.col("kind") == "removal").alias("removed"))
        left = keyed.where("kind = 'departure'").select("target", "key")
        kinds = {r[0] for r in keyed.select("kind").distinct().collect()}
        after = step(self.state, refs if "reference" in kinds else None, came if kinds & {"arrival", "removal"} else None, left if "departure" in kinds else None)
        old: list[str] = []
        if max(map(len, after.layers.values())) > LAYERS:
            after, old = after.compacted()
        after = replace(after, batch=number)
        after.save()
        self.state = after
        drop_layers(after, old)
        drop_cut(keyed)
        if self.snapshot and number % self.every == 0:
            self.snapshot(after.counts(), number)

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over a streaming DataFrame of EVENTS until what is there has been read."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
