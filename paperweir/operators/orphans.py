"""References to records that do not exist, as keyed state that is kept up to date.

The state is an index of parents (one entry for each key: when it first came, whether it is there, whether it
was ever removed) and every reference with its judgement: null where the parent is there, else the kind of orphan.
Both are stored as layers of written files, of which the newest row of a key holds. A step adds one layer with
what changed: new references probe the index, parents that arrive resolve what waits for them, departures reopen
what was resolved, and so does the first time that a parent without one gets. Only entries of keys that the step
names, and references of keys whose entry changed, are looked up; files are divided by a hash of the key into
`parts`, so a small step reads few of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions.ids import chunk_key, outer_trimmed, paper_key
from paperweir.operators.skew import key_counts, salted_join
from paperweir.session import cut, drop_cut, read_text, remove, scratch, scratch_path, write_text

REF_COLUMNS = ["source_table", "source_key", "ref_key", "target", "key", "ref_time"]
REFS = "source_table string, source_key string, ref_key string, target string, key string, ref_time timestamp_ntz"
PARENTS = "target string, key string, first_seen timestamp_ntz, present boolean, removed boolean"
KEY = ["target", "key"]
#: Layers from which a stream writes them together.
LAYERS = 16
_ENTRY = ["first_seen", "present", "removed"]
_STORED = {"parents": f"{PARENTS}, seq int, part int", "refs": f"{REFS}, orphan_kind string, seq int, part int", "moved": f"{REFS}, orphan_kind string, seq int, part int"}


def empty_refs(spark: SparkSession) -> DataFrame:
    """References, none."""
    return spark.createDataFrame([], REFS)


def empty_parents(spark: SparkSession) -> DataFrame:
    """Index entries, none."""
    return spark.createDataFrame([], PARENTS)


@dataclass(frozen=True)
class OrphanState:
    """State between steps: names of written layers in the folder `at`, so a lost executor or driver costs nothing.

    `parents` holds changed entries, `refs` new references with their first judgement, `moved` references that were
    judged anew. `batch` is the last micro-batch that went in.
    """

    spark: SparkSession
    at: str
    parts: int = 1
    seq: int = 0
    batch: int = -1
    layers: dict[str, list[str]] = field(default_factory=lambda: {"parents": [], "refs": [], "moved": []})

    @classmethod
    def start(cls, spark: SparkSession, at: str | None = None, parts: int = 1) -> OrphanState:
        """The state before any step, in a folder of its own below spark.checkpoint.dir if none is named."""
        return cls(spark, at or scratch_path(spark, "orphans"), parts)

    @classmethod
    def load(cls, spark: SparkSession, at: str, parts: int = 1) -> OrphanState:
        """The state that was saved last in `at`, or the one before any step."""
        saved = read_text(spark, f"{at}/current.json")
        return cls(spark, at, **json.loads(saved)) if saved else cls.start(spark, at, parts)

    def save(self) -> None:
        """Makes this the state that `load` finds; the file is replaced as a whole."""
        write_text(self.spark, f"{self.at}/current.json", json.dumps({"parts": self.parts, "seq": self.seq, "batch": self.batch, "layers": self.layers}))

    def stored(self, name: str) -> DataFrame:
        """All layers of a table, with `seq` of the step that wrote a row."""
        paths = [f"{self.at}/{p}" for p in self.layers[name]]
        read = self.spark.read.schema(_STORED[name])
        return read.option("basePath", f"{self.at}/{name}").parquet(*paths) if paths else self.spark.createDataFrame([], _STORED[name])

    def lookup(self, names: list[str], keys: DataFrame) -> DataFrame:
        """Rows of some tables whose key is in `keys` (each once), from the parts that hold such keys."""
        rows = self.stored(names[0])
        for n in names[1:]:
            rows = rows.unionByName(self.stored(n))
        if self.parts > 1:
            touched = [r[0] for r in keys.select(_part(self.parts).alias("part")).distinct().collect()]  # at most `parts` numbers
            rows = rows.where(F.col("part").isin(touched))
        return rows.drop("part").join(keys.select(*KEY), KEY, "left_semi")

    def put(self, name: str, df: DataFrame, seq: int) -> str:
        """Writes the layer of a step; a step that is repeated overwrites its own."""
        layer = f"{name}/seq={seq}"
        df.withColumn("part", _part(self.parts)).write.mode("overwrite").partitionBy("part").parquet(f"{self.at}/{layer}")
        return layer

    def waiting(self) -> DataFrame:
        """The references that are orphans now, with `orphan_kind`."""
        moved = self.stored("moved")
        rows = self.stored("refs").unionByName(moved).where("orphan_kind is not null")
        if not self.layers["moved"]:
            return rows.select(*REF_COLUMNS, "orphan_kind")
        last = moved.groupBy(*REF_COLUMNS).agg(F.max("seq").alias("last")).select(*(F.col(c).alias(f"m_{c}") for c in REF_COLUMNS), "last")
        same = F.lit(True)
        for c in REF_COLUMNS:
            same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
        return rows.join(last, same, "left").where(F.col("last").isNull() | (F.col("seq") >= F.col("last"))).select(*REF_COLUMNS, "orphan_kind")

    def orphans(self) -> DataFrame:
        """The references that wait: `source_table, source_key, ref_key, ref_month, orphan_kind`."""
        month = F.coalesce(F.date_format("ref_time", "yyyy-MM"), F.lit("unknown"))
        return self.waiting().select("source_table", "source_key", "ref_key", month.alias("ref_month"), "orphan_kind").distinct()

    def counts(self) -> DataFrame:
        """Snapshot of the number of orphan references by table, month and kind."""
        return self.orphans().groupBy("source_table", "ref_month", "orphan_kind").agg(F.count("*").alias("n_refs"))

    def compacted(self) -> tuple[OrphanState, list[str]]:
        """The same state in one layer of each table, and the names of the layers that it replaces."""
        seq = self.seq + 1
        refs = self.stored("refs").unionByName(self.stored("moved")).groupBy(*REF_COLUMNS).agg(F.max(F.struct("seq", "orphan_kind")).alias("l")).select(*REF_COLUMNS, "l.orphan_kind")
        layers = {"parents": [self.put("parents", _last_entry(self.stored("parents")), seq)], "refs": [self.put("refs", refs, seq)], "moved": []}
        return replace(self, seq=seq, layers=layers), [p for v in self.layers.values() for p in v]


def _part(parts: int) -> F.Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(parts)).cast("int")


def _last_entry(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max(F.struct("seq", *_ENTRY)).alias("l")).select(*KEY, *(F.col(f"l.{c}") for c in _ENTRY))


def arrivals(df: DataFrame, target: str, key, seen: str) -> DataFrame:
    """Index entries of records that came."""
    return df.select(F.lit(target).alias("target"), key.alias("key"), F.col(seen).cast("timestamp_ntz").alias("first_seen"), F.lit(True).alias("present"), F.lit(False).alias("removed")).where(F.col("key").isNotNull())


def removals(df: DataFrame, table: str, key: str) -> DataFrame:
    """Index entries of keys in a log of removals, whenever that was. They do not take a present record away."""
    norm = F.when(F.col(table) == "papers", paper_key(key)).when(F.col(table) == "chunks", chunk_key(key))
    return df.select(F.col(table).alias("target"), norm.alias("key"), F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit(False).alias("present"), F.lit(True).alias("removed")).where(F.col("key").isNotNull())


def _kind() -> F.Column:
    there = F.coalesce("present", F.lit(False))
    return F.when(there & (F.col("first_seen") > F.col("ref_time")), "late").when(there, None).when(F.coalesce("removed", F.lit(False)), "deleted").otherwise("missing")


def _changed_entries(state: OrphanState, came: DataFrame | None, left: DataFrame | None) -> DataFrame:
    """Entries of the keys that came or left as they are after it, but for those that stay as they were."""
    parts = []
    if came is not None:
        parts.append(came.select(*KEY, *_ENTRY, F.lit(False).alias("gone")))
    if left is not None:
        parts.append(left.select(*KEY, F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit(False).alias("present"), F.lit(True).alias("removed"), F.lit(True).alias("gone")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    now = every.groupBy(*KEY).agg(F.min("first_seen").alias("first_seen"), F.bool_or("present").alias("present"), F.bool_or("removed").alias("removed"), F.bool_or("gone").alias("gone"))
    if not state.layers["parents"]:
        return now.drop("gone")
    now = cut(now, "came")
    old = _last_entry(state.lookup(["parents"], now)).select(*KEY, *(F.col(c).alias(f"old_{c}") for c in _ENTRY))
    both = now.join(old, KEY, "left")
    seen = F.when(F.col("gone"), F.col("first_seen")).otherwise(F.least("first_seen", "old_first_seen"))
    there = F.col("present") | F.coalesce("old_present", F.lit(False)) & ~F.col("gone")
    after = both.select(*KEY, seen.alias("first_seen"), there.alias("present"), (F.col("removed") | F.coalesce("old_removed", F.lit(False))).alias("removed"), "old_first_seen", "old_present", "old_removed")
    same = F.col("present").eqNullSafe(F.col("old_present")) & F.col("removed").eqNullSafe(F.col("old_removed")) & F.col("first_seen").eqNullSafe(F.col("old_first_seen"))
    return after.where(~same).select(*KEY, *_ENTRY)


@scratch()
def step(state: OrphanState, refs: DataFrame | None = None, came: DataFrame | None = None, left: DataFrame | None = None) -> OrphanState:
    """The state after new references (REFS), index entries that came (PARENTS) and keys that left (`target, key`).

    Any of them may be None or empty. A key that left and is not among those that came is marked as removed, and what
    it had resolved waits again, and so does what a key resolved before its first time came. References that are
    repeated count once. Null keys and blank references are for the caller to leave out.
    """
    seq = state.seq + 1
    layers = {k: list(v) for k, v in state.layers.items()}
    if came is not None or left is not None:
        entries = _changed_entries(state, came, left)
        layers["parents"].append(state.put("parents", entries, seq))
        if state.layers["refs"]:
            entries = replace(state, layers=layers).stored("parents").where(F.col("seq") == seq).select(*KEY, *_ENTRY)
            known = state.lookup(["refs", "moved"], entries).groupBy(*REF_COLUMNS).agg(F.max(F.struct("seq", "orphan_kind")).alias("l")).select(*REF_COLUMNS, F.col("l.orphan_kind").alias("was"))
            judged = salted_join(cut(known, "known"), entries, KEY).select(*REF_COLUMNS, "was", _kind().alias("orphan_kind"))
            layers["moved"].append(state.put("moved", judged.where(~F.col("was").eqNullSafe(F.col("orphan_kind"))).drop("was"), seq))
    after = replace(state, seq=seq, layers=layers)
    if refs is not None:
        counts = key_counts(refs, KEY)
        index = _last_entry(after.lookup(["parents"], counts))
        judged = salted_join(refs.select(*REF_COLUMNS), index, KEY, "left", counts=counts)
        layers["refs"].append(after.put("refs", judged.select(*REF_COLUMNS, _kind().alias("orphan_kind")), seq))
    return after


def project_refs(chunks: DataFrame, query_log: DataFrame, eval_set: DataFrame) -> DataFrame:
    """The references of the project's tables. Null and blank entries are none."""

    def rows(df: DataFrame, table: str, key: str, ref: str | F.Column, target: str, norm, at: str) -> DataFrame:
        taken = df.select(F.lit(table).alias("source_table"), F.col(key).cast("string").alias("source_key"), ref.alias("ref_key"), F.lit(target).alias("target"), F.col(at).cast("timestamp_ntz").alias("ref_time"))
        taken = taken.where(F.col("ref_key").isNotNull() & (outer_trimmed("ref_key") != ""))
        return taken.withColumn("key", norm("ref_key")).select(*REF_COLUMNS)

    return (
        rows(chunks, "chunks", "chunk_id", F.col("paper_id"), "papers", paper_key, "ingested_at")
        .unionByName(rows(query_log, "query_log", "query_id", F.explode("retrieved_chunks"), "chunks", chunk_key, "logged_at"))
        .unionByName(rows(eval_set, "eval_set", "query_id", F.explode("ground_truth.chunk_uids"), "chunks", chunk_key, "created_at"))
    )


def track(refs: DataFrame, came: DataFrame, periods: list[str]) -> Iterator[tuple[str, OrphanState]]:
    """The state after everything before each of `periods` (timestamps, ascending) and after the rest ("end"), in steps.

    References step in by their own time and entries by the time they were first seen; those without a time
    step in first. The last state is that of a single step, since the state is complete after each.
    """
    state = OrphanState.start(refs.sparkSession)
    refs, came = cut(refs, "refs"), cut(came, "came")  # keys are worked out once
    bounds = [None, *periods, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):

        def within(col: str, lo=lo, hi=hi) -> F.Column:
            at = F.col(col)
            test = F.lit(True)
            if lo is not None:
                test = test & (at >= F.lit(lo).cast("timestamp_ntz"))
            if hi is not None:
                test = test & (at < F.lit(hi).cast("timestamp_ntz"))
            return F.coalesce(test, F.lit(lo is None))

        state = step(state, refs.where(within("ref_time")), came.where(within("first_seen")))
        yield hi or "end", state
    drop_cut(refs)
    drop_cut(came)


def last_state(refs: DataFrame, came: DataFrame, periods: list[str]) -> OrphanState:
    """The state after all steps of `track`."""
    *_, (_, state) = track(refs, came, periods)
    return state


def drop_layers(state: OrphanState, names: list[str]) -> None:
    """Removes layers that no saved state names any more."""
    for n in names:
        remove(state.spark, f"{state.at}/{n}")
