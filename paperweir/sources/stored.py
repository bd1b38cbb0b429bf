"""Stored tables: Parquet files divided by a hash of a key, and a manifest that says which of them count.

A change writes the parts that it touches beside the old ones and then a manifest of the next number, which only
one writer can create; readers see one state or the other. An append adds files and reads nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir import schemas
from paperweir.session import create_text, list_names, read_text, remove

#: Manifests that stay, with the files that they name.
KEPT = 3


class StoredTable:
    """A table of `schema` in the folder `at`, divided by `key` into `parts`."""

    def __init__(self, spark: SparkSession, at: str, schema: str, key: str, parts: int = 16):
        self.spark, self.at, self.schema, self.key, self.parts = spark, at, schema, key, parts

    def _numbers(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in list_names(self.spark, self.at) if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self) -> dict:
        for n in reversed(self._numbers()):
            try:
                return json.loads(read_text(self.spark, f"{self.at}/manifest-{n:08d}.json") or "")
            except ValueError:  # a writer broke off within it
                continue
        return {"version": 0, "files": {}, "batches": {}}

    def version(self) -> int:
        """The number of changes so far."""
        return self._manifest()["version"]

    def part(self) -> Column:
        """The part of a row."""
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.parts)).cast("int")

    def parts_of(self, keys: DataFrame) -> list[int]:
        """The parts in which keys (a column named as the table's key) lie: at most `parts` numbers."""
        return [r[0] for r in keys.select(self.part().alias("part")).distinct().collect()]

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows, of some parts only if these are given."""
        files = self._manifest()["files"]
        paths = [f"{self.at}/{f}" for p, fs in files.items() if parts is None or int(p) in parts for f in fs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(f"{self.schema}, change int, part int").option("basePath", self.at).parquet(*paths).drop("change", "part")

    def row_id(self) -> Column:
        """Numbers for the rows of the next change that no other change gives: its number, the task and the row in it."""
        row = F.monotonically_increasing_id()
        return F.lit(self.version() + 1) * F.lit(1 << 44) + F.shiftright(row, 33) * F.lit(1 << 28) + row.bitwiseAND(F.lit((1 << 28) - 1))

    def _write(self, rows: DataFrame, version: int) -> dict[str, list[str]]:
        folder = f"change={version}"
        remove(self.spark, f"{self.at}/{folder}")  # of a writer that broke off
        rows = schemas.conform(rows, self.schema).withColumn("part", self.part())
        rows.write.partitionBy("part").parquet(f"{self.at}/{folder}")
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in list_names(self.spark, f"{self.at}/{folder}") if n.startswith("part=")}

    def _commit(self, old: dict, files: dict, batch: tuple[str, int] | None) -> None:
        batches = old["batches"] | ({batch[0]: batch[1]} if batch else {})
        new = {"version": old["version"] + 1, "files": files, "batches": batches}
        if not create_text(self.spark, f"{self.at}/manifest-{new['version']:08d}.json", json.dumps(new)):
            raise RuntimeError(f"another writer changed {self.at}")
        numbers = self._numbers()
        keep = [json.loads(read_text(self.spark, f"{self.at}/manifest-{n:08d}.json") or "{}") for n in numbers[-KEPT:]]
        used = {f.split("/")[0] for m in keep for fs in m.get("files", {}).values() for f in fs}
        for n in numbers[:-KEPT]:
            remove(self.spark, f"{self.at}/manifest-{n:08d}.json")
        for name in list_names(self.spark, self.at):
            if name.startswith("change=") and name not in used and int(name[7:]) <= old["version"]:
                remove(self.spark, f"{self.at}/{name}")

    def done(self, batch: tuple[str, int] | None) -> bool:
        """Whether a batch `(stream, number)` is in the table already."""
        return batch is not None and self._manifest()["batches"].get(batch[0], -1) >= batch[1]

    def replace(self, rows: DataFrame, parts: list[int] | None = None, batch: tuple[str, int] | None = None) -> None:
        """`rows` in place of all rows, or of those of `parts`, in which all of them must lie."""
        if self.done(batch):
            return
        old = self._manifest()
        new = self._write(rows, old["version"] + 1)
        kept = {} if parts is None else {p: f for p, f in old["files"].items() if int(p) not in parts}
        self._commit(old, kept | new, batch)

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds rows; a batch `(stream, number)` that was added before adds nothing."""
        if self.done(batch):
            return
        old = self._manifest()
        new = self._write(rows, old["version"] + 1)
        files = {p: old["files"].get(p, []) + new.get(p, []) for p in old["files"].keys() | new.keys()}
        self._commit(old, files, batch)
