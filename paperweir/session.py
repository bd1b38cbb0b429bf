"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "paperweir", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC. `master` and `conf` override the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


#: Tables that `cut` wrote and nobody removed yet.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor can read.

    Where the setting is absent in a local session, as in tests, it is set to a folder that goes with the process:
    driver and executors are one process then. On a cluster without the setting this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"paperweir-{os.getpid()}")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system that Spark knows; one that is not there is no error."""
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there, so that readers see the old text or the new."""
    at, fs = _fs(spark, path)
    new = _fs(spark, f"{path}.new")[0]
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that must not be there yet; False if it is."""
    at, fs = _fs(spark, path)
    try:
        out = fs.create(at, False)
    except Exception as e:
        if fs.exists(at):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    at, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or the one that was to take its place when the writer broke off; None without both."""
    for p in (path, f"{path}.new"):
        at, fs = _fs(spark, p)
        if fs.exists(at):
            stream = fs.open(at)
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
    return None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for what a query writes, which `scratch` removes."""
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back: lineage ends there and survives lost executors.

    The table lies beside Spark's own checkpoints; `drop_cut` removes it, and so does the end of `scratch`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", "lz4").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._paperweir_path = path
    return back


def drop_cut(df: DataFrame) -> None:
    """Removes the table that `cut` wrote for `df`."""
    path = getattr(df, "_paperweir_path", None)
    if path is not None and _written.pop(path, None) is not None:
        remove(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes at its end what `cut` wrote within: for callers that have written or counted the result by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            remove(_written.pop(path), path)
