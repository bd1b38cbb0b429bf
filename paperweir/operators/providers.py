"""Models behind the engine: embedding and generation providers, run over Arrow batches.

A provider is an object with one method; it is built in the worker by a factory, so that clients are not
shipped. The stand-ins here are deterministic and need no network.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.operators.store import misses


class EmbeddingProvider(Protocol):
    """Vectors of texts, in their order."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class GenerationProvider(Protocol):
    """An answer to a prompt."""

    def generate(self, prompt: str, query: str) -> str: ...


class HashedWords:
    """A stand-in: words hashed into a vector of unit length; the first digits of a word's MD5 are its place, the ninth the sign."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            raise ValueError("inputs must not be empty")
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                out[i, int(h[:8], 16) % self.dim] += 1 if h[8] > "7" else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n == 0, 1, n)).tolist()


class FirstChunk:
    """A stand-in: answers with the first passage of the prompt that is cited there."""

    def generate(self, prompt: str, query: str) -> str:
        m = re.search(r"\[arXiv:\S+ p\.\d+\]", prompt)
        if not m:
            return "I do not know."
        words = prompt[m.end() :].split()[:8]
        return f"{query} {m.group()} *\"{' '.join(words)}\"*"


def available(factory: Callable) -> bool:
    """Whether a provider can be set up here; why not is for the caller to find out by doing it."""
    try:
        factory()
    except Exception:  # noqa: BLE001
        return False
    return True


def with_retries(call: Callable, attempts: int = 5, first_wait: float = 1.0, longest: float = 20.0, wait: Callable[[float], None] = time.sleep, retry_on: tuple = (Exception,)):
    """`call()` again after failures, with doubling, jittered waits; the last failure is raised."""
    for i in range(attempts):
        try:
            return call()
        except retry_on:
            if i == attempts - 1:
                raise
            wait(min(longest, first_wait * 2**i * (0.5 + random.random())))


def token_batches(counts: list[int], max_request: int = 32_000, max_input: int = 8_192, batch_size: int | None = None) -> list[int]:
    """The batch of each text, filled in order: one more token than `max_request` opens the next batch."""
    out, batch, total, size = [], 0, 0, 0
    for n in counts:
        if n > max_input or n > max_request:
            raise ValueError(f"a text of {n} tokens exceeds the limit")
        if batch_size is not None:
            if size and size >= batch_size:
                batch, total, size = batch + 1, 0, 0
            if total + n > max_request:
                raise ValueError(f"{batch_size} texts together have more than {max_request} tokens")
        elif size and total + n > max_request:
            batch, total, size = batch + 1, 0, 0
        out.append(batch)
        total, size = total + n, size + 1
    return out


def assign_batches(df: DataFrame, group: str, order: str, count: str, max_request: int = 32_000, max_input: int = 8_192) -> DataFrame:
    """`group, order, batch_id` of every row, filled greedily in `order` within each group; a null count is none.

    Filling is sequential, so the rows of a group go through one task, in order and a batch of them at a time: neither
    memory nor time grows faster than their number.
    """
    rows = df.select(group, order, F.coalesce(F.col(count), F.lit(0)).cast("long").alias("c")).repartition(group).sortWithinPartitions(group, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()
        b = total = size = 0
        for batch in batches:
            ids = []
            for g, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n > max_input or n > max_request:
                    raise ValueError(f"a text exceeds the token limit: {n}")
                if g != now:
                    now, b, total, size = g, 0, 0, 0
                elif size and total + n > max_request:
                    b, total, size = b + 1, 0, 0
                ids.append(b)
                total, size = total + n, size + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64())], [group, order, "batch_id"])

    kinds = [df.schema[c].dataType.simpleString() for c in (group, order)]
    return rows.mapInArrow(run, f"`{group}` {kinds[0]}, `{order}` {kinds[1]}, batch_id long")


def embed(df: DataFrame, key: str, text: str, factory: Callable[[], EmbeddingProvider], batch: int = 256) -> DataFrame:
    """`key, embedding` of every row; null and blank texts have a null vector. Failed batches are tried again."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            texts = b.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if t and t.strip()]
            vectors: list = [None] * len(texts)
            for lo in range(0, len(some), batch):
                part = some[lo : lo + batch]
                for i, v in zip(part, with_retries(lambda part=part: provider.embed([texts[i] for i in part]))):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<float>")


def embed_cached(df: DataFrame, key: str, text: str, cache: DataFrame, model: str, factory: Callable[[], EmbeddingProvider]) -> tuple[DataFrame, DataFrame]:
    """(vectors of all rows, entries new to the cache): each distinct text that the cache lacks is embedded once."""
    have = cache.where(F.col("embedding_model") == model).select(F.col("query_text").alias(text), "embedding")
    new = embed(misses(df.where(F.col(text).isNotNull()), have, [text]).withColumn("_t", F.col(text)), text, "_t", factory)
    every = have.withColumn("embedding", F.col("embedding").cast("array<float>")).unionByName(new)
    fresh = new.select(F.col(text).alias("query_text"), F.lit(model).alias("embedding_model"), F.col("embedding").cast("array<double>").alias("embedding"), F.current_timestamp().alias("created_at"))
    return df.join(every, text, "left").select(key, "embedding"), fresh


def generate(prompts: DataFrame, factory: Callable[[], GenerationProvider], key: str = "query_id", concurrency: int = 4) -> DataFrame:
    """`key, answer, error` of rows `key, prompt, query`; a failure is an error in its row, not of the job.

    `concurrency` is the number of partitions, and so of requests at a time.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            answers, errors = [], []
            for p, q in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    answers.append(with_retries(lambda p=p, q=q: provider.generate(p, q)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    answers.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], [key, "answer", "error"])

    return prompts.select(key, "prompt", "query").repartition(concurrency).mapInArrow(run, f"`{key}` {kind}, answer string, error string")


def answer_key(context: DataFrame, key: str = "query_id") -> DataFrame:
    """`key, chunk_uids_hash`: SHA-256 over the context's uids in their order."""
    w = F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_uid"))), lambda s: s["chunk_uid"])
    return context.groupBy(key).agg(F.sha2(F.array_join(w, "\n"), 256).alias("chunk_uids_hash"))



