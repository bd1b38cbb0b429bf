"""Remote paper services behind small interfaces; nothing here needs a network until a client is given."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions.ids import base_id

# Orders that a search can have.
SORTS = ("relevance", "submittedDate", "lastUpdatedDate")
PAPER_ROWS = "paper_id string, title string, authors array<string>, abstract string, categories array<string>, published_date date"


@dataclass(frozen=True)
class FetchConfig:
    """Where PDFs go and how patient a client is."""

    folder: str
    delay_seconds: float = 10.0
    retries: int = 3
    timeout_seconds: float = 30.0
    user_agent: str = "paperweir"


class PaperClient(Protocol):
    """Metadata of papers, as dicts with the columns of PAPER_ROWS; identifiers may have versions."""

    def search(self, query: str, max_results: int, sort: str) -> Iterable[dict]: ...

    def fetch(self, ids: list[str]) -> Iterable[dict]: ...


class Response(Protocol):
    """What a fetcher gives: a status, headers and the body in parts."""

    status: int
    headers: dict[str, str]

    def parts(self) -> Iterable[bytes]: ...


class _Reply:
    """A reply of urllib as a Response."""

    def __init__(self, status: int, headers: dict[str, str], body) -> None:
        self.status, self.headers, self.body = status, headers, body

    def parts(self) -> Iterable[bytes]:
        """The body in pieces."""
        while piece := self.body.read(1 << 16):
            yield piece


def url_fetcher(config: FetchConfig, address: Callable[[str], str]) -> Callable[[str], Response]:
    """A fetcher that asks `address(identifier)` with the timeout and user agent of the settings."""

    def get(one: str) -> Response:
        request = urllib.request.Request(address(one), headers={"User-Agent": config.user_agent})
        try:
            reply = urllib.request.urlopen(request, timeout=config.timeout_seconds)  # noqa: S310
        except urllib.error.HTTPError as e:
            return _Reply(e.code, dict(e.headers), e)
        return _Reply(reply.status, dict(reply.headers), reply)

    return get


def search(spark: SparkSession, client: PaperClient, query: str, max_results: int = 10, sort: str = "relevance") -> DataFrame:
    """Found papers under their base identifiers."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    rows = [[r.get(c) for c in ("paper_id", "title", "authors", "abstract", "categories", "published_date")] for r in client.search(query, max_results, sort)]
    return spark.createDataFrame(rows, PAPER_ROWS).withColumn("paper_id", base_id("paper_id"))


def metadata(spark: SparkSession, client: PaperClient, ids: list[str]) -> DataFrame:
    """Papers of the identifiers, each once."""
    rows = [[r.get(c) for c in ("paper_id", "title", "authors", "abstract", "categories", "published_date")] for r in client.fetch(list(dict.fromkeys(ids)))]
    return spark.createDataFrame(rows, PAPER_ROWS).withColumn("paper_id", base_id("paper_id")).dropDuplicates(["paper_id"])


def download(config: FetchConfig, ids: list[str], get: Callable[[str], Response], wait: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Fetches PDFs into the folder: identifier to `exists`, `fetched` or what went wrong.

    One at a time, with `delay_seconds` between two, since services ask for it. A file is written as `.part` and renamed when whole; a service that asks for patience (429) gets what its
    Retry-After says, other failures 1, 2, 4 ... seconds.
    """
    Path(config.folder).mkdir(parents=True, exist_ok=True)
    out: dict[str, str] = {}
    asked = False
    for one in dict.fromkeys(ids):
        target = Path(config.folder) / f"{one.replace('/', '_')}.pdf"
        if target.exists():
            out[one] = "exists"
            continue
        if asked and config.delay_seconds > 0:
            wait(config.delay_seconds)
        asked = True
        part = target.with_suffix(".part")
        for attempt in range(config.retries + 1):
            pause = float(2**attempt)
            try:
                r = get(one)
                if r.status == 200:
                    with part.open("wb") as f:
                        for chunk in r.parts():
                            f.write(chunk)
                    os.replace(part, target)
                    out[one] = "fetched"
                    break
                out[one] = f"HTTP {r.status}"
                if r.status == 429:
                    asked = r.headers.get("Retry-After", "")
                    pause = float(asked) if asked.isdigit() else pause
                elif r.status < 500:
                    break
            except OSError as e:
                out[one] = str(e)
            finally:
                part.unlink(missing_ok=True)
            if attempt < config.retries:
                wait(pause)
    return out


def pending(spark: SparkSession, ids: list[str], existing: DataFrame) -> DataFrame:
    """`pos, paper_id` of the identifiers that `existing` (`paper_id`) lacks, in their order."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(ids))], "pos int, paper_id string")
    return rows.join(existing.select("paper_id").distinct(), "paper_id", "left_anti").select("pos", "paper_id").orderBy(F.col("pos"))
