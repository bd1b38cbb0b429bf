"""Files that the engine reads and writes: PDFs, parsed pages, lists of identifiers, eval sets, prompts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import resources
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir import schemas
from paperweir.functions.ids import base_id, is_base_id
from paperweir.operators.chunking import clean_pages, strip_repeated_lines

#: Extracts the pages of a PDF: bytes to (page texts, warnings); a page that can't be read is None.
Extractor = Callable[[bytes], tuple[list[str | None], list[str]]]
# Warnings of an extractor that do not bear on the text.
HARMLESS_WARNINGS = ("font", "bogus", "structure tree", "graphics state")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """The newest PDF of each paper: `paper_id, path, doc_id, content`; of equal times the least path.

    Names that are no identifiers are left out; `doc_id` is the SHA-1 of the bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.pdf\z", "")
    rows = files.withColumn("paper_id", base_id(F.regexp_replace(stem, r"^([A-Za-z.-]+)_(?=\d{7})", "$1/"))).where(is_base_id("paper_id"))
    newest = rows.groupBy("paper_id").agg(F.min_by("path", F.struct(-F.unix_micros("modificationTime"), "path")).alias("path"))
    return rows.join(newest, ["paper_id", "path"]).select("paper_id", "path", F.sha1("content").alias("doc_id"), "content")


def warning_summary(warnings: list[str], shown: int = 3) -> str | None:
    """The first warnings that matter, and how many more there are; None without any."""
    some = [w.strip() for w in warnings if w.strip() and not any(h in w.casefold() for h in HARMLESS_WARNINGS)]
    if not some:
        return None
    more = f" (+{len(some) - shown} more)" if len(some) > shown else ""
    return "; ".join(some[:shown]) + more


def plain_extractor(content: bytes) -> tuple[list[str | None], list[str]]:
    """A stand-in for PDFs: UTF-8 text with form feeds between pages."""
    return list(content.decode("utf-8").split("\f")), []


def extract_pages(files: DataFrame, extractor: Extractor = plain_extractor) -> DataFrame:
    """`paper_id, doc_id, path, page, text, warning, error` of each page. A file that fails is one row with its error
    and no page; a page that fails is left out and named in the warning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for paper, doc, path, content in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    pages, warnings = extractor(content)
                    warnings = [*warnings, *[f"page {i} could not be read" for i, p in enumerate(pages, 1) if p is None]]
                    note = warning_summary(warnings)
                    out += [(paper, doc, path, i, p, note, None) for i, p in enumerate(pages, 1) if p is not None]
                except Exception as e:  # noqa: BLE001
                    out.append((paper, doc, path, None, None, None, str(e) or type(e).__name__))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.string()] * 3 + [pa.int32()] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["paper_id", "doc_id", "path", "page", "text", "warning", "error"])

    schema = "paper_id string, doc_id string, path string, page int, text string, warning string, error string"
    return files.select("paper_id", "doc_id", "path", "content").mapInArrow(run, schema)


def parse_pages(pages: DataFrame, remove_headers: bool = False) -> DataFrame:
    """Extracted pages with cleaned text, without repeated heads and feet if asked."""
    good = clean_pages(pages.where(F.col("error").isNull()))
    return strip_repeated_lines(good, "doc_id") if remove_headers else good.withColumn("removed", F.lit(0))


def write_parsed(pages: DataFrame, folder: str) -> None:
    """Pages as one JSON object a document, in a file of its own, which is what `read_parsed` reads."""
    docs = pages.groupBy("doc_id", F.col("path").alias("pdf_path")).agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    docs.select("doc_id", "pdf_path", F.size("pages").alias("num_pages"), "pages", F.col("doc_id").alias("document")).write.mode("overwrite").partitionBy("document").json(folder)


def read_parsed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """`doc_id, pdf_path, page, text, error` of parsed JSON files or folders of them.

    A file that is no object or lacks a `doc_id` is one row with an error; pages without a number are left out,
    a missing text is empty.
    """
    for p in [paths] if isinstance(paths, str) else paths:
        if Path(p).suffix and Path(p).suffix != ".json" and Path(p).is_file():
            raise ValueError(f"not a .json file: {p}")
    raw = spark.read.schema(schemas.PARSED + ", _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).json(paths)
    bad = F.coalesce(F.trim("doc_id"), F.lit("")) == ""
    error = F.when(F.col("_corrupt_record").isNotNull(), "invalid_parsed_json").when(bad, "missing_doc_id")
    rows = raw.withColumn("error", error)
    fine = rows.where("error is null").select("doc_id", "pdf_path", F.explode("pages").alias("p")).where("p.page is not null")
    good = fine.select("doc_id", "pdf_path", "p.page", F.coalesce("p.text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(rows.where("error is not null").select("doc_id", "pdf_path", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), "error"))


def read_ids(path: str) -> list[str]:
    """Identifiers of a .txt file (blank and # lines skipped) or a .json list or object with `ids`."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"no file of identifiers at {path}")
    if p.suffix.lower() == ".txt":
        return [x for line in p.read_text(encoding="utf-8").splitlines() if (x := line.strip()) and not x.startswith("#")]
    if p.suffix.lower() != ".json":
        raise ValueError(f"identifiers come in a .txt or .json file, not in {p.name}")
    try:
        found = json.loads(p.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no JSON: {e}") from e
    found = found.get("ids") if isinstance(found, dict) else found
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError(f"{path} holds no list of texts, nor an object with one as ids")
    return [x.strip() for x in found if x.strip()]


def normalize_ids(spark: SparkSession, raw: list[str]) -> DataFrame:
    """`pos, base_id, valid` of a list as given: trimmed, without versions, each once at its first place."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "pos int, raw string")
    one = rows.select("pos", base_id(F.trim("raw")).alias("base_id")).where("base_id <> ''").groupBy("base_id").agg(F.min("pos").alias("pos"))
    return one.select("pos", "base_id", is_base_id("base_id").alias("valid"))


def write_id_index(papers: DataFrame, path: str) -> None:
    """Sorted identifiers, one a line."""
    papers.select("paper_id").where("paper_id is not null").distinct().orderBy("paper_id").write.mode("overwrite").text(path)


def read_id_index(spark: SparkSession, path: str) -> DataFrame:
    """The identifiers of an index."""
    return spark.read.text(path).select(F.trim("value").alias("paper_id")).where("paper_id <> ''").distinct()


def read_eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Items of an eval-set file, with defaults for missing fields, and its metadata."""
    raw = spark.read.schema(schemas.EVAL_FILE).option("multiLine", True).json(path)
    head = raw.select("metadata", F.size("eval_set").alias("n"), F.col("eval_set").isNotNull().alias("ok")).first()
    if head is None or not head.ok or head.metadata is None:
        raise ValueError(f"{path} lacks an eval_set or its metadata")
    items = raw.select(F.inline("eval_set"))
    empty = F.array().cast("array<string>")
    g = F.col("ground_truth")
    truth = F.struct(F.coalesce(g["chunk_uids"], empty).alias("chunk_uids"), F.coalesce(g["papers"], empty).alias("papers"), F.coalesce(g["pages"], F.array().cast("array<array<int>>")).alias("pages"), F.coalesce(g["expected_topics"], empty).alias("expected_topics"))
    rows = items.select(F.coalesce("query_id", F.lit("")).alias("query_id"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce("difficulty", F.lit("factual")).alias("difficulty"), truth.alias("ground_truth"), F.coalesce("reference_answer", F.lit("")).alias("reference_answer"))
    meta = {"created": head.metadata.created or "", "corpus_version": head.metadata.corpus_version or "", "n_queries": head.n if head.metadata.n_queries is None else head.metadata.n_queries}
    return rows, meta


def write_eval_set(items: DataFrame, path: str, created: str, corpus_version: str = "") -> None:
    """An eval set as one JSON file; an eval set is questions for people to review and stays small."""
    rows = [json.loads(r[0]) for r in items.select(F.to_json(F.struct(*items.columns))).orderBy(items.columns[0]).toLocalIterator()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"eval_set": rows, "metadata": {"created": created, "corpus_version": corpus_version, "n_queries": len(rows)}}, indent=2, ensure_ascii=False), encoding="utf-8")


def read_openings(path: str) -> list[str]:
    """Openings of a JSON list or of lines; blank ones are dropped. A file without any is an error."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no file of openings at {path}")
    said = Path(path).read_text(encoding="utf-8").strip()
    found = json.loads(said) if said.startswith("[") else said.splitlines()
    out = [x.strip() for x in found if isinstance(x, str) and x.strip()]
    if not out:
        raise ValueError(f"{path} holds no openings")
    return out


def read_prompt(name: str, override: str | None = None) -> str:
    """A prompt template: the file given, else the packaged one. Blank templates are errors."""
    if override is not None:
        if not Path(override).is_file():
            raise FileNotFoundError(f"no prompt at {override}")
        said = Path(override).read_text(encoding="utf-8")
    else:
        place = resources.files("paperweir") / "prompts" / f"{name}.txt"
        if not place.is_file():
            raise FileNotFoundError(f"no prompt named {name}")
        said = place.read_text(encoding="utf-8")
    if not said.strip():
        raise ValueError(f"the prompt {override or name} is blank")
    return said
