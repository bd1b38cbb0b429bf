"""Changes to tables as algebra: a function of the old rows and the new ones gives the rows to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperweir.functions.ids import chunk_uid


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first by `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_seen(df: DataFrame, key: str, order: list) -> DataFrame:
    """Rows whose key was not seen before, in `order`."""
    return latest(df, [key], order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = (), refresh: dict | None = None) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key; columns in `keep` stay as they were.

    `new` must hold a key once (see `latest`). `refresh` maps columns to expressions that replaced and new rows get.
    """
    fresh = {k: v for k, v in (refresh or {}).items()}
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    both = o.join(n, keys, "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in fresh:
            out.append(F.when(F.col("n._new"), fresh[c]).otherwise(F.col(f"o.{c}")).alias(c))
        elif c in keep or c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            out.append(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return both.select(*out)


def fill_chunk_uids(chunks: DataFrame) -> DataFrame:
    """Chunks in which a missing or empty uid is computed."""
    made = chunk_uid(F.col("doc_id"), F.col("page_number"), F.col("chunk_index"), F.col("char_start"), F.col("char_end"))
    return chunks.withColumn("chunk_uid", F.when(F.coalesce("chunk_uid", F.lit("")) == "", made).otherwise(F.col("chunk_uid")))


def assign_documents(papers: DataFrame, parsed: DataFrame) -> DataFrame:
    """Papers with the `doc_id` and path of `parsed` (`paper_id, doc_id, pdf_path`); a null path keeps the old one.

    Two papers with one document are an error when the result is read.
    """
    n = parsed.select("paper_id", F.col("doc_id").alias("_d"), F.col("pdf_path").alias("_p"))
    out = papers.join(n, "paper_id", "left").withColumn("doc_id", F.coalesce("_d", "doc_id")).withColumn("pdf_path", F.coalesce("_p", "pdf_path")).drop("_d", "_p")
    w = Window.partitionBy("doc_id")
    twice = F.col("doc_id").isNotNull() & (F.count("*").over(w) > 1)
    return out.withColumn("doc_id", F.when(twice, F.raise_error(F.concat(F.lit("two papers with document "), F.col("doc_id")))).otherwise(F.col("doc_id")))


def replace_versions(chunks: DataFrame, papers: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after new ones came: all chunks of a paper go when its document changed, those of a document always.

    `papers` has the documents before (`paper_id, doc_id`); `new` has the columns of `chunks`.
    """
    docs = new.select("paper_id", "doc_id").distinct()
    before = papers.select("paper_id", F.col("doc_id").alias("was"))
    changed = docs.join(before, "paper_id").where(~F.col("was").eqNullSafe(F.col("doc_id"))).where(F.col("was").isNotNull()).select("paper_id").distinct()
    kept = chunks.join(changed, "paper_id", "left_anti").join(docs.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.select(*chunks.columns).unionByName(new.select(*chunks.columns))


def stale(existing: DataFrame, new: DataFrame, uid: str = "chunk_uid", doc: str = "doc_id") -> DataFrame:
    """Rows of an index whose document was indexed anew and whose uid is gone."""
    docs = new.select(doc).distinct()
    return existing.join(docs, doc, "left_semi").join(new.select(uid).distinct(), uid, "left_anti")


def reindex(existing: DataFrame, new: DataFrame, requested: DataFrame | None = None, deletes: bool = True, uid: str = "chunk_uid", doc: str = "doc_id") -> DataFrame:
    """An index after documents were indexed: new rows replace and, if `deletes`, stale ones go.

    `requested` documents without chunks lose all their rows. With a limit on what was read, deletes must be off
    unless forced, since rows may be missing from `new` that are not stale.
    """
    kept = existing.join(new.select(uid), uid, "left_anti")
    if deletes:
        docs = new.select(doc).distinct()
        if requested is not None:
            docs = docs.unionByName(requested.select(doc)).distinct()
        kept = kept.join(docs, doc, "left_anti")
    return kept.select(*existing.columns).unionByName(new.select(*existing.columns))


def counts_per_document(docs: DataFrame, vectors: DataFrame, doc: str = "doc_id", uid: str = "chunk_uid") -> DataFrame:
    """Number of vectors of each document, also of those without, and a row `TOTAL`."""
    per = docs.select(doc).distinct().join(vectors, doc, "left").groupBy(F.col(doc).cast("string").alias(doc)).agg(F.count(uid).alias("n"))
    return per.unionByName(per.agg(F.lit("TOTAL").alias(doc), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that the cache lacks."""
    return wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """`wanted` with the cached columns and `hit`; repeats and order of rows are the caller's."""
    return wanted.join(cache.withColumn("hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def query_log_rows(df: DataFrame) -> DataFrame:
    """Rows as they are appended to the log: a blank question is an error, retrieved chunks are JSON."""
    text = F.when(F.trim(F.coalesce("query_text", F.lit(""))) == "", F.raise_error(F.lit("query_text must not be blank"))).otherwise(F.col("query_text"))
    return df.withColumn("query_text", text).withColumn("retrieved_chunks", F.to_json("retrieved_chunks"))


def matched_papers(paths: DataFrame, papers: DataFrame) -> DataFrame:
    """The paper of each file path: `path, paper_id, how`.

    The paper with that path, else the only one whose path ends in the file name, else the stem of the name.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    known = papers.where(F.col("pdf_path").isNotNull()).select("paper_id", "pdf_path")
    exact = known.groupBy("pdf_path").agg(F.min("paper_id").alias("exact"))
    tail = known.groupBy(name(F.col("pdf_path")).alias("_name")).agg(F.count_distinct("paper_id").alias("k"), F.min("paper_id").alias("tail")).where("k = 1")
    rows = paths.select("path", name(F.col("path")).alias("_name")).join(exact, F.col("path") == F.col("pdf_path"), "left").join(tail, "_name", "left")
    stem = F.regexp_replace("_name", r"\.[^.]*\z", "")
    how = F.when(F.col("exact").isNotNull(), "path").when(F.col("tail").isNotNull(), "name").otherwise("stem")
    return rows.select("path", F.coalesce("exact", "tail", stem).alias("paper_id"), how.alias("how"))
