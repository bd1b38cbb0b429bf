"""Retrieval metrics, failure counts, question filters and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweir.functions.text import col, is_grounded, is_reference_like, names_excerpt, question_key

FAILURES = {
    "retrieval_empty": "size(retrieved) = 0",
    "recall_at_5_zero": "recall_at_5 = 0",
    "mrr_zero": "mrr = 0",
    "citation_absent": "citation_count = 0",
    "citation_zero_score": "citation_count > 0 and citation_accuracy = 0",
    "citation_parse_error": "coalesce(citation_error, '') <> ''",
    "citation_inaccurate": "citation_accuracy < 1",
}


def truth_set(uids: Column | str) -> Column:
    """Distinct ground-truth uids; null and empty entries are none."""
    return F.array_distinct(F.filter(F.coalesce(col(uids), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def recall_at(retrieved: Column | str, truth: Column | str, k: int) -> Column:
    """Share of the truth among the first k; 0 where there is no truth."""
    if k <= 0:
        raise ValueError("k must be > 0")
    t = truth_set(truth)
    return F.when(F.size(t) == 0, 0.0).otherwise(F.size(F.array_intersect(F.slice(col(retrieved), 1, k), t)) / F.size(t))


def first_correct_rank(retrieved: Column | str, truth: Column | str) -> Column:
    """Rank of the first correct uid, from 1, or null."""
    t = truth_set(truth)
    hits = F.filter(F.transform(col(retrieved), lambda x, i: F.when(F.array_contains(t, x), i + 1)), lambda x: x.isNotNull())
    return F.array_min(hits)


def retrieval_metrics(results: DataFrame, items: DataFrame, key: str = "query_id", uid: str = "chunk_uid") -> DataFrame:
    """`key, retrieved, truth, recall_at_5, recall_at_10, first_correct_rank, mrr` of every item, also without results.

    `results` has `key, rank, uid`; `items` has `key, truth` with the uids that are right.
    """
    lists = results.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", uid))), lambda s: s[uid]).alias("retrieved"))
    rows = items.select(key, "truth").join(lists, key, "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<string>")))
    rows = rows.withColumn("first_correct_rank", first_correct_rank("retrieved", "truth"))
    return rows.select(key, "retrieved", "truth", recall_at("retrieved", "truth", 5).alias("recall_at_5"), recall_at("retrieved", "truth", 10).alias("recall_at_10"), "first_correct_rank", F.coalesce(1.0 / F.col("first_correct_rank"), F.lit(0.0)).alias("mrr"))


def citation_scores(items: DataFrame, citations: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """`key, citation_count, citation_accuracy`: the share of citations with a true chunk on their page; 0 without any.

    `citations` has `key, citation_id, paper_id, page_number`, `chunks` has `paper_id, page_number, chunk_uid`;
    papers are compared as they are.
    """
    truth = items.select(key, F.explode(truth_set("truth")).alias("chunk_uid"))
    pages = truth.join(chunks.select("chunk_uid", "paper_id", "page_number").distinct(), "chunk_uid").select(key, "paper_id", "page_number").distinct().withColumn("right", F.lit(1))
    judged = citations.join(pages, [key, "paper_id", "page_number"], "left")
    scores = judged.groupBy(key).agg(F.count("*").alias("citation_count"), F.avg(F.coalesce("right", F.lit(0))).alias("citation_accuracy"))
    return items.select(key).join(scores, key, "left").select(key, F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.coalesce("citation_accuracy", F.lit(0.0)).alias("citation_accuracy"))


def summarize(metrics: DataFrame) -> DataFrame:
    """One row of means: recall and MRR are 0 without items, citation means null without scores."""
    acc = "citation_accuracy" in metrics.columns
    scored = F.col("citation_accuracy") if acc else F.lit(None).cast("double")
    return metrics.agg(
        F.count("*").alias("n_queries"),
        F.coalesce(F.avg("recall_at_5"), F.lit(0.0)).alias("recall_at_5"),
        F.coalesce(F.avg("recall_at_10"), F.lit(0.0)).alias("recall_at_10"),
        F.coalesce(F.avg("mrr"), F.lit(0.0)).alias("mrr"),
        F.avg(scored).alias("citation_accuracy"),
        F.avg(F.when(F.col("recall_at_5") > 0, scored)).alias("citation_accuracy_recall_at_5"),
    )


def failures(metrics: DataFrame) -> DataFrame:
    """One row with the number of items of each failure."""
    for name, kind in (("citation_count", "int"), ("citation_accuracy", "double"), ("citation_error", "string")):
        if name not in metrics.columns:
            metrics = metrics.withColumn(name, F.lit(None).cast(kind))
    return metrics.agg(*[F.count_if(F.expr(test)).alias(name) for name, test in FAILURES.items()])


def context_diagnostics(items: DataFrame, context: DataFrame, citations: DataFrame, key: str = "query_id") -> DataFrame:
    """`key, ground_truth_in_context, citations_in_context, citations_outside_context`."""
    ctx = context.select(key, "paper_id", "page_number").distinct().withColumn("inside", F.lit(True))
    uids = context.groupBy(key).agg(F.collect_set("chunk_uid").alias("uids"))
    counted = citations.join(ctx, [key, "paper_id", "page_number"], "left").groupBy(key).agg(F.count_if("inside").alias("a"), F.count_if(F.col("inside").isNull()).alias("b"))
    rows = items.select(key, "truth").join(uids, key, "left").join(counted, key, "left")
    return rows.select(key, F.coalesce(F.arrays_overlap(truth_set("truth"), "uids"), F.lit(False)).alias("ground_truth_in_context"), F.coalesce("a", F.lit(0)).alias("citations_in_context"), F.coalesce("b", F.lit(0)).alias("citations_outside_context"))


def coverage(items: DataFrame, papers: DataFrame, ids: str = "papers") -> DataFrame:
    """Papers that the items name and `papers` doesn't have, as they are written: `missing_paper`."""
    named = items.select(F.explode(ids).alias("paper_id")).where(F.col("paper_id").isNotNull()).distinct()
    return named.join(papers.select("paper_id").distinct(), "paper_id", "left_anti").select(F.col("paper_id").alias("missing_paper"))


def question_filter(items: DataFrame, key: str = "query_id") -> DataFrame:
    """`key, reason`: why a generated question is rejected, or null.

    `items` has `key, question, answer, text`. Questions with the key of an earlier one (smaller `key`) are
    duplicates; then those that refer to an excerpt, then answers that the text does not carry.
    """
    w = Window.partitionBy(question_key("question")).orderBy(key)
    rows = items.withColumn("n", F.row_number().over(w))
    # The reasons, which are part of the result.
    reason = (
        F.when(F.col("n") > 1, "duplicate question in eval set")
        .when(names_excerpt("question"), "question is not standalone")
        .when(~F.coalesce(is_grounded("answer", "text"), F.lit(False)), "expected answer is weakly grounded in chunk text")
    )
    return rows.select(key, reason.alias("reason"))


def candidates(chunks: DataFrame, min_chars: int = 200, uid: str = "chunk_uid") -> DataFrame:
    """Chunks of at least `min_chars` characters that are no bibliographies."""
    return chunks.where((F.length("text") >= min_chars) & ~is_reference_like("text"))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """`n` rows drawn by the seed: a sort of n rows a partition, not of all."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def report_markdown(summary: dict, failed: dict, misses: list[str], created: str) -> str:
    """The evaluation report as text; of the queries without a hit the first five are named."""
    lines = ["# Evaluation report", "", f"Created: {created}", "", "## Summary", "", "| Metric | Value |", "| --- | --- |"]
    lines += [f"| {k} | {'n/a' if v is None else f'{v:.2f}' if isinstance(v, float) else v} |" for k, v in summary.items()]
    lines += ["", "## Failures", "", "| Failure | Queries |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in failed.items()]]
    if misses:
        lines += ["", "## First misses", "", *[f"- {m}" for m in misses[:5]]]
    return "\n".join(lines) + "\n"
