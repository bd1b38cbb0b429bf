"""Answers to questions from their contexts, in stages around a generation provider."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.functions.json_text import evidence, quote_selection, selection_indices
from paperweir.functions.text import normalize_space
from paperweir.operators import citations, prompting, providers
from paperweir.session import cut
from paperweir.sources.files import read_prompt


@dataclass(frozen=True)
class AnswerConfig:
    """Which stages run."""

    select_evidence: bool = False
    select_k: int = 2
    quote_first: bool = False
    cite_chunks: bool = False
    repair: bool = False
    repair_attempts: int = 1
    concurrency: int = 4

    def __post_init__(self) -> None:
        if self.select_k <= 0 or self.repair_attempts <= 0 or self.concurrency <= 0:
            raise ValueError("select_k, repair_attempts and concurrency must be > 0")
        if self.cite_chunks and self.quote_first:
            raise ValueError("citations by chunk number and quote-first answers exclude one another")

    def version(self):
        """What answers are cached under."""
        names = ["generate"] + ["select_evidence"] * self.select_evidence + ["select_quote", "quote_first"] * self.quote_first + ["cite_chunks"] * self.cite_chunks + ["repair"] * self.repair
        flags = {"select": self.select_evidence, "select_k": self.select_k, "quote_first": self.quote_first, "cite_chunks": self.cite_chunks, "repair": self.repair, "attempts": self.repair_attempts}
        return prompting.prompt_version([read_prompt(n) for n in names], flags)


def _ask(prompts: DataFrame, factory: Callable, config: AnswerConfig) -> DataFrame:
    """Answers, written once: a model must not be asked again when a later stage is."""
    return cut(providers.generate(prompts, factory, concurrency=config.concurrency), "asked")


def remapped(answers: DataFrame, context: DataFrame, key: str = "query_id") -> DataFrame:
    """Answers whose citations name the chunk of the context that supports them best, where that differs."""
    best = citations.remap(answers, context, key, "answer").where("best_uid is not null")
    where = context.select(key, F.col("chunk_uid").alias("best_uid"), F.col("paper_id").alias("p"), F.col("page_number").alias("g"))
    target = F.when((F.col("p") != F.col("paper_id")) | (F.col("g") != F.col("page_number")), F.concat(F.lit("[arXiv:"), F.col("p"), F.lit(" p."), F.col("g"), F.lit("]")))
    n = F.regexp_replace("citation_id", "^c", "").cast("int")
    maps = best.join(where, [key, "best_uid"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(n, target))).alias("m"))
    rows = answers.join(maps, key, "left")
    count = F.size(citations.citation_texts("answer"))
    targets = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.try_element_at("m", i)))
    return rows.select(*[c for c in answers.columns if c != "answer"], F.when(F.col("m").isNull() | (count <= 0), F.col("answer")).otherwise(citations.rewrite(F.col("answer"), targets)).alias("answer"))


def generate_answers(questions: DataFrame, context: DataFrame, factory: Callable, config: AnswerConfig = AnswerConfig()) -> DataFrame:
    """`query_id, answer, error` for questions (`query_id, query`) with a context (`query_id, rank, chunk_uid, paper_id, page_number, text`).

    Evidence is selected first if asked (the best chunk always stays), then a quote; chunk numbers become page
    citations, citations move to the chunk that supports them, and broken answers are repaired. The prompt of a
    repair is made from the first answer, whatever the attempt.
    """
    q = questions.select("query_id", "query")
    ctx = cut(prompting.valid_context(context), "context")
    if config.select_evidence:
        p = prompting.format_chunks(ctx).join(q, "query_id")
        said = _ask(p.withColumn("prompt", prompting.render(read_prompt("select_evidence"), chunks="chunks", query="query", max_chunks=F.lit(str(config.select_k)))), factory, config)
        most = ctx.groupBy("query_id").agg(F.max("rank").alias("most"))
        chosen = said.join(most, "query_id").select("query_id", F.explode(evidence(selection_indices(F.coalesce("answer", F.lit("")), F.col("most")), config.select_k)).alias("rank"))
        ctx = cut(ctx.join(chosen, ["query_id", "rank"], "left_semi"), "context")
    p = cut(prompting.format_chunks(ctx).join(q, "query_id"), "prompts")
    template = read_prompt("cite_chunks" if config.cite_chunks else "generate")
    prompt = prompting.render(template, chunks="chunks")
    if config.quote_first:
        said = _ask(p.withColumn("prompt", prompting.render(read_prompt("select_quote"), chunks="chunks", query="query")), factory, config)
        last = ctx.groupBy("query_id").agg(F.max("rank").alias("last"))
        picked = said.join(last, "query_id").select("query_id", quote_selection(F.coalesce("answer", F.lit("")), F.col("last")).alias("s")).where("s is not null").select("query_id", F.col("s.chunk_index").alias("rank"), F.col("s.quote").alias("quote"))
        held = picked.join(ctx.select("query_id", "rank", "text"), ["query_id", "rank"]).where(F.contains(F.lower(normalize_space("text")), F.lower("quote"))).select("query_id", "quote")
        p = p.join(held, "query_id", "left")
        prompt = F.when(F.col("quote").isNull(), prompt).otherwise(prompting.render(read_prompt("quote_first"), chunks="chunks", query="query", quote="quote"))
    got = _ask(p.withColumn("prompt", prompt), factory, config)
    labels = ctx.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "paper_id", "page_number"))), lambda s: F.concat(F.lit("[arXiv:"), s["paper_id"], F.lit(" p."), s["page_number"], F.lit("]"))).alias("labels"))

    def finished(rows: DataFrame) -> DataFrame:
        if config.cite_chunks:
            rows = rows.join(labels, "query_id", "left").select("query_id", F.coalesce(citations.map_chunk_citations("answer", "labels"), "answer").alias("answer"), "error")
        return cut(remapped(rows.select("query_id", "answer", "error"), ctx), "answers")

    done = finished(got)
    if config.repair:
        first = done
        for _ in range(config.repair_attempts):
            broken = done.where(F.coalesce(citations.needs_repair("answer"), F.lit(False)))
            again = first.join(broken.select("query_id"), "query_id", "left_semi").join(p.select("query_id", "query", "chunks"), "query_id")
            asked = _ask(again.withColumn("prompt", prompting.render(read_prompt("repair"), chunks="chunks", query="query", answer="answer")), factory, config)
            mended = finished(asked).where("answer is not null")
            done = cut(done.join(mended.select("query_id"), "query_id", "left_anti").unionByName(mended), "answers")
    return done.select("query_id", "answer", "error")
