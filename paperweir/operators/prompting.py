"""Prompts from contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.functions.text import col


def valid_context(context: DataFrame) -> DataFrame:
    """The context, in which a chunk without paper, uid, page or text is an error when it is read."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    broken = blank("paper_id") | blank("chunk_uid") | blank("text") | ~F.coalesce(F.col("page_number") > 0, F.lit(False))
    return context.withColumn("text", F.when(broken, F.raise_error(F.concat(F.lit("broken chunk "), F.coalesce("chunk_uid", F.lit("?"))))).otherwise(F.col("text")))


def format_chunks(context: DataFrame, key: str = "query_id") -> DataFrame:
    """`key, chunks`: the chunks of each context as text, with their place, citation, uid and title."""
    title = F.col("title") if "title" in context.columns else F.lit(None).cast("string")
    tail = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit(" "), title)).otherwise("")
    head = F.concat(F.lit("Chunk "), F.col("rank"), F.lit(": [arXiv:"), F.col("paper_id"), F.lit(" p."), F.col("page_number"), F.lit("] (chunk_uid="), F.col("chunk_uid"), F.lit(")"), tail)
    block = F.concat(head, F.lit("\n"), F.col("text"))
    lists = context.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return lists.select(key, F.array_join(F.transform("bs", lambda s: s["b"]), "\n\n").alias("chunks"))


def render(template: str, **values: Column | str) -> Column:
    """The template with each `{name}` replaced by a column; a name that it lacks is an error."""
    for name in values:
        if "{" + name + "}" not in template:
            raise ValueError(f"the prompt has no place for {name}")
    # one pass: values are not searched for placeholders
    out: list[Column] = []
    rest = template
    while rest:
        at = min((i, n) for n in values if (i := rest.find("{" + n + "}")) >= 0) if any("{" + n + "}" in rest for n in values) else None
        if at is None:
            out.append(F.lit(rest))
            break
        i, name = at
        if i:
            out.append(F.lit(rest[:i]))
        out.append(F.coalesce(col(values[name]), F.lit("")))
        rest = rest[i + len(name) + 2 :]
    return F.concat(*out) if out else F.lit("")


def prompt_version(templates: list[str], flags: dict[str, object]) -> Column:
    """SHA-256 of the templates and settings that shape an answer."""
    parts = [templates[0], *[f"{k}={v}" for k, v in flags.items()], *templates[1:]]
    return F.sha2(F.lit("\n".join(parts)), 256)
