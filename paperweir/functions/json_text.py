"""Values from model outputs that should be JSON but often aren't only that."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperweir.functions.text import col, normalize_space

QUESTION = "array<struct<question:string,expected_answer:string,difficulty:string>>"


def _object(text: Column, schema: str) -> Column:
    """The whole text as an object, else what is between its outermost braces."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(F.when(F.trim(text).startswith("{"), text), schema), F.from_json(F.when(inner != "", inner), schema))


def selection_indices(text: Column | str, max_index: Column | int) -> Column:
    """Distinct numbers of a selection within 1 and `max_index`, in order.

    Those under `selected`, numbers or digit strings; without any, every number in the text.
    """
    t = col(text)
    listed = F.filter(F.transform(_object(t, "selected array<string>")["selected"], lambda x: F.when(x.rlike(r"^\d+\z"), x.try_cast("int"))), lambda x: x.isNotNull())
    loose = F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    chosen = F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed).otherwise(loose)
    return F.array_distinct(F.filter(chosen, lambda x: (x >= 1) & (x <= max_index)))


def evidence(indices: Column | str, most: int) -> Column:
    """Indices of evidence chunks: the first result always, then the chosen ones, at most `most`."""
    return F.slice(F.array_distinct(F.concat(F.array(F.lit(1)), F.coalesce(col(indices), F.array().cast("array<int>")))), 1, most)


def quote_selection(text: Column | str, max_index: Column | int) -> Column:
    """struct(chunk_index, quote) of a chosen quote, or null where index or quote is not usable."""
    o = _object(col(text), "chunk_index string, quote string")
    index, quote = o["chunk_index"].try_cast("int"), normalize_space(o["quote"])
    fine = (index >= 1) & (index <= max_index) & (quote != "")
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(index.alias("chunk_index"), quote.alias("quote")))


def generated_questions(text: Column | str) -> Column:
    """Valid questions of a model output: a list, the outermost list in it, or an object's `items` or `questions`.

    A question needs text, an answer and a difficulty that is factual or synthesis; others are dropped.
    """
    t = col(text)
    inner = F.regexp_extract(t, r"(?s)(\[.*\])", 1)
    obj = _object(t, f"items {QUESTION}, questions {QUESTION}")
    whole = F.from_json(F.when(F.trim(t).startswith("["), t), QUESTION)
    items = F.coalesce(obj["items"], obj["questions"], whole, F.from_json(F.when(inner != "", inner), QUESTION))
    tidy = F.transform(items, lambda q: F.struct(F.trim(q["question"]).alias("question"), F.trim(q["expected_answer"]).alias("expected_answer"), F.lower(F.trim(q["difficulty"])).alias("difficulty")))
    return F.filter(tidy, lambda q: (F.length(q["question"]) > 0) & (F.length(q["expected_answer"]) > 0) & q["difficulty"].isin("factual", "synthesis"))
