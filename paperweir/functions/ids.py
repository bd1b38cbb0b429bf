"""Identifiers of papers and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers of papers, new and old style, with a version behind them or without.
NEW_STYLE = r"\d{4}\.\d{4,5}"
OLD_STYLE = r"(?i:[a-z-]+(?:\.[A-Z]{2})?/\d{7})"
OLD_STYLE_VERSION = r"(?i:v)\d+"


def outer_trimmed(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def base_id(text: Column | str) -> Column:
    """The identifier without its version; other texts unchanged. The `v` of a new-style version is lower case."""
    new = F.regexp_replace(text, rf"^({NEW_STYLE})v\d+\z", "$1")
    return F.regexp_replace(new, rf"^({OLD_STYLE}){OLD_STYLE_VERSION}\z", "$1")


def is_base_id(text: Column | str) -> Column:
    """Whether a text is an identifier without a version."""
    col = F.col(text) if isinstance(text, str) else text
    return col.rlike(rf"^(?:{NEW_STYLE}|{OLD_STYLE})\z")


def paper_key(text: Column | str) -> Column:
    """What papers are compared by: the base identifier in lower case, without outer white space."""
    return base_id(F.lower(outer_trimmed(text)))


def chunk_key(text: Column | str) -> Column:
    """What chunks are compared by: the uid in lower case, without outer white space."""
    return F.lower(outer_trimmed(text))


def chunk_uid(doc_id: Column, page: Column, index: Column, start: Column, end: Column) -> Column:
    """SHA-1 over document, page, index and offsets; -1 stands for an unknown offset."""
    parts = [c.cast("string") for c in (doc_id, page, index, F.coalesce(start, F.lit(-1)), F.coalesce(end, F.lit(-1)))]
    return F.sha1(F.concat_ws(":", *parts))
