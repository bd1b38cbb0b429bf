"""Several values packed in one text, divided by a parsing expression grammar.

    list      <- bracketed / sequence
    bracketed <- '[' (member (',' member)*)? ','? ']' end
    sequence  <- item? (separator item?)* end
    item      <- quoted / bare
    quoted    <- '"' ('""' / '\\' any / [^"])* '"' &(separator / end)   likewise with an apostrophe
    bare      <- group / inverted / long / name / word                  which of them, the field says
    long      <- surnames ',' given names &(divider / end)              where ; | or line breaks divide the list

Alternatives are tried in order and a failed one is taken back, so a quotation mark that is never closed, or
closed before other text, is read as part of a bare value and flagged.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WS = re.compile(r"\s*")
_QUOTED = re.compile(r'"((?:""|\\.|[^"\\])*)"|\'((?:\\.|[^\'\\])*)\'', re.S)
_MEMBER = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|[^,\[\]"\']+', re.S)
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}|.)', re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
# Words in lower case that belong to a surname.
PARTICLES = r"(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|al|el|bin|ibn|ter|ten|zu|zur|zum|y)"
_CAP = r"(?:(?:[a-z]{1,3}['’-])?[^\W\d_a-z][\w'’.\-]*)"
_INITIALS = r"(?:[^\W\d_a-z]\.(?:[\s-]*[^\W\d_a-z]\.)*)"
_SUFFIX = r"(?:\s*,\s*(?:Jr|Sr|II|III|IV|PhD|Ph\.D|MD)\b\.?)"
#: A surname of one word, with particles, then a comma and given names or initials, then perhaps a suffix.
_INVERTED = re.compile(rf"(?:{PARTICLES}\s+)*{_CAP}\s*,\s*(?:{_INITIALS}|[^\W\d_a-z][\w'’\-]*(?:\s+{_INITIALS})?){_SUFFIX}?(?=\s*(?:$|[;；|·、&,\t\n]|/\s|\band\b))")
_GAP = r"[^\S\t\n\r]+"
_NAMES = rf"(?:{PARTICLES}{_GAP})*{_CAP}(?:{_GAP}(?:{PARTICLES}{_GAP})*{_CAP})*"
_DIVIDER = re.compile(r"[;；|\n]")
#: As above with any number of surnames and of given names, up to a divider.
_LONG = re.compile(rf"(?P<family>{_NAMES})[^\S\n]*,[^\S\n]*(?P<given>{_NAMES}){_SUFFIX}?(?=\s*(?:$|[;；|\n]))")
_PARTICLE = re.compile(PARTICLES)
_HAS_SUFFIX = re.compile(_SUFFIX)
#: The name of a group, of which "and" or "&" is a part.
_GROUP = re.compile(r"[^\W\d_][\w-]*\s+(?:and|&)\s+[^\W\d_][\w-]*\s+(?:Group|Collaboration|Team|Consortium|Network|Project|Laboratory|Institute)\b", re.U)
_WEAK, _CLOSING = re.compile(r"\s*(?:and|&)\s*"), re.compile(r"[)\]}]")
_STRONG = r"[;；|·、\t\n\r]|/"
_AUTHOR_SEP = re.compile(rf"\s*(?:{_STRONG}|,\s+and\s|,\s*&|,|&|(?<=\s)and\s)\s*")
_WORD_SEP = re.compile(rf"\s*(?:{_STRONG}|,)\s*|\s+")


@dataclass(frozen=True)
class Field:
    """How bare values of a field end and what they may hold."""

    separator: re.Pattern
    names: bool


AUTHORS, CATEGORIES = Field(_AUTHOR_SEP, True), Field(_WORD_SEP, False)


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        e = m.group(1)
        if len(e) > 1:
            return chr(int(e[1:], 16))
        return _PLAIN.get(e, e)

    return _ESCAPE.sub(one, s)


def _unquote(raw: str) -> str:
    """The value of a quoted member of a bracketed list."""
    if raw[0] == '"':
        try:
            return json.loads(raw, strict=False)
        except ValueError:
            pass
    return _unescape(raw[1:-1])


def _bracketed(text: str) -> list[str] | None:
    s = text.strip()
    if not (s.startswith("[") and s.endswith("]")):
        return None
    out, at, end = [], 1, len(s) - 1
    while True:
        at = _WS.match(s, at).end()
        if at >= end:
            return out
        m = _MEMBER.match(s, at, end)
        if not m:
            return None
        raw = m.group().strip()
        out.append(_unquote(raw) if raw[:1] in "\"'" else "" if raw in ("null", "None") else raw)
        at = _WS.match(s, m.end()).end()
        if at >= end:
            return out
        if s[at] != ",":
            return None
        at += 1


def _divided(text: str) -> tuple[bool, bool]:
    """Whether dividers stand between names, and whether a surname comes first in all the names between them."""
    parts = [p.strip() for p in _DIVIDER.split(re.sub(r'"[^"]*"', '""', text))]
    parts = [p for p in parts if p]
    bare = [p for p in parts if p[0] != '"']
    return len(parts) > 1, len(bare) > 1 and all(_INVERTED.fullmatch(p) or _LONG.fullmatch(p) for p in bare)


def _long_end(text: str, at: int, inverted: bool) -> int | None:
    """Where a name `surnames, given names` ends that fills the place between two dividers, from `at`.

    Two full names with a comma between them look the same; they are one only where the whole list is `inverted`.
    """
    i = at - 1
    while i >= 0 and text[i].isspace() and text[i] != "\n":
        i -= 1
    if i >= 0 and not _DIVIDER.match(text, i) or not (m := _LONG.match(text, at)):
        return None
    family = [w for w in m["family"].split() if not _PARTICLE.fullmatch(w)]
    given = [w for w in m["given"].split() if not w.endswith(".")]
    return m.end() if inverted or len(family) == 1 or len(given) <= 1 and len(m["given"].split()[0].rstrip(".")) > 1 else None


def _bare_end(text: str, at: int, field: Field, divided: bool = False, inverted: bool = False) -> int:
    """Where the bare value that begins at `at` ends.

    Between dividers, "and" behind a single word belongs to a name.
    """
    if field.names:
        if m := _GROUP.match(text, at):
            return m.end()
        if m := _INVERTED.match(text, at):
            return m.end()
        if divided and (end := _long_end(text, at, inverted)):
            return end
    depth, i, size = 0, at, len(text)
    while i < size:
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif (depth == 0 or not _CLOSING.search(text, i)) and (m := field.separator.match(text, i)):
            if divided and _WEAK.fullmatch(m.group()) and len(text[at:i].split()) < 2:
                i = m.end()  # the name of a firm, since dividers stand between names
                continue
            if field.names and c == "," and (s := _HAS_SUFFIX.match(text, i)):
                i = s.end()
                continue
            return i
        i += 1
    return size


def split_packed(text: str | None, field: Field) -> list[tuple[int, str, str | None]]:
    """(position from 1, value, flag) of each value; flag names what was malformed, None where nothing was.

    Empty entries are dropped before counting; repeated values stay. A null, empty or blank text has none.
    """
    if text is None or not text.strip():
        return []
    items: list[tuple[str, str | None]] = []
    listed = _bracketed(text)
    if listed is not None:
        items = [(v, None) for v in listed]
    else:
        flag = None
        s = text
        if s.lstrip().startswith("[") and not field.names or re.match(r"\s*\[\s*[\"']", s):  # a list whose bracket is not closed
            s, flag = s.strip().lstrip("[").rstrip("]"), "broken_bracket"
        at, size = 0, len(s)
        divided, inverted = _divided(s) if field.names and _DIVIDER.search(s) else (False, False)
        while at < size:
            at = _WS.match(s, at).end()
            if at >= size:
                break
            if m := field.separator.match(s, at):
                if m.end() > at:
                    at = m.end()
                    continue
            if q := _QUOTED.match(s, at):
                after = _WS.match(s, q.end()).end()
                if after >= size or field.separator.match(s, q.end()):
                    inner = q.group(1) if q.group(1) is not None else q.group(2)
                    inner = inner.replace('""', '"') if s[at] == '"' else inner
                    items.append((re.sub(r"\\([\"'\\])", r"\1", inner), flag))
                    at = q.end()
                    continue
            end = _bare_end(s, at, field, divided, inverted)
            if end == at:
                end = at + 1
            value = s[at:end].strip()
            items.append((value, "open_quote" if s[at] == '"' else flag))
            at = end
    kept = [(v.strip(), f) for v, f in items if v.strip()]
    return [(i, v, f) for i, (v, f) in enumerate(kept, 1)]


def unpack(df: DataFrame, key: str, fields: dict[str, Field]) -> DataFrame:
    """One row for each value of the packed text columns: `key, field_name, pos, item, flag`.

    `pos` counts from 1 in the order of the text; repeated values stay, empty ones are not counted. Repeated
    rows count once; null keys stay as null; null and blank texts give no rows; other columns are not read.
    """
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                for name, text in zip(names, row[1:]):
                    out += [(row[0], name, *x) for x in split_packed(text, fields[name])]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "field_name", "pos", "item", "flag"])

    rows = df.select(F.col(key).cast("string"), *(F.col(n).cast("string") for n in names)).distinct()
    return rows.mapInArrow(run, "key string, field_name string, pos int, item string, flag string").distinct()
