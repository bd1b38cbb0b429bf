"""Text expressions. All stay in the JVM; a regular expression is written for Java and RE2 alike where it can be."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, as a character class of Java and RE2.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
# Words that full-text queries leave out.
QUERY_STOPWORDS = "a an and are as at be by for from how in is it of on or that the this to was what which with".split()
# Words that overlap scores leave out.
OVERLAP_STOPWORDS = "a an and are as at be by for from has in is it its of on or that the their this to was were with".split()
# Phrases that tie a question to an excerpt.
CONTEXT_PHRASES = [
    "in the excerpt", "from the excerpt", "this excerpt", "the excerpt", "as described in the excerpt", "as described in this excerpt", "as mentioned in the excerpt",
    "according to the excerpt", "in this passage", "from this passage", "the passage", "the text above", "the above text", "the paper referenced",
]
# Patterns of words that bibliographies hold, and of years.
REFERENCE_CUES = [
    r"\barxiv\b", r"\bpreprint\b", r"\bproceedings\b", r"\bconference\b", r"\bjournal\b", r"\btechnical report\b", r"\bdoi\b", r"\bvol\.\b", r"\bno\.\b", r"\bpp\.\b", r"\bpages?\b",
    r"\burl\b", r"\beditors?\b", r"\bpublisher\b", r"\bissn\b", r"\bisbn\b", r"\bcorr\b",
]
REFERENCE_YEAR = r"\b(19|20)\d{2}\b"


def col(c: Column | str) -> Column:
    """A column, by name or as it is."""
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(text), rf"^{WS}+|{WS}+\z", "")


def normalize_space(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), rf"{WS}+", " "))


def clean_text(text: Column | str) -> Column:
    """Page text with unified line ends, words joined over hyphens, trimmed lines and no empty ones."""
    one = F.replace(F.regexp_replace(col(text), r"\r\n?", "\n"), F.lit("-\n"), F.lit(""))
    lines = F.transform(F.split(one, "\n"), lambda x: F.regexp_replace(strip(x), r"[ \t]+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def snippet(text: Column | str, max_chars: int) -> Column:
    """The text in one line, cut to `max_chars` with an ellipsis where it is longer."""
    if max_chars <= 0:
        raise ValueError("max_chars must be > 0")
    flat = normalize_space(text)
    cut = F.substring(flat, 1, max_chars) if max_chars <= 3 else F.concat(F.rtrim(F.substring(flat, 1, max_chars - 3)), F.lit("..."))
    return F.when(F.length(flat) <= max_chars, flat).otherwise(cut)


def words(text: Column | str, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with one mark, and the letters without it."""
    marked, plain = [], []
    for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) == 2 and 0x300 <= ord(parts[1]) <= 0x331 and chr(c) == chr(c).lower():
            marked.append(chr(c))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def index_text(text: Column | str) -> Column:
    """Text as the index sees it: lower case, without marks on letters."""
    marked, plain = folding()
    return F.translate(F.regexp_replace(F.lower(col(text)), r"[\x{300}-\x{331}]", ""), marked, plain)


def index_tokens(text: Column | str) -> Column:
    """Tokens of the index: runs of letters and numbers of `index_text`."""
    return words(index_text(text), r"[\p{L}\p{N}\p{Co}]+")


def query_tokens(text: Column | str) -> Column:
    """Words of a question, as they are."""
    return words(text, r"[\p{L}\p{N}_]+")


def rerank_tokens(text: Column | str) -> Column:
    """Distinct ASCII words in lower case."""
    return F.array_distinct(words(F.lower(col(text)), "[a-z0-9]+"))


def content_tokens(text: Column | str) -> Column:
    """Distinct ASCII words of three letters or more that are no stop words."""
    stop = F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS])
    return F.filter(rerank_tokens(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def overlap_words(lowered: Column | str) -> Column:
    """ASCII words of two letters or more, repeats kept."""
    return F.filter(words(lowered, "[a-z0-9]+"), lambda w: F.length(w) >= 2)


def snippet_words(lowered: Column | str) -> Column:
    """ASCII words of three letters or more that are no stop words, repeats kept."""
    stop = F.array(*[F.lit(w) for w in OVERLAP_STOPWORDS])
    return F.filter(words(lowered, "[a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def question_key(text: Column | str) -> Column:
    """What questions are compared by: lower case, one blank between words, no marks."""
    return F.regexp_replace(F.lower(normalize_space(text)), r"[^\p{L}\p{N}_ ]", "")


def names_excerpt(text: Column | str) -> Column:
    """Whether a question refers to an excerpt that its reader doesn't have."""
    flat = F.lower(normalize_space(text))
    found = F.lit(False)
    for phrase in CONTEXT_PHRASES:
        found = found | F.contains(flat, F.lit(phrase))
    return found


def is_reference_like(text: Column | str) -> Column:
    """Whether a text looks like a bibliography, by its cue words and years."""
    low = F.lower(col(text))
    cues = sum((low.rlike(p).cast("int") for p in REFERENCE_CUES), F.lit(0))
    years = F.regexp_count(low, F.lit(REFERENCE_YEAR))
    return ((cues >= 3) & (years >= 2)) | ((years >= 6) & (cues >= 2)) | ((cues >= 4) & (years >= 1))


def is_grounded(answer: Column | str, text: Column | str) -> Column:
    """Whether an answer shares enough content words with a text."""
    a = content_tokens(answer)
    both, n = F.size(F.array_intersect(a, content_tokens(text))), F.size(a)
    return F.when(n == 0, False).when(n <= 4, both >= 1).otherwise((both >= 2) & (both / n >= 0.25))


# DuckDB twins of the expressions, for the SQL that queries are held against.
SQL_WS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_normalize(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SQL_WS}+', ' ', 'g'), ' ')"


def sql_clean(x: str) -> str:
    one = f"replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '-' || chr(10), '')"
    return f"array_to_string([y FOR y IN [regexp_replace({sql_strip('l')}, '[ \\t]+', ' ', 'g') FOR l IN string_split({one}, chr(10))] IF y <> ''], chr(10))"


def sql_snippet(x: str, n: int) -> str:
    flat = sql_normalize(x)
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE rtrim(substring({flat}, 1, {n - 3}), ' ') || '...' END"


def sql_index_tokens(x: str) -> str:
    marked, plain = folding()
    return rf"regexp_extract_all(translate(regexp_replace(lower({x}), '[\x{{300}}-\x{{331}}]', '', 'g'), '{marked}', '{plain}'), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def sql_query_tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"


def sql_ascii(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
