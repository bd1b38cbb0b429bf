"""Citations in answers: parsing, quotes, coverage, verification and remapping, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweir.functions.ids import base_id, is_base_id
from paperweir.functions.text import col, normalize_space, overlap_words, snippet_words

# The form of a citation, of what looks like one, and of a quote behind one.
PAPER = r"\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?"
CITATION = rf"(?i)\[arXiv:({PAPER}) p\.(\d+)\]"
LIKE_CITATION = r"(?i)\[arXiv:[^\]]*\]"
QUOTE = r'(?s)^\s*\*"(.*?)"\*'
CHUNK_CITATION = r"(?i)\[chunk:(\d+)\]"
MIN_QUOTE_OVERLAP, MIN_SNIPPET_OVERLAP = 0.6, 0.25


def citation_texts(answer: Column | str) -> Column:
    """Citations as they stand in the answer."""
    return F.regexp_extract_all(col(answer), F.lit(CITATION), F.lit(0))


def malformed(answer: Column | str) -> Column:
    """What looks like a citation but isn't one, in order, then marks for doubled brackets."""
    text = col(answer)
    odd = F.filter(F.regexp_extract_all(text, F.lit(LIKE_CITATION), F.lit(0)), lambda x: ~x.rlike(CITATION.replace("(?i)", "(?i)^", 1) + r"\z"))
    double = F.when(text.rlike(r"(?i)\[\[arXiv:"), F.array(F.lit("[[arXiv:"))).otherwise(F.array().cast("array<string>"))
    after = F.when(text.rlike(r"(?i)arXiv:[^\]]*\]\]"), F.array(F.lit("arXiv:...]]"))).otherwise(F.array().cast("array<string>"))
    return F.concat(odd, double, after)


def _tails(answer: Column) -> Column:
    """The text behind each citation, up to the next."""
    parts = F.split(answer, CITATION)
    return F.slice(parts, 2, F.size(parts))


def parsed(answers: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """`key, n, citation_id, paper_id, page_number, raw, quote` of each citation; quote is null where none follows.

    The paper is the base identifier. Pages beyond an int are null.
    """
    a = F.col(answer)
    ids, pages = F.regexp_extract_all(a, F.lit(CITATION), F.lit(1)), F.regexp_extract_all(a, F.lit(CITATION), F.lit(2))
    quotes = F.transform(_tails(a), lambda t: F.when(t.rlike(QUOTE), normalize_space(F.regexp_extract(t, QUOTE, 1))))
    rows = answers.where(a.isNotNull()).select(key, F.posexplode(F.arrays_zip(citation_texts(a).alias("raw"), ids.alias("id"), pages.alias("page"), quotes.alias("quote"))).alias("i", "c"))
    n = F.col("i") + 1
    return rows.select(key, n.alias("n"), F.concat(F.lit("c"), n).alias("citation_id"), base_id(F.col("c.id")).alias("paper_id"), F.col("c.page").try_cast("int").alias("page_number"), F.col("c.raw").alias("raw"), F.when(F.col("c.quote") != "", F.col("c.quote")).alias("quote"))


def parse_error(answer: Column | str) -> Column:
    """Whether an answer can't be parsed: malformed citations, bad identifiers or a page below 1."""
    a = col(answer)
    ids, pages = F.regexp_extract_all(a, F.lit(CITATION), F.lit(1)), F.regexp_extract_all(a, F.lit(CITATION), F.lit(2))
    return (F.size(malformed(a)) > 0) | F.exists(ids, lambda x: ~is_base_id(base_id(x))) | F.exists(pages, lambda p: p.rlike(r"^0+\z"))


def needs_repair(answer: Column | str) -> Column:
    """Whether a repair should be tried: no or broken citations, or one without a quote. Blank answers need none."""
    a = col(answer)
    unquoted = F.exists(_tails(a), lambda t: ~t.rlike(QUOTE) | (normalize_space(F.regexp_extract(t, QUOTE, 1)) == ""))
    blank = F.coalesce(normalize_space(a), F.lit("")) == ""
    return F.when(blank, False).otherwise(parse_error(a) | (F.size(citation_texts(a)) == 0) | unquoted)


#: Stands between sentences while they are divided; no character of any text (a noncharacter of Unicode).
_BETWEEN = "\uffff"


def _spans(text: Column, parts: Column, gaps: Column) -> Column:
    """Parts with their places, from the parts and the lengths of what stands behind each: `part, start, end`."""
    steps = F.transform(parts, lambda p, i: F.length(p) + F.coalesce(F.get(gaps, i), F.lit(0)))
    return F.transform(parts, lambda p, i: F.struct(p.alias("part"), F.aggregate(F.slice(steps, 1, i), F.lit(0), lambda s, n: s + n).alias("start")))


def paragraph_spans(answers: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """`key, paragraph_index, text, start_char, end_char, part`: parts between blank lines that hold text.

    Places count code points of the answer as it is, `part` is what stands there, `text` the same in one line. Null and
    blank answers have none.
    """
    a, blank = F.col(answer), r"\n\s*\n+"
    gaps = F.transform(F.regexp_extract_all(a, F.lit(blank), F.lit(0)), lambda g: F.length(g))
    found = F.filter(_spans(a, F.split(a, blank), gaps), lambda s: normalize_space(s["part"]) != "")
    rows = answers.where(a.isNotNull()).select(key, F.posexplode(found).alias("paragraph_index", "s"))
    return rows.select(key, "paragraph_index", normalize_space("s.part").alias("text"), F.col("s.start").alias("start_char"), (F.col("s.start") + F.length("s.part")).alias("end_char"), F.col("s.part").alias("part"))


def sentence_spans(answers: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """`key, sentence_index, text, start_char, end_char`: sentences of the answer in one line and their places in that line.

    A sentence ends at a full stop, question or exclamation mark with quotes or asterisks behind it, before a
    blank and a capital, digit or opening bracket.
    """
    line = normalize_space(answer)
    parts = F.split(F.regexp_replace(line, r"""([.!?]["'*]*) (?=[\p{Lu}\p{Nd}\[])""", "$1" + _BETWEEN), _BETWEEN)
    found = _spans(line, parts, F.transform(parts, lambda _: F.lit(1)))
    rows = answers.where(F.coalesce(line, F.lit("")) != "").select(key, F.posexplode(found).alias("sentence_index", "s"))
    return rows.select(key, "sentence_index", F.col("s.part").alias("text"), F.col("s.start").alias("start_char"), (F.col("s.start") + F.length("s.part")).alias("end_char"))


def paragraphs(answers: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """`key, paragraph_index, text, n_citations`: parts between blank lines that hold text."""
    return paragraph_spans(answers, key, answer).select(key, "paragraph_index", "text", F.size(citation_texts("part")).alias("n_citations"))


def sentence_map(answers: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """`key, sentence_index, text, citations`: sentences of the answer in one line and the citations within each."""
    rows = sentence_spans(answers, key, answer).select(key, "sentence_index", "text").withColumn("k", F.size(citation_texts("text")))
    w = Window.partitionBy(key).orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("k").over(w), F.lit(0)).cast("int")
    numbers = F.when(F.col("k") > 0, F.transform(F.sequence(before + 1, before + F.col("k")), lambda i: F.concat(F.lit("c"), i))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, "sentence_index", "text", numbers.alias("citations"))


def locate(citations: DataFrame, pages: DataFrame, key: str = "answer_id") -> DataFrame:
    """Citations with `has_page, quote_start, quote_end`: the first place of the quote in the page text in one line.

    `pages` has `paper_id, page_number, text`; papers are compared in lower case.
    """
    texts = pages.groupBy(F.lower("paper_id").alias("p"), F.col("page_number").alias("pg")).agg(F.min(normalize_space("text")).alias("page_text"))
    joined = citations.join(texts, (F.lower("paper_id") == F.col("p")) & (F.col("page_number") == F.col("pg")), "left")
    at = F.instr(F.col("page_text"), F.col("quote"))
    start = F.when(F.col("quote").isNotNull() & (at > 0), at - 1)
    return joined.select(*citations.columns, F.col("page_text").isNotNull().alias("has_page"), start.alias("quote_start"), (start + F.length("quote")).alias("quote_end"))


def validate(citations: DataFrame, papers: DataFrame, key: str = "answer_id") -> DataFrame:
    """`key, citation_id, code` of what is wrong with single citations, each code once.

    invalid_paper_id stops there; unknown_paper_id and missing_page_count may both hold, page_out_of_range needs a page
    below 1 or above the paper's. `papers` has `paper_id, total_pages`; identifiers are compared in lower case.
    """
    known = papers.groupBy(F.lower("paper_id").alias("p")).agg(F.max("total_pages").alias("last"), F.lit(True).alias("known"))
    c = citations.join(known, F.lower("paper_id") == F.col("p"), "left")
    valid = F.coalesce(is_base_id("paper_id"), F.lit(False))
    outside = (F.col("page_number") < 1) | (F.col("page_number") > F.col("last"))
    codes = F.when(~valid, F.array(F.lit("invalid_paper_id"))).otherwise(F.array_compact(F.array(F.when(F.col("known").isNull(), "unknown_paper_id"), F.when(F.col("last").isNull(), "missing_page_count"), F.when(F.coalesce(outside, F.lit(False)), "page_out_of_range"))))
    return c.select(key, "citation_id", F.explode(codes).alias("code"))


def verify(answers: DataFrame, papers: DataFrame, pages: DataFrame, key: str = "answer_id", answer: str = "answer", known_pages: DataFrame | None = None, broken_files: DataFrame | None = None) -> DataFrame:
    """`key, status, codes`: pass, or fail with the sorted codes of what is wrong.

    Malformed citations stop the check, then citations of papers or pages that are not known; otherwise missing
    quotes, missing page texts, quotes that are not on their page and paragraphs without a citation all count.
    `papers` has `paper_id`; `pages` has `paper_id, page_number, text`; `known_pages` (`paper_id, page_number`) are the
    pages that may be cited, those of `pages` if None; a known page without text is missing_parsed_file where its
    paper has none at all, invalid_parsed_json where `broken_files` (`paper_id`) names it, else missing_page_text.
    Blank answers pass.
    """
    flagged = answers.select(key, F.col(answer).alias("answer"), F.coalesce(parse_error(answer), F.lit(False)).alias("broken"))
    cites = parsed(flagged.where(~F.col("broken")), key, "answer")
    known = papers.select(F.lower("paper_id").alias("p")).distinct().withColumn("known", F.lit(True))
    at = locate(cites, pages, key).join(known, F.lower("paper_id") == F.col("p"), "left")
    if known_pages is None:
        at = at.withColumn("citable", F.col("has_page")).withColumn("gap", F.lit(None).cast("string"))
    else:
        may = known_pages.select(F.lower("paper_id").alias("kp"), F.col("page_number").alias("kg")).distinct().withColumn("may", F.lit(True))
        some = pages.select(F.lower("paper_id").alias("sp")).distinct().withColumn("some", F.lit(True))
        bad = (broken_files if broken_files is not None else papers.limit(0)).select(F.lower("paper_id").alias("bp")).distinct().withColumn("bad", F.lit(True))
        low = F.lower("paper_id")
        at = at.join(may, (low == F.col("kp")) & (F.col("page_number") == F.col("kg")), "left").join(some, low == F.col("sp"), "left").join(bad, low == F.col("bp"), "left")
        gap = F.when(F.col("has_page"), None).when(F.col("bad"), "invalid_parsed_json").when(F.col("some").isNull(), "missing_parsed_file").otherwise("missing_page_text")
        at = at.withColumn("citable", F.col("may").isNotNull()).withColumn("gap", gap)
    per = at.groupBy(key).agg(
        F.bool_or(F.col("known").isNull() | ~F.col("citable")).alias("unresolved"),
        F.bool_or(F.col("quote").isNull()).alias("unquoted"),
        F.bool_or(F.col("quote").isNotNull() & F.col("has_page") & F.col("quote_start").isNull()).alias("lost"),
        F.collect_set("gap").alias("gaps"),
    )
    bare = paragraphs(flagged.where(~F.col("broken")), key, "answer").groupBy(key).agg(F.bool_or(F.col("n_citations") == 0).alias("bare"))
    rows = flagged.join(per, key, "left").join(bare, key, "left")
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    later = F.array_compact(F.array(F.when(off("bare"), "missing_paragraph_citation"), F.when(off("unquoted"), "missing_quote"), F.when(off("lost"), "quote_not_found")))
    later = F.array_sort(F.concat(later, F.coalesce("gaps", F.array().cast("array<string>"))))
    codes = F.when(F.col("broken"), F.array(F.lit("malformed_citation"))).when(off("unresolved"), F.array(F.lit("unresolved_citation"))).otherwise(later)
    return rows.select(key, F.when(F.size(codes) == 0, "pass").otherwise("fail").alias("status"), codes.alias("codes"))


def _overlap(normal: Column, tokens: Column, text: Column) -> Column:
    """1 where the text holds the quote, else the share of its words that the text has."""
    chunk = F.lower(normalize_space(text))
    have = overlap_words(chunk)
    return F.when(F.contains(chunk, normal), 1.0).otherwise(F.size(F.filter(tokens, lambda t: F.array_contains(have, t))) / F.size(tokens))


def sentence_snippet(answer: Column, raw: Column, n: Column) -> Column:
    """The sentence around the n-th citation `raw`, without citations, or null where it is blank.

    It reaches from the last `.`, `!`, `?` or line end before the citation to the next one after it.
    """
    parts = F.split(answer, CITATION)
    marks = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(0))
    before = F.array_join(F.concat(*[F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, F.array(F.get(parts, i - 1), F.get(marks, i - 1))).otherwise(F.array(F.get(parts, i - 1)))))]), "")
    after = F.array_join(F.flatten(F.transform(F.sequence(n, F.size(parts) - 1), lambda i: F.when(i == n, F.array(F.get(parts, i))).otherwise(F.array(F.get(marks, i - 1), F.get(parts, i))))), "")
    left = F.regexp_extract(before, r"(?s)([^.!?\n]*)\z", 1)
    right = F.regexp_extract(after, r"(?s)^([^.!?\n]*)", 1)
    flat = normalize_space(F.regexp_replace(F.regexp_replace(F.concat(left, right), CITATION, ""), r'(?i)\*"quote"\\*', ""))
    return F.when(flat != "", flat)


def remap(answers: DataFrame, context: DataFrame, key: str = "answer_id", answer: str = "answer") -> DataFrame:
    """`key, citation_id, paper_id, page_number, best_uid, score`: the context chunk that supports each citation best.

    `context` has `key, rank, chunk_uid, paper_id, page_number, text`. With a quote its words are compared and a
    score of 0.6 is needed; without one the words of the sentence around the citation (three or more) and 0.25.
    Ties go to the earlier rank; below the need `best_uid` and `score` are null. Answers that can't be parsed have none.
    """
    fine = answers.where(~F.coalesce(parse_error(answer), F.lit(True)))
    cites = parsed(fine, key, answer).join(fine.select(key, F.col(answer).alias("_a")), key)
    said = F.when(F.col("quote").isNotNull(), F.lower(normalize_space("quote"))).otherwise(F.lower(sentence_snippet(F.col("_a"), F.col("raw"), F.col("n"))))
    cites = cites.withColumn("said", said)
    toks = F.when(F.col("quote").isNotNull(), overlap_words("said")).otherwise(snippet_words("said"))
    cites = cites.withColumn("toks", toks).withColumn("usable", F.coalesce(F.when(F.col("quote").isNotNull(), F.size("toks") > 0).otherwise(F.size("toks") >= 3), F.lit(False)))
    ctx = context.select(key, "rank", F.col("chunk_uid").alias("uid"), F.col("text").alias("chunk_text"))
    pairs = cites.where("usable").join(ctx, key).withColumn("score", _overlap(F.col("said"), F.col("toks"), F.coalesce("chunk_text", F.lit(""))))
    need = F.when(F.col("quote").isNotNull(), MIN_QUOTE_OVERLAP).otherwise(MIN_SNIPPET_OVERLAP)
    best = pairs.where((F.col("score") >= need) & (F.col("score") > 0)).groupBy(key, "n").agg(F.max_by(F.struct("uid", "score"), F.struct("score", -F.col("rank"))).alias("b"))
    return cites.join(best, [key, "n"], "left").select(key, "citation_id", "paper_id", "page_number", F.col("b.uid").alias("best_uid"), F.col("b.score").alias("score"))


def rewrite(answer: Column, targets: Column) -> Column:
    """The answer with its n-th citation replaced by the n-th of `targets` where that is not null."""
    parts, marks = F.split(answer, CITATION), citation_texts(answer)
    pieces = F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(targets, i), F.get(marks, i), F.lit(""))))
    return F.array_join(pieces, "")


def map_chunk_citations(answer: Column | str, labels: Column | str) -> Column:
    """`[chunk:N]` replaced by the N-th of `labels`; numbers out of range stay as they are."""
    a, l = col(answer), col(labels)
    parts, marks = F.split(a, CHUNK_CITATION), F.regexp_extract_all(a, F.lit(CHUNK_CITATION), F.lit(0))
    numbers = F.regexp_extract_all(a, F.lit(CHUNK_CITATION), F.lit(1))
    label = lambda i: F.get(l, F.get(numbers, i).try_cast("int") - 1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.when(F.get(numbers, i).try_cast("int") >= 1, label(i)), F.get(marks, i), F.lit("")))), "")



