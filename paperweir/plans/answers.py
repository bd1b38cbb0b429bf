"""Queries on answers: citations, quotes, coverage, verification, remapping and prompts.

Answers are made from the chunks: the text, then a citation of its page with the first eight words as quote.
By chunk id every seventh each has a malformed citation, page 0, a wrong quote, no quote, a second paragraph
without a citation, or a second citation of the next page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweir.functions import json_text, text
from paperweir.operators import citations, evalgen, prompting, providers
from paperweir.plans import base
from paperweir.sources.tables import table


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c = base.chunks(spark, d)
    flat = text.normalize_space("text")
    paper = text.strip("paper_id")
    quote = F.concat(F.lit('*"'), F.array_join(F.slice(F.split(flat, " "), 1, 8), " "), F.lit('"*'))
    cite = lambda page: F.concat(F.lit("[arXiv:"), paper, F.lit(" p."), page.cast("string"), F.lit("]"))
    here, k = cite(F.col("page_number")), F.col("chunk_id") % 7
    answer = (
        F.when(k == 1, F.concat(flat, F.lit(" [arXiv:"), paper, F.lit(" page 1] "), quote))
        .when(k == 2, F.concat(flat, F.lit(" "), cite(F.lit(0)), F.lit(" "), quote))
        .when(k == 3, F.concat(flat, F.lit(" "), here, F.lit(' *"no such words stand here"*')))
        .when(k == 4, F.concat(flat, F.lit(" "), here))
        .when(k == 5, F.concat(flat, F.lit(" "), here, F.lit(" "), quote, F.lit("\n\nA second paragraph.")))
        .when(k == 6, F.concat(flat, F.lit(" "), here, F.lit(" "), quote, F.lit(" "), cite(F.col("page_number") + 1), F.lit(" "), quote))
        .otherwise(F.concat(flat, F.lit(" "), here, F.lit(" "), quote))
    )
    return c.select(F.col("chunk_id").alias("answer_id"), answer.alias("answer"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Page texts, joined from chunks in their order."""
    rows = base.chunks(spark, d).select(F.lower(text.strip("paper_id")).alias("paper_id"), "page_number", "chunk_index", "chunk_id", "text")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))), lambda s: s["text"])
    return rows.groupBy("paper_id", "page_number").agg(F.array_join(ordered, "\n").alias("text"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    """For each answer the chunks of its page of its document, by their index."""
    c = base.chunks(spark, d).select("doc_id", "page_number", "chunk_id", "chunk_index", "chunk_uid", text.strip("paper_id").alias("paper_id"), "text")
    mine = c.select("doc_id", "page_number", F.col("chunk_id").alias("answer_id"))
    w = Window.partitionBy("answer_id").orderBy("chunk_index", "chunk_id")
    return mine.join(c, ["doc_id", "page_number"]).withColumn("rank", F.row_number().over(w)).select("answer_id", "rank", "chunk_uid", "paper_id", "page_number", "text")


def citation_parse(spark: SparkSession, d: str) -> DataFrame:
    """Citations of every answer and the quote behind each."""
    return citations.parsed(_answers(spark, d)).select("answer_id", "citation_id", "paper_id", "page_number", "quote")


def citation_malformed(spark: SparkSession, d: str) -> DataFrame:
    """Malformed citations of every answer, and whether it needs a repair."""
    return _answers(spark, d).select("answer_id", F.size(citations.malformed("answer")).alias("n_malformed"), citations.needs_repair("answer").alias("needs_repair"))


def quote_locate(spark: SparkSession, d: str) -> DataFrame:
    """Where the quotes stand on their pages."""
    at = citations.locate(citations.parsed(_answers(spark, d)), _pages(spark, d))
    return at.select("answer_id", "citation_id", "has_page", "quote_start", "quote_end")


def paragraph_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of every answer and their citations."""
    return citations.paragraphs(_answers(spark, d)).select("answer_id", "paragraph_index", F.sha1("text").alias("text_sha1"), "n_citations")


def sentence_map(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every answer and the citations in them."""
    return citations.sentence_map(_answers(spark, d)).withColumn("citations", F.array_join("citations", ","))


def paragraph_spans(spark: SparkSession, d: str) -> DataFrame:
    """Places of the paragraphs of every answer."""
    return citations.paragraph_spans(_answers(spark, d)).select("answer_id", "paragraph_index", "start_char", "end_char", F.sha1("text").alias("text_sha1"))


def sentence_spans(spark: SparkSession, d: str) -> DataFrame:
    """Places of the sentences of every answer, in the answer in one line."""
    return citations.sentence_spans(_answers(spark, d)).select("answer_id", "sentence_index", "start_char", "end_char", F.sha1("text").alias("text_sha1"))


def openings_plan(spark: SparkSession, d: str) -> DataFrame:
    """All openings that questions can be given, in their turn, for each of three seeds."""
    return spark.createDataFrame([(seed, i, o) for seed in range(3) for i, o in enumerate(evalgen.openings_plan(evalgen.ROUNDS * sum(map(len, evalgen.OPENINGS)), seed), 1)], "seed int, pos int, opening string")


def questions_parse(spark: SparkSession, d: str) -> DataFrame:
    """Questions read from outputs that are a list, a list within prose, or an object; one in five has no answer and is dropped."""
    c = base.chunks(spark, d).select("chunk_id", "token_count", F.coalesce(F.col("chunk_index").cast("string"), F.lit("0")).alias("i"))
    answer = F.when(F.col("chunk_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("A "), F.col("i")))
    one = F.concat(F.lit('{"question": " Q '), F.col("i"), F.lit('? ", "expected_answer": "'), answer, F.lit('", "difficulty": "Factual"}, {"question": "Why?", "expected_answer": "So.", "difficulty": "hard"}'))
    said = F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("["), one, F.lit("]"))).when(F.col("chunk_id") % 3 == 1, F.concat(F.lit("Here they are: ["), one, F.lit("] I hope it helps"))).otherwise(F.concat(F.lit('{"items": ['), one, F.lit("]}")))
    return c.select("chunk_id", F.explode(json_text.generated_questions(said)).alias("q")).select("chunk_id", "q.question", "q.expected_answer", "q.difficulty")


def verify_report(spark: SparkSession, d: str) -> DataFrame:
    """Whether every answer stands, and what is wrong if not."""
    papers = table(spark, d, "papers").select("paper_id")
    return citations.verify(_answers(spark, d), papers, _pages(spark, d)).withColumn("codes", F.array_join("codes", ","))


def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with single citations, by the page counts of papers."""
    papers = base.papers(spark, d).select("paper_id", "total_pages")
    return citations.validate(citations.parsed(_answers(spark, d)), papers)


def citation_remap(spark: SparkSession, d: str) -> DataFrame:
    """The chunk of the context that supports each citation best."""
    out = citations.remap(_answers(spark, d), _context(spark, d))
    return out.select("answer_id", "citation_id", "best_uid", F.round("score", 6).alias("score"))


def chunk_citation_map(spark: SparkSession, d: str) -> DataFrame:
    """Citations by place in the context, as citations of pages."""
    labels = _context(spark, d).groupBy("answer_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "paper_id", "page_number"))), lambda s: F.concat(F.lit("[arXiv:"), s["paper_id"], F.lit(" p."), s["page_number"], F.lit("]"))).alias("labels"))
    said = labels.withColumn("answer", F.concat(F.lit("First [chunk:1], then [Chunk:2] and [chunk:99]; page "), F.size("labels").cast("string")))
    return said.select("answer_id", citations.map_chunk_citations("answer", "labels").alias("mapped"))


def answer_keys(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the context's uids of every answer."""
    return providers.answer_key(_context(spark, d), "answer_id")


def selection_parse(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read from outputs that should be JSON, some within prose, some without any JSON."""
    page, index, k = (F.col(c).cast("string") for c in ("page_number", "chunk_index", "token_count"))
    said = (
        F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit('{"selected": ['), page, F.lit(', "'), index, F.lit('", 1, 1]}')))
        .when(F.col("chunk_id") % 3 == 1, F.concat(F.lit('Here: {"selected": ["'), page, F.lit('"]} done ')))
        .otherwise(F.concat(F.lit("I choose "), page, F.lit(" and "), index, F.lit("; not "), F.coalesce(k, F.lit("none"))))
    )
    c = base.chunks(spark, d).select("chunk_id", json_text.selection_indices(said, 10).alias("indices"))
    return c.select("chunk_id", F.array_join("indices", ",").alias("indices"), F.array_join(json_text.evidence("indices", 2), ",").alias("evidence"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Digest and length of the prompt of every answer's context."""
    lists = prompting.format_chunks(prompting.valid_context(_context(spark, d)), "answer_id").withColumnRenamed("chunks", "prompt")
    return lists.select("answer_id", F.sha2("prompt", 256).alias("prompt_sha256"), F.length("prompt").alias("n_chars"))


def answer_stub(spark: SparkSession, d: str) -> DataFrame:
    """Answers of the stand-in model to every eval question, from the text of its first true chunk."""
    i = base.items(spark, d).select("query_id", "query", F.get("truth", F.lit(0)).alias("chunk_uid"))
    p = i.join(base.chunks(spark, d).select("chunk_uid", F.concat(F.lit("[arXiv:"), F.trim("paper_id"), F.lit(" p."), F.col("page_number"), F.lit("] "), F.col("text")).alias("prompt")), "chunk_uid")
    return providers.generate(p, providers.FirstChunk)


def embed_stub(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the stand-in model for every chunk."""
    out = providers.embed(base.chunks(spark, d), "chunk_id", "text", providers.HashedWords)
    return out.select("chunk_id", F.posexplode("embedding").alias("place", "value")).where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 5))


_FLAT, _PAPER = text.sql_normalize("text"), text.sql_strip("paper_id")
_QUOTE = f"""'*"' || array_to_string(string_split({_FLAT}, ' ')[1:8], ' ') || '"*'"""
_HERE = f"'[arXiv:' || {_PAPER} || ' p.' || page_number || ']'"
ANSWERS = f"""{base.SQL_CHUNKS}, ans AS (SELECT chunk_id AS answer_id, {_FLAT} || ' ' || CASE chunk_id % 7
  WHEN 1 THEN '[arXiv:' || {_PAPER} || ' page 1] ' || {_QUOTE} WHEN 2 THEN '[arXiv:' || {_PAPER} || ' p.0] ' || {_QUOTE} WHEN 3 THEN {_HERE} || ' *"no such words stand here"*' WHEN 4 THEN {_HERE}
  WHEN 5 THEN {_HERE} || ' ' || {_QUOTE} || chr(10) || chr(10) || 'A second paragraph.' WHEN 6 THEN {_HERE} || ' ' || {_QUOTE} || ' [arXiv:' || {_PAPER} || ' p.' || (page_number + 1) || '] ' || {_QUOTE}
  ELSE {_HERE} || ' ' || {_QUOTE} END AS answer FROM uchunks)"""
_C = citations.CITATION
_UNV = r"regexp_replace(regexp_replace({0}, '^(\d{{4}}\.\d{{4,5}})v\d+$', '\1'), '(?i)^([a-z-]+(?:\.[A-Z]{{2}})?/\d{{7}})v\d+$', '\1')"
PARSED = f"""{ANSWERS}, z AS (SELECT answer_id, answer, unnest(regexp_extract_all(answer, '{_C}', 1)) AS id, unnest(regexp_extract_all(answer, '{_C}', 2)) AS pg, unnest(range(len(regexp_extract_all(answer, '{_C}')))) AS i FROM ans),
q AS (SELECT *, string_split_regex(answer, '{_C}')[i + 2] AS tail FROM z),
par AS (SELECT answer_id, i + 1 AS n, 'c' || (i + 1) AS citation_id, {_UNV.format('id')} AS paper_id, CAST(pg AS INTEGER) AS page_number,
  CASE WHEN regexp_matches(tail, '{citations.QUOTE}') THEN nullif({text.sql_normalize(f"regexp_extract(tail, '{citations.QUOTE}', 1)")}, '') END AS quote FROM q)"""
_ODD = f"[x FOR x IN regexp_extract_all(answer, '{citations.LIKE_CITATION}') IF NOT regexp_full_match(x, '{_C}')]"
_DOUBLE = r"CAST(regexp_matches(answer, '(?i)\[\[arXiv:') AS INTEGER) + CAST(regexp_matches(answer, '(?i)arXiv:[^\]]*\]\]') AS INTEGER)"
_BROKEN = f"(len({_ODD}) + {_DOUBLE} > 0 OR len([p FOR p IN regexp_extract_all(answer, '{_C}', 2) IF regexp_full_match(p, '0+')]) > 0)"
_TAILS = f"string_split_regex(answer, '{_C}')[2:]"
_UNQUOTED = f"len([t FOR t IN {_TAILS} IF NOT regexp_matches(t, '{citations.QUOTE}') OR {text.sql_normalize(f"regexp_extract(t, '{citations.QUOTE}', 1)")} = '']) > 0"
PAGES = f"pgs AS (SELECT lower({_PAPER}) AS p, page_number AS pg, {text.sql_normalize('string_agg(text, chr(10) ORDER BY chunk_index, chunk_id)')} AS page_text FROM uchunks GROUP BY 1, 2)"
LOCATED = f"""{PARSED}, {PAGES}, loc AS (SELECT par.*, page_text IS NOT NULL AS has_page, CASE WHEN instr(page_text, quote) > 0 THEN instr(page_text, quote) - 1 END AS quote_start,
  CASE WHEN instr(page_text, quote) > 0 THEN instr(page_text, quote) - 1 + length(quote) END AS quote_end FROM par LEFT JOIN pgs ON lower(par.paper_id) = p AND par.page_number = pg)"""
_PARTS = rf"[x FOR x IN string_split_regex(answer, '\n\s*\n+') IF {text.sql_normalize('x')} <> '']"
CONTEXT = f"""{base.SQL_CHUNKS}, ctx AS (SELECT a.chunk_id AS answer_id, row_number() OVER (PARTITION BY a.chunk_id ORDER BY b.chunk_index, b.chunk_id) AS rank, b.chunk_uid, {_PAPER.replace('paper_id', 'b.paper_id')} AS paper_id, b.page_number, b.text
  FROM uchunks a JOIN uchunks b ON a.doc_id = b.doc_id AND a.page_number = b.page_number)"""
_CHUNK_LOW = f"lower({text.sql_normalize('c.text')})"
_HAVE = f"[w FOR w IN regexp_extract_all({_CHUNK_LOW}, '[a-z0-9]+') IF length(w) >= 2]"

_GAPS = r"regexp_extract_all(answer, '\n\s*\n+')"
_ALL = r"string_split_regex(answer, '\n\s*\n+')"
_OPENINGS = ", ".join(f"({g}, '{o}')" for g, group in enumerate(evalgen.OPENINGS) for o in group)
_EMBED_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

SQL = {
    "paragraph_spans": f"""WITH {ANSWERS}, g AS (SELECT answer_id, {_ALL} AS ps, {_GAPS} AS gs FROM ans), p AS (SELECT answer_id, unnest(ps) AS part, unnest(range(len(ps))) AS i, ps, gs FROM g),
      s AS (SELECT answer_id, part, i, coalesce(list_sum([length(ps[k + 1]) + length(gs[k + 1]) FOR k IN range(i)]), 0) AS start_char FROM p WHERE {text.sql_normalize('part')} <> '')
      SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY i) - 1 AS paragraph_index, start_char, start_char + length(part) AS end_char, sha1({text.sql_normalize('part')}) AS text_sha1 FROM s""",
    "sentence_spans": f"""WITH {ANSWERS}, n AS (SELECT answer_id, {text.sql_normalize('answer')} AS t FROM ans), p AS (SELECT answer_id, string_split(regexp_replace(t, '([.!?]["''*]*) ([\\p{{Lu}}\\p{{Nd}}\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM n WHERE t <> ''),
      s AS (SELECT answer_id, unnest(ps) AS text, unnest(range(len(ps))) AS sentence_index, ps FROM p)
      SELECT answer_id, sentence_index, coalesce(list_sum([length(ps[k + 1]) + 1 FOR k IN range(sentence_index)]), 0) AS start_char, coalesce(list_sum([length(ps[k + 1]) + 1 FOR k IN range(sentence_index)]), 0) + length(text) AS end_char, sha1(text) AS text_sha1 FROM s""",
    "openings_plan": f"""WITH o AS (SELECT * FROM (VALUES {_OPENINGS}) v(g, opening)), r AS (SELECT s.seed, r.round, g, opening, row_number() OVER (PARTITION BY s.seed, r.round, g ORDER BY md5(s.seed || ':' || r.round || ':' || opening)) AS i FROM o, (SELECT unnest(range(3)) AS seed) s, (SELECT unnest(range({evalgen.ROUNDS})) AS round) r)
      SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY round, i, g) AS pos, opening FROM r""",
    "questions_parse": f"WITH {base.SQL_CHUNKS} SELECT chunk_id, 'Q ' || coalesce(chunk_index, 0) || '?' AS question, 'A ' || coalesce(chunk_index, 0) AS expected_answer, 'factual' AS difficulty FROM uchunks WHERE chunk_id % 5 <> 0",
    "embed_stub": f"""WITH {base.SQL_CHUNKS}, w AS (SELECT chunk_id, md5(unnest({_EMBED_WORDS})) AS h FROM uchunks), d AS (SELECT chunk_id, CAST(('0x' || h[1:8]) AS BIGINT) % 64 AS place, sum(CASE WHEN h[9] > '7' THEN 1.0 ELSE -1.0 END) AS s FROM w GROUP BY ALL),
      n AS (SELECT chunk_id, sqrt(CAST(sum(s * s) AS DOUBLE)) AS n FROM d GROUP BY 1) SELECT d.chunk_id, place, round(CAST(CAST(s / n AS FLOAT) AS DOUBLE), 5) AS value FROM d JOIN n ON d.chunk_id = n.chunk_id WHERE s <> 0""",
    "answer_stub": f"""WITH {base.SQL_ITEMS}, {base.SQL_CHUNKS}, p AS (SELECT i.query_id, i.query, '[arXiv:' || trim(c.paper_id, ' ') || ' p.' || c.page_number || '] ' || c.text AS prompt FROM items i JOIN uchunks c ON i.truth[1] = c.chunk_uid)
      SELECT query_id, CASE WHEN regexp_matches(prompt, '\\[arXiv:\\S+ p\\.\\d+\\]') THEN query || ' ' || regexp_extract(prompt, '\\[arXiv:\\S+ p\\.\\d+\\]') || ' *"' || array_to_string(string_split({text.sql_normalize("substring(prompt, instr(prompt, regexp_extract(prompt, '\\[arXiv:\\S+ p\\.\\d+\\]')) + length(regexp_extract(prompt, '\\[arXiv:\\S+ p\\.\\d+\\]')))")}, ' ')[1:8], ' ') || '"*' ELSE 'I do not know.' END AS answer, CAST(NULL AS VARCHAR) AS error FROM p""",
    "citation_parse": f"WITH {PARSED} SELECT answer_id, citation_id, paper_id, page_number, quote FROM par",
    "citation_malformed": f"WITH {ANSWERS} SELECT answer_id, len({_ODD}) + {_DOUBLE} AS n_malformed, {_BROKEN} OR len(regexp_extract_all(answer, '{_C}')) = 0 OR {_UNQUOTED} AS needs_repair FROM ans",
    "quote_locate": f"WITH {LOCATED} SELECT answer_id, citation_id, has_page, quote_start, quote_end FROM loc",
    "paragraph_coverage": f"WITH {ANSWERS}, x AS (SELECT answer_id, unnest({_PARTS}) AS part, unnest(range(len({_PARTS}))) AS paragraph_index FROM ans) SELECT answer_id, paragraph_index, sha1({text.sql_normalize('part')}) AS text_sha1, len(regexp_extract_all(part, '{_C}')) AS n_citations FROM x",
    "sentence_map": f"""WITH {ANSWERS}, n AS (SELECT answer_id, {text.sql_normalize('answer')} AS t FROM ans), p AS (SELECT answer_id, string_split(regexp_replace(t, '([.!?]["''*]*) ([\\p{{Lu}}\\p{{Nd}}\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM n WHERE t <> ''),
      s AS (SELECT answer_id, unnest(ps) AS text, unnest(range(len(ps))) AS sentence_index FROM p), k AS (SELECT *, len(regexp_extract_all(text, '{_C}')) AS k FROM s),
      b AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY answer_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k)
      SELECT answer_id, sentence_index, text, array_to_string(['c' || i FOR i IN range(CAST(b + 1 AS BIGINT), CAST(b + k + 1 AS BIGINT))], ',') AS citations FROM b""",
    "verify_report": f"""WITH {LOCATED}, fl AS (SELECT answer_id, answer, {_BROKEN} AS broken FROM ans), known AS (SELECT DISTINCT lower(paper_id) AS p FROM papers),
      un AS (SELECT answer_id, bool_or(known.p IS NULL OR NOT has_page) AS unresolved, bool_or(quote IS NULL) AS unquoted, bool_or(quote IS NOT NULL AND has_page AND quote_start IS NULL) AS lost FROM loc LEFT JOIN known ON lower(loc.paper_id) = known.p GROUP BY 1),
      st AS (SELECT fl.answer_id, CASE WHEN broken THEN 'malformed_citation' WHEN coalesce(unresolved, false) THEN 'unresolved_citation'
        ELSE array_to_string([x FOR x IN [CASE WHEN len([y FOR y IN {_PARTS} IF NOT regexp_matches(y, '{_C}')]) > 0 THEN 'missing_paragraph_citation' END, CASE WHEN unquoted THEN 'missing_quote' END, CASE WHEN lost THEN 'quote_not_found' END] IF x IS NOT NULL], ',') END AS codes FROM fl LEFT JOIN un ON fl.answer_id = un.answer_id)
      SELECT answer_id, CASE WHEN codes = '' THEN 'pass' ELSE 'fail' END AS status, codes FROM st""",
    "citation_validate": f"""WITH {PARSED}, {base.SQL_PAPERS}, kn AS (SELECT lower(paper_id) AS p, max(total_pages) AS last FROM upapers GROUP BY 1),
      c AS (SELECT par.*, kn.p AS known, last, regexp_full_match(paper_id, '\\d{{4}}\\.\\d{{4,5}}|(?i:[a-z-]+(?:\\.[A-Z]{{2}})?/\\d{{7}})') AS valid FROM par LEFT JOIN kn ON lower(par.paper_id) = kn.p)
      SELECT answer_id, citation_id, 'invalid_paper_id' AS code FROM c WHERE NOT valid UNION ALL SELECT answer_id, citation_id, 'unknown_paper_id' FROM c WHERE valid AND known IS NULL
      UNION ALL SELECT answer_id, citation_id, 'missing_page_count' FROM c WHERE valid AND last IS NULL UNION ALL SELECT answer_id, citation_id, 'page_out_of_range' FROM c WHERE valid AND (page_number < 1 OR page_number > last)""",
    "citation_remap": f"""WITH {PARSED}, {CONTEXT[len(base.SQL_CHUNKS) + 2:]},
      parts AS (SELECT par.*, a.answer, string_split_regex(a.answer, '{_C}') AS ps, regexp_extract_all(a.answer, '{_C}') AS ms FROM par JOIN ans a ON par.answer_id = a.answer_id WHERE NOT {_BROKEN.replace('answer', 'a.answer')}),
      bef AS (SELECT *, array_to_string([CASE WHEN k % 2 = 0 THEN ps[k // 2 + 1] ELSE ms[k // 2 + 1] END FOR k IN range(2 * n - 1)], '') AS b, array_to_string([CASE WHEN k % 2 = 0 THEN ps[n + 1 + k // 2] ELSE ms[n + 1 + k // 2] END FOR k IN range(2 * (len(ps) - n) - 1)], '') AS f FROM parts),
      sn AS (SELECT *, nullif({text.sql_normalize(f"regexp_replace(regexp_extract(b, '([^.!?\\n]*)$', 1) || regexp_extract(f, '^([^.!?\\n]*)', 1), '{_C}', '', 'g')")}, '') AS snip FROM bef),
      sd AS (SELECT *, lower(CASE WHEN quote IS NOT NULL THEN quote ELSE snip END) AS said FROM sn),
      tk AS (SELECT *, CASE WHEN quote IS NOT NULL THEN [w FOR w IN regexp_extract_all(said, '[a-z0-9]+') IF length(w) >= 2] ELSE [w FOR w IN regexp_extract_all(said, '[a-z0-9]+') IF length(w) >= 3 AND NOT list_contains({text.sql_list(text.OVERLAP_STOPWORDS)}, w)] END AS toks FROM sd),
      pr AS (SELECT t.answer_id, t.n, c.rank, c.chunk_uid, t.quote, CASE WHEN contains({_CHUNK_LOW}, said) THEN 1.0 ELSE len([w FOR w IN toks IF list_contains({_HAVE}, w)]) / len(toks) END AS score
        FROM tk t JOIN ctx c ON t.answer_id = c.answer_id WHERE CASE WHEN t.quote IS NOT NULL THEN len(toks) > 0 ELSE len(toks) >= 3 END),
      best AS (SELECT * FROM pr WHERE score > 0 AND score >= CASE WHEN quote IS NOT NULL THEN 0.6 ELSE 0.25 END QUALIFY row_number() OVER (PARTITION BY answer_id, n ORDER BY score DESC, rank) = 1)
      SELECT p.answer_id, p.citation_id, b.chunk_uid AS best_uid, round(b.score, 6) AS score FROM parts p LEFT JOIN best b ON p.answer_id = b.answer_id AND p.n = b.n""",
    "chunk_citation_map": f"""WITH {CONTEXT}, l AS (SELECT answer_id, list('[arXiv:' || paper_id || ' p.' || page_number || ']' ORDER BY rank) AS ls FROM ctx GROUP BY 1)
      SELECT answer_id, 'First ' || ls[1] || ', then ' || coalesce(ls[2], '[Chunk:2]') || ' and ' || coalesce(ls[99], '[chunk:99]') || '; page ' || len(ls) AS mapped FROM l""",
    "answer_keys": f"WITH {CONTEXT} SELECT answer_id, sha256(string_agg(chunk_uid, chr(10) ORDER BY rank)) AS chunk_uids_hash FROM ctx GROUP BY 1",
    "prompts": f"""WITH {CONTEXT}, p AS (SELECT answer_id, string_agg('Chunk ' || rank || ': [arXiv:' || paper_id || ' p.' || page_number || '] (chunk_uid=' || chunk_uid || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS prompt FROM ctx GROUP BY 1)
      SELECT answer_id, sha256(prompt) AS prompt_sha256, length(prompt) AS n_chars FROM p""",
    "selection_parse": f"""WITH {base.SQL_CHUNKS}, s AS (SELECT chunk_id, CASE chunk_id % 3 WHEN 0 THEN [page_number, chunk_index, 1] WHEN 1 THEN [page_number] ELSE [page_number, chunk_index, token_count] END AS xs FROM uchunks),
      i AS (SELECT chunk_id, x, min(k) AS k FROM (SELECT chunk_id, unnest(xs) AS x, unnest(range(len(xs))) AS k FROM s) WHERE x BETWEEN 1 AND 10 GROUP BY ALL), r AS (SELECT uchunks.chunk_id, coalesce(list(x ORDER BY k) FILTER (x IS NOT NULL), []) AS xs FROM uchunks LEFT JOIN i ON uchunks.chunk_id = i.chunk_id GROUP BY 1)
      SELECT chunk_id, array_to_string(xs, ',') AS indices, array_to_string(([1] || [x FOR x IN xs IF x <> 1])[1:2], ',') AS evidence FROM r""",
}
QUERIES = {
    "citation_parse": citation_parse,
    "citation_malformed": citation_malformed,
    "quote_locate": quote_locate,
    "paragraph_coverage": paragraph_coverage,
    "sentence_map": sentence_map,
    "verify_report": verify_report,
    "citation_validate": citation_validate,
    "citation_remap": citation_remap,
    "chunk_citation_map": chunk_citation_map,
    "answer_keys": answer_keys,
    "selection_parse": selection_parse,
    "prompts": prompts,
    "paragraph_spans": paragraph_spans,
    "sentence_spans": sentence_spans,
    "openings_plan": openings_plan,
    "questions_parse": questions_parse,
    "answer_stub": answer_stub,
    "embed_stub": embed_stub,
}
