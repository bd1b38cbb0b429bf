"""Queries on text: cleaning, pages, chunks, identifiers, index tables and query compilation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions import ids, text
from paperweir.operators import chunking, evaluation, fulltext
from paperweir.plans import base
from paperweir.sources.tables import table

CONFIG = chunking.ChunkConfig(64, 16)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pages_by_lines(table(spark, d, "documents"), "doc_id", "text")


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of every document's cleaned text."""
    t = table(spark, d, "documents").select("doc_id", text.clean_text("text").alias("t"))
    return t.select("doc_id", F.length("t").alias("cleaned_len"), F.sha1("t").alias("cleaned_sha1"))


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that head or foot most pages of a document."""
    return chunking.repeated_lines(_pages(spark, d), "doc_id")


def strip_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pages without those lines."""
    out = chunking.strip_repeated_lines(_pages(spark, d), "doc_id")
    return out.select("doc_id", "page", "removed", F.sha1("text").alias("text_sha1"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Token windows of every page, with their uid."""
    return chunking.chunk_pages(_pages(spark, d), config=CONFIG).drop("text")


def chunk_uids(spark: SparkSession, d: str) -> DataFrame:
    """The uid of every chunk by the rule, and whether the table has it."""
    made = ids.chunk_uid(F.col("doc_id"), F.col("page_number"), F.col("chunk_index"), F.col("char_start"), F.col("char_end"))
    return table(spark, d, "chunks").select("chunk_id", made.alias("made_uid"), (made == F.col("chunk_uid")).alias("same"))


def id_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers as written, their base and whether that is valid."""
    raw = table(spark, d, "chunks").select(F.col("paper_id").alias("raw")).distinct()
    one = raw.withColumn("base_id", ids.base_id(ids.outer_trimmed("raw")))
    return one.withColumn("valid", ids.is_base_id("base_id"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Documents in one short line."""
    return table(spark, d, "documents").select("doc_id", text.snippet("text", 240).alias("snippet"))


def postings(spark: SparkSession, d: str) -> DataFrame:
    """Inverted index of the chunks."""
    return fulltext.postings(base.chunks(spark, d), "chunk_id").select("term", "chunk_id", "tf", F.array_join("positions", ",").alias("positions"))


def term_df(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every term."""
    return fulltext.term_df(fulltext.postings(base.chunks(spark, d), "chunk_id"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number of chunks and their mean length."""
    return fulltext.corpus_stats(base.chunks(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def query_compile(spark: SparkSession, d: str) -> DataFrame:
    """Required and optional terms of every eval question."""
    out = fulltext.compile_queries(base.items(spark, d))
    return out.select("query_id", F.array_join("required", " ").alias("required"), F.array_join("optional", " ").alias("optional"))


def question_keys(spark: SparkSession, d: str) -> DataFrame:
    """What logged questions are compared by, and whether they name an excerpt."""
    return table(spark, d, "query_log").select("query_id", text.question_key("query_text").alias("question_key"), text.names_excerpt("query_text").alias("names_excerpt")).distinct()


def reference_like(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that look like bibliographies, of all chunks."""
    return base.chunks(spark, d).select("chunk_uid", text.is_reference_like("text").alias("reference_like"))


def qa_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Chunks from which questions may be made."""
    return evaluation.candidates(base.chunks(spark, d)).select("chunk_uid", F.length("text").alias("n_chars"))


def qa_filter(spark: SparkSession, d: str) -> DataFrame:
    """Why eval questions would be rejected, against their first true chunk."""
    first = base.items(spark, d).select("query_id", F.col("query").alias("question"), F.col("reference_answer").alias("answer"), F.get(evaluation.truth_set("truth"), F.lit(0)).alias("chunk_uid"))
    return evaluation.question_filter(first.join(base.chunks(spark, d).select("chunk_uid", "text"), "chunk_uid", "left"))


PAGES = """lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, ls, unnest(range(CAST(ceil(len(ls) / 20.0) AS BIGINT))) AS p FROM lines),
pages AS (SELECT doc_id, CAST(p + 1 AS INTEGER) AS page, array_to_string(ls[p * 20 + 1 : p * 20 + 20], chr(10)) AS text FROM cut)"""
REPEATED = f"""{PAGES},
ends AS (SELECT DISTINCT doc_id, page, unnest([string_split(text, chr(10))[1], string_split(text, chr(10))[-1]]) AS line FROM pages WHERE text <> ''),
rep AS (SELECT e.doc_id, e.line, count(*) AS n FROM ends e WHERE line <> '' AND length(line) <= 120 GROUP BY e.doc_id, e.line
  HAVING count(*) >= ceil(CAST(0.6 AS DOUBLE) * (SELECT count(*) FROM pages p WHERE p.doc_id = e.doc_id)))"""
_TOKEN = r"[ \t\n\f\r]*[^ \t\n\f\r]+|[ \t\n\f\r]+$"
TOKENS = f"{base.SQL_CHUNKS}, tok AS (SELECT chunk_id, {text.sql_index_tokens('text')} AS ts FROM uchunks), tf AS (SELECT term, chunk_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM (SELECT chunk_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM tok) GROUP BY ALL)"
COMPILE = f"""{base.SQL_ITEMS},
qt AS (SELECT query_id, t, i, CASE WHEN length(t) >= 6 THEN 1 ELSE 0 END AS imp FROM (SELECT query_id, unnest(ts) AS t, unnest(range(len(ts))) AS i FROM (SELECT query_id, {text.sql_query_tokens('query')} AS ts FROM items WHERE query IS NOT NULL)) WHERE lower(t) NOT IN (SELECT unnest({text.sql_list(text.QUERY_STOPWORDS)}))),
req AS (SELECT query_id, t, i FROM qt WHERE imp = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY -length(t), i) <= 4),
opt AS (SELECT query_id, t, i FROM qt WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.query_id = qt.query_id AND r.t = qt.t))"""
_BASE_ID = r"regexp_replace(regexp_replace({0}, '^(\d{{4}}\.\d{{4,5}})v\d+$', '\1'), '(?i)^([a-z-]+(?:\.[A-Z]{{2}})?/\d{{7}})v\d+$', '\1')".format(text.sql_strip("raw"))
_CUES = " + ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER)" for p in text.REFERENCE_CUES)
_YEARS = f"len(regexp_extract_all(lower(text), '{text.REFERENCE_YEAR}'))"
REF_LIKE = f"(({_CUES}) >= 3 AND {_YEARS} >= 2 OR {_YEARS} >= 6 AND ({_CUES}) >= 2 OR ({_CUES}) >= 4 AND {_YEARS} >= 1)"
_CONTENT = "list_distinct([w FOR w IN {0} IF length(w) >= 3 AND NOT list_contains({1}, w)])"
_A, _C = (_CONTENT.format(text.sql_ascii(x), text.sql_list(text.OVERLAP_STOPWORDS)) for x in ("answer", "text"))
_EXCERPT = " OR ".join(f"contains(lower({text.sql_normalize('{0}')}), '{p}')" for p in text.CONTEXT_PHRASES)
_KEY = rf"regexp_replace(lower({text.sql_normalize('{0}')}), '[^\p{{{{L}}}}\p{{{{N}}}}_ ]', '', 'g')"


def _fill(template: str, x: str) -> str:
    return template.replace("{0}", x).replace("{{", "{").replace("}}", "}")


SQL = {
    "clean_text": f"WITH t AS (SELECT doc_id, {text.sql_clean('text')} AS t FROM documents) SELECT doc_id, length(t) AS cleaned_len, sha1(t) AS cleaned_sha1 FROM t",
    "repeated_lines": f"WITH {REPEATED} SELECT doc_id, line, n FROM rep",
    "strip_repeated_lines": f"""WITH {REPEATED}, sets AS (SELECT doc_id, list(line) AS rs FROM rep GROUP BY 1),
      kept AS (SELECT p.doc_id, page, text, rs, string_split(text, chr(10)) AS ls, [l FOR l IN string_split(text, chr(10)) IF NOT list_contains(rs, l)] AS ks FROM pages p LEFT JOIN sets s ON p.doc_id = s.doc_id)
      SELECT doc_id, page, CASE WHEN rs IS NULL OR text = '' THEN 0 ELSE len(ls) - len(ks) END AS removed, sha1(CASE WHEN rs IS NULL OR text = '' THEN text ELSE array_to_string(ks, chr(10)) END) AS text_sha1 FROM kept""",
    "chunk_windows": f"""WITH {PAGES}, t AS (SELECT doc_id, page, regexp_extract_all(text, '{_TOKEN}') AS ts FROM pages WHERE regexp_matches(text, '[^ \\t\\n\\f\\r]')),
      w AS (SELECT doc_id, page, ts, unnest(range(CASE WHEN len(ts) <= 64 THEN 1 ELSE 1 + CAST(ceil((len(ts) - 64) / 48.0) AS BIGINT) END)) AS i FROM t),
      c AS (SELECT doc_id, page AS page_number, i AS chunk_index, length(array_to_string(ts[1 : i * 48], '')) AS char_start, length(array_to_string(ts[1 : i * 48 + 64], '')) AS char_end, least(64, len(ts) - i * 48) AS token_count FROM w)
      SELECT doc_id, page_number, chunk_index, char_start, char_end, token_count, sha1(concat_ws(':', doc_id, page_number, chunk_index, char_start, char_end)) AS chunk_uid FROM c""",
    "chunk_uids": "WITH m AS (SELECT chunk_id, chunk_uid, sha1(concat_ws(':', doc_id, page_number, chunk_index, coalesce(char_start, -1), coalesce(char_end, -1))) AS made_uid FROM chunks) SELECT chunk_id, made_uid, made_uid = chunk_uid AS same FROM m",
    "id_normalize": rf"WITH r AS (SELECT DISTINCT paper_id AS raw FROM chunks), b AS (SELECT raw, {_BASE_ID} AS base_id FROM r) SELECT raw, base_id, regexp_full_match(base_id, '\d{{4}}\.\d{{4,5}}|(?i:[a-z-]+(?:\.[A-Z]{{2}})?/\d{{7}})') AS valid FROM b",
    "snippets": f"SELECT doc_id, {text.sql_snippet('text', 240)} AS snippet FROM documents",
    "postings": f"WITH {TOKENS} SELECT term, chunk_id, tf, positions FROM tf",
    "term_df": f"WITH {TOKENS} SELECT term, count(*) AS df FROM tf GROUP BY 1",
    "corpus_stats": f"WITH {TOKENS} SELECT count(*) AS n, round(avg(coalesce(len(ts), 0)), 6) AS avgdl FROM tok",
    "query_compile": f"""WITH {COMPILE} SELECT q.query_id, coalesce((SELECT string_agg(t, ' ' ORDER BY i) FROM req r WHERE r.query_id = q.query_id), '') AS required,
      coalesce((SELECT string_agg(t, ' ' ORDER BY i) FROM opt o WHERE o.query_id = q.query_id), '') AS optional FROM items q""",
    "question_keys": f"SELECT DISTINCT query_id, {_fill(_KEY, 'query_text')} AS question_key, {_fill(_EXCERPT, 'query_text')} AS names_excerpt FROM query_log",
    "reference_like": f"WITH {base.SQL_CHUNKS} SELECT chunk_uid, {REF_LIKE} AS reference_like FROM uchunks",
    "qa_candidates": f"WITH {base.SQL_CHUNKS} SELECT chunk_uid, length(text) AS n_chars FROM uchunks WHERE length(text) >= 200 AND NOT {REF_LIKE}",
    "qa_filter": f"""WITH {base.SQL_CHUNKS}, {base.SQL_ITEMS}, f AS (SELECT query_id, query AS question, reference_answer AS answer, [u FOR u IN truth IF u IS NOT NULL AND u <> ''][1] AS uid FROM items),
      g AS (SELECT f.*, c.text, row_number() OVER (PARTITION BY {_fill(_KEY, 'question')} ORDER BY query_id) AS n FROM f LEFT JOIN uchunks c ON f.uid = c.chunk_uid),
      h AS (SELECT *, {_A} AS a, {_C} AS c FROM g), k AS (SELECT *, len(a) AS na, len(list_intersect(a, c)) AS shared FROM h)
      SELECT query_id, CASE WHEN n > 1 THEN 'duplicate question in eval set' WHEN {_fill(_EXCERPT, 'question')} THEN 'question is not standalone'
        WHEN NOT coalesce(CASE WHEN na = 0 THEN false WHEN na <= 4 THEN shared >= 1 ELSE shared >= 2 AND shared / na >= 0.25 END, false) THEN 'expected answer is weakly grounded in chunk text' END AS reason FROM k""",
}
QUERIES = {
    "clean_text": clean_text,
    "repeated_lines": repeated_lines,
    "strip_repeated_lines": strip_repeated_lines,
    "chunk_windows": chunk_windows,
    "chunk_uids": chunk_uids,
    "id_normalize": id_normalize,
    "snippets": snippets,
    "postings": postings,
    "term_df": term_df,
    "corpus_stats": corpus_stats,
    "query_compile": query_compile,
    "question_keys": question_keys,
    "reference_like": reference_like,
    "qa_candidates": qa_candidates,
    "qa_filter": qa_filter,
}
