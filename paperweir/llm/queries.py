"""Queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.llm import bpe, knn, leakage, lookalike, pairs, sentences
from paperweir.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose embeddings are among each other's ten most similar, from a cosine of 0.9."""
    pairs = knn.similar_pairs(table(spark, d, "chunks"))
    return pairs.select(pairs.a.alias("chunk_id_a"), pairs.b.alias("chunk_id_b"))


def p3_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose id is divisible by 20, by greedy search in the neighbour graph."""
    found = knn.search_similar(table(spark, d, "chunks"))
    return found.select(F.col("query_id"), "rank", F.col("id").alias("chunk_id"), F.round("cosine", 6).alias("cosine"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks, and of papers, whose texts look the same but differ in their characters."""
    chunks = lookalike.lookalikes(table(spark, d, "chunks"), "chunk_uid", "text")
    papers = lookalike.lookalikes(table(spark, d, "papers"), "paper_id", "abstract")
    return chunks.select(F.lit("chunks.text").alias("field_name"), "key_a", "key_b").unionByName(papers.select(F.lit("papers.abstract").alias("field_name"), "key_a", "key_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same as classes: a row for each chunk, and paper, whose text has variants that look the same."""
    chunks = lookalike.look_classes(table(spark, d, "chunks"), "chunk_uid", "text").withColumn("field_name", F.lit("chunks.text"))
    papers = lookalike.look_classes(table(spark, d, "papers"), "paper_id", "abstract").withColumn("field_name", F.lit("papers.abstract"))
    return chunks.unionByName(papers)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Eval items with a broken answer and the sort of its defect, the first that the rules name."""
    return p5_defects(spark, d).where("place = 1").select("query_id", "defect")


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    """As p5_found, with every defect that the rules name, in their order."""
    return pairs.pair_defects(table(spark, d, "eval_set"), "query_id", "query", "reference_answer").withColumnRenamed("key", "query_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the held-out items whose wording they contain."""
    return p7_spans(spark, d).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """As p7_found, with the place of the first shared run in the document."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))
    return found.select(F.col("k").alias("doc_id"), F.col("item").alias("item_id"), "start_char", "end_char")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Places of the sentences of every document."""
    return sentences.split_sentences(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {
        "p3_found": p3_found,
        "p3_search": p3_search,
        "p4_found": p4_found,
        "p4_classes": p4_classes,
        "p5_found": p5_found,
        "p5_defects": p5_defects,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_spans": p7_spans,
        "p8_found": p8_found,
    }


# Words are runs of letters and digits, in lower case, after hyphens at line ends; runs of 13 words, or of all of a shorter item.
P7_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(item_text, '[-\x{2010}\x{AD}]\r?\n', '', 'g')), '[\p{L}\p{N}]+') AS w FROM heldout_items WHERE item_text IS NOT NULL),
isz AS (SELECT item_id, w, least(13, len(w)) AS n FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM isz)),
dw AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[-\x{2010}\x{AD}]\r?\n', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) AS k FROM dw, (SELECT DISTINCT n FROM isz)))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig ON dg.n = ig.n AND dg.g = ig.g
"""


# All pairs of usable vectors, each ranked for both of its ends.
P3_SQL = """
WITH usable AS (SELECT min(chunk_id) AS id, arg_min(embedding, chunk_id)::DOUBLE[] AS v FROM chunks
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND chunk_id IS NOT NULL AND chunk_uid IS NOT NULL GROUP BY chunk_uid),
sized AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM usable),
sims AS (SELECT a.id AS x, b.id AS y, least(list_dot_product(a.v, b.v) / (a.n * b.n), 1.0) AS sim FROM sized a JOIN sized b ON a.id <> b.id),
best AS (SELECT x, y FROM sims WHERE sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) <= 10)
SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM best
"""


def _sql_looks(text: str) -> str:
    """The look of a text in SQL: characters translated or removed by the operator's table, Latin and lam-alef ligatures replaced."""
    table = lookalike.looks_table()
    one = {chr(c): v for c, v in table.items() if v is not None and len(v) == 1 and not 0xD800 <= c <= 0xDFFF and c < 0x10000}
    gone = [chr(c) for c, v in table.items() if v is None and c != 0x200D and c < 0x10000]
    several = {chr(c): v for c, v in table.items() if v is not None and len(v) > 1 and (c < 0x2180 or 0xFB00 <= c <= 0xFB06 or 0xFEF5 <= c <= 0xFEFC)}
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"nfc_normalize({text})"
    for c, v in several.items():
        out = f"replace({out}, {quoted(c)}, {quoted(v)})"
    out = f"translate({out}, {quoted(''.join(one) + ''.join(gone))}, {quoted(''.join(one.values()))})"
    joined = r"'([\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}])\x{200D}([\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}])'"  # a joiner between pictures shows
    return rf"nfc_normalize(replace(replace(regexp_replace(regexp_replace({out}, {joined}, '\1' || chr(1) || '\2', 'g'), {joined}, '\1' || chr(1) || '\2', 'g'), chr(8205), ''), chr(1), chr(57344)))"


P4_ROWS = f"""
WITH rows AS (
  SELECT DISTINCT 'chunks.text' AS field_name, chunk_uid AS key, text, {_sql_looks('text')} AS look FROM chunks WHERE chunk_uid IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT DISTINCT 'papers.abstract', paper_id, abstract, {_sql_looks('abstract')} FROM papers WHERE paper_id IS NOT NULL AND abstract IS NOT NULL
)
"""
P4_SQL = P4_ROWS + """SELECT DISTINCT a.field_name, a.key AS key_a, b.key AS key_b FROM rows a JOIN rows b ON a.field_name = b.field_name AND a.look = b.look AND a.key < b.key AND a.text <> b.text"""
P4_CLASSES = P4_ROWS + """, classes AS (
  SELECT field_name, look, min(key) AS class_key, count(DISTINCT text) AS n_texts, count(DISTINCT key) AS n_keys FROM rows GROUP BY ALL HAVING count(DISTINCT text) > 1
)
SELECT DISTINCT field_name, key, class_key, n_texts, n_keys FROM rows JOIN classes USING (field_name, look)"""

P3_SEARCH = P3_SQL.split("best AS")[0].rstrip().rstrip(",") + """,
reps AS (SELECT min(id) AS id FROM usable GROUP BY v),
found AS (SELECT x AS query_id, y AS chunk_id, sim FROM sims JOIN reps ON reps.id = sims.y WHERE x % 20 = 0 AND sim >= 0.9)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank, chunk_id, round(sim, 6) AS cosine FROM found QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL. The other llm operators are tested against brute force or public encoders instead."""
    return {"p3_found": P3_SQL, "p3_search": P3_SEARCH, "p4_found": P4_SQL, "p4_classes": P4_CLASSES, "p7_found": P7_SQL}
