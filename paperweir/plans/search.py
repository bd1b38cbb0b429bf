"""Queries on retrieval: BM25, nearest vectors, fusion, reranking and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions import text
from paperweir.operators import evaluation, fulltext, fusion, vectors
from paperweir.plans import base, texts
from paperweir.session import cut
from paperweir.sources.tables import table


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The chunks, written once for a query that reads them several times."""
    return cut(base.chunks(spark, d).select("chunk_id", "chunk_uid", "paper_id", "page_number", "text", "embedding"), "chunks")


def _bm25(spark: SparkSession, d: str, k: int, chunks: DataFrame | None = None) -> DataFrame:
    c = base.chunks(spark, d) if chunks is None else chunks
    return fulltext.bm25_topk(base.items(spark, d).select("query_id", "query"), c.select("chunk_id", "text"), k)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best chunks of every eval question; relaxed where the strict query has none."""
    return _bm25(spark, d, 10).withColumn("score", F.round("score", 6))


def _examples(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    """Every eval item with the vector of its first true chunk."""
    first = base.items(spark, d).select("query_id", F.get(evaluation.truth_set("truth"), F.lit(0)).alias("chunk_uid"))
    return first.join(chunks.select("chunk_uid", F.col("embedding").alias("vector")), "chunk_uid").select("query_id", "vector")


def _vector_list(spark: SparkSession, d: str, k: int, chunks: DataFrame | None = None) -> DataFrame:
    c = base.chunks(spark, d) if chunks is None else chunks
    return vectors.exact_topk(_examples(spark, d, c), c, k, "cosine", "query_id", "vector", "chunk_id", "embedding")


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten chunks nearest to the vector of every eval item."""
    return _vector_list(spark, d, 10).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def _embedding_topk(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "embeddings")
        asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
        return vectors.exact_topk(asked, e, 10, metric).withColumn("distance", F.round("distance", 6) + F.lit(0.0))

    query.__doc__ = f"The ten nearest vectors by {metric} for every vector whose id is divisible by 20."
    return query


def vector_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """As cosine_topk, among the vectors of label 3."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return vectors.exact_topk(asked, e.where("label = 3"), 5).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    """Length of every chunk vector and of its normalised form."""
    c = vectors.usable(base.chunks(spark, d), "chunk_id", "embedding", 64)
    return c.select("chunk_id", F.round(vectors.norm("embedding"), 6).alias("norm"), F.round(vectors.norm(vectors.normalize("embedding")), 6).alias("unit"))


def _lists(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    a = _bm25(spark, d, 20, chunks).select("query_id", F.lit("fts").alias("backend"), "rank", "chunk_id", F.col("score").alias("raw_score"))
    b = _vector_list(spark, d, 20, chunks).select("query_id", F.lit("vector").alias("backend"), "rank", "chunk_id", F.col("distance").alias("raw_score"))
    return a.unionByName(b)


def _hybrid(spark: SparkSession, d: str, k: int = 10, chunks: DataFrame | None = None) -> DataFrame:
    return fusion.rrf(_lists(spark, d, _stored(spark, d) if chunks is None else chunks), k, {"fts": 1.0, "vector": 1.0})


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Full-text and vector results of every eval item, fused."""
    return _hybrid(spark, d).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"))


def rrf_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Which list gave each fused result how much."""
    each = _hybrid(spark, d).select("query_id", "chunk_id", F.explode("provenance").alias("p"))
    return each.select("query_id", "chunk_id", "p.backend", F.col("p.rank").alias("backend_rank"), F.round("p.normalized_score", 9).alias("normalized_score"), F.round("p.rrf_contribution", 9).alias("contribution"))


def _with_text(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored(spark, d)
    got = _hybrid(spark, d, chunks=stored).select("query_id", "rank", "chunk_id")
    c = stored.select("chunk_id", "chunk_uid", "paper_id", "page_number", "text")
    return got.join(c, "chunk_id").join(base.items(spark, d).select("query_id", "query"), "query_id")


def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Fused results ordered anew by the words they share with the question."""
    return fusion.rerank(_with_text(spark, d)).select("query_id", "new_rank", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"))


def generation_context(spark: SparkSession, d: str) -> DataFrame:
    """The five chunks that an answer would be made from."""
    return fusion.generation_context(_with_text(spark, d), 5).select("query_id", "new_rank", "chunk_uid")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored(spark, d)
    got = _hybrid(spark, d, chunks=stored).join(stored.select("chunk_id", "chunk_uid"), "chunk_id")
    return evaluation.retrieval_metrics(got, base.items(spark, d))


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall and reciprocal rank of every eval item."""
    return _metrics(spark, d).select("query_id", F.round("recall_at_5", 6).alias("recall_at_5"), F.round("recall_at_10", 6).alias("recall_at_10"), "first_correct_rank", F.round("mrr", 6).alias("mrr"))


def _citations(spark: SparkSession, d: str) -> DataFrame:
    """A citation of each paper that an item names, at the first of its pages."""
    z = base.items(spark, d).select("query_id", F.posexplode(F.arrays_zip(F.col("ground_truth.papers").alias("p"), F.col("ground_truth.pages").alias("g"))).alias("i", "z"))
    return z.select("query_id", F.concat(F.lit("c"), F.col("i") + 1).alias("citation_id"), F.col("z.p").alias("paper_id"), F.get("z.g", F.lit(0)).alias("page_number")).where(F.col("paper_id").isNotNull() & F.col("page_number").isNotNull())


def citation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of right citations of every eval item."""
    out = evaluation.citation_scores(base.items(spark, d), _citations(spark, d), base.chunks(spark, d))
    return out.withColumn("citation_accuracy", F.round("citation_accuracy", 6))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).join(evaluation.citation_scores(base.items(spark, d), _citations(spark, d), base.chunks(spark, d)), "query_id")


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over the eval set."""
    s = evaluation.summarize(_scored(spark, d))
    return s.select("n_queries", *[F.round(c, 6).alias(c) for c in s.columns if c != "n_queries"])


def eval_failures(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of failures over the eval set."""
    return evaluation.failures(_scored(spark, d))


def context_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Whether truth and citations are within the generation context."""
    # written once: pages and uids of the context are read each for itself
    ctx = cut(fusion.generation_context(_with_text(spark, d), 5).select("query_id", "chunk_uid", "paper_id", "page_number"), "context")
    return evaluation.context_diagnostics(base.items(spark, d), ctx, _citations(spark, d))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Papers that the eval set and the chunks name, as they write them, and that are not there."""
    named = base.items(spark, d).select(F.col("ground_truth.papers").alias("papers")).unionByName(table(spark, d, "chunks").select(F.array("paper_id").alias("papers")))
    return evaluation.coverage(named, base.papers(spark, d))


BM25 = f"""{texts.COMPILE}, {texts.TOKENS},
lens AS (SELECT chunk_id, len(ts) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
ph AS (SELECT query_id, role, {text.sql_index_tokens('t')}[1] AS term, count(*) AS mult FROM (SELECT query_id, 'required' AS role, t FROM req UNION ALL SELECT query_id, 'optional', t FROM opt) GROUP BY ALL),
sc AS (SELECT tf.term, tf.chunk_id, -(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s
  FROM tf JOIN dfs ON tf.term = dfs.term JOIN lens ON tf.chunk_id = lens.chunk_id, st WHERE tf.term IN (SELECT term FROM ph)),
hit AS (SELECT query_id, chunk_id, sum(mult * s) AS score, count(*) FILTER (role = 'required') AS got, count(*) FILTER (role = 'optional') AS opt FROM ph JOIN sc ON ph.term = sc.term GROUP BY ALL),
need AS (SELECT query_id, count(*) FILTER (role = 'required') AS nreq, count(*) FILTER (role = 'optional') AS nopt FROM ph GROUP BY 1),
strict AS (SELECT h.query_id, chunk_id, score, 'strict' AS mode FROM hit h JOIN need ON h.query_id = need.query_id WHERE got = nreq AND (opt > 0 OR nopt = 0)),
bm AS (SELECT query_id, chunk_id, score, mode, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), chunk_id) AS rank
  FROM (SELECT * FROM strict UNION ALL SELECT query_id, chunk_id, score, 'relaxed' FROM hit WHERE query_id NOT IN (SELECT query_id FROM strict)))"""
_USABLE = "len({0}) = 64 AND len([x FOR x IN {0} IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN {0} IF x <> 0]) > 0"
_UNIT = "[x / sqrt(list_inner_product({0}, {0})) FOR x IN {0}]"
VECTOR = f"""vs AS (SELECT chunk_id, {_UNIT.format('v')} AS u FROM (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM uchunks WHERE {_USABLE.format('embedding')})),
ex AS (SELECT query_id, u AS q FROM (SELECT query_id, [x FOR x IN truth IF x IS NOT NULL AND x <> ''][1] AS uid FROM items) i JOIN uchunks c ON i.uid = c.chunk_uid JOIN vs ON vs.chunk_id = c.chunk_id),
vl AS (SELECT query_id, chunk_id, 1 - list_inner_product(q, u) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_inner_product(q, u), 9), chunk_id) AS rank FROM ex, vs)"""
RRF = f"""{BM25}, {VECTOR},
ls AS (SELECT query_id, 0 AS o, 'fts' AS backend, rank, chunk_id FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, 1, 'vector', rank, chunk_id FROM vl WHERE rank <= 20),
fu AS (SELECT query_id, chunk_id, sum(CAST(1.0 AS DOUBLE) / (60 + rank)) AS score, min(o * 1000 + rank) AS seen FROM ls GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM fu QUALIFY rank <= 10)"""
_Q, _T = (f"list_distinct({text.sql_ascii(x)})" for x in ("query", "c.text"))
RERANK = f"""{RRF}, rr AS (SELECT f.query_id, f.chunk_id, c.chunk_uid, c.paper_id, c.page_number, f.rank, CASE WHEN len({_Q}) = 0 THEN CAST(0.3 AS DOUBLE) / f.rank ELSE CAST(0.7 AS DOUBLE) * (len(list_intersect({_Q}, {_T})) / len({_Q})) + CAST(0.3 AS DOUBLE) / f.rank END AS rerank_score
  FROM fused f JOIN uchunks c ON f.chunk_id = c.chunk_id JOIN items i ON f.query_id = i.query_id),
rrr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM rr)"""
METRICS = f"""{RRF}, res AS (SELECT f.query_id, f.rank, c.chunk_uid FROM fused f JOIN uchunks c ON f.chunk_id = c.chunk_id),
tr AS (SELECT DISTINCT query_id, uid FROM (SELECT query_id, unnest(truth) AS uid FROM items) WHERE uid IS NOT NULL AND uid <> ''),
hits AS (SELECT res.query_id, res.rank FROM res JOIN tr ON res.query_id = tr.query_id AND res.chunk_uid = tr.uid),
met AS (SELECT i.query_id, (SELECT count(*) FROM tr WHERE tr.query_id = i.query_id) AS nt, (SELECT count(*) FROM hits h WHERE h.query_id = i.query_id AND rank <= 5) AS h5, (SELECT count(*) FROM hits h WHERE h.query_id = i.query_id) AS h10,
  (SELECT min(rank) FROM hits h WHERE h.query_id = i.query_id) AS first_correct_rank, (SELECT count(*) FROM res WHERE res.query_id = i.query_id) AS nres FROM items i),
mm AS (SELECT query_id, nres, CASE WHEN nt = 0 THEN 0.0 ELSE h5 / nt END AS recall_at_5, CASE WHEN nt = 0 THEN 0.0 ELSE h10 / nt END AS recall_at_10, first_correct_rank, coalesce(1.0 / first_correct_rank, 0) AS mrr FROM met)"""
CITES = """zz AS (SELECT query_id, unnest(ground_truth.papers) AS paper_id, unnest(ground_truth.pages) AS g FROM items),
ci AS (SELECT query_id, paper_id, g[1] AS page_number FROM zz WHERE paper_id IS NOT NULL AND g[1] IS NOT NULL),
rightp AS (SELECT DISTINCT i.query_id, c.paper_id, c.page_number FROM (SELECT query_id, unnest(truth) AS uid FROM items) i JOIN uchunks c ON i.uid = c.chunk_uid WHERE i.uid <> ''),
ca AS (SELECT i.query_id, count(ci.paper_id) AS citation_count, coalesce(avg(CASE WHEN ci.paper_id IS NULL THEN NULL WHEN r.paper_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 0) AS citation_accuracy
  FROM items i LEFT JOIN ci ON i.query_id = ci.query_id LEFT JOIN rightp r ON r.query_id = ci.query_id AND r.paper_id = ci.paper_id AND r.page_number = ci.page_number GROUP BY 1)"""


def _embedding_sql(metric: str, where: str = "true", k: int = 10) -> str:
    unit = f"e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_UNIT.format('CAST(embedding AS DOUBLE[])')} AS u FROM embeddings)"
    dist = {"cosine": "1 - list_inner_product(a.u, b.u)", "ip": "1 - list_inner_product(a.v, b.v)", "l2": "list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v)"}[metric]
    return f"""WITH {unit}, p AS (SELECT a.vec_id AS qid, b.vec_id, greatest({dist}, {'0' if metric == 'l2' else '-1e9'}) AS x FROM e a, e b WHERE a.vec_id % 20 = 0 AND b.{where}),
      r AS (SELECT qid, vec_id, x, row_number() OVER (PARTITION BY qid ORDER BY round(x, 9), vec_id) AS rank FROM p) SELECT qid, rank, vec_id, round(x, 6) + 0.0 AS distance FROM r WHERE rank <= {k}"""


SQL = {
    "bm25_topk": f"WITH {BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score, mode FROM bm WHERE rank <= 10",
    "vector_topk": f"WITH {base.SQL_ITEMS}, {base.SQL_CHUNKS}, {VECTOR} SELECT query_id, rank, chunk_id, round(distance, 6) + 0.0 AS distance FROM vl WHERE rank <= 10",
    "cosine_topk": _embedding_sql("cosine", "vec_id >= 0"),
    "l2_topk": _embedding_sql("l2", "vec_id >= 0"),
    "ip_topk": _embedding_sql("ip", "vec_id >= 0"),
    "vector_filtered_topk": _embedding_sql("cosine", "label = 3", 5),
    "vector_norms": f"WITH {base.SQL_CHUNKS}, v AS (SELECT chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM uchunks WHERE {_USABLE.format('embedding')}), u AS (SELECT chunk_id, v, {_UNIT.format('v')} AS u FROM v) SELECT chunk_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(sqrt(list_inner_product(u, u)), 6) AS unit FROM u",
    "rrf_fusion": f"WITH {RRF} SELECT query_id, rank, chunk_id, round(score, 9) AS score FROM fused",
    "rrf_provenance": f"WITH {RRF} SELECT ls.query_id, ls.chunk_id, backend, ls.rank AS backend_rank, round(CAST(1.0 AS DOUBLE) / ls.rank, 9) AS normalized_score, round(CAST(1.0 AS DOUBLE) / (60 + ls.rank), 9) AS contribution FROM ls JOIN fused f ON ls.query_id = f.query_id AND ls.chunk_id = f.chunk_id",
    "lexical_rerank": f"WITH {RERANK} SELECT query_id, new_rank, chunk_id, round(rerank_score, 9) AS rerank_score FROM rrr",
    "generation_context": f"WITH {RERANK} SELECT query_id, new_rank, chunk_uid FROM rrr WHERE new_rank <= 5",
    "retrieval_metrics": f"WITH {METRICS} SELECT query_id, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, first_correct_rank, round(mrr, 6) AS mrr FROM mm",
    "citation_accuracy": f"WITH {base.SQL_ITEMS}, {base.SQL_CHUNKS}, {CITES} SELECT query_id, citation_count, round(citation_accuracy, 6) AS citation_accuracy FROM ca",
    "eval_summary": f"WITH {METRICS}, {CITES} SELECT count(*) AS n_queries, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(citation_accuracy), 6) AS citation_accuracy, round(avg(CASE WHEN recall_at_5 > 0 THEN citation_accuracy END), 6) AS citation_accuracy_recall_at_5 FROM mm JOIN ca ON mm.query_id = ca.query_id",
    "eval_failures": f"""WITH {METRICS}, {CITES} SELECT count(*) FILTER (nres = 0) AS retrieval_empty, count(*) FILTER (recall_at_5 = 0) AS recall_at_5_zero, count(*) FILTER (mrr = 0) AS mrr_zero, count(*) FILTER (citation_count = 0) AS citation_absent,
      count(*) FILTER (citation_count > 0 AND citation_accuracy = 0) AS citation_zero_score, count(*) FILTER (false) AS citation_parse_error, count(*) FILTER (citation_accuracy < 1) AS citation_inaccurate FROM mm JOIN ca ON mm.query_id = ca.query_id""",
    "context_diagnostics": f"""WITH {RERANK}, {CITES}, ctx AS (SELECT * FROM rrr WHERE new_rank <= 5)
      SELECT i.query_id, EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = i.query_id AND list_contains([u FOR u IN i.truth IF u IS NOT NULL AND u <> ''], ctx.chunk_uid)) AS ground_truth_in_context,
        (SELECT count(*) FROM ci WHERE ci.query_id = i.query_id AND EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = ci.query_id AND ctx.paper_id = ci.paper_id AND ctx.page_number = ci.page_number)) AS citations_in_context,
        (SELECT count(*) FROM ci WHERE ci.query_id = i.query_id AND NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.query_id = ci.query_id AND ctx.paper_id = ci.paper_id AND ctx.page_number = ci.page_number)) AS citations_outside_context FROM items i""",
    "coverage": f"WITH {base.SQL_ITEMS} SELECT DISTINCT p AS missing_paper FROM (SELECT unnest(ground_truth.papers) AS p FROM items UNION ALL SELECT paper_id FROM chunks) WHERE p IS NOT NULL AND p NOT IN (SELECT paper_id FROM papers WHERE paper_id IS NOT NULL)",
}
QUERIES = {
    "bm25_topk": bm25_topk,
    "vector_topk": vector_topk,
    "cosine_topk": _embedding_topk("cosine"),
    "l2_topk": _embedding_topk("l2"),
    "ip_topk": _embedding_topk("ip"),
    "vector_filtered_topk": vector_filtered_topk,
    "vector_norms": vector_norms,
    "rrf_fusion": rrf_fusion,
    "rrf_provenance": rrf_provenance,
    "lexical_rerank": lexical_rerank,
    "generation_context": generation_context,
    "retrieval_metrics": retrieval_metrics,
    "citation_accuracy": citation_accuracy,
    "eval_summary": eval_summary,
    "eval_failures": eval_failures,
    "context_diagnostics": context_diagnostics,
    "coverage": coverage,
}
