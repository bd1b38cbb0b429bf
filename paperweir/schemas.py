"""Schemas of the stored tables; readers give them and never infer."""

from __future__ import annotations

PAPERS = "paper_id string, doc_id string, title string, authors array<string>, abstract string, categories array<string>, published_date date, pdf_path string, total_pages int, indexed_at timestamp, source_type string"
CHUNKS = "chunk_id long, chunk_uid string, paper_id string, doc_id string, page_number int, chunk_index int, text string, char_start int, char_end int, token_count int"
VECTORS = "chunk_uid string, doc_id string, paper_id string, page_number int, chunk_index int, token_count int, embedding array<float>"
PARSED = "doc_id string, pdf_path string, num_pages int, pages array<struct<page:int,text:string>>"
QUERY_LOG = "query_id long, query_text string, timestamp timestamp, retrieved_chunks string, answer string, latency_ms int, model string, feedback int"
GROUND_TRUTH = "struct<chunk_uids:array<string>,papers:array<string>,pages:array<array<int>>,expected_topics:array<string>>"
EVAL_ITEM = f"query_id string, query string, difficulty string, ground_truth {GROUND_TRUTH}, reference_answer string"
EVAL_FILE = f"eval_set array<struct<query_id:string,query:string,difficulty:string,ground_truth:{GROUND_TRUTH},reference_answer:string>>, metadata struct<created:string,corpus_version:string,n_queries:int>"
EMBEDDING_CACHE = "query_text string, embedding_model string, embedding array<double>, created_at timestamp"
ANSWER_CACHE = "query_text string, generation_model string, prompt_version string, chunk_uids_hash string, answer_text string, created_at timestamp"


def conform(df, schema: str):
    """`df` with the columns of a schema in their order; missing ones are null, others are dropped."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
