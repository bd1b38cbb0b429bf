"""What the plans of queries must look like: columns and filters at the scan, no cross joins, no collected groups."""

import pytest

import __spark_entry__ as entry
from paperweir.operators import chunking, orphans
from paperweir.plans import corpus, tables, texts
from paperweir.sources.stored import StoredTable

QUERIES = entry.queries()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark, small):
    refs, came = corpus._inputs(spark, small)
    for df in (refs, came):
        assert "embedding" not in physical(df) and "text:" not in physical(df)
    snippets = physical(texts.snippets(spark, small))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in snippets


def test_filters_reach_the_scan(spark, small):
    last = physical(tables.latest_version(spark, small))
    assert "PushedFilters: [IsNotNull(paper_id)]" in last
    removed = physical(tables._removed(spark, small, "papers"))
    assert "EqualTo(target_table,papers)" in removed


def test_limits_are_taken_in_each_partition(spark, small):
    assert "TakeOrderedAndProject" in physical(tables.sample(spark, small))
    assert "WindowGroupLimit" in physical(tables.latest_version(spark, small))


def test_stages_stay_in_generated_code(spark, small):
    pages = chunking.pages_by_lines(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text")
    assert "Python" not in physical(chunking.chunk_pages(pages)) and "MapInArrow" not in physical(chunking.chunk_pages(pages))
    assert "MapInArrow" not in physical(orphans.project_refs(*(spark.read.parquet(f"{small}/{t}.parquet") for t in ("chunks", "query_log", "eval_set"))))


@pytest.mark.parametrize("name", ["chunk_titles", "pending_papers", "uids_by_page", "pages_by_paper", "load_by_uid", "papers_upsert", "versioned_replace", "stale_vectors", "citation_validate", "verify_report", "quote_locate"])
def test_joins_are_on_keys(name, spark, small):
    found = physical(QUERIES[name](spark, small))
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found


def test_lookups_read_the_parts_of_their_keys(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/t", "k string, v int", "k", 8)
    t.replace(spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, v int"))
    every, some = t.read().inputFiles(), t.read(t.parts_of(spark.createDataFrame([("k1", 0)], "k string, v int"))).inputFiles()
    assert 0 < len(some) < len(every) and set(some) < set(every)
