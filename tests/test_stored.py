import pytest

from paperweir.engine import Engine
from paperweir.operators import fulltext
from paperweir.sources.stored import StoredTable
from paperweir.streaming.reindex import log_stream

SCHEMA = "k string, v int"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def have(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_parts_and_batches(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", 4)
    assert have(t) == [] and t.version() == 0
    t.replace(rows(spark, *[(f"k{i}", i) for i in range(20)]))
    parts = t.parts_of(rows(spark, ("k3", 0)))
    assert len(parts) == 1 and 0 < t.read(parts).count() < 20
    t.replace(t.read(parts).where("k <> 'k3'"), parts)
    assert have(t) == sorted((f"k{i}", i) for i in range(20) if i != 3)
    for _ in range(2):
        t.append(rows(spark, ("new", 1), (None, 2)), ("log", 0))
    assert StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", 4).read().count() == 21
    t.append(rows(spark), ("log", 1))
    assert t.read().count() == 21
    ids = [r[0] for r in t.read().select(t.row_id()).collect()]
    assert len(set(ids)) == 21 and min(ids) > t.version() << 44


def test_one_writer_wins_and_old_files_go(spark, tmp_path):
    t = StoredTable(spark, f"file://{tmp_path}/t", SCHEMA, "k", 2)
    for i in range(6):
        t.replace(rows(spark, ("a", i)))
    assert have(t) == [("a", 5)]
    assert len(list((tmp_path / "t").glob("change=*"))) <= 4 and len(list((tmp_path / "t").glob("manifest-*.json"))) == 3
    old = t._manifest()
    t.append(rows(spark, ("b", 1)))
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit(old, {}, None)
    assert have(t) == [("a", 5), ("b", 1)]


def test_log_takes_a_batch_once(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/home")
    schema = "query_text string, retrieved_chunks array<string>, answer string, latency_ms int, model string"
    one = spark.createDataFrame([("q", ["u"], "a", 1, "m")], schema)
    for _ in range(2):
        e.log(one, ("s", 0))
    e.log(one)
    assert e.table("query_log").count() == 2
    one.write.parquet(str(tmp_path / "in"))
    log_stream(e, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(60)
    assert len({r.query_id for r in e.table("query_log").collect()}) == 3


def test_stored_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta_gamma delta"), (3, None)], "chunk_id long, text string")
    fulltext.store_index(fulltext.index_tables(docs, "chunk_id"), f"file://{tmp_path}/i")
    q = spark.createDataFrame([("a", "alpha"), ("b", "beta_gamma"), ("c", "nothing")], "query_id string, query string")
    want = sorted(tuple(r) for r in fulltext.bm25_topk(q, docs, 5).collect())
    got = fulltext.bm25_topk(q, None, 5, index=fulltext.read_index(spark, f"file://{tmp_path}/i"))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 3
