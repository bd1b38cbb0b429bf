"""Every registered query against its SQL, on the smallest tables."""

import decimal
import glob
import os
import sys

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from paperweir.session import scratch

QUERIES, SQL = entry.queries(), entry.oracle_sql()
#: Queries for which the smallest tables hold no case; their own tests have some.
NOTHING_THERE = {"p3_search"}


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, small):
    with scratch():
        df = QUERIES[name](spark, small)
        cols = sorted(df.columns)
        got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got or name in NOTHING_THERE, "a query that returns nothing shows nothing"
    if name not in SQL:
        return
    rel = duck.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_only_an_absent_folder_hides_llm(monkeypatch):
    import builtins

    real = builtins.__import__

    def lacking(name):
        def load(n, *a, **k):
            if n == name or n == "paperweir.llm" and name == "paperweir.llm":
                raise ModuleNotFoundError(name, name=name)
            return real(n, *a, **k)

        return load

    monkeypatch.setattr(builtins, "__import__", lacking("paperweir.llm"))
    assert entry._llm() is None
    for m in [m for m in sys.modules if m.startswith("paperweir.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", lacking("ahocorasick"))
    if os.path.isdir(os.path.join(os.path.dirname(entry.__file__), "paperweir", "llm")):
        with pytest.raises(ModuleNotFoundError):
            entry._llm()


def test_core_stands_without_llm():
    from paperweir.plans import registry

    assert {"p1_found", "p2_found"} <= set(registry.queries())
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "paperweir", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "paperweir.llm" not in open(path, encoding="utf-8").read(), path
