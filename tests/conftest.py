from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from foliospark.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    """A value in the form both engines give."""
    if isinstance(value, float):
        return repr(round(value, 6))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compares a query with its SQL: columns by name, rows in any order."""

    def check(query, sql):
        got = query(spark, SF)
        names = sorted(got.columns)
        cursor = duck.execute(sql)
        theirs = [d[0] for d in cursor.description]
        assert sorted(theirs) == names
        want = sorted(tuple(plain(r[theirs.index(c)]) for c in names) for r in cursor.fetchall())
        assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == want

    return check


@pytest.fixture(scope="session")
def items(spark):
    """Content items from plain dictionaries: items([{...}, ...]) of one document, or {doc: [...]} of several."""
    import json

    from foliospark.sources.content import parse_items

    def make(given):
        docs = given if isinstance(given, dict) else {"d": given}
        return parse_items(spark.createDataFrame([(d, json.dumps(x, ensure_ascii=False)) for d, x in docs.items()], "doc_id string, value string"))

    return make
