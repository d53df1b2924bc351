"""The registry, and every query with SQL against it on the smallest data, where it is there."""

import glob
import os
import re

import pytest

import __spark_entry__ as entry
from codexmill.plans import registry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 3, 4, 5, 6)} <= set(entry.queries())
    without = set(registry.queries()) - set(registry.oracles())
    assert without == {"w1_html", "w3_plain"}  # see README


def test_no_other_sessions_folder():
    """Nothing in the package keeps data in a folder of one machine but for local sessions."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for p in glob.glob(f"{root}/codexmill/**/*.py", recursive=True):
        text = open(p, encoding="utf-8").read()
        assert "localCheckpoint(" not in text and not re.search(r"[\"']/tmp", text), p


@pytest.fixture(scope="module")
def con():
    c = pytest.importorskip("duckdb").connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    res = con.execute(registry.oracles()[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(str([r[names.index(c)] for c in cols]) for r in res.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
