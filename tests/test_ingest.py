"""Ingest end to end: versions, idempotence, untouched sources, resumable backfill."""

import gzip
import hashlib

import pytest

from codexmill.operators import ingest as I
from codexmill.operators import mutations as M
from codexmill.operators.vectors import hashing_embedder
from codexmill.sources import dumps as D

from .test_library import ART


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_index_ingest_is_idempotent_and_atomic(spark, tmp_path):
    src = tmp_path / "index.txt"
    src.write_text("".join(f"{(i - 1) // 10 * 100}:{i}:Article{i}\n" for i in range(1, 51)))
    before = hashlib.sha1(src.read_bytes()).hexdigest()
    table = str(tmp_path / "articles")
    assert I.read_current(spark, table) is None
    empty = spark.createDataFrame([], ART)
    one = I.write_version(I.ingest_index(empty, D.read_index(spark, str(src)), 7), table, "page_id")
    assert one.count() == 50 and {r.tier for r in one.collect()} == {"cold"}
    two = I.write_version(I.ingest_index(I.read_current(spark, table), D.read_index(spark, str(src)), 7), table)
    assert rows(one) == rows(two) == rows(I.read_current(spark, table))
    clash = spark.createDataFrame([(0, 99, "Article1")], "stream_offset bigint, page_id bigint, title string")
    with pytest.raises(ValueError):
        I.write_version(I.ingest_index(I.read_current(spark, table), clash, 7), table)
    assert I.read_current(spark, table).count() == 50
    assert hashlib.sha1(src.read_bytes()).hexdigest() == before


def test_index_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = str(tmp_path / "t")
    I.write_version(spark.createDataFrame([], ART), table)
    for n in range(2):
        (tmp_path / "in" / f"{n}.txt").write_text(f"0:1:One v{n}\n{n}:{n + 2}:Other {n}\n")
        q = I.ingest_index_stream(spark, str(tmp_path / "in"), table, 5, str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.page_id: r.title for r in I.read_current(spark, table).collect()} == {1: "One v1", 2: "Other 0", 3: "Other 1"}


def test_table_ingest(spark, tmp_path):
    with gzip.open(tmp_path / "r.sql.gz", "wt") as f:
        f.write("INSERT INTO `redirect` VALUES (1,0,'A','',''),(2,0,'B_c','',''),(3,1,'D','','');\n")
    now = spark.createDataFrame([(2, "Old"), (9, "Kept")], "from_page_id bigint, target_title string")
    after, n = I.ingest_table(spark, str(tmp_path / "r.sql.gz"), "redirect", now)
    assert n.first().processed == 2 and rows(after) == [(1, "A"), (2, "B c"), (9, "Kept")]
    assert rows(I.ingest_table(spark, str(tmp_path / "r.sql.gz"), "redirect", after)[0]) == rows(after)


def test_backfill_goes_on_where_it_stopped(spark):
    a = spark.createDataFrame([(i, f"t{i}", "evicted" if i == 4 else "cold", False, None, None, None, 0, 0, 1, 1) for i in range(5)], ART)
    e = spark.createDataFrame([(0, [1.0], "old")], "page_id bigint, embedding array<float>, model string")
    part = I.backfill_embeddings(a, e, "new", hashing_embedder(4), 2)
    assert sorted(r.page_id for r in part.where("model = 'new'").collect()) == [0, 1] and part.count() == 2
    whole = I.backfill_embeddings(a, part, "new", hashing_embedder(4))
    assert sorted(r.page_id for r in whole.collect()) == [0, 1, 2, 3, 4] and {r.model for r in whole.collect()} == {"new"}


def test_modules(spark):
    m = spark.createDataFrame([("a", "A", "cold", 1)], "id string, name string, default_tier string, installed_at bigint")
    t = spark.createDataFrame([("a", "X"), ("a", "Y")], "module_id string, title string")
    m2, t2 = M.install_module(m, t, {"id": "a", "name": "A2", "explicit_titles": ["Y", "Z", "Z"]}, 9)
    assert rows(m2) == [("a", "A2", "cold", 1)] and rows(t2) == [("a", "Y"), ("a", "Z")]
    m3, t3 = M.install_module(m2, t2, {"id": "b", "name": "B", "explicit_titles": ["Y"]}, 9)
    m4, t4 = M.uninstall_module(m3, t3, "a")
    assert rows(m4) == [("b", "B", "cold", 9)] and rows(t4) == [("b", "Y")]
    with pytest.raises(M.NotFound):
        M.uninstall_module(m4, t4, "a")
