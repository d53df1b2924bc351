"""Derived tables: built once, rebuilt when a source changes, and read with filters that reach the scan."""

import os
import re

import pytest

import __spark_entry__ as entry
from codexmill.store import stored

DATA = "/root/testdata/sf0.001"


def test_built_once_for_each_state(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t.parquet")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{tmp_path}/t.parquet").selectExpr("id", "id % 3 as k")

    for _ in range(3):
        assert stored(spark, str(tmp_path), "x", ["t"], build, ["k", "id"]).count() == 10
    assert len(built) == 1
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert stored(spark, str(tmp_path), "x", ["t"], build, ["k", "id"]).count() == 14 and len(built) == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data here")
@pytest.mark.parametrize("name, key", [("q1_lookup", "EqualTo(title"), ("q5_categories_of_page", "EqualTo(cl_from"), ("q6_category_prefix", "StringStartsWith(fold"), ("q7_title_prefix", "StringStartsWith(fold"), ("q16_categories_of_title", "EqualTo(cl_from"), ("j2_category_members", "EqualTo(cl_to"), ("j3_related", "(cl_to,")])
def test_lookups_reach_the_scan(spark, name, key):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert any(key in x for x in re.findall(r"PushedFilters: (.*)", plan))
    if name in ("q1_lookup", "q5_categories_of_page", "q7_title_prefix", "q16_categories_of_title", "j2_category_members"):
        assert "Aggregate" not in plan
