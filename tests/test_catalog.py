"""Helpers that only touch metadata."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablemirror.operators import analytics as A
from tablemirror.sources import scans
from tablemirror.spec import catalog_columns, catalog_tables, describe_table, list_tables, primary_key_columns, visible_tables


@pytest.fixture
def view(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    df.createOrReplaceTempView("helper_items")
    spark.range(1).createOrReplaceTempView("helper_items__raw")
    yield df
    for name in ("helper_items", "helper_items__raw"):
        spark.catalog.dropTempView(name)


def test_names(spark, view):
    names = list_tables(spark, exclude=("helper_items__raw",))
    assert "helper_items" in names and "helper_items__raw" not in names and names == sorted(names)
    assert visible_tables(["items", "items__raw", "_state"]) == ["items"]


def test_columns_and_tables(spark, view):
    rows = [tuple(r) for r in describe_table(view, ("id",), {"name": "x"}).collect()]
    assert rows == [(1, "id", "int", True, "PRI", None), (2, "name", "string", True, "", "x")]
    assert [(r["ordinal"], r["column_name"], r["data_type"]) for r in catalog_columns(spark, ["helper_items"]).collect()] == [(1, "id", "int"), (2, "name", "string")]
    found = {r["table_name"]: (r["table_type"], r["is_temporary"]) for r in catalog_tables(spark).collect()}
    assert found["helper_items"] == ("VIEW", True)


def test_overview(spark):
    row = scans.table_overview(["a", "b", "c"], ["a"], {"a": "success", "b": "error"}, spark, "shop").first()
    assert tuple(row) == ("shop", 3, 1, 1, 1)


def test_primary_key_in_index_order():
    asked = {}

    class Reader:
        def format(self, kind):
            return self

        def options(self, **given):
            asked.update(given)
            return self

        def load(self):
            return SimpleNamespace(collect=lambda: [{"c": "a", "n": 2}, {"c": "b", "n": 1}])

    assert primary_key_columns(SimpleNamespace(read=Reader()), "jdbc:x", "o'rders", user="me") == ["b", "a"]
    assert "table_name = 'o''rders'" in asked["query"] and asked["user"] == "me"


def test_a_log_page_past_the_end_still_counts(spark):
    log = spark.createDataFrame([(i, "x") for i in range(5)], "id int, level string")
    order = [F.col("id").desc()]
    assert [tuple(r) for r in A.log_page(log, order, limit=2, offset=9).collect()] == [(None, None, 5)]
    assert [tuple(r) for r in A.log_page(log, order, limit=2, offset=1).collect()] == [(3, "x", 5), (2, "x", 5)]


def test_a_read_that_detects_its_column(spark):
    rows = spark.createDataFrame([(i, f"2025-01-0{i}") for i in range(1, 6)], "id int, day string").select("id", F.to_timestamp("day").cast("timestamp_ntz").alias("modified_at"))
    assert [r["id"] for r in scans.detected_incremental(rows, "2025-01-03").collect()] == [3, 4, 5]
    assert [r["id"] for r in scans.detected_incremental(rows, "2025-01-03", limit=1).collect()] == [3]
    with pytest.raises(LookupError, match="id"):
        scans.detected_incremental(rows.select("id"), "2025-01-03")
