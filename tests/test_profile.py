"""Profiles by statistics, and parts of equal row counts."""

from __future__ import annotations

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tablemirror.operators import profile as PR
from tablemirror.operators import store as S
from tablemirror.sources import scans
from tablemirror.spec import TableSpec, is_supported, watermark_quality

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_footers_tell_rows_nulls_and_ranges(spark, tmp_path):
    rows = [(i if i % 7 else None, f"t{i}", date(2024, 1, 1 + i % 28), datetime(2024, 1, 1, i % 24)) for i in range(100)]
    spark.createDataFrame(rows, "id int, name string, day date, updated_at timestamp_ntz").write.parquet(str(tmp_path / "t"))
    facts = PR.footer_facts(spark, str(tmp_path / "t"), ["id", "day", "updated_at"])
    assert facts["rows"] == 100 and facts["id"] == {"nulls": 15, "low": 1, "high": 99}
    assert (facts["day"]["low"], facts["day"]["high"]) == (date(2024, 1, 1), date(2024, 1, 28)) and facts["updated_at"]["nulls"] == 0
    plan = scans.footer_reader(spark).parquet(str(tmp_path / "t")).agg(F.count("id"), F.max("id"))._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(id), MAX(id)]" in plan


def test_fast_counts_come_from_footers(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.parquet.aggregatePushdown", "spark.sql.sources.useV1SourceList")}
    found = scans.fast_counts(spark, {"region": "/root/testdata/sf0.001/region.parquet"})
    assert "PushedAggregation: [COUNT(*)]" in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("region", 5)]
    assert before == {k: spark.conf.get(k) for k in before}


@pytest.mark.parametrize("repeats", [0, 1, 20_000])
def test_uniqueness_is_exact(spark, repeats):
    df = spark.range(50_000).union(spark.range(repeats)).select((F.col("id") * 3).alias("a"), F.lit("x").alias("b"))
    assert PR.key_is_unique(df, ["a", "b"]) == (repeats == 0)
    halves = [PR.key_sketch(df.where(c), ["a", "b"]) for c in ("a % 2 = 0", "a % 2 = 1")]
    merged = PR.merged_sketch(halves[0].union(halves[1])).first()
    assert merged["rows"] == 50_000 + repeats and abs(merged["distinct_keys"] / 50_000 - 1) < 0.05
    assert PR.key_is_unique(df, ["a", "b"], halves[0].union(halves[1])) == (repeats == 0)
    assert PR.key_is_unique(df.where("a < 0"), ["a"])


def test_sketches_stay_with_their_batches(spark, tmp_path):
    store, spec = S.Store(spark, str(tmp_path / "db")), TableSpec("t", ("id",), "updated_at")
    at = lambda h: F.lit(datetime(2024, 1, 1, h)).cast("timestamp_ntz").alias("updated_at")
    for h in range(3):
        S.sync_table(store, spec, spark.range(100).select("id", at(h)))
        assert PR.versions_per_key(store, spec) == pytest.approx(1 + h, rel=0.05)
    assert PR.sketch_batches(store, spec).count() == 3
    S.vacuum(store, spec)
    assert PR.versions_per_key(store, spec) == pytest.approx(1, rel=0.05)


def test_supported_types_and_watermarks():
    assert all(map(is_supported, ("int unsigned", "enum('point')", "varchar(9)", "DATETIME(6)", "decimal(5,2)", "year", "bit(1)", "json")))
    assert not any(map(is_supported, ("point", "geometry", "vector(3)", "")))
    assert [watermark_quality(c) for c in ("updated_at", "modifiedAt", "timestamp", "createdAt", None)] == ["best", "best", "best", "append-only", "none"]


def test_a_skewed_jdbc_key_is_cut_into_equal_parts(spark):
    url, rng = "jdbc:derby:memory:parts;create=true", random.Random(4)
    keys = sorted({(rng.choice(["it's", "b", "c"]), rng.randrange(10) if rng.random() < 0.9 else rng.randrange(10**6), rng.randrange(10**6)) for _ in range(900)})
    rows = [(*k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "A string, B int, C int, V int")
    df.write.option("createTableColumnTypes", "A varchar(9)").jdbc(url, "PARTS", mode="overwrite", properties=DERBY)
    scan = scans.balanced_jdbc_scan(spark, url, "PARTS", ["A", "B", "C"], 100, DERBY, dialect="derby")
    sizes = [r["n"] for r in scan.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()]
    assert sizes == [100] * (len(keys) // 100) + [len(keys) % 100] * bool(len(keys) % 100)
    assert sorted(map(tuple, scan.collect())) == sorted(rows)
    one = scans.balanced_jdbc_scan(spark, url, "PARTS", ["A", "B", "C"], 10**6, DERBY, dialect="derby")
    assert one.rdd.getNumPartitions() == 1 and one.count() == len(rows)


def test_conditions_cover_every_key_once(spark):
    rng = random.Random(5)
    keys = sorted({(rng.randrange(4), rng.randrange(4)) for _ in range(30)})
    df = spark.createDataFrame(keys, "a int, b int")
    for bounds in ([], [keys[3]], [keys[2], keys[7], keys[8]]):
        parts = [sorted(map(tuple, df.where(c).collect())) for c in scans.key_predicates(["a", "b"], bounds)]
        assert [k for p in parts for k in p] == keys
        assert all(p[-1] == tuple(b) for p, b in zip(parts, bounds, strict=False))
    with pytest.raises(ValueError):
        scans.keyset_bounds(lambda key, n: (1,), 1, most=3)
    with pytest.raises(ValueError):
        scans.offset_page(df, ["a"], limit=10_001)
