"""Maintained current tables and polling cycles."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablemirror.operators import maintained as M
from tablemirror.operators import store as S
from tablemirror.operators.current import current_from_changes
from tablemirror.spec import TableSpec
from tablemirror.streaming import changes as C

SPEC = TableSpec("t", ("id", "part"))
T0 = datetime(2025, 1, 1)
SCHEMA = "id int, part string, v int, _op string, _seq bigint"


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, str(tmp_path / "db"))


def test_merges_equal_the_whole_history(store, spark):
    rng, log = random.Random(3), []
    for n in range(400):
        op = rng.choice("iuud")
        log.append((rng.randrange(40), rng.choice("ab"), None if op == "d" else n, op, n))
    rng.shuffle(log)  # changes come late and out of order
    for batch in range(4):
        part = spark.createDataFrame(log[batch * 100 : batch * 100 + 100], SCHEMA)
        M.merge_changes(store, SPEC, part, batch, buckets=5)
        assert M.merge_changes(store, SPEC, part, batch) == []  # a replay
        wanted = current_from_changes(spark.createDataFrame(log[: batch * 100 + 100], SCHEMA), SPEC.keys).drop("_op", "_seq")
        assert sorted(map(tuple, store.current(SPEC).collect())) == sorted(map(tuple, wanted.collect()))
    some = spark.createDataFrame([(3, "a"), (4, "b"), (99, "a")], "id int, part string")
    rows = sorted(map(tuple, M.lookup(store, SPEC, some).collect()))
    assert rows == sorted(tuple(r) for r in store.current(SPEC).collect() if (r["id"], r["part"]) in {(3, "a"), (4, "b")})
    assert store.current(SPEC, 1).count() > 0  # the table as it was after the first batch


def test_untouched_buckets_keep_their_files(store, spark):
    M.merge_changes(store, SPEC, spark.createDataFrame([(i, "a", i, "i", i) for i in range(100)], SCHEMA), buckets=16)
    before = {b["bucket"]: b["folder"] for b in store.batches("t")}
    touched = M.merge_changes(store, SPEC, spark.createDataFrame([(7, "a", -1, "u", 1000), (7, "a", -2, "u", 999)], SCHEMA))
    after = {b["bucket"]: b["folder"] for b in store.batches("t")}
    assert len(touched) == 1 and {b for b in after if after[b] != before.get(b)} == set(touched)
    assert [r["v"] for r in store.current(SPEC).where("id = 7").collect()] == [-1]
    plan = store.current(SPEC)._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan  # a read does not rank
    wider = spark.createDataFrame([(7, "b", 5, "new", "i", 2000)], "id int, part string, v int, more string, _op string, _seq bigint")
    M.merge_changes(store, SPEC, wider)
    assert {(r["part"], r["more"]) for r in store.current(SPEC).where("id = 7").collect()} == {("a", None), ("b", "new")}
    store.clean_up("t", timedelta(0))
    assert store.current(SPEC).count() == 101


def test_a_stream_maintains_a_table(store, spark, tmp_path):
    for part in ([(1, "a", 1, "i", 1), (2, "a", 1, "i", 2)], [(1, "a", None, "d", 3), (3, "a", 1, "i", 4)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "feed"))
        M.maintain(stream, store, SPEC, str(tmp_path / "position"), buckets=4).awaitTermination()
    assert sorted(r["id"] for r in store.current(SPEC).collect()) == [2, 3]


def source(spark, *rows):
    return spark.createDataFrame([(i, T0 + timedelta(hours=h)) for i, h in rows], "id int, updated_at timestamp_ntz").coalesce(1)


def test_cycles_keep_their_snapshot_until_all_is_done(store, spark):
    a, b = TableSpec("a", ("id",), "updated_at"), TableSpec("b", ("id",), "updated_at")
    one, two = source(spark, (1, 1)), source(spark, (1, 1), (2, 2))
    assert C.logged_cycle(store, [(a, one), (b, one)]) is None
    broken = two.withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("id")))
    before = C.last_snapshot(store)[0]
    assert "broken" in C.logged_cycle(store, [(a, broken), (b, two)])
    assert C.last_snapshot(store)[0] == before
    done = C.poll_cycle(S.Store(spark, store.root), [(a, two), (b, two)])  # as after a restart
    assert done == {"cycle": before + 1, "inserts": 2, "updates": 0, "deletes": 0}
    assert store.current(a).count() == store.current(b).count() == 2
    assert C.poll_cycle(store, [(a, one), (b, two)])["deletes"] == 1 and store.current(a).count() == 1
    S.drop_replica(store, b)
    assert "vanished: b" in C.logged_cycle(store, [(a, one), (b, two)])
    log = [(r["cycle"], r["status"]) for r in store.state("cycles", C.CYCLES).orderBy("created_at").collect()]
    assert log == [(1, "success"), (2, "error"), (4, "error")]


def test_a_planned_table_needs_its_source(store, spark):
    snapshots = spark.createDataFrame([("a", 1, "x")], "table_name string, row_count bigint, change_token string")
    with pytest.raises(LookupError, match="a"):
        C.poll_sync(store, [], None, snapshots)
