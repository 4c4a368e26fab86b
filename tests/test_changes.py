"""Change feeds, polling, quotas, scans and statement classes."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablemirror.functions import logs
from tablemirror.operators.current import current_from_changes
from tablemirror.operators.store import Store
from tablemirror.sources import scans
from tablemirror.spec import TableSpec
from tablemirror.streaming import changes, quota

SCHEMA = "_op string, _seq bigint, _source_ts timestamp, id int, price double"
T0 = datetime(2025, 1, 1)


def feed(spark, path, *rows):
    spark.createDataFrame([(op, seq, T0, i, p) for op, seq, i, p in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, src, out, mark, guard=None):
    q = changes.apply_changes(scans.change_feed(spark, src, SCHEMA), out, mark, guard)
    q.awaitTermination()


def test_restart_failure_and_replay(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    feed(spark, src, ("i", 1, 1, 9.0), ("i", 2, 2, 5.0))
    run(spark, src, out, mark)
    feed(spark, src, ("u", 3, 1, 24.99), ("d", 4, 2, None), ("i", 5, 3, 7.0))

    def gone(s):
        changes.guard_targets(s.createDataFrame([("t",)], "table_name string"), s.createDataFrame([], "table_name string"))

    with pytest.raises(Exception, match="vanished"):
        run(spark, src, out, mark, gone)
    assert changes.mirrored(spark, out, ["id"]).count() == 2  # the position did not move
    run(spark, src, out, mark)
    assert sorted(tuple(r) for r in changes.mirrored(spark, out, ["id"]).collect()) == [(1, 24.99), (3, 7.0)]
    feed(spark, src, ("i", 6, 2, 1.0))
    run(spark, src, out, mark)
    assert changes.mirrored(spark, out, ["id"]).count() == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("iud"), st.integers(1, 4), st.integers(0, 9)), min_size=1, max_size=25), st.randoms())
def test_order_inside_a_batch_does_not_matter(spark, ops, rnd):
    rows = [(op, seq, k, v) for seq, (op, k, v) in enumerate(ops)]
    wanted = {}
    for op, _, k, v in rows:
        wanted.pop(k, None)
        if op != "d":
            wanted[k] = v
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "_op string, _seq bigint, k int, v int")
    assert {r["k"]: r["v"] for r in current_from_changes(df, ["k"]).collect()} == wanted


def test_plan_and_poll(spark, tmp_path):
    snap = lambda *rows: spark.createDataFrame(list(rows), "table_name string, row_count bigint, change_token string")
    plan = changes.plan_cycle(snap(("a", 5, "x"), ("b", 5, "x"), ("c", 5, "x"), ("e", 1, "x"), ("f", 1, "x")), snap(("a", 7, "y"), ("b", 3, "x"), ("c", 5, "z"), ("d", 1, "x"), ("e", 1, "x")))
    found = {r["table_name"]: (r["action"], r["inserts"], r["updates"], r["deletes"]) for r in plan.collect()}
    assert found == {"a": ("incremental", 2, 0, 0), "b": ("full", 0, 0, 2), "c": ("incremental", 0, 1, 0), "d": ("full", 0, 0, 0), "e": ("none", 0, 0, 0), "f": ("vanished", 0, 0, 0)}
    store, spec = Store(spark, str(tmp_path / "db")), TableSpec("t", ("id",), "ts")
    rows = spark.createDataFrame([(i, T0) for i in range(1005)], "id int, ts timestamp_ntz")
    one = snap(("t", 1005, "x"))
    _, done = changes.poll_sync(store, [(spec, rows)], None, one)
    assert [r["mode"] for r in done.collect()] == ["full"] and store.current(spec).count() == 1005
    _, done = changes.poll_sync(store, [(spec, rows)], one, one)
    assert done.count() == 0
    fewer = rows.where("id > 4")
    changes.poll_sync(store, [(spec, fewer)], one, snap(("t", 1000, "x")))
    assert store.current(spec).count() == 1000


def test_quota_batch_and_stream_agree_with_a_loop(spark, tmp_path):
    rows = [(c, t * 7, float(1 + t % 3)) for c in ("a", "b") for t in range(40)]
    log = spark.createDataFrame(rows, "client string, ts bigint, cost double").withColumn("tie", F.col("ts"))
    wanted = {c: [(t, used, lim) for _, t, _, used, lim in quota.replay([(t, p) for k, t, p in rows if k == c], 50, 9.0)] for c in ("a", "b")}
    found = quota.quota_replay(log, "client", "ts", "cost", 50, 9.0, "tie").toPandas()
    for c, w in wanted.items():
        assert [(r.ts_us, r.used, r.limited) for r in found[found.client == c].sort_values("ts_us").itertuples()] == w
    assert any(lim for w in wanted.values() for _, _, lim in w)
    src = str(tmp_path / "log")
    log.drop("tie").coalesce(1).write.parquet(src)
    stream = quota.quota_stream(spark.readStream.schema("client string, ts bigint, cost double").parquet(src), "client", "ts", "cost", 50, 9.0)
    q = stream.writeStream.format("memory").queryName("quota_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mark")).start()
    q.awaitTermination()
    live = spark.table("quota_out").toPandas()
    assert {(r.client, r.ts_us, r.used, r.limited) for r in live.itertuples()} == {(r.client, r.ts_us, r.used, r.limited) for r in found.itertuples()}


def test_quota_stream_over_several_batches(spark, tmp_path):
    """State outlives a batch and a restart, goes after idle time of the log's own clock, and equal times follow the tie."""
    src, mark, out = (str(tmp_path / n) for n in ("log", "mark", "out"))
    schema = "client string, ts bigint, cost double, tie int"
    batches = [
        [("a", 10_000, 4.0, 1), ("a", 10_000, 5.0, 0), ("b", 20_000, 1.0, 0)],
        [("a", 30_000, 3.0, 0), ("a", 120_000, 4.0, 0)],
        [("b", 90_000_000, 9.0, 0)],  # far later: the state of a is dropped
        [("a", 90_010_000, 9.0, 0)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = quota.quota_stream(spark.readStream.schema(schema).parquet(src), "client", "ts", "cost", 100_000, 9.0, idle_ms=1000, tie="tie")
        q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", mark).start(out)
        assert q.awaitTermination(60)
    log = spark.createDataFrame([r for rows in batches for r in rows], schema)
    found = quota.quota_replay(log, "client", "ts", "cost", 100_000, 9.0, "tie")
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, found.collect()))
    with pytest.raises(ValueError, match="two windows"):
        quota.quota_stream(log, "client", "ts", "cost", 1_000_000, 9.0, idle_ms=1000)


def test_dedup_stream(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.createDataFrame(pd.DataFrame({"id": [1, 1, 2], "ts": [T0, T0, T0]})).write.parquet(src)
    s = changes.dedup_stream(spark.readStream.schema("id bigint, ts timestamp").parquet(src), ["id"], "ts", "1 hour")
    q = s.writeStream.format("memory").queryName("dedup_out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "m")).start()
    q.awaitTermination()
    assert spark.table("dedup_out").count() == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=20), st.integers(1, 6))
def test_pages_make_the_table(spark, keys, n):
    df = spark.createDataFrame(sorted(keys), "a int, b int")
    seen, after = [], None
    while page := [tuple(r) for r in scans.keyset_page(df, ["b", "a"], after, n).collect()]:
        seen += page
        after = (page[-1][1], page[-1][0])
        rest = scans.resume_scan(df, ["b", "a"], after).count()
        assert rest == len(keys) - len(seen)
    assert seen == sorted(keys, key=lambda k: (k[1], k[0]))


def test_parameters(spark):
    assert scans.run_query(spark, "SELECT ? AS a, '?' AS b -- ?", [3]).first()["a"] == 3
    for params in ([], [1, 2]):
        with pytest.raises(ValueError):
            scans.run_query(spark, "SELECT ? AS a", params)


def test_jdbc_source(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/derby;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(100).selectExpr("CAST(id AS INT) AS ID", "CAST(id % 7 AS INT) AS G")
    try:
        rows.write.jdbc(url, "T", properties=options)
    except Exception as e:  # the embedded database may be absent
        pytest.skip(str(e)[:80])
    split = scans.snapshot_scan(spark, url=url, table="T", split=("ID", 0, 100), partitions=4, options=options)
    assert split.rdd.getNumPartitions() == 4 and split.where("G = 3").count() == 14
    parts = scans.snapshot_scan(spark, url=url, table="T", predicates=["ID < 50", "ID >= 50"], options=options)
    assert parts.count() == 100


def test_statement_classes(spark):
    cases = {
        "SELECT 1": "read", " -- c\n select a from t;": "read", "show tables": "read", "EXPLAIN SELECT 1": "read", "select ';' as x": "read",
        "EXPLAIN ANALYZE SELECT 1": "other", "SELECT 1; DROP TABLE t": "other", "WITH a AS (SELECT 1) SELECT * FROM a": "other",
        "select * from t for update": "other", "insert into t values (1)": "write", "/* x */ DELETE FROM t": "write", "": "other",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", logs.classify_statement(F.col("s")).alias("kind"))
    assert {r["s"]: r["kind"] for r in df.collect()} == cases
    many = spark.createDataFrame([("GET", "/api/tables"), ("POST", "/api/query?x=1"), ("POST", "/auth/login"), ("OPTIONS", "/api/x"), ("DELETE", "/t")], "m string, p string")
    assert [r[0] for r in many.select(logs.classify_endpoint(F.col("m"), F.col("p"))).collect()] == ["read", "query", "auth", None, "write"]
