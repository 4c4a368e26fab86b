"""Loads, state, upkeep and validation on small seed tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tablemirror.functions import clean
from tablemirror.operators import reconcile as R
from tablemirror.operators import store as S
from tablemirror.spec import TableSpec, detect_watermark, map_schema, map_type, schema_changed, schema_fingerprint

PEOPLE = TableSpec("people", ("id",), "updated_at", {"birth": "date", "active": "tinyint(1)"})
T0 = datetime(2025, 1, 1)


def people(spark, *rows):
    return spark.createDataFrame(list(rows), "id int, name string, birth string, active boolean, updated_at timestamp_ntz")


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, str(tmp_path / "db"))


@pytest.fixture
def seed(spark):
    return people(spark, (1, "Alice", "1994-06-15", True, T0), (2, "Bob", "0000-00-00", False, T0 + timedelta(hours=1)))


def shown(store, spec=PEOPLE):
    return sorted(tuple(r) for r in store.current(spec).collect())


def test_full_then_incremental(store, spark, seed):
    assert S.sync_table(store, PEOPLE, seed)[:3] == ("full", "success", 2)
    assert [r[3] for r in shown(store)] == [1, 0]
    assert shown(store)[1][2] is None  # a zero date
    later = seed.union(people(spark, (3, "Cy", "2000-02-29", True, T0 + timedelta(hours=2)), (1, "Alicia", "1994-06-15", True, T0 + timedelta(hours=3))))
    changed = later.where("NOT (id = 1 AND name = 'Alice')")
    mode, status, n, _, _ = S.sync_table(store, PEOPLE, changed)
    assert (mode, status, n) == ("incremental", "success", 3)  # the boundary row comes again
    assert [(r[0], r[1]) for r in shown(store)] == [(1, "Alicia"), (2, "Bob"), (3, "Cy")]
    assert store.watermark("people")["last_processed_timestamp"] == T0 + timedelta(hours=3)
    S.sync_table(store, PEOPLE, changed)
    assert len(shown(store)) == 3  # nothing doubles when nothing is new
    log = store.state("sync_log", S.SYNC_LOG).orderBy("id").collect()
    assert [r["sync_type"] for r in log] == ["full", "incremental", "incremental"]
    assert log[1]["watermark_before"] < log[1]["watermark_after"]


def test_schema_change_reloads(store, spark, seed):
    S.sync_table(store, PEOPLE, seed)
    wider = seed.withColumn("email", F.lit("x"))
    assert S.sync_table(store, PEOPLE, wider)[0] == "full"
    assert "email" in store.current(PEOPLE).columns
    assert schema_changed(wider.schema, ("id",), schema_fingerprint(seed.schema, ("id",)))


def test_table_without_key_replaces_its_boundary(store, spark):
    spec = TableSpec("log", (), "created_at")
    rows = lambda *hours: spark.createDataFrame([(f"e{h}", T0 + timedelta(hours=h)) for h in hours], "what string, created_at timestamp_ntz")
    S.sync_table(store, spec, rows(1, 2, 2))
    assert S.sync_table(store, spec, rows(1, 2, 2, 2, 3))[:3] == ("incremental", "success", 4)
    assert sorted(r["what"] for r in store.current(spec).collect()) == ["e1", "e2", "e2", "e2", "e3"]


def test_table_without_key_keeps_rows_without_a_watermark(store, spark):
    spec = TableSpec("undated", (), "created_at")
    rows = lambda *hours: spark.createDataFrame([(f"e{h}", None if h is None else T0 + timedelta(hours=h)) for h in hours], "what string, created_at timestamp_ntz")
    S.sync_table(store, spec, rows(1, 2, None))
    assert S.sync_table(store, spec, rows(1, 2, None, None, 3))[:3] == ("incremental", "success", 4)
    assert sorted(r["what"] for r in store.current(spec).collect()) == ["e1", "e2", "e3", "eNone", "eNone"]
    assert S.sync_table(store, spec, rows(1, 2, None, None, 3))[:2] == ("incremental", "success")
    assert store.current(spec).count() == 5


def test_one_failing_table_does_not_stop_others(store, spark, seed):
    bad = seed.withColumn("name", F.raise_error(F.lit("no source")).cast("string"))
    done = {r["table_name"]: r for r in S.sync_all(store, [(TableSpec("bad", ("id",), "updated_at"), bad), (PEOPLE, seed)]).collect()}
    assert done["bad"]["status"] == "error" and done["people"]["status"] == "success"
    totals = R.sync_totals(spark.createDataFrame([("a", "success", "full", 3), ("b", "error", "incremental", 0)], "table_name string, status string, mode string, records bigint"))
    assert tuple(totals.first()) == (1, 1, 3, 1, 1)
    status = S.sync_status(store, ["people", "bad", "new"])
    assert sorted(r["table_name"] for r in status["pending"].collect()) == ["bad", "new"]


def test_bootstrap_resumes_and_guards(store, spark, seed):
    bad = seed.withColumn("name", F.raise_error(F.lit("no source")).cast("string"))
    two = TableSpec("two", ("id",), "updated_at")
    with pytest.raises(RuntimeError, match="two"):
        S.bootstrap_then(store, [(PEOPLE, seed), (two, bad)], lambda: "started")
    first = store.watermark("people")["version"]
    assert S.bootstrap_then(store, [(PEOPLE, seed), (two, seed)], lambda: "started", resume=True) == "started"
    assert store.watermark("people")["version"] == first
    S.bootstrap(store, [(PEOPLE, seed), (two, seed)])
    assert store.watermark("people")["version"] == first  # finished: no-op
    S.bootstrap(store, [(PEOPLE, seed)], force=True)
    assert store.watermark("people")["version"] == first + 1


def test_compact_vacuum_backup_restore(store, spark, seed, tmp_path):
    S.sync_table(store, PEOPLE, seed)
    S.sync_table(store, PEOPLE, people(spark, (1, "Al", "1994-06-15", True, T0 + timedelta(hours=5))).union(seed.where("id = 2")))
    before, versions = shown(store), store.raw("people").count()
    S.compact(store, PEOPLE, 1)
    assert shown(store) == before and store.raw("people").count() == versions == 4
    S.vacuum(store, PEOPLE)
    assert shown(store) == before and store.raw("people").count() == 2
    target = str(tmp_path / "backups")
    name = S.backup_database(store, target, "backup-1")
    listed = S.list_backups(spark, target).collect()
    assert [r["backup"] for r in listed] == [name] and listed[0]["bytes"] > 0
    again = S.restore_database(spark, target, name, str(tmp_path / "other"))
    assert sorted(tuple(r) for r in again.current(PEOPLE).collect()) == before
    with pytest.raises(FileExistsError):
        S.restore_database(spark, target, name, str(tmp_path / "other"))
    with pytest.raises(ValueError):
        S.delete_backup(store, target, "../db")
    assert S.prune_backups(store, target, 0) == []
    assert S.prune_backups(store, target, 1, datetime.now(timezone.utc) + timedelta(days=3)) == [name]
    assert store.children(target) == ["_batches"] and not store.children(f"{target}/_batches/people")


def test_vacuum_without_a_key_loses_no_row(store, spark):
    spec = TableSpec("log", (), "created_at")
    rows = spark.createDataFrame([(i % 3, T0 + timedelta(hours=i)) for i in range(10)], "what int, created_at timestamp_ntz")
    S.sync_table(store, spec, rows)
    before = sorted(map(tuple, store.current(spec).collect()))
    S.vacuum(store, spec)
    assert sorted(map(tuple, store.current(spec).collect())) == before and len(before) == 10


def test_many_tables_at_once_keep_their_state(store, spark, seed):
    specs = [TableSpec(f"t{i:02}", ("id",), "updated_at") for i in range(12)]
    done = S.sync_all(store, [(s, seed) for s in specs], at_once=6).collect()
    assert [r["status"] for r in done] == ["success"] * 12
    assert store.state("sync_log", S.SYNC_LOG).count() == 12
    assert {r["table_name"] for r in store.state("watermarks", S.WATERMARKS).collect()} == {s.name for s in specs}
    assert all(store.current(s).count() == 2 for s in specs)


@pytest.mark.parametrize("keys", [("id",), ()])
def test_a_run_that_broke_off_leaves_nothing_behind(store, spark, seed, monkeypatch, keys):
    """A crash between writing a version and naming it: the next run does not read what the first one left."""
    spec = TableSpec("people", keys, "updated_at", PEOPLE.declared)
    with monkeypatch.context() as m:
        m.setattr(S.Store, "save_watermark", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        assert S.sync_table(store, spec, seed)[1] == "error"
    assert S.sync_table(store, spec, seed.where("id = 1"))[:3] == ("full", "success", 1)
    assert store.current(spec).count() == 1
    later = seed.where("id = 1").union(people(spark, (1, "Al", "1994-06-15", True, T0 + timedelta(hours=5)))).coalesce(1)
    with monkeypatch.context() as m:
        m.setattr(S.Store, "save_watermark", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        assert S.sync_table(store, spec, later)[1] == "error"
    assert S.sync_table(store, spec, later)[:2] == ("incremental", "success")
    assert sorted(r["name"] for r in store.current(spec).collect()) == (["Al"] if keys else ["Al", "Alice"])
    with monkeypatch.context() as m:
        m.setattr(S.Store, "save_watermark", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError, match="crash"):
            S.compact(store, spec, 1)
    before = sorted(map(tuple, store.current(spec).collect()))
    S.compact(store, spec, 1)
    assert sorted(map(tuple, store.current(spec).collect())) == before
    store.clean_up("people", timedelta(0))
    assert len(store.children(f"{store.root}/people")) == 1


def test_one_run_a_table(store, seed):
    with store.writing("people"):
        assert S.sync_table(store, PEOPLE, seed)[1:3] == ("error", 0)
        with pytest.raises(S.TableBusy):
            S.vacuum(store, PEOPLE)
    assert S.sync_table(store, PEOPLE, seed)[1] == "success"


def test_drop_and_clear(store, spark, seed):
    S.sync_table(store, PEOPLE, seed)
    S.drop_replica(store, PEOPLE)
    with pytest.raises(LookupError):
        store.raw("people")
    assert S.sync_table(store, PEOPLE, seed)[0] == "full"
    S.clear_all(store, [PEOPLE])
    assert store.tables() == [] and store.watermark("people") is None


def test_partitioned_writes(store, spark, seed, tmp_path):
    path = str(tmp_path / "facts")
    for day in ("2025-01-01", "2025-01-02", "2025-01-02"):
        S.write_partitioned(seed, path, "fact", day)
    assert spark.read.parquet(path).count() == 6
    dims = str(tmp_path / "dims")
    for day in ("2025-01-01", "2025-01-02", "2025-01-02"):
        S.write_partitioned(seed, dims, "dimension", day)
    assert spark.read.parquet(dims).count() == 4
    assert S.drop_old_partitions(store, path, "ingest_date", 1, "2025-01-03") == ["ingest_date=2025-01-01"]
    assert spark.read.parquet(path).count() == 4


def test_types():
    wanted = {
        "tinyint(1)": "tinyint", "tinyint": "tinyint", "tinyint unsigned": "smallint", "int unsigned": "bigint", "bigint unsigned": "decimal(20,0)",
        "decimal(5,0)": "decimal(5,0)", "decimal": "decimal(38,10)", "datetime(6)": "timestamp_ntz", "timestamp": "timestamp", "date": "date",
        "time(6)": "string", "year": "string", "point": "string", "bit(8)": "string", "varbinary(64)": "binary", "enum('a','b')": "string", "float": "float",
    }
    assert {k: map_type(k).simpleString() for k in wanted} == wanted
    assert all(f.nullable for f in map_schema({"a": "int", "b": "date"}).fields)
    assert detect_watermark(["created_at", "updated_at"]) == "updated_at" and detect_watermark(["x"]) is None


def test_values(spark):
    df = spark.createDataFrame([("2024-00-15", bytearray(b"\xff")), ("1000-01-01", bytearray(b"\x00")), (None, None)], "d string, b binary")
    rows = clean.normalize(df, {"d": "date", "b": "bit(8)"}).collect()
    assert [str(r["d"]) if r["d"] else None for r in rows] == [None, "1000-01-01", None]
    assert [r["b"] for r in rows] == ["255", "0", None]
    times = spark.createDataFrame([("25:00:00",), ("23:59:59",), ("",)], "t string").select(clean.sanitize(F.col("t"), "time(6)").alias("t"))
    assert [r["t"] for r in times.collect()] == [None, "23:59:59", None]


def test_mismatch_reasons(spark):
    schema = "table_name string, in_source boolean, in_replica boolean, missing_columns string, extra_columns string, source_max_id string, replica_max_id string, source_checksum string, replica_checksum string, source_count bigint, replica_count bigint"
    base = dict(in_source=True, in_replica=True, missing_columns="", extra_columns="", source_max_id="9", replica_max_id="9", source_checksum="45", replica_checksum="45", source_count=9, replica_count=9)
    cases = {
        "ok": {}, "missing_table": {"in_replica": False}, "orphaned_table": {"in_source": False}, "missing_columns": {"missing_columns": "a", "extra_columns": "b"},
        "extra_columns": {"extra_columns": "b"}, "max_id": {"replica_max_id": "8", "replica_count": 8}, "checksum": {"replica_checksum": "44"}, "row_count": {"replica_count": 8},
    }
    names = [s.split()[0] for s in schema.split(", ")]
    rows = [tuple(({"table_name": n} | base | c)[k] for k in names) for n, c in cases.items()]
    found = R.classify_mismatch(spark.createDataFrame(rows, schema)).collect()
    assert {r["table_name"]: r["reason"] for r in found} == {n: n for n in cases}
