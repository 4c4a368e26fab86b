"""Versions that readers hold, increments that go on, state that folds, packed and backed-up batches."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.operators import range_tree as RT
from tablemirror.operators import reconcile as R
from tablemirror.operators import state as ST
from tablemirror.operators import store as S
from tablemirror.spec import TableSpec, wider_type

SPEC = TableSpec("t", ("id", "part"), "updated_at")
T0 = datetime(2025, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    return S.Store(spark, str(tmp_path / "db"))


def rows(spark, *some):
    data = [(i, p, v, T0 + timedelta(hours=h)) for i, p, v, h in some]
    return spark.createDataFrame(data, "id int, part string, v int, updated_at timestamp_ntz").coalesce(1)


def shown(store, version=None, spec=SPEC):
    return sorted((r["id"], r["part"], r["v"]) for r in store.current(spec, version).collect())


def test_the_watermark_never_goes_back(store, spark):
    S.sync_table(store, SPEC, rows(spark, (1, "a", 1, 0), (2, "a", 1, 200)))
    S.incremental_refresh(store, SPEC, rows(spark, (1, "a", 1, 0), (3, "a", 1, 150)), lookback=timedelta(hours=100))
    assert store.watermark("t")["last_processed_timestamp"] == T0 + timedelta(hours=200)
    keyless = TableSpec("u", (), "updated_at")
    S.sync_table(store, keyless, rows(spark, (2, "a", 1, 200)))
    S.incremental_refresh(store, keyless, rows(spark, (3, "a", 1, 150)), lookback=timedelta(hours=100))
    assert store.watermark("u")["last_processed_timestamp"] == T0 + timedelta(hours=200)
    assert shown(store, spec=keyless) == [(3, "a", 1)]


def test_readers_and_older_versions(store, spark):
    S.full_refresh(store, SPEC, rows(spark, (1, "a", 1, 0)))
    first, reader = store.live("t"), store.current(SPEC)
    S.full_refresh(store, SPEC, rows(spark, (1, "a", 2, 0), (2, "a", 2, 0)))
    S.sync_table(store, SPEC, rows(spark, (2, "a", 3, 0), (3, "a", 3, 1)))
    assert reader.count() == 1 and shown(store, first) == [(1, "a", 1)]
    assert shown(store, first + 1) == [(1, "a", 2), (2, "a", 2)]
    assert shown(store) == [(1, "a", 2), (2, "a", 3), (3, "a", 3)]
    gone = store.clean_up("t", timedelta(0))
    assert len(gone) == 1 and shown(store) == [(1, "a", 2), (2, "a", 3), (3, "a", 3)]
    with pytest.raises(LookupError):
        store.current(SPEC, first)


def test_two_drivers_do_not_publish_one_version(store, spark):
    S.full_refresh(store, SPEC, rows(spark, (1, "a", 1, 0)))
    other = S.Store(spark, store.root)
    batches, version = store.batches("t"), store.next_version("t")
    other.commit(SPEC, version, batches, None, None, None)
    with pytest.raises(S.VersionConflict):
        store.commit(SPEC, version, batches, None, None, None)


def test_an_increment_without_a_key_leaves_other_batches_alone(store, spark):
    spec = TableSpec("log", (), "updated_at")
    S.sync_table(store, spec, rows(spark, *((i, "a", 1, i) for i in range(10))))
    before = {b["folder"]: b["rows"] for b in store.batches("log")}
    assert sorted(before.values()) == [1, 9]
    everything = rows(spark, *((i, "a", 1, i) for i in range(10)), (9, "b", 1, 9), (10, "a", 1, 10))
    assert S.sync_table(store, spec, everything)[:3] == ("incremental", "success", 3)
    after = {b["folder"]: b["rows"] for b in store.batches("log")}
    body = next(f for f, n in before.items() if n == 9)
    assert body in after and sum(after.values()) == 12 and len(store.current(spec).collect()) == 12
    # with a look back into the body that one is cut, and only it
    S.incremental_refresh(store, spec, everything.where("id <> 8"), lookback=timedelta(hours=3))
    assert body not in {b["folder"] for b in store.batches("log")}
    assert sorted(r["id"] for r in store.current(spec).collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 9, 10]


@pytest.mark.parametrize("chunk", [1, 2])
def test_an_increment_goes_on_where_it_broke_off(store, spark, chunk):
    S.sync_table(store, SPEC, rows(spark, *((i, "a", 0, 0) for i in range(5))))
    source = rows(spark, *((i // 3, "abc"[i % 3], 1, 1 + i // 20) for i in range(60)))  # ties of 20 rows
    S.sync_table(store, TableSpec("whole", SPEC.keys, SPEC.watermark), source)

    def stop(done):
        if done == chunk:
            raise RuntimeError("crash")

    with pytest.raises(RuntimeError, match="crash"):
        S.incremental_refresh(store, SPEC, source, chunk_rows=10, after_chunk=stop)
    stored = store.raw("t").where("v = 1").count()
    assert 0 < stored < 60 and store.manifest("t", store.live("t"))["cursor"]
    mode, n = S.incremental_refresh(store, SPEC, source, chunk_rows=10)
    assert (mode, n) == ("incremental", 60 - stored) and store.manifest("t", store.live("t"))["cursor"] is None
    assert store.raw("t").where("v = 1").count() == 60
    assert [r for r in shown(store) if r[2]] == sorted((i // 3, "abc"[i % 3], 1) for i in range(60))
    assert store.watermark("t")["last_processed_timestamp"] == T0 + timedelta(hours=3)


def test_a_crash_before_a_chunk_is_named_repeats_that_chunk_only(store, spark, monkeypatch):
    S.sync_table(store, SPEC, rows(spark, (0, "a", 0, 0)))
    source, calls, save = rows(spark, *((i, "a", 1, i) for i in range(1, 41))), [], S.Store.save_watermark

    def failing(self, *a):
        calls.append(a)
        if len(calls) == 2:
            raise RuntimeError("crash")
        save(self, *a)

    with monkeypatch.context() as m:
        m.setattr(S.Store, "save_watermark", failing)
        with pytest.raises(RuntimeError, match="crash"):
            S.incremental_refresh(store, SPEC, source, chunk_rows=10)
    S.incremental_refresh(store, SPEC, source, chunk_rows=10)
    assert store.raw("t").where("v = 1").count() == 40


def test_schemas_that_widen_are_appended(store, spark):
    S.sync_table(store, SPEC, rows(spark, (1, "a", 1, 0), (2, "a", 1, 5)))
    wide = rows(spark, (1, "a", 1, 0), (3, "a", 7, 9)).withColumn("v", F.col("v").cast("bigint") * 2**40).withColumn("more", F.lit("x"))
    assert S.sync_table(store, SPEC, wide, evolve=True)[:3] == ("incremental", "success", 1)
    found = {r["id"]: (r["v"], r["more"]) for r in store.current(SPEC).collect()}
    assert found == {1: (1, None), 2: (1, None), 3: (7 * 2**40, "x")} and len(store.batches("t")) == 2
    assert store.current(SPEC).schema["v"].dataType == T.LongType()
    text = wide.withColumn("v", F.col("v").cast("string"))
    assert S.sync_table(store, SPEC, text, evolve=True)[0] == "full"


def test_types_that_hold_others():
    number = lambda p, s: T.DecimalType(p, s)
    assert wider_type(T.IntegerType(), T.LongType()) == wider_type(T.LongType(), T.IntegerType()) == T.LongType()
    assert wider_type(T.IntegerType(), number(12, 2)) == number(12, 2) and wider_type(T.LongType(), number(10, 0)) is None
    assert wider_type(number(10, 2), number(12, 3)) == number(12, 3) and wider_type(number(10, 2), number(12, 5)) is None
    assert wider_type(T.FloatType(), T.DoubleType()) == T.DoubleType() and wider_type(T.StringType(), T.LongType()) is None


def test_state_folds_and_keeps_every_row(spark, tmp_path):
    state = ST.StateTable(spark, str(tmp_path / "s"), "name string, n int, at timestamp", fold_at=8)
    with ThreadPoolExecutor(12) as pool:  # twelve tables at once
        list(pool.map(lambda i: state.add((f"t{i % 12}", i, T0 if i % 3 else None)), range(300)))
    found = state.read().collect()
    assert sorted(r["n"] for r in found) == list(range(300)) and all((r["at"] == T0) == bool(r["n"] % 3) for r in found)
    while state.fold():
        pass
    files = [p for p in (tmp_path / "s").rglob("*") if p.is_file() and p.name[0] not in "._"]
    assert len(files) < 50, len(files)
    assert state.read().count() == 300


def test_packing_takes_small_files_only_and_sorts_them(store, spark):
    big = spark.range(20_000).select(F.col("id").cast("int").alias("id"), F.lit("a").alias("part"), F.lit(0).alias("v"), F.lit(T0).cast("timestamp_ntz").alias("updated_at"))
    S.full_refresh(store, SPEC, spark.createDataFrame(big.collect(), rows(spark, (0, "", 0, 0)).schema).repartition(1))
    large = store.batches("t")[0]["folder"]
    size = max(store.files(f"{store.root}/t/{large}").values())
    for i in range(4):
        S.sync_table(store, SPEC, rows(spark, *((j, "b", i, 1 + i) for j in range(i, 40, 4))).repartition(3))
    before, versions = shown(store), store.raw("t").count()
    packed = S.compact(store, SPEC, target_bytes=size)
    assert large not in packed and len(packed) == 4 and len(store.batches("t")) == 2
    merged = next(b["folder"] for b in store.batches("t") if b["folder"] != large)
    assert len(store.files(f"{store.root}/t/{merged}")) == 1
    ids = [r["id"] for r in spark.read.parquet(f"{store.root}/t/{merged}").collect()]
    assert ids == sorted(ids) and shown(store) == before and store.raw("t").count() == versions
    assert S.compact(store, SPEC, target_bytes=size) == []


def test_a_number_of_files_does_not_make_files_too_large(store, spark, monkeypatch):
    S.full_refresh(store, SPEC, rows(spark, *((i, "a", i, 0) for i in range(4000))).repartition(4))
    before, folder = shown(store), store.batches("t")[0]["folder"]
    sizes = store.files(f"{store.root}/t/{folder}").values()
    for target, least, most in ((sum(sizes) // 5, 5, 6), (S.TARGET_BYTES, 2, 2)):
        S.compact(store, SPEC, 2, target_bytes=target)
        files = store.files(f"{store.root}/t/{store.batches('t')[0]['folder']}")
        assert least <= len(files) <= most and shown(store) == before
    monkeypatch.setattr(S, "FILE_ROWS", 1000)  # however small the files
    S.compact(store, SPEC, 2)
    assert len(store.files(f"{store.root}/t/{store.batches('t')[0]['folder']}")) == 4 and shown(store) == before
    assert S.compact(store, SPEC) == []


def test_backups_copy_what_is_new_and_restores_check_it(store, spark, tmp_path):
    target = str(tmp_path / "backups")
    pool = lambda: {str(p.parent) for p in (tmp_path / "backups/_batches").rglob("*.parquet")}
    S.sync_table(store, SPEC, rows(spark, (1, "a", 1, 0), (2, "a", 1, 1)))
    S.backup_database(store, target, "one")
    first = pool()
    S.sync_table(store, SPEC, rows(spark, (1, "a", 1, 0), (3, "a", 1, 2)))
    S.backup_database(store, target, "two")
    assert len(first) == 1 and len(pool() - first) == 1
    assert shown(S.restore_database(spark, target, "one", str(tmp_path / "r1"))) == [(1, "a", 1), (2, "a", 1)]
    restored = S.restore_database(spark, target, "two", str(tmp_path / "r2"))
    assert shown(restored) == [(1, "a", 1), (2, "a", 1), (3, "a", 1)]
    assert S.sync_table(restored, SPEC, rows(spark, (4, "a", 1, 3)))[0] == "incremental"
    S.delete_backup(store, target, "one")
    assert pool() >= first  # the other backup still has it
    (new,) = pool() - first
    changed = spark.read.parquet(new).withColumn("v", F.col("v") + 1).collect()
    spark.createDataFrame(changed, spark.read.parquet(new).schema).coalesce(1).write.mode("overwrite").parquet(new)
    with pytest.raises(RuntimeError, match="backed up"):
        S.restore_database(spark, target, "two", str(tmp_path / "r3"))


def diff(df, keys):
    return sorted((*(r[k] for k in keys), r["diff"]) for r in df.collect())


@pytest.mark.parametrize("kind", ["int", "string", "date"])
def test_ranges_find_what_rows_find(spark, kind):
    rng = random.Random(kind)
    base = spark.range(3000).select((F.col("id") * 3 % 2999).cast("int").alias("n"), (F.col("id") % 2).alias("m"), F.col("id").alias("v"))
    key = {"int": F.col("n"), "string": F.concat(F.lit("k"), F.col("n")), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("n"))}[kind]
    source = base.withColumn("k", key).drop("n").dropDuplicates(["k", "m"])
    assert RT.differing_ranges(source, source, ["k", "m"], 8, 50) == []
    gone = [rng.randrange(3000) for _ in range(3)]
    replica = source.where(~F.col("v").isin(gone)).withColumn("v", F.when(F.col("v") == 77, -1).when(F.col("v") == 78, None).otherwise(F.col("v")))
    replica = replica.unionByName(source.limit(1).withColumn("m", F.lit(9).cast("long")))
    for leaf, most in ((50, 256), (10**6, 256), (10, 3)):
        assert diff(RT.row_diff_by_ranges(source, replica, ["k", "m"], 8, leaf, most), ["k", "m"]) == diff(R.row_diff(source, replica, ["k", "m"]), ["k", "m"])
    assert diff(RT.row_diff_by_ranges(source, source.limit(0), ["k", "m"], 8, 50), ["k", "m"]) == diff(R.row_diff(source, source.limit(0), ["k", "m"]), ["k", "m"])


def test_one_changed_row_reads_one_range(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(20_000).select("id", (F.col("id") * 7).alias("v")).repartitionByRange(8, "id").sortWithinPartitions("id").write.parquet(path)
    source = spark.read.parquet(path)
    replica = source.withColumn("v", F.when(F.col("id") == 12_345, 0).otherwise(F.col("v")))
    ranges = RT.differing_ranges(source, replica, ["id"], 16, 100)
    assert len(ranges) == 1 and ranges[0][0] <= 12_345 < ranges[0][1] and ranges[0][1] - ranges[0][0] <= 100
    read = RT.row_diff_by_ranges(source, replica, ["id"], 16, 100)
    assert [tuple(r) for r in read.collect()] == [(12_345, "changed")]
    plan = read._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id" in plan and "LessThan(id" in plan  # the scan gets the range
    none = RT.row_diff_by_ranges(source, source, ["id"])
    assert none.count() == 0 and none.columns == ["id", "diff"]


def test_the_first_digest_brings_the_first_quantiles(spark, monkeypatch):
    passes, digests = [], RT.range_digests
    monkeypatch.setattr(RT, "range_digests", lambda *a: passes.append(a[3]) or digests(*a))
    source = spark.range(5000).select("id", (F.col("id") * 7).alias("v"))
    replica = source.withColumn("v", F.when(F.col("id") == 1234, 0).otherwise(F.col("v")))
    assert RT.differing_ranges(source, source, ["id"], 16, 100) == [] and not passes
    ranges = RT.differing_ranges(source, replica, ["id"], 64, 100)
    assert len(ranges) == 1 and ranges[0][0] <= 1234 < ranges[0][1] and len(passes) == 1  # two before


def test_ranges_with_null_keys(spark):
    source = spark.createDataFrame([(None, 1), (1, 1), (2, 2)], "k int, v int")
    assert RT.differing_ranges(source, source.where("k IS NOT NULL"), ["k"], 4, 1)[0][0] is None
