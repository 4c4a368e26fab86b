"""Registered queries of the load path: each loads derived tables into a store of its own and shows what readers see.

Stores are under the folder that all executors share. The SQL is the table that has to be
there in the end.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemirror.functions.clean import with_lineage
from tablemirror.operators import maintained, profile
from tablemirror.operators import store as S
from tablemirror.plans.queries import CHANGES_SQL, change_log, query, source_counts, table
from tablemirror.session import shared_dir
from tablemirror.sources import scans
from tablemirror.spec import TableSpec
from tablemirror.streaming import changes

ORDERS = TableSpec("orders", ("o_orderkey",), "o_orderdate")
EVENTS = TableSpec("events", ("event_id",), "ts")
SMALL = (TableSpec("region", ("r_regionkey",)), TableSpec("nation", ("n_nationkey",)), TableSpec("supplier", ("s_suppkey",)))
HALF = "TIMESTAMP '1998-04-25 00:00:00'"
#: The newest order of the first half: where an increment begins.
MARK_SQL = f"(SELECT max(o_orderdate) FROM orders WHERE o_orderdate < {HALF})"


def fresh(spark: SparkSession) -> S.Store:
    return S.Store(spark, f"{shared_dir(spark)}/mirror/{uuid.uuid4().hex}")


def done(result: tuple) -> None:
    """A load that failed is logged and not raised; here it is."""
    if result[1] != "success":
        raise RuntimeError(result[4])


def dearer(rows: DataFrame) -> DataFrame:
    return rows.withColumn("o_totalprice", F.col("o_totalprice") + 1)


@query("""SELECT *, 'b1' AS _sync_batch_id FROM orders UNION ALL
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1, o_orderdate, o_orderpriority, 'b2' FROM orders WHERE o_orderstatus = 'O'""")
def snk1_append_versions(spark, d):
    """Two batches of versions, the second written twice: a repeated batch changes nothing."""
    store, o = fresh(spark), table(spark, d, "orders")
    store.append_versions(o, "orders", 1, "b1")
    for _ in range(2):
        store.append_versions(dearer(o.where("o_orderstatus = 'O'")), "orders", 1, "b2")
    store.save_watermark(ORDERS, 1, None, None, None)
    return store.raw("orders")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderstatus <> 'P'""")
def snk2_full_refresh(spark, d):
    """Loaded whole twice: rows that the source no longer has are gone, the others are new."""
    store, o = fresh(spark), table(spark, d, "orders")
    S.full_refresh(store, ORDERS, o)
    S.full_refresh(store, ORDERS, dearer(o.where("o_orderstatus <> 'P'")))
    return store.current(ORDERS)


@query("""SELECT 'older' AS version, count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total FROM orders
    UNION ALL SELECT 'live', count(*), sum((o_totalprice + 2)::DECIMAL(18, 2))::DOUBLE FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'held by a reader', count(*), sum(o_totalprice::DECIMAL(18, 2))::DOUBLE FROM orders""")
def snk2_read_as_of(spark, d):
    """The first of three full loads: by its number, and by a reader that began before the others."""
    store, o = fresh(spark), table(spark, d, "orders")
    S.full_refresh(store, ORDERS, o)
    first, reader = store.live("orders"), store.current(ORDERS)
    S.full_refresh(store, ORDERS, dearer(o.where("o_orderstatus <> 'P'")))
    S.full_refresh(store, ORDERS, dearer(dearer(o.where("o_orderstatus = 'O'"))))
    seen = {"older": store.current(ORDERS, first), "live": store.current(ORDERS), "held by a reader": reader}
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    parts = [df.agg(F.count(F.lit(1)).alias("n"), total).select(F.lit(name).alias("version"), "n", "total") for name, df in seen.items()]
    return parts[0].union(parts[1]).union(parts[2])


class BrokeOff(RuntimeError):
    """A run is stopped from outside."""


@query(f"""SELECT o_orderkey, CASE WHEN o_orderdate >= {MARK_SQL} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderdate = {MARK_SQL} THEN 2 ELSE 1 END::BIGINT AS versions FROM orders""")
def src5_resumed_increment(spark, d):
    """An increment in chunks that breaks off after the second and is taken up there: no row but those at the watermark is stored twice."""
    store, o = fresh(spark), table(spark, d, "orders")
    done(S.sync_table(store, ORDERS, o.where(F.expr(f"o_orderdate < {HALF}"))))

    def stop(chunk: int) -> None:
        if chunk == 2:
            raise BrokeOff("after the second chunk")

    rows = max(o.count() // 10, 1)
    try:
        S.incremental_refresh(store, ORDERS, dearer(o), chunk_rows=rows, after_chunk=stop)
    except BrokeOff:
        S.incremental_refresh(store, ORDERS, dearer(o), chunk_rows=rows)
    versions = store.raw("orders").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("versions"))
    return store.current(ORDERS).select("o_orderkey", "o_totalprice").join(versions, "o_orderkey")


@query(f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderdate >= {MARK_SQL} THEN o_orderpriority END AS o_orderpriority
    FROM orders""")
def mt4_evolving_schema(spark, d):
    """A column that the source gained and a wider key type are appended, and the table is not loaded anew."""
    store, o = fresh(spark), table(spark, d, "orders")
    small = o.withColumn("o_custkey", F.col("o_custkey").cast("int")).drop("o_orderpriority")
    done(S.sync_table(store, ORDERS, small.where(F.expr(f"o_orderdate < {HALF}"))))
    done(S.sync_table(store, ORDERS, o, evolve=True))
    return store.current(ORDERS)


@query(f"""SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderdate >= {MARK_SQL} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    o_orderdate, o_orderpriority FROM orders""")
def snk3_incremental_refresh(spark, d):
    """The older half, then what is new: rows at the watermark come again and replace what they were."""
    store, o = fresh(spark), table(spark, d, "orders")
    done(S.sync_table(store, ORDERS, o.where(F.expr(f"o_orderdate < {HALF}"))))
    done(S.sync_table(store, ORDERS, dearer(o)))
    return store.current(ORDERS)


@query(f"""SELECT * FROM orders WHERE o_orderdate < {MARK_SQL} AND o_orderstatus <> 'P' UNION ALL SELECT * FROM orders WHERE o_orderdate >= {MARK_SQL}""")
def snk3_incremental_without_key(spark, d):
    """The same without a key: the boundary's slice is replaced, not doubled."""
    store, o, spec = fresh(spark), table(spark, d, "orders"), TableSpec("orders", (), "o_orderdate")
    # the first load lacks some old rows, and the increment must not bring them back
    first = o.where(F.expr(f"o_orderdate < {HALF}"))
    mark = first.agg(F.max("o_orderdate")).first()[0]
    done(S.sync_table(store, spec, first.where((F.col("o_orderstatus") != "P") | (F.col("o_orderdate") == F.lit(mark)))))
    done(S.sync_table(store, spec, o))
    return store.current(spec)


@query("""SELECT 'region' AS table_name, 'full' AS mode, 'success' AS status, count(*)::BIGINT AS records FROM region
    UNION ALL SELECT 'nation', 'full', 'success', count(*) FROM nation UNION ALL SELECT 'supplier', 'full', 'success', count(*) FROM supplier
    UNION ALL SELECT 'broken', 'full', 'error', 0""")
def snk5_sync_all(spark, d):
    """Several tables at once; one fails and the others do not."""
    bad = table(spark, d, "region").withColumn("r_name", F.raise_error(F.lit("no source")).cast("string"))
    pairs = [(s, table(spark, d, s.name)) for s in SMALL] + [(TableSpec("broken", ("r_regionkey",)), bad)]
    return S.sync_all(fresh(spark), pairs).select("table_name", "mode", "status", "records")


@query(f"""SELECT 'orders' AS table_name, (SELECT max(o_orderkey)::VARCHAR FROM orders WHERE o_orderdate >= {MARK_SQL}) AS last_processed_id,
    (SELECT max(o_orderdate) FROM orders) AS last_processed_timestamp, 'o_orderkey' AS primary_key_column, 'o_orderdate' AS timestamp_column""")
def snk6_watermarks(spark, d):
    """The newest state row of a table after a full and an incremental load."""
    store, o = fresh(spark), table(spark, d, "orders")
    done(S.sync_table(store, ORDERS, o.where(F.expr(f"o_orderdate < {HALF}"))))
    done(S.sync_table(store, ORDERS, o))
    marks = S.sync_status(store, ["orders"])["watermarks"]
    at = F.col("last_processed_timestamp").cast("timestamp_ntz").alias("last_processed_timestamp")
    return marks.select("table_name", "last_processed_id", at, "primary_key_column", "timestamp_column")


@query(f"""SELECT 'full' AS sync_type, 'success' AS status, count(*)::BIGINT AS records_processed, NULL::TIMESTAMP AS watermark_before, max(o_orderdate) AS watermark_after
    FROM orders WHERE o_orderdate < {HALF}
    UNION ALL SELECT 'incremental', 'success', count(*), {MARK_SQL}, max(o_orderdate) FROM orders WHERE o_orderdate >= {MARK_SQL}
    UNION ALL SELECT 'full', 'error', 0, max(o_orderdate), max(o_orderdate) FROM orders""")
def snk7_sync_log(spark, d):
    """One log row a run, a failed one too, with both watermarks."""
    store, o = fresh(spark), table(spark, d, "orders")
    S.sync_table(store, ORDERS, o.where(F.expr(f"o_orderdate < {HALF}")))
    S.sync_table(store, ORDERS, o)
    S.sync_table(store, ORDERS, o.withColumn("o_orderstatus", F.raise_error(F.lit("no source")).cast("string")), force_full=True)
    marks = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("watermark_before", "watermark_after")]
    return store.state("sync_log", S.SYNC_LOG).select("sync_type", "status", "records_processed", *marks)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey > 0")
def snk9_restore(spark, d):
    """A backup restored elsewhere, after the store it came from was loaded anew."""
    store, spec = fresh(spark), SMALL[1]
    n = table(spark, d, "nation")
    S.full_refresh(store, spec, n.where("n_regionkey > 0"))
    name = S.backup_database(store, f"{store.root}-backups", "b1")
    S.full_refresh(store, spec, n)
    return S.restore_database(spark, f"{store.root}-backups", name, f"{store.root}-restored").current(spec)


@query("SELECT 'b1' AS backup, true AS has_bytes")
def snk12_prune_backups(spark, d):
    """Old backups go; what was written in the meantime stays listed."""
    from datetime import datetime, timedelta, timezone

    store = fresh(spark)
    S.full_refresh(store, SMALL[0], table(spark, d, "region"))
    target = f"{store.root}-backups"
    S.backup_database(store, target, "b0")
    S.prune_backups(store, target, 1, datetime.now(timezone.utc) + timedelta(days=2))
    S.backup_database(store, target, "b1")
    return S.list_backups(spark, target).select("backup", (F.col("bytes") > 0).alias("has_bytes"))


@query("SELECT 'supplier' AS table_name")
def snk13_drop_replica(spark, d):
    """A table without its replica is pending again."""
    store = fresh(spark)
    S.sync_all(store, [(s, table(spark, d, s.name)) for s in SMALL])
    S.drop_replica(store, SMALL[2])
    return S.sync_status(store, [s.name for s in SMALL])["pending"]


@query("SELECT 'region' AS table_name UNION ALL SELECT 'nation'")
def snk14_clear_all(spark, d):
    """After everything was cleared, only what is loaded again has a replica."""
    store = fresh(spark)
    pairs = [(s, table(spark, d, s.name)) for s in SMALL]
    S.sync_all(store, pairs)
    S.clear_all(store, SMALL)
    S.sync_all(store, pairs[2:])
    return S.sync_status(store, [s.name for s in SMALL])["pending"]


@query("""SELECT table_name, last_sync FROM (VALUES ('region', 'full'), ('nation', 'full'), ('orders', 'incremental')) t(table_name, last_sync)""")
def ag13_sync_status(spark, d):
    """Tables with a replica, and how each was loaded last."""
    store = fresh(spark)
    o = table(spark, d, "orders")
    done(S.sync_table(store, ORDERS, o.where(F.expr(f"o_orderdate < {HALF}"))))
    S.sync_all(store, [(s, table(spark, d, s.name)) for s in SMALL[:2]] + [(ORDERS, o)])
    status = S.sync_status(store, ["region"])
    last = status["log"].groupBy("table_name").agg(F.max_by("sync_type", "id").alias("last_sync"))
    return status["watermarks"].select("table_name").join(last, "table_name")


@query("SELECT event_id, ts AS updated_at, value FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def src6_detected_incremental(spark, d):
    """An incremental read that finds the watermark column by its name."""
    e = table(spark, d, "events").select("event_id", F.col("ts").alias("updated_at"), "value")
    return scans.detected_incremental(e, "2024-01-15 00:00:00")


@query(f"""SELECT o_orderkey, o_totalprice FROM (SELECT * FROM {CHANGES_SQL}
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY _seq DESC) = 1) WHERE _op <> 'd'""")
def sm3_apply_changes(spark, d):
    """A change feed in two parts, each applied by a run of the stream; readers see the newest change of each key."""
    root = fresh(spark).root
    log = change_log(spark, d).withColumn("_source_ts", F.lit(None).cast("timestamp"))
    for part in (F.col("_op") == "i", F.col("_op") != "i"):
        log.where(part).write.mode("append").parquet(f"{root}/feed")
        feed = scans.change_feed(spark, f"{root}/feed", log.schema)
        changes.apply_changes(feed, f"{root}/applied", f"{root}/position").awaitTermination()
    return changes.mirrored(spark, f"{root}/applied", ["o_orderkey"])


@query(f"""SELECT o_orderkey, o_totalprice FROM (SELECT * FROM {CHANGES_SQL}
    QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY _seq DESC) = 1) WHERE _op <> 'd'""")
def sm5_maintained_current(spark, d):
    """The same changes merged into buckets, the newest first and the oldest last, one batch twice: no read ranks the history."""
    store, spec = fresh(spark), TableSpec("orders", ("o_orderkey",))
    log = change_log(spark, d)
    for batch, part in enumerate((F.col("_op") == "u", F.col("_op") == "d", F.col("_op") == "i")):
        for _ in range(1 + (batch == 1)):
            maintained.merge_changes(store, spec, log.where(part), batch, buckets=8)
    return store.current(spec)


def _pairs(spark: SparkSession, d: str, *which: int) -> list:
    return [(SMALL[i], table(spark, d, SMALL[i].name)) for i in which]


@query("""SELECT n_nationkey, n_name, n_regionkey, 'success,error,success' AS cycles FROM nation""")
def sm6_failed_cycle(spark, d):
    """A cycle in which one of two tables fails keeps the old snapshot, and the next one loads what it missed."""
    store = fresh(spark)
    n = table(spark, d, "nation")
    changes.logged_cycle(store, [(SMALL[1], n.where("n_regionkey > 0")), *_pairs(spark, d, 0)])
    broken = n.withColumn("n_name", F.raise_error(F.lit("no source")).cast("string"))
    changes.logged_cycle(store, [(SMALL[1], broken), *_pairs(spark, d, 0)])
    changes.logged_cycle(store, _pairs(spark, d, 0, 1))
    said = [r["status"] for r in store.state("cycles", changes.CYCLES).orderBy("created_at").collect()]
    return store.current(SMALL[1]).withColumn("cycles", F.lit(",".join(said)))


@query("""SELECT 'success,error,success' AS cycles, 'success,error,success' AS wanted, (SELECT count(*)::BIGINT FROM nation) AS nations,
    (SELECT count(*)::BIGINT FROM supplier) AS suppliers""")
def sm7_vanished_target(spark, d):
    """A cycle is blocked while a tracked table has no replica, and goes on when it is back."""
    store, said = fresh(spark), []
    said.append(changes.logged_cycle(store, _pairs(spark, d, 1)))
    S.drop_replica(store, SMALL[1])
    said.append(changes.logged_cycle(store, _pairs(spark, d, 1, 2)))
    done(S.sync_table(store, *_pairs(spark, d, 1)[0]))
    said.append(changes.logged_cycle(store, _pairs(spark, d, 1, 2)))
    log = store.state("cycles", changes.CYCLES).orderBy("created_at").collect()
    counts = [store.current(spec).agg(F.count(F.lit(1)).alias(name)) for spec, name in ((SMALL[1], "nations"), (SMALL[2], "suppliers"))]
    cycles = [F.lit(",".join(r["status"] for r in log)).alias("cycles"), F.lit(",".join("error" if e else "success" for e in said)).alias("wanted")]
    return counts[0].crossJoin(counts[1]).select(*cycles, "nations", "suppliers")  # a row each


@query("SELECT * FROM orders")
def sm8_restarted_polling(spark, d):
    """Polling is stopped, the source grows, and polling that starts again loads what it has missed."""
    store, o = fresh(spark), table(spark, d, "orders")
    o.where(F.expr(f"o_orderdate < {HALF}")).write.parquet(f"{store.root}-source")
    source = lambda: [(ORDERS, spark.read.schema(o.schema).parquet(f"{store.root}-source"))]

    def run(cycles: int) -> None:
        polling = changes.start_polling(store, source, f"{store.root}-position")
        try:
            for _ in range(600):
                if polling.exception() is not None or changes.last_snapshot(store)[0] >= cycles:
                    break
                time.sleep(0.5)
        finally:
            polling.stop()

    run(1)
    o.where(F.expr(f"o_orderdate >= {HALF}")).write.mode("append").parquet(f"{store.root}-source")
    run(changes.last_snapshot(store)[0] + 1)
    return store.current(ORDERS)


@query("""SELECT 'region' AS table_name, count(*)::BIGINT AS n, 'bootstrap' AS loaded_by FROM region
    UNION ALL SELECT 'nation', count(*), 'bootstrap' FROM nation UNION ALL SELECT 'supplier', count(*), 'polling' FROM supplier""")
def sm10_bootstrap_then_poll(spark, d):
    """Tables are loaded, then polled with one table more; a load that failed starts nothing."""
    store = fresh(spark)
    bad = table(spark, d, "nation").withColumn("n_name", F.raise_error(F.lit("no source")).cast("string"))
    poll = lambda: changes.poll_cycle(store, _pairs(spark, d, 0, 1, 2))
    try:
        S.bootstrap_then(store, [*_pairs(spark, d, 0), (SMALL[1], bad)], poll)
    except RuntimeError:
        S.bootstrap_then(store, _pairs(spark, d, 0, 1), poll, resume=True)
    by = {r["table_name"] for r in store.state("progress", S.PROGRESS).where("status = 'done'").collect()}
    parts = [
        store.current(s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s.name).alias("table_name"), "n", F.lit("bootstrap" if s.name in by else "polling").alias("loaded_by"))
        for s in SMALL
    ]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT 'events' AS table_name, count(*)::BIGINT AS row_count, 'event_id' AS key_columns, 0::BIGINT AS null_keys, true AS key_is_unique,
        'created_at' AS watermark_column, 'append-only' AS watermark_quality, 0::BIGINT AS null_marks, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day,
        0::BIGINT AS unsupported, '' AS unsupported_columns FROM events
    UNION ALL SELECT 'lines', count(*), 'l_orderkey', 0, false, 'updated_at', 'best', 0, min(l_shipdate)::DATE::VARCHAR, max(l_shipdate)::DATE::VARCHAR, 2, 'l_comment,l_place'
        FROM lineitem
    UNION ALL SELECT 'orders', count(*), 'o_orderkey', count(*) FILTER (o_orderstatus = 'P'), (count(*) FILTER (o_orderstatus = 'P')) <= 1, 'modifiedAt', 'none',
        count(*) FILTER (o_orderpriority = '5-LOW'), min(o_orderdate) FILTER (o_orderpriority <> '5-LOW')::DATE::VARCHAR,
        max(o_orderdate) FILTER (o_orderpriority <> '5-LOW')::DATE::VARCHAR, 0, '' FROM orders
    UNION ALL SELECT 'nation', count(*), '', 0, NULL, NULL, 'none', 0, NULL, NULL, 0, '' FROM nation""")
def vl5_profile_from_statistics(spark, d):
    """Profiles by footers and sketches: watermarks found by name, repeated and NULL keys, rows without a time, unsupported types."""
    root = fresh(spark).root
    o = table(spark, d, "orders").withColumn("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")))
    o = o.withColumn("modifiedAt", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))).drop("o_orderdate")
    declared = {"l_orderkey": "bigint", "l_comment": "geometry", "l_place": "point", "l_note": "json", "l_year": "year"}
    pairs = [
        (TableSpec("events", ("event_id",)), table(spark, d, "events").withColumnRenamed("ts", "created_at")),
        (TableSpec("lines", ("l_orderkey",), declared=declared), table(spark, d, "lineitem").withColumnRenamed("l_shipdate", "updated_at")),
        (TableSpec("orders", ("o_orderkey",)), o),
        (TableSpec("nation"), table(spark, d, "nation")),
    ]
    found = None
    for spec, rows in pairs:
        rows.write.parquet(f"{root}/{spec.name}")
        one = profile.profile_files(spark, spec, f"{root}/{spec.name}")
        found = one if found is None else found.union(one)
    days = [F.substring(f"{w}_mark", 1, 10).alias(f"{w}_day") for w in ("first", "last")]
    return found.select(*[c for c in found.columns if c not in ("first_mark", "last_mark")], *days)


#: A key with most of its rows in a small part of its range.
SKEWED = "CASE WHEN o_orderkey % 10 < 9 THEN o_orderkey ELSE o_orderkey * 1000 END"


@query(f"""SELECT (r // s)::INTEGER AS part, count(*)::BIGINT AS n, min(k)::BIGINT AS first_key, max(k)::BIGINT AS last_key FROM (
    SELECT k, row_number() OVER (ORDER BY p, k) - 1 AS r, count(*) OVER () // 8 + 1 AS s FROM (SELECT {SKEWED} AS k, o_orderpriority AS p FROM orders)) GROUP BY 1""")
def src1_balanced_ranges(spark, d):
    """Parts of equal row counts of a table with a skewed composite key, by the conditions that a source would get."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.expr(SKEWED).alias("k"))
    step = rows.count() // 8 + 1

    def first_after(key, n):
        page = scans.keyset_page(rows, ["p", "k"], key, n).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("p", "k")).alias("last")).first()
        return tuple(page["last"]) if page["n"] == n else None

    bounds = scans.keyset_bounds(first_after, step)
    parts = [rows.where(F.expr(condition)).withColumn("part", F.lit(i)) for i, condition in enumerate(scans.key_predicates(["p", "k"], bounds))]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))


@query("SELECT * FROM events")
def sm12_dedup_stream(spark, d):
    """Rows that a feed holds twice come out of the stream once."""
    root, e = fresh(spark).root, table(spark, d, "events")
    e.union(e.where("event_type = 'click'")).write.parquet(f"{root}/feed")
    once = changes.dedup_stream(scans.change_feed(spark, f"{root}/feed", e.schema), ["event_id"], "ts", "60 days")
    writer = once.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{root}/position")
    writer.start(f"{root}/out").awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{root}/out")


@query("""SELECT 'region' AS table_name, 'full' AS mode, count(*)::BIGINT AS records FROM region
    UNION ALL SELECT 'nation', 'full', count(*) FROM nation WHERE n_regionkey > 0""")
def sm2_poll_sync(spark, d):
    """Two polling cycles: the second loads only the table that has lost rows and the one that is new."""
    store = fresh(spark)
    n = table(spark, d, "nation")
    snap = source_counts(spark, d).withColumn("change_token", F.lit("x"))
    first = snap.where("table_name IN ('nation', 'supplier')")
    changes.poll_sync(store, [(SMALL[1], n), (SMALL[2], table(spark, d, "supplier"))], None, first)
    fewer = F.when(F.col("table_name") == "nation", F.col("row_count") - 1).otherwise(F.col("row_count"))
    now = snap.where("table_name IN ('nation', 'supplier', 'region')").withColumn("row_count", fewer)
    pairs = [(SMALL[0], table(spark, d, "region")), (SMALL[1], n.where("n_regionkey > 0")), (SMALL[2], table(spark, d, "supplier"))]
    return changes.poll_sync(store, pairs, first, now)[1].select("table_name", "mode", "records")


@query("""SELECT 'region' AS table_name, 'done' AS status, count(*)::BIGINT AS records FROM region
    UNION ALL SELECT 'nation', 'done', count(*) FROM nation UNION ALL SELECT 'supplier', 'done', count(*) FROM supplier""")
def sm9_bootstrap(spark, d):
    """A first load of which a table failed, then resumed: the failed one follows and no other is repeated."""
    store, pairs = fresh(spark), [(s, table(spark, d, s.name)) for s in SMALL]
    bad = pairs[1][1].withColumn("n_name", F.raise_error(F.lit("no source")).cast("string"))
    S.bootstrap(store, [pairs[0], (SMALL[1], bad)])
    return S.bootstrap(store, pairs, resume=True).select("table_name", "status", "records")


@query("""SELECT 'b1' AS batch, count(*)::BIGINT AS versions, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total FROM orders
    UNION ALL SELECT 'b2', count(*), sum((o_totalprice + 1)::DECIMAL(18, 2))::DOUBLE FROM orders WHERE o_orderstatus = 'O'""")
def mt1_compact(spark, d):
    """Compaction rewrites files, not versions: every batch is still there."""
    store, o = fresh(spark), table(spark, d, "orders")
    for batch, rows in (("b1", o), ("b2", dearer(o.where("o_orderstatus = 'O'")))):
        store.append_versions(with_lineage(rows, batch, "", F.col("o_orderdate")), "orders", 1, batch)
    store.save_watermark(ORDERS, 1, None, None, None)
    S.compact(store, ORDERS, 2)
    raw = store.raw("orders").groupBy(F.col("_sync_batch_id").alias("batch"))
    return raw.agg(F.count(F.lit(1)).alias("versions"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""SELECT o_orderstatus, count(*)::BIGINT AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total FROM (
    SELECT o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders) GROUP BY 1""")
def mt1_packed_batches(spark, d):
    """Batches of small files are packed into one sorted file; a read as of the version before still finds the old ones."""
    store, o = fresh(spark), table(spark, d, "orders")
    S.full_refresh(store, ORDERS, o.repartition(7))
    for status in ("O", "P"):
        version = store.next_version("orders")
        rows = with_lineage(dearer(o.where(F.col("o_orderstatus") == status)).repartition(5), status, "", F.current_timestamp())
        new = store.add_batch(rows, ORDERS, version, f"b-{status}")
        store.commit(ORDERS, version, [*store.batches("orders"), new], None, None, None)
    before = store.live("orders") - 1  # without the last batch
    S.compact(store, ORDERS)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    by = lambda df: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), total)
    now, older = by(store.current(ORDERS)), by(store.current(ORDERS, before))
    return now.where("o_orderstatus <> 'P'").union(older.where("o_orderstatus = 'P'"))


@query("SELECT * FROM orders")
def mt4_rebuild_on_schema_change(spark, d):
    """A column that the source gained makes the next run a full load."""
    store, o = fresh(spark), table(spark, d, "orders")
    done(S.sync_table(store, ORDERS, o.drop("o_orderpriority").where("o_orderstatus <> 'P'")))
    done(S.sync_table(store, ORDERS, o))
    return store.current(ORDERS)


@query("""SELECT 'fact' AS kind, DATE '2025-01-01' AS day, count(*)::BIGINT AS n FROM nation UNION ALL SELECT 'fact', DATE '2025-01-02', 2 * count(*) FROM nation
    UNION ALL SELECT 'dimension', DATE '2025-01-01', count(*) FROM nation UNION ALL SELECT 'dimension', DATE '2025-01-02', count(*) FROM nation WHERE n_regionkey > 0
    UNION ALL SELECT 'metadata', NULL, count(*) FROM nation WHERE n_regionkey > 0""")
def pd2_write_partitioned(spark, d):
    """Facts append to a date, dimensions replace theirs, metadata replaces all."""
    root, n = fresh(spark).root, table(spark, d, "nation")
    parts = []
    for kind, day in (("fact", "ingest_date"), ("dimension", "snapshot_date"), ("metadata", None)):
        for date, rows in (("2025-01-01", n), ("2025-01-02", n), ("2025-01-02", n if kind == "fact" else n.where("n_regionkey > 0"))):
            S.write_partitioned(rows, f"{root}/{kind}", kind, date)
        found = spark.read.parquet(f"{root}/{kind}").groupBy((F.col(day) if day else F.lit(None)).cast("date").alias("day"))
        parts.append(found.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "day", "n"))
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT ts::DATE AS day, count(*)::BIGINT AS n FROM events WHERE ts::DATE >= DATE '2024-01-23' GROUP BY 1""")
def pd4_drop_old_partitions(spark, d):
    """Date partitions older than seven days are gone, the others whole."""
    store = fresh(spark)
    path = f"{store.root}/events"
    table(spark, d, "events").withColumn("day", F.col("ts").cast("date")).write.partitionBy("day").parquet(path)
    S.drop_old_partitions(store, path, "day", 7, "2024-01-30")
    return spark.read.parquet(path).groupBy(F.col("day").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
