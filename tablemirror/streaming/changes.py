"""Change feeds and polling."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablemirror.operators.current import current_from_changes, current_rows
from tablemirror.operators.reconcile import missing_targets
from tablemirror.operators.store import Store, sync_all
from tablemirror.spec import TableSpec


def plan_cycle(before: DataFrame, now: DataFrame, first: bool = False) -> DataFrame:
    """What each table needs, from two sets of ``(table_name, row_count, change_token)``.

    A new table is loaded; fewer rows mean deletes and a full load; more rows or another
    token an incremental one. The first cycle only loads tables without a snapshot.
    """
    b = before.select("table_name", F.col("row_count").alias("b_count"), F.col("change_token").alias("b_token"))
    n = now.select("table_name", F.col("row_count").alias("n_count"), F.col("change_token").alias("n_token"))
    gap = F.col("n_count") - F.col("b_count")
    action = (
        F.when(F.col("n_count").isNull(), "vanished")
        .when(F.col("b_count").isNull(), "full")
        .when(F.lit(first), "none")
        .when(gap < 0, "full")
        .when((gap > 0) | ~F.col("b_token").eqNullSafe(F.col("n_token")), "incremental")
        .otherwise("none")
    )
    return b.join(n, "table_name", "full_outer").select(
        "table_name",
        action.alias("action"),
        F.when(action == "incremental", F.greatest(gap, F.lit(0))).otherwise(0).cast("long").alias("inserts"),
        F.when((action == "incremental") & (gap == 0), 1).otherwise(0).cast("long").alias("updates"),
        F.when((action == "full") & (gap < 0), -gap).otherwise(0).cast("long").alias("deletes"),
    )


def change_counters(log: DataFrame, batch: str, op: str = "_op") -> DataFrame:
    """Inserts, updates and deletes of each batch, and running sums over the batches."""
    from pyspark.sql import Window

    kinds = {"inserts": "i", "updates": "u", "deletes": "d"}
    each = log.groupBy(batch).agg(*[F.count_if(F.col(op) == code).alias(name) for name, code in kinds.items()])
    # one row a batch: the log of batches is small whatever the batches hold
    so_far = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)
    return each.select("*", *[F.sum(name).over(so_far).alias(f"total_{name}") for name in kinds])


def detect_deletes(source_keys: DataFrame, replica: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the replica that the source no longer has: the tombstones to append."""
    return replica.select(*keys).join(source_keys.select(*keys), list(keys), "left_anti")


def guard_targets(tracked: DataFrame, visible: DataFrame) -> None:
    """Fail if a tracked table has gone from the target."""
    gone = [r["table_name"] for r in missing_targets(tracked, visible).collect()]
    if gone:
        raise RuntimeError(f"targets have vanished: {', '.join(sorted(gone))}")


def apply_changes(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    guard: Callable[[SparkSession], None] | None = None,
    once: bool = True,
    interval: str = "1 second",
) -> StreamingQuery:
    """Append a change feed to a log of versions, exactly once in effect.

    Each micro-batch is one folder, written by overwriting it, so a batch that is replayed
    after a failure replaces itself. An exception leaves the position where it was; a
    query started again with the same checkpoint goes on with what came meanwhile.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if guard is not None:
            guard(batch.sparkSession)
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def mirrored(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The table that an applied change log shows: newest change per key, deletes absent."""
    return current_from_changes(spark.read.parquet(path), keys).drop("_op", "_seq", "_source_ts", "batch_id")


def poll_sync(store: Store, tables: Sequence[tuple[TableSpec, DataFrame]], before: DataFrame | None, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The actions of one polling cycle: plan, run what is needed, and give the plan and the results.

    A planned table that is not among ``tables`` is an error.
    """
    spark = store.spark
    nothing = spark.createDataFrame([], "table_name string, row_count bigint, change_token string")
    plan = plan_cycle(nothing if before is None else before, snapshots)
    actions = {r["table_name"]: r["action"] for r in plan.collect()}
    pairs = {s.name: (s, d) for s, d in tables}
    unknown = sorted(n for n, a in actions.items() if a in ("full", "incremental") and n not in pairs)
    if unknown:
        raise LookupError(f"no source was given for {', '.join(unknown)}")
    results = None
    for force, action in ((True, "full"), (False, "incremental")):
        chosen = [pairs[n] for n, a in actions.items() if a == action]
        done = sync_all(store, chosen, force_full=force) if chosen else None
        results = done if results is None else results if done is None else results.union(done)
    empty = spark.createDataFrame([], "table_name string, mode string, status string, records bigint, duration_ms bigint, error string")
    return plan, empty if results is None else results


#: One row a cycle that succeeded, with what it saw of each source table, and one row a cycle however it ended.
SNAPSHOTS = "cycle bigint, tables string, updated_at timestamp"
CYCLES = "cycle bigint, status string, inserts bigint, updates bigint, deletes bigint, error_message string, created_at timestamp"
_SNAPSHOT = "table_name string, row_count bigint, change_token string"


def last_snapshot(store: Store) -> tuple[int, DataFrame | None]:
    """Number of the last cycle that succeeded, and what it saw; 0 and None before the first."""
    row = store.state("snapshots", SNAPSHOTS).agg(F.max_by("tables", "cycle").alias("tables"), F.max("cycle").alias("cycle")).first()
    if row["cycle"] is None:
        return 0, None
    return row["cycle"], store.spark.createDataFrame([tuple(r) for r in json.loads(row["tables"])], _SNAPSHOT)


def snapshot_sources(tables: Sequence[tuple[TableSpec, DataFrame]]) -> DataFrame:
    """Row count and newest watermark of every source table, in one job."""

    def one(spec: TableSpec, df: DataFrame) -> DataFrame:
        token = F.max(spec.watermark).cast("string") if spec.watermark else F.lit(None).cast("string")
        return df.agg(F.count(F.lit(1)).alias("row_count"), token.alias("change_token")).select(F.lit(spec.name).alias("table_name"), "row_count", "change_token")

    return reduce(DataFrame.unionByName, (one(*t) for t in tables))


def poll_cycle(store: Store, tables: Sequence[tuple[TableSpec, DataFrame]]) -> dict[str, int]:
    """One cycle of polling: its number and its counts of inserts, updates and deletes.

    It is blocked if a table of the last snapshot has no replica any more. Snapshots are
    stored when all actions have succeeded, in one row, so a cycle that fails is repeated
    from the old ones by the next, also after a restart. In the first cycle tables without
    a replica are loaded, and others brought up to date.
    """
    number, before = last_snapshot(store)
    spark = store.spark
    replicas = [t for t in store.tables() if (row := store.watermark(t)) is not None and row["version"] is not None]
    visible = spark.createDataFrame([(t,) for t in replicas], "table_name string")
    if before is not None:
        guard_targets(before, visible)
    now = snapshot_sources(tables)
    now = spark.createDataFrame([tuple(r) for r in now.collect()], _SNAPSHOT)  # a row a table
    known = before
    if before is None:  # nothing is known of what the replicas hold: another token brings them up to date
        known = now.join(visible, "table_name", "left_semi").withColumn("change_token", F.concat(F.coalesce("change_token", F.lit("")), F.lit("?")))
    plan, results = poll_sync(store, tables, known, now)
    failed = {r["table_name"]: r["error"] for r in results.where("status <> 'success'").collect()}
    if failed:
        raise RuntimeError("; ".join(f"{name}: {error}" for name, error in sorted(failed.items())))
    sums = plan.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inserts", "updates", "deletes")]).first().asDict()
    rows = [[r["table_name"], r["row_count"], r["change_token"]] for r in now.collect()]
    store.add_state("snapshots", SNAPSHOTS, (number + 1, json.dumps(rows), datetime.now(timezone.utc)))
    return {"cycle": number + 1, **sums}


def logged_cycle(store: Store, tables: Sequence[tuple[TableSpec, DataFrame]]) -> str | None:
    """A cycle with its row in the log of cycles; the error if it failed, which is not raised."""
    try:
        done, error = poll_cycle(store, tables), None
    except Exception as e:  # noqa: BLE001
        done, error = {"cycle": last_snapshot(store)[0] + 1, "inserts": 0, "updates": 0, "deletes": 0}, f"{type(e).__name__}: {e}"
    counts = (done["inserts"], done["updates"], done["deletes"])
    store.add_state("cycles", CYCLES, (done["cycle"], "error" if error else "success", *counts, error, datetime.now(timezone.utc)))
    return error


def start_polling(store: Store, tables: Callable[[], Sequence[tuple[TableSpec, DataFrame]]], checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """Repeat cycles until the query is stopped; a failed one is logged and the next tries again.

    ``tables`` is asked anew in each cycle, so that it sees files that have come. ``stop``
    waits for the cycle under way; a query started again goes on from the last snapshot and
    loads what it has missed.
    """

    def cycle(_: DataFrame, __: int) -> None:
        logged_cycle(store, tables())

    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def dedup_versions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows that were read more than once, resolved when they are read."""
    return current_rows(df, keys, order)


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, within: str) -> DataFrame:
    """Identical re-reads dropped in flight; keeps the first row, so not for updates.

    ``ts`` may be a time without a zone too, which watermarks do not take as it is.
    """
    timed = stream.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", within)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("__at")
