"""A current table that is kept up to date, so that readers need not rank all history.

Rows are dealt to a fixed number of buckets by a hash of their key. Changes are merged by
writing the touched buckets anew, one row a key in each, and making a version of the table
that names them and the old folders of all others. A key that was deleted stays as a mark
with the number of its last change, so that an older change that comes late does not bring
it back.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablemirror.operators.store import Store
from tablemirror.spec import TableSpec

#: Buckets of a new table; choose them so that one is some hundred megabytes, because a bucket is what one task writes.
BUCKETS = 64


def bucket_of(spec: TableSpec, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*spec.keys), F.lit(buckets)).cast("int")


def _newest(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """The newest change of each key; of equal numbers a delete counts last."""
    order = Window.partitionBy("_sync_bucket", *spec.keys).orderBy(F.desc("_sync_newest"), F.desc("_sync_gone"))
    return rows.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def merge_changes(store: Store, spec: TableSpec, changes: DataFrame, batch_id: int | None = None, seq: str = "_seq", op: str = "_op", buckets: int = BUCKETS) -> list[int]:
    """Merge inserts, updates and deletes (``op`` is ``d``) into a table's buckets; the buckets that were written.

    ``seq`` orders the changes of a key, across batches too. A ``batch_id`` that is not
    above the last one merged has been merged before, and nothing is done. ``buckets``
    counts for a new table. Columns that the table lacks are added, NULL in older rows.
    """
    state = store.watermark(spec.name)
    live = state["version"] if state else None
    facts: Mapping[str, Any] = (store.manifest(spec.name, live) or {}) if live else {}
    if facts and "buckets" not in facts:
        raise TypeError(f"{spec.name} is not a maintained table")
    applied, buckets = facts.get("applied"), facts.get("buckets", buckets)
    if batch_id is not None and applied is not None and batch_id <= applied:
        return []
    rows = changes.withColumnsRenamed({seq: "_sync_newest"}).withColumns({"_sync_gone": F.col(op) == "d", "_sync_bucket": bucket_of(spec, buckets)}).drop(op)
    touched = sorted(r[0] for r in rows.select("_sync_bucket").distinct().collect())
    old = facts.get("batches", [])
    read = [b for b in old if b["bucket"] in touched]
    # a batch is small beside the buckets: it is cut down to one change a key before it meets them
    merged = _newest(rows.repartition(max(len(touched), 1), "_sync_bucket"), spec)
    if read:
        merged = _newest(store.read_batches(spec.name, read).drop("_sync_batch_id").unionByName(merged, allowMissingColumns=True).repartition(len(touched), "_sync_bucket"), spec)
    version = store.next_version(spec.name)
    where = f"_sync_version={version}"
    merged.withColumn("__part", F.col("_sync_bucket")).write.partitionBy("__part").parquet(f"{store.root}/{spec.name}/{where}/merged-buckets")
    schema = merged.schema.jsonValue()
    known = {"schema": schema, "rows": None, "low": None, "high": None, "undated": True}
    written = store.children(f"{store.root}/{spec.name}/{where}/merged-buckets")
    new = [known | {"folder": f"{where}/merged-buckets/{name}", "bucket": int(name.split("=")[1])} for name in written]
    kept = [b for b in old if b["bucket"] not in touched]
    last = max((x for x in (applied, batch_id) if x is not None), default=None)
    store.commit(spec, version, [*kept, *new], None, None, None, facts={"buckets": buckets, "applied": last})
    return touched


def maintain(stream: DataFrame, store: Store, spec: TableSpec, checkpoint: str, once: bool = True, interval: str = "1 second", **options: Any) -> StreamingQuery:
    """Merge a change feed micro-batch by micro-batch; a batch that is replayed after a failure is merged once."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        with store.writing(spec.name):
            merge_changes(store, spec, batch, batch_id, **options)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def lookup(store: Store, spec: TableSpec, keys: DataFrame) -> DataFrame:
    """Current rows of some keys, of which only the buckets are read; the keys are few."""
    facts = store.manifest(spec.name, store.live(spec.name)) or {}
    wanted = {r[0] for r in keys.select(bucket_of(spec, facts["buckets"])).distinct().collect()}
    rows = store.read_batches(spec.name, [b for b in facts["batches"] if b["bucket"] in wanted]).where("NOT _sync_gone")
    return rows.join(keys.select(*spec.keys).distinct(), list(spec.keys), "left_semi").drop("_sync_newest", "_sync_gone", "_sync_bucket", "_sync_batch_id")
