"""Mirrored tables on disk: versions, batches, state, and their loads.

A table's rows lie in batch folders, ``root/<name>/_sync_version=<n>/_sync_batch_id=<id>/``, which are
written once. A version of the table is a manifest, a list of such folders with what is
known of them; the state names the live version. A load writes its batches under a number
of its own, then the manifest, which only one of several writers can create, then the state
row that lets readers see it. What a run left behind before that is never read, and the
next run takes a higher number.

A version that is no longer live is kept for a time (``Store.keep``), so that readers who
are under way finish and older versions can be read; then its manifest goes, and with it the
batches that no other version names. A table is written by one run of a driver at a time.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from tablemirror.functions.clean import LINEAGE, last_key, normalize, with_lineage
from tablemirror.operators.current import current_rows, latest_state
from tablemirror.operators.state import Files, StateTable
from tablemirror.sources.scans import after_key, incremental_scan, up_to_key
from tablemirror.spec import TableSpec, schema_fingerprint, widened

WATERMARKS = (
    "table_name string, version int, last_processed_id string, last_processed_timestamp timestamp, primary_key_column string, "
    "timestamp_column string, schema_fingerprint string, updated_at timestamp"
)
SYNC_LOG = (
    "id bigint, table_name string, sync_type string, records_processed bigint, duration_ms bigint, status string, "
    "error_message string, watermark_before timestamp, watermark_after timestamp, created_at timestamp"
)
PROGRESS = "table_name string, status string, records bigint, error_message string, updated_at timestamp"


#: How long versions that are not live any more can still be read.
KEEP = timedelta(hours=24)

#: Size of a file that compaction makes, and the beginning of the name of a folder that holds several batches.
TARGET_BYTES, MERGED = 128 << 20, "merged-"
#: Rows of such a file: one task sorts it, and rows that compress well would be many times its size.
FILE_ROWS = 3_000_000

_RUNNING: set[tuple[str, str]] = set()
_GUARD = threading.Lock()


def _now() -> datetime:
    return datetime.now(timezone.utc)


class TableBusy(RuntimeError):
    """Another run of this driver is writing the table."""


class VersionConflict(RuntimeError):
    """Another driver has published the version that this run was about to."""


class Store(Files):
    """A root folder of mirrored tables in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, keep: timedelta = KEEP):
        super().__init__(spark)
        self.root, self.keep = root.rstrip("/"), keep

    def tables(self) -> list[str]:
        return [t for t in self.children(self.root) if not t.startswith("_")]

    # state

    def state_table(self, name: str, schema: str) -> StateTable:
        return StateTable(self.spark, f"{self.root}/_state/{name}", schema)

    def state(self, name: str, schema: str) -> DataFrame:
        return self.state_table(name, schema).read()

    def add_state(self, name: str, schema: str, row: tuple) -> None:
        self.state_table(name, schema).add(row)

    @contextmanager
    def writing(self, table: str) -> Iterator[None]:
        """Hold a table for one run; a second one at the same time gets ``TableBusy``."""
        key = self.root, table
        with _GUARD:
            if key in _RUNNING:
                raise TableBusy(f"{table} is being written")
            _RUNNING.add(key)
        try:
            yield
        finally:
            with _GUARD:
                _RUNNING.discard(key)

    def next_version(self, table: str) -> int:
        """A version number above the live one and above all that a broken run has left."""
        state = self.watermark(table)
        left = [int(c[14:]) for c in self.children(f"{self.root}/{table}") if c.startswith("_sync_version=") and c[14:].isdigit()]
        return 1 + max([0, *left, *self.versions(table), (state and state["version"]) or 0])

    def watermark(self, table: str) -> Any:
        """Newest watermark row of a table, or None."""
        rows = self.state("watermarks", WATERMARKS).where(F.col("table_name") == table)
        return latest_state(rows, "table_name", "updated_at").first()

    def save_watermark(self, spec: TableSpec, version: int | None, last_id: str | None, last_ts: datetime | None, fingerprint: str | None) -> None:
        keys = ",".join(spec.keys) or None
        self.add_state("watermarks", WATERMARKS, (spec.name, version, last_id, last_ts, keys, spec.watermark, fingerprint, _now()))

    def log(self, table: str, kind: str, records: int, ms: int, error: str | None, before: datetime | None, after: datetime | None) -> None:
        """One log row a table run, failures and both watermarks included."""
        status = "error" if error else "success"
        self.add_state("sync_log", SYNC_LOG, (time.time_ns(), table, kind, records, ms, status, error, before, after, _now()))

    # versions

    def _manifest(self, table: str, version: int) -> str:
        return f"{self.root}/_manifests/{table}/{version:010d}.json"

    def versions(self, table: str) -> list[int]:
        """Numbers of the versions whose manifests are there, the live one and older ones; also what broken runs left."""
        return [int(n.removesuffix(".json")) for n in self.files(f"{self.root}/_manifests/{table}")]

    def manifest(self, table: str, version: int) -> dict[str, Any] | None:
        """``batches`` (folder, rows, schema, least and greatest watermark, whether it has rows without), ``cursor``, ``created``."""
        text = self.read(self._manifest(table, version))
        return json.loads(text) if text else None

    def live(self, table: str) -> int:
        row = self.watermark(table)
        if row is None or row["version"] is None:
            raise LookupError(f"{table} has no replica")
        return row["version"]

    def batches(self, table: str, version: int | None = None) -> list[dict[str, Any]]:
        """The batches of a version; those in its folder if they were appended without a manifest."""
        version = self.live(table) if version is None else version
        manifest = self.manifest(table, version)
        if manifest is not None:
            return manifest["batches"]
        return [self.batch(table, f"_sync_version={version}/{name}", None) for name in self.children(f"{self.root}/{table}/_sync_version={version}")]

    def batch(self, table: str, folder: str, watermark: str | None) -> dict[str, Any]:
        """What is known of a written batch, by one pass over its watermark column."""
        rows = self.spark.read.parquet(f"{self.root}/{table}/{folder}")
        facts: dict[str, Any] = {"folder": folder, "schema": rows.schema.jsonValue(), "low": None, "high": None, "undated": True}
        if watermark is None:
            return facts | {"rows": rows.count()}
        at = F.col(watermark).cast("timestamp")
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"), F.count_if(at.isNull()).alias("undated")).first()
        shown = {k: found[k] and found[k].astimezone(timezone.utc).isoformat() for k in ("low", "high")}
        return facts | shown | {"rows": found["n"], "undated": found["undated"] > 0}

    def read_batches(self, table: str, batches: Sequence[dict[str, Any]]) -> DataFrame:
        """Rows of batches under the schema that all of theirs widen to; what a batch lacks is NULL."""
        schema = T.StructType([])
        for entry in batches:
            wider = widened(schema, T.StructType.fromJson(entry["schema"]))
            if wider is None:
                raise TypeError(f"batches of {table} have types that do not go together")
            schema = wider
        schema = T.StructType([*(f for f in schema.fields if f.name != "_sync_batch_id"), T.StructField("_sync_batch_id", T.StringType())])
        if not batches:
            return self.spark.createDataFrame([], schema)
        where, parts = f"{self.root}/{table}", []
        for merged in (False, True):  # a merged folder has its batch ids as a column, others in their names
            paths = [f"{where}/{b['folder']}" for b in batches if (MERGED in b["folder"]) == merged]
            reader = self.spark.read.schema(schema)
            if paths:
                parts.append(reader.parquet(*paths) if merged else reader.option("basePath", where).parquet(*paths).drop("_sync_version"))
        return reduce(DataFrame.unionByName, parts)

    def raw(self, table: str, version: int | None = None) -> DataFrame:
        """All stored versions of a table's rows, as of the live version of the table or an older one."""
        version = self.live(table) if version is None else version
        if version not in self.versions(table) and not self.children(f"{self.root}/{table}/_sync_version={version}"):
            raise LookupError(f"{table} has no version {version}")
        return self.read_batches(table, self.batches(table, version))

    def append_versions(self, df: DataFrame, table: str, version: int, batch_id: str) -> None:
        """Write a batch; writing it again replaces it, so a repeated batch changes nothing."""
        path = f"{self.root}/{table}/_sync_version={version}/_sync_batch_id={batch_id}"
        df.drop("_sync_batch_id").write.mode("overwrite").parquet(path)

    def add_batch(self, df: DataFrame, spec: TableSpec, version: int, batch_id: str) -> dict[str, Any]:
        """Write a batch and say what is known of it."""
        self.append_versions(df, spec.name, version, batch_id)
        return self.batch(spec.name, f"_sync_version={version}/_sync_batch_id={batch_id}", spec.watermark)

    def commit(
        self, spec: TableSpec, version: int, batches: Sequence[dict[str, Any]], last_id: str | None, last_ts: datetime | None, fingerprint: str | None,
        cursor: list[str] | None = None, facts: Mapping[str, Any] | None = None,
    ) -> None:
        """Make a version of these batches, with further facts about it, let readers see it, and clean up."""
        text = json.dumps({**(facts or {}), "version": version, "created": _now().isoformat(), "cursor": cursor, "batches": list(batches)})
        if not self.create(self._manifest(spec.name, version), text):
            raise VersionConflict(f"{spec.name} has a version {version} already")
        self.save_watermark(spec, version, last_id, last_ts, fingerprint)
        self.publish(spec)
        self.clean_up(spec.name)

    def clean_up(self, table: str, keep: timedelta | None = None) -> list[str]:
        """Delete versions that have not been live for longer than ``keep``, and the batches that no version names; these.

        What lies above the live version belongs to a run that is under way.
        """
        keep, live, now = self.keep if keep is None else keep, self.live(table), _now()
        numbers = sorted(self.versions(table))
        made = {n: m for n in numbers if (m := self.manifest(table, n))}
        for n, after in zip(numbers, numbers[1:], strict=False):
            if n < live and (n not in made or after not in made or now - datetime.fromisoformat(made[after]["created"]) >= keep):
                self.remove(self._manifest(table, n))
                made.pop(n, None)
        if live not in made:
            return []
        named = {b["folder"] for m in made.values() for b in m["batches"]}
        gone: list[str] = []

        def tidy(folder: str) -> bool:
            """Delete what no version names below a folder, and the folder if nothing is left; whether it is."""
            if folder in named:
                return False
            inner = [f"{folder}/{name}" for name in self.children(f"{self.root}/{table}/{folder}")]
            if all([tidy(f) for f in inner]):
                self.remove(f"{self.root}/{table}/{folder}")
                gone.append(folder)
                return True
            return False

        for name in self.children(f"{self.root}/{table}"):
            if name.startswith("_sync_version=") and int(name[14:]) <= live:
                tidy(name)
        return [f for f in gone if "/" in f]

    def current(self, spec: TableSpec, version: int | None = None) -> DataFrame:
        """The table as readers see it, or saw it in an older version."""
        raw = self.raw(spec.name, version)
        if "_sync_newest" in raw.columns:  # a maintained table has one row a key
            return raw.where("NOT _sync_gone").drop("_sync_newest", "_sync_gone", "_sync_bucket", *LINEAGE)
        if not spec.keys:
            return raw.where("_sync_deleted = 0").drop(*LINEAGE)
        return current_rows(raw, spec.keys, deleted=F.col("_sync_deleted") == 1).drop(*LINEAGE)

    def publish(self, spec: TableSpec) -> None:
        """(Re)create the table's view over its live version."""
        self.current(spec).createOrReplaceTempView(spec.name)


def _cleaned(store: Store, spec: TableSpec, source: DataFrame, batch_id: str) -> tuple[DataFrame, str]:
    fingerprint = schema_fingerprint(source.schema, spec.keys)
    return with_lineage(normalize(source, spec.declared), batch_id, fingerprint, F.lit(_now())), fingerprint


def _moment(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def _newest(*times: datetime | None) -> datetime | None:
    aware = [t.astimezone(timezone.utc) for t in times if t is not None]
    return max(aware, default=None)


def _edge(rows: DataFrame, spec: TableSpec, newest: datetime | None) -> tuple[Any, Any]:
    """Conditions of the rows that an inclusive read finds again, and of all others."""
    at = F.col(spec.watermark).cast("timestamp")
    again = at.isNull() if newest is None else at.isNull() | (at >= F.lit(newest))
    return again, ~F.coalesce(again, F.lit(True))


def _add_parted(store: Store, spec: TableSpec, rows: DataFrame, version: int, batch_id: str) -> list[dict[str, Any]]:
    """Write rows of a table without a key: those at the newest time, and those without a time, in a batch of their own."""
    at = F.col(spec.watermark).cast("timestamp")
    edge, body = _edge(rows, spec, rows.agg(F.max(at)).first()[0])
    return [store.add_batch(rows.where(part), spec, version, f"{batch_id}-{name}") for name, part in (("body", body), ("edge", edge))]


def full_refresh(store: Store, spec: TableSpec, source: DataFrame) -> int:
    """Load the whole table into a new version and let readers see it; the row count.

    The old version can be read for a while (``Store.keep``).
    """
    version, batch_id = store.next_version(spec.name), f"full-{uuid.uuid4().hex}"
    rows, fingerprint = _cleaned(store, spec, source, batch_id)
    if spec.keys or not spec.watermark:
        batches = [store.add_batch(rows, spec, version, batch_id)]
    else:
        batches = _add_parted(store, spec, rows, version, batch_id)
    last = last_key(store.read_batches(spec.name, batches), spec.keys).first()["last_key"] if spec.keys else None
    newest = _newest(*(_moment(b["high"]) for b in batches))
    store.commit(spec, version, batches, last, newest, fingerprint)
    return sum(b["rows"] for b in batches)


def _compatible(store: Store, spec: TableSpec, source: DataFrame, fingerprint: str | None, evolve: bool) -> bool:
    """Whether rows of the source can be appended: the same schema, or with ``evolve`` one that the stored one can widen to."""
    if schema_fingerprint(source.schema, spec.keys) == fingerprint:
        return True
    if not evolve:
        return False
    stored = store.raw(spec.name).schema
    rows, _ = _cleaned(store, spec, source, "")
    return widened(stored, rows.schema) is not None


def incremental_refresh(
    store: Store, spec: TableSpec, source: DataFrame, lookback: timedelta | None = None, evolve: bool = False, chunk_rows: int | None = None,
    after_chunk: Callable[[int], None] | None = None,
) -> tuple[str, int]:
    """Append the rows at or after the watermark; ``(mode, rows)``.

    A full load instead if there is no watermark column, replica or watermark, or if the
    schema changed; with ``evolve`` only if it changed to one that does not go together with
    the stored one: new columns and wider types are appended as they are. Boundary rows come
    again; a table with a key sorts that out when it is read. One without has its boundary
    slice replaced, and with it the rows without a watermark, of which nothing tells what is
    new; other batches are not touched. The stored watermark never goes back.

    With ``chunk_rows`` a table with a key is loaded in chunks of about so many rows, in the
    order of (watermark, key). Each is a version of the table and stores how far it goes; a
    run after one that broke off begins there. ``after_chunk`` is called with the number of
    chunks that are done.
    """
    state = store.watermark(spec.name)
    known = state is not None and state["version"] is not None and state["last_processed_timestamp"] is not None
    if not spec.watermark or not known or not _compatible(store, spec, source, state["schema_fingerprint"], evolve):
        return "full", full_refresh(store, spec, source)
    if spec.keys and chunk_rows:
        return "incremental", _in_chunks(store, spec, source, state, lookback, chunk_rows, after_chunk)
    mark, version, batch_id = state["last_processed_timestamp"], store.next_version(spec.name), f"inc-{uuid.uuid4().hex}"
    old = store.batches(spec.name)
    if spec.keys:
        rows, fingerprint = _cleaned(store, spec, incremental_scan(source, spec.watermark, mark, lookback), batch_id)
        new = [store.add_batch(rows, spec, version, batch_id)]
        n, kept, carried = new[0]["rows"], old, []
        last = last_key(store.read_batches(spec.name, new), spec.keys).first()["last_key"] if n else state["last_processed_id"]
    else:
        since = (mark - lookback if lookback else mark).astimezone(timezone.utc)
        # cleaned first: times that do not exist become NULL, and kept and read rows have to complement each other
        rows, fingerprint = _cleaned(store, spec, source, batch_id)
        again, before = _edge(rows, spec, since)
        new = _add_parted(store, spec, rows.where(again), version, batch_id)
        n, last = sum(b["rows"] for b in new), state["last_processed_id"]
        touched = [b for b in old if b["undated"] or (b["high"] is not None and _moment(b["high"]) >= since)]
        kept = [b for b in old if b not in touched]
        rest = [b for b in touched if b["low"] is not None and _moment(b["low"]) < since]
        carried = [store.add_batch(store.read_batches(spec.name, rest).where(before), spec, version, f"{batch_id}-kept")] if rest else []
    newest = _newest(mark, *(_moment(b["high"]) for b in new))
    store.commit(spec, version, [*kept, *carried, *new], last, newest, fingerprint)
    return "incremental", n


def _in_chunks(
    store: Store, spec: TableSpec, source: DataFrame, state: Any, lookback: timedelta | None, chunk_rows: int, after_chunk: Callable[[int], None] | None
) -> int:
    order = [spec.watermark, *spec.keys]
    manifest = store.manifest(spec.name, state["version"]) or {}
    if manifest.get("cursor"):  # a run broke off behind this row
        rest = source.where(after_key(source, order, manifest["cursor"]))
    else:
        rest = incremental_scan(source, spec.watermark, state["last_processed_timestamp"], lookback)
    bounds = chunk_bounds(rest, order, chunk_rows)
    done, mark, last = 0, state["last_processed_timestamp"], state["last_processed_id"]
    for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None], strict=True), 1):
        part = rest if low is None else rest.where(after_key(rest, order, low))
        part = part if high is None else part.where(up_to_key(part, order, high))
        version, batch_id = store.next_version(spec.name), f"inc-{uuid.uuid4().hex}"
        rows, fingerprint = _cleaned(store, spec, part, batch_id)
        new = store.add_batch(rows, spec, version, batch_id)
        if new["rows"]:
            last = last_key(store.read_batches(spec.name, [new]), spec.keys).first()["last_key"]
        mark = _newest(mark, _moment(new["high"]))
        store.commit(spec, version, [*store.batches(spec.name), new], last, mark, fingerprint, cursor=high)
        done += new["rows"]
        if after_chunk:
            after_chunk(i)
    return done


def chunk_bounds(rows: DataFrame, order: Sequence[str], chunk_rows: int) -> list[list[str]]:
    """Greatest keys of all chunks but the last, as text: quantiles of the order, found by Spark's range sampling.

    Only the columns of the order are shuffled, and one row a chunk reaches the driver.
    """
    keys = rows.select(*order)
    chunks = -(-keys.count() // chunk_rows)
    if chunks < 2:
        return []
    dealt = keys.repartitionByRange(chunks, *order).select(F.spark_partition_id().alias("__chunk"), F.struct(*order).alias("__key"))
    ends = dealt.groupBy("__chunk").agg(F.max("__key").alias("end")).orderBy("end")
    found = ends.select(*[F.col(f"end.{c}").cast("string").alias(f"c{i}") for i, c in enumerate(order)]).collect()
    return [list(r) for r in found[:-1]]


def sync_table(store: Store, spec: TableSpec, source: DataFrame, force_full: bool = False, **options: Any) -> tuple[str, str, int, int, str | None]:
    """``(mode, status, records, ms, error)`` of one table's run; a failure is logged, not raised.

    A table that another run is writing is left alone, which is a failure too. ``options``
    are those of ``incremental_refresh``.
    """
    start, mode, error, n, mark, after = time.monotonic(), "full", None, 0, None, None
    try:
        with store.writing(spec.name):
            before = store.watermark(spec.name)
            mark = before["last_processed_timestamp"] if before else None
            if force_full or not spec.watermark:
                n = full_refresh(store, spec, source)
            else:
                mode, n = incremental_refresh(store, spec, source, **options)
        after = store.watermark(spec.name)
    except Exception as e:  # noqa: BLE001
        error = f"{type(e).__name__}: {e}"
    ms = int(1000 * (time.monotonic() - start))
    try:
        store.log(spec.name, mode, n, ms, error, mark, after["last_processed_timestamp"] if after else mark)
    except Exception as e:  # noqa: BLE001  the run's own failure, if there was one, says more
        error = error or f"not logged: {type(e).__name__}: {e}"
    return mode, "error" if error else "success", n, ms, error


def sync_all(store: Store, tables: Mapping[TableSpec, DataFrame] | Sequence[tuple[TableSpec, DataFrame]], force_full: bool = False, at_once: int = 4) -> DataFrame:
    """All tables, several at once; one that fails does not stop the rest. One result row a table."""
    pairs = list(tables.items()) if isinstance(tables, Mapping) else list(tables)
    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(lambda p: (p[0].name, *sync_table(store, p[0], p[1], force_full)), pairs))
    return store.spark.createDataFrame(done, "table_name string, mode string, status string, records bigint, duration_ms bigint, error string")


def sync_status(store: Store, sources: Sequence[str], log_rows: int = 20) -> dict[str, DataFrame]:
    """Newest watermarks, newest log rows, and the tables without a replica."""
    marks = latest_state(store.state("watermarks", WATERMARKS), "table_name", "updated_at")
    log = store.state("sync_log", SYNC_LOG).orderBy(F.col("id").desc()).limit(log_rows)
    names = store.spark.createDataFrame([(s,) for s in sources], "table_name string")
    return {"watermarks": marks, "log": log, "pending": names.join(marks.where("version IS NOT NULL"), "table_name", "left_anti")}


def drop_replica(store: Store, spec: TableSpec) -> None:
    """Drop a table's view and files and empty its watermark, so that the next run loads it anew."""
    store.spark.catalog.dropTempView(spec.name)
    store.remove(f"{store.root}/{spec.name}")
    store.remove(f"{store.root}/_manifests/{spec.name}")
    store.save_watermark(spec, None, None, None, None)


def clear_all(store: Store, specs: Sequence[TableSpec]) -> None:
    """Drop all replicas and the state; stream positions (checkpoints) are kept."""
    for spec in specs:
        store.spark.catalog.dropTempView(spec.name)
    for name in store.tables():
        store.remove(f"{store.root}/{name}")
    store.remove(f"{store.root}/_manifests")
    store.remove(f"{store.root}/_state")


def bootstrap(store: Store, tables: Sequence[tuple[TableSpec, DataFrame]], resume: bool = False, force: bool = False) -> DataFrame:
    """First load of all tables with progress rows.

    A run that finished is not repeated unless ``force``; ``resume`` goes on after the
    tables that are done. Returns the newest progress of each table.
    """
    progress = latest_state(store.state("progress", PROGRESS), "table_name", "updated_at")
    done = {r["table_name"] for r in progress.where("status = 'done'").collect()}
    todo = list(tables)
    if not force:
        finished = all(spec.name in done for spec, _ in todo)
        todo = [(s, d) for s, d in todo if s.name not in done] if resume or finished else todo
    for spec, source in todo:
        try:
            with store.writing(spec.name):
                n, status, error = full_refresh(store, spec, source), "done", None
        except Exception as e:  # noqa: BLE001
            n, status, error = 0, "failed", f"{type(e).__name__}: {e}"
        store.add_state("progress", PROGRESS, (spec.name, status, n, error, _now()))
    return latest_state(store.state("progress", PROGRESS), "table_name", "updated_at")


def bootstrap_then(store: Store, tables: Sequence[tuple[TableSpec, DataFrame]], start: Callable[[], Any], **options: bool) -> Any:
    """Load, then ``start`` polling or a stream; nothing is started if a table failed."""
    failed = [r["table_name"] for r in bootstrap(store, tables, **options).where("status <> 'done'").collect()]
    if failed:
        raise RuntimeError(f"not started; not loaded: {', '.join(sorted(failed))}")
    return start()


# upkeep


def compact(store: Store, spec: TableSpec, files: int | None = None, target_bytes: int = TARGET_BYTES) -> list[str]:
    """Rewrite batches of small files into few files of about ``target_bytes``, the same versions in them; their folders.

    The file listing tells which batches have files under half that size; they are packed
    together, dealt by ranges of the key (without one, of the watermark) and sorted by it,
    so that a read by key skips files and row groups. Batches of large files are left
    alone. With ``files`` all batches are rewritten, into so many files, or more where
    these would be too large. No file is meant to have more than ``FILE_ROWS`` rows, since
    one task sorts it; batches whose files have half of that count as large.
    """
    with store.writing(spec.name):
        batches = store.batches(spec.name)
        sizes = {b["folder"]: store.files(f"{store.root}/{spec.name}/{b['folder']}") for b in batches}
        full = lambda b: 2 * b["rows"] >= FILE_ROWS * len(sizes[b["folder"]])
        small = [b for b in batches if files or not full(b) and any(size < target_bytes // 2 for size in sizes[b["folder"]].values())]
        total, count = sum(sum(sizes[b["folder"]].values()) for b in small), sum(b["rows"] for b in small)
        n = max(files or 1, -(-total // target_bytes), -(-count // FILE_ROWS))
        if not files and sum(len(sizes[b["folder"]]) for b in small) <= n:
            return []
        rows, order = store.read_batches(spec.name, small), list(spec.keys) or [c for c in [spec.watermark] if c]
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "_sync_batch_id") if order else rows.repartition(n)
        _swap(store, spec, dealt, [b for b in batches if b not in small])
        return [b["folder"] for b in small]


def vacuum(store: Store, spec: TableSpec) -> None:
    """Keep only the newest version of each key; without a key, every row that is not deleted."""
    with store.writing(spec.name):
        raw = store.raw(spec.name)
        _swap(store, spec, current_rows(raw, spec.keys) if spec.keys else raw.where("_sync_deleted = 0"), [])


def _swap(store: Store, spec: TableSpec, rows: DataFrame, kept: Sequence[dict[str, Any]]) -> None:
    """Make a version of the kept batches and of rows of several batches, which go to one folder with their batch ids."""
    state, version = store.watermark(spec.name), store.next_version(spec.name)
    folder = f"_sync_version={version}/{MERGED}{uuid.uuid4().hex}"
    rows.write.parquet(f"{store.root}/{spec.name}/{folder}")
    new = store.batch(spec.name, folder, spec.watermark)
    store.commit(spec, version, [*kept, new], state["last_processed_id"], state["last_processed_timestamp"], state["schema_fingerprint"])


def prune_log(log: DataFrame, at: str, days: int, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The rows that stay and the count of those that go; at least one day is kept."""
    edge = F.lit(now - timedelta(days=max(days, 1))).cast(log.schema[at].dataType)
    return log.where(F.col(at) >= edge), log.where(F.col(at) < edge).agg(F.count(F.lit(1)).alias("deleted"))


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and the sum and the exclusive or of a 64-bit hash of each; their order does not count, repeated rows do."""
    whole = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).alias("h"))
    total = F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string")
    return whole.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"), total.alias("total"))


def backup_database(store: Store, target: str, name: str | None = None) -> str:
    """Back up the live version of all tables, their watermarks, log and progress as ``target/<name>``; the name.

    Positions of streams and what polling saw last are not part of it: polling a restored
    store begins by bringing its tables up to date.

    Batches are written once, so a backup copies only those that no earlier one has, to
    ``target/_batches``. The manifest has a digest of the content of each, taken from the
    store; a copy that does not have it is an error.
    """
    name = name or f"backup-{_now().strftime('%Y-%m-%dT%H-%M-%SZ')}"
    target = target.rstrip("/")
    tables = {}
    for table in store.tables():
        state = store.watermark(table)
        if state is None or state["version"] is None:
            continue
        manifest = store.manifest(table, state["version"]) or {"cursor": None, "batches": store.batches(table)}
        with ThreadPoolExecutor(4) as pool:
            digests = list(pool.map(lambda b, table=table: _back_up(store, target, table, b), manifest["batches"]))
        tables[table] = {"version": state["version"], "cursor": manifest["cursor"], "batches": digests}
    _copy_state(store, f"{store.root}/_state", f"{target}/{name}/state")
    store.create(f"{target}/{name}/manifest.json", json.dumps({"created": _now().isoformat(), "tables": tables}))
    return name


def _digest(rows: DataFrame) -> list:
    return list(content_digest(rows).first())


def _back_up(store: Store, target: str, table: str, batch: dict[str, Any]) -> dict[str, Any]:
    """Copy a batch unless it is there; the batch with its digest."""
    pool = f"{target}/_batches/{table}/{batch['folder']}"
    noted = store.read(f"{pool}.json")
    if noted:
        return batch | {"digest": json.loads(noted)}
    rows = store.spark.read.parquet(f"{store.root}/{table}/{batch['folder']}")
    rows.write.mode("overwrite").parquet(pool)
    digest = _digest(rows)
    if _digest(store.spark.read.parquet(pool)) != digest:
        raise RuntimeError(f"{pool} was not copied whole")
    store.create(f"{pool}.json", json.dumps(digest))
    return batch | {"digest": digest}


def restore_database(spark: SparkSession, source: str, name: str, root: str) -> Store:
    """Copy a backup to an empty root; an existing root is an error, and so is content that has not the digest of the manifest."""
    store = Store(spark, root)
    if store.exists(store.root):
        raise FileExistsError(f"{root} exists")
    source = source.rstrip("/")
    text = store.read(f"{source}/{name}/manifest.json")
    if text is None:
        raise FileNotFoundError(f"there is no backup {name}")
    for table, facts in json.loads(text)["tables"].items():
        for batch in facts["batches"]:
            rows = spark.read.parquet(f"{source}/_batches/{table}/{batch['folder']}")
            rows.write.parquet(f"{root}/{table}/{batch['folder']}")
            if _digest(spark.read.parquet(f"{root}/{table}/{batch['folder']}")) != batch["digest"]:
                raise RuntimeError(f"{table}/{batch['folder']} is not what was backed up")
        batches = [{k: v for k, v in b.items() if k != "digest"} for b in facts["batches"]]
        manifest = {"version": facts["version"], "created": _now().isoformat(), "cursor": facts["cursor"], "batches": batches}
        store.create(store._manifest(table, facts["version"]), json.dumps(manifest))
    _copy_state(store, f"{source}/{name}/state", f"{root}/_state")
    return store


def _copy_state(store: Store, source: str, target: str) -> None:
    """State rows of every kind, folded into one segment at the target."""
    kinds = {"watermarks": WATERMARKS, "sync_log": SYNC_LOG, "progress": PROGRESS}
    for kind in store.children(source):
        if kind in kinds:
            rows = StateTable(store.spark, f"{source}/{kind}", kinds[kind]).read()
            StateTable(store.spark, f"{target}/{kind}", kinds[kind]).start_from(rows)


def list_backups(spark: SparkSession, target: str) -> DataFrame:
    """``(backup, bytes, modified)``, newest first, from file listings; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", rf"/{_escape(target.rstrip('/').rsplit('/', 1)[-1])}/([^/]+)/", 1)
    return files.groupBy(name.alias("backup")).agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified")).orderBy(F.col("modified").desc())


def _escape(text: str) -> str:
    import re

    return re.escape(text)


def delete_backup(store: Store, target: str, name: str) -> None:
    """Delete one backup and the batches that no other backup has; names that lead out of the target are refused."""
    if not name or name.startswith("/") or ".." in name.split("/") or "/" in name.strip("/"):
        raise ValueError(f"{name!r} names no backup")
    target = target.rstrip("/")
    store.remove(f"{target}/{name}")
    texts = (store.read(f"{target}/{other}/manifest.json") for other in store.children(target) if not other.startswith("_"))
    named = {f"{table}/{b['folder']}" for text in texts if text for table, facts in json.loads(text)["tables"].items() for b in facts["batches"]}
    for table in store.children(f"{target}/_batches"):
        for version in store.children(f"{target}/_batches/{table}"):
            for batch in store.children(f"{target}/_batches/{table}/{version}"):
                if f"{table}/{version}/{batch}" not in named:
                    store.remove(f"{target}/_batches/{table}/{version}/{batch}")
                    store.remove(f"{target}/_batches/{table}/{version}/{batch}.json")
            if not store.children(f"{target}/_batches/{table}/{version}"):
                store.remove(f"{target}/_batches/{table}/{version}")


def prune_backups(store: Store, target: str, days: int, now: datetime | None = None) -> list[str]:
    """Delete backups older than so many days; 0 keeps all."""
    if days <= 0:
        return []
    edge = (now or _now()) - timedelta(days=days)
    old = [r["backup"] for r in list_backups(store.spark, target).where(F.col("modified") < F.lit(edge)).collect()]
    for name in old:
        delete_backup(store, target, name)
    return sorted(old)


def write_partitioned(df: DataFrame, path: str, kind: str, date: str) -> None:
    """Facts append to their ingest date, dimensions replace their snapshot date, metadata replaces all."""
    if kind == "fact":
        df.withColumn("ingest_date", F.lit(date).cast("date")).write.mode("append").partitionBy("ingest_date").parquet(path)
    elif kind == "dimension":
        rows = df.withColumn("snapshot_date", F.lit(date).cast("date"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def dedup_by_partition(df: DataFrame, keys: Sequence[str], partition: str, ties: Sequence[str] = ()) -> DataFrame:
    """Newest partition's row of each key."""
    return current_rows(df, keys, [partition, *ties])


def drop_old_partitions(store: Store, path: str, column: str, days: int, today: str) -> list[str]:
    """Delete date partitions older than so many days; whole folders, nothing is rewritten."""
    edge = (datetime.fromisoformat(today) - timedelta(days=days)).date().isoformat()
    old = [c for c in store.children(path) if c.startswith(f"{column}=") and c.split("=", 1)[1] < edge]
    for name in old:
        store.remove(f"{path}/{name}")
    return old


def add_new_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both row sets with the columns of both; what a side lacks is NULL."""
    return old.unionByName(new, allowMissingColumns=True)
