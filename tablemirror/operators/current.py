"""Serving the newest version of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERSION_ORDER = ("_sync_timestamp", "_sync_batch_id", "_sync_seq")


def _descending(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).desc() if isinstance(c, str) else c for c in order]


def current_rows(raw: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = VERSION_ORDER, deleted: Column | None = None) -> DataFrame:
    """Newest version of each key; keys whose newest version is a delete are absent.

    All versions are ranked before deletes are dropped, else an old version would come
    back. The rank limit is applied in each task before the shuffle, so a key with very
    many versions sends few.
    """
    ranked = raw.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*_descending(order))))
    newest = ranked.where("__rank = 1").drop("__rank")
    return newest if deleted is None else newest.where(~deleted)


def latest_state(df: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key of a small state table, by a combined aggregate."""
    whole = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(whole, F.struct(version, F.xxhash64(whole))).alias("__row")).select("__row.*")


def current_from_changes(changes: DataFrame, keys: Sequence[str], seq: str = "_seq", op: str = "_op") -> DataFrame:
    """The table that a log of inserts, updates and deletes leaves."""
    return current_rows(changes, keys, [seq], F.col(op) == "d")


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "row_num") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("int"))


def vacuum_versions(raw: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = VERSION_ORDER) -> DataFrame:
    """Only the versions that readers can still see, deletes included until the next full load."""
    return current_rows(raw, keys, order)
