"""Comparing a replica with its source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pending_tables(source: DataFrame, replica: DataFrame) -> DataFrame:
    """Source tables without a replica (``table_name``)."""
    return source.select("table_name").join(replica.select("table_name"), "table_name", "left_anti")


def table_presence(source: DataFrame, replica: DataFrame) -> DataFrame:
    """``missing`` (no replica), ``orphaned`` (no source) or ``both`` for each table name."""
    s, r = (df.select(F.col("table_name").alias(n)).distinct() for df, n in ((source, "s"), (replica, "r")))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("s").isNull(), "orphaned").otherwise("both")
    return s.join(r, F.col("s") == F.col("r"), "full_outer").select(F.coalesce("s", "r").alias("table_name"), status.alias("presence"))


def column_diff(source: DataFrame, replica: DataFrame) -> DataFrame:
    """Columns that one side lacks; both sides are (table_name, column_name) rows."""
    keys = ["table_name", "column_name"]
    missing = source.select(*keys).join(replica.select(*keys), keys, "left_anti").withColumn("diff", F.lit("missing"))
    extra = replica.select(*keys).join(source.select(*keys), keys, "left_anti").withColumn("diff", F.lit("extra"))
    return missing.union(extra)


def reconcile_counts(source: DataFrame, replica: DataFrame) -> DataFrame:
    """Counts of both sides by table, their difference and whether they agree."""
    s = source.select("table_name", F.col("row_count").alias("source_count"))
    r = replica.select("table_name", F.col("row_count").alias("replica_count"))
    both = s.join(r, "table_name", "full_outer")
    gap = F.coalesce("source_count", F.lit(0)) - F.coalesce("replica_count", F.lit(0))
    return both.select("table_name", "source_count", "replica_count", gap.alias("difference"), F.col("source_count").eqNullSafe(F.col("replica_count")).alias("matches"))


def missing_targets(tracked: DataFrame, visible: DataFrame) -> DataFrame:
    """Tracked tables that the target no longer shows."""
    return pending_tables(tracked, visible)


def row_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Hash of a row's other columns by name; NULL differs from every value."""
    others = [f"`{c}`" for c in sorted(df.columns) if c not in keys]
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in others]) if others else F.lit(0).cast("long")


def row_diff(source: DataFrame, replica: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows are ``missing``, ``extra`` or ``changed`` in the replica. Only hashes are shuffled."""
    s = source.select(*keys, row_hash(source, keys).alias("__s"))
    r = replica.select(*keys, row_hash(replica, keys).alias("__r"))
    diff = F.when(F.col("__r").isNull(), "missing").when(F.col("__s").isNull(), "extra").when(F.col("__s") != F.col("__r"), "changed")
    return s.join(r, list(keys), "full_outer").withColumn("diff", diff).where(F.col("diff").isNotNull()).select(*keys, "diff")


def key_checksum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count, largest first key and, for integer keys, their sum (exact, without overflow)."""
    first = df.schema[keys[0]].dataType
    parts = [F.count(F.lit(1)).alias("row_count"), F.max(keys[0]).cast("string").alias("max_key")]
    for key in keys:
        if isinstance(df.schema[key].dataType, T.IntegralType):
            parts.append(F.sum(F.col(key).cast("decimal(38,0)")).cast("string").alias(f"sum_{key}"))
    if not isinstance(first, T.IntegralType):
        parts.append(F.lit(None).cast("string").alias(f"sum_{keys[0]}"))
    return df.agg(*parts)


def table_snapshot(df: DataFrame, ts: str) -> DataFrame:
    """Row count and newest time: the token by which polling sees a change."""
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.max(ts).cast("string").alias("change_token"))


def key_sums(df: DataFrame, keys: Sequence[str]) -> Column:
    """A checksum of each key column, comma-separated: the exact sum of integers, else the sum of a hash of the value as text."""
    parts = []
    for key in keys:
        whole = F.col(key) if isinstance(df.schema[key].dataType, T.IntegralType) else F.xxhash64(F.col(key).cast("string"))
        parts.append(F.coalesce(F.sum(whole.cast("decimal(38,0)")).cast("string"), F.lit("")))
    found = F.concat_ws(",", *parts)
    return F.when(found.rlike("[0-9]"), found)  # as a sum, NULL without rows


def table_details(name: str, source: DataFrame | None, replica: DataFrame | None, keys: Sequence[str] = (), skip_count: bool = False) -> DataFrame:
    """One row: whether each side has the table, its columns, count, largest first key and a checksum of all key columns.

    A side that does not have the table is None; its numbers are NULL. ``skip_count`` leaves
    the source's count out.
    """

    def facts(df: DataFrame | None, side: str, counted: bool) -> DataFrame | None:
        if df is None:
            return None
        none = F.lit(None).cast("string")
        return df.agg(
            F.count(F.lit(1)).alias(f"{side}_count") if counted else F.lit(None).cast("long").alias(f"{side}_count"),
            (F.max(keys[0]).cast("string") if keys else none).alias(f"{side}_max_id"),
            (key_sums(df, keys) if keys else none).alias(f"{side}_checksum"),
        )

    if source is None and replica is None:
        raise LookupError(f"neither side has {name}")
    spark = (source if source is not None else replica).sparkSession
    absent = lambda side: spark.range(1).select(*[F.lit(None).cast(t).alias(f"{side}_{c}") for c, t in (("count", "long"), ("max_id", "string"), ("checksum", "string"))])
    sides = [facts(source, "source", not skip_count), facts(replica, "replica", True)]
    left, right = (df if df is not None else absent(side) for df, side in zip(sides, ("source", "replica"), strict=True))
    both = source is not None and replica is not None
    missing, extra = ((sorted(set(a.columns) - set(b.columns)) for a, b in ((source, replica), (replica, source))) if both else ([], []))
    listed = lambda names: F.lit(",".join(names))
    # both sides are one row
    return left.crossJoin(right).select(
        F.lit(name).alias("table_name"), "*", listed(missing).alias("missing_columns"), listed(extra).alias("extra_columns"),
        F.lit(source is not None).alias("in_source"), F.lit(replica is not None).alias("in_replica"),
    )


def classify_mismatch(details: DataFrame) -> DataFrame:
    """The first reason that holds, most telling first; ``ok`` if none does."""
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    reason = (
        F.when(~F.col("in_replica"), "missing_table")
        .when(~F.col("in_source"), "orphaned_table")
        .when(F.col("missing_columns") != "", "missing_columns")
        .when(F.col("extra_columns") != "", "extra_columns")
        .when(differs("source_max_id", "replica_max_id"), "max_id")
        .when(differs("source_checksum", "replica_checksum"), "checksum")
        .when(F.col("source_count").isNotNull() & differs("source_count", "replica_count"), "row_count")
        .otherwise("ok")
    )
    return details.withColumn("reason", reason)


def filter_validation(classified: DataFrame, text: str = "", reason: str | None = None, only_bad: bool = False) -> DataFrame:
    rows = classified.where(F.lower("table_name").contains(text.lower())) if text else classified
    rows = rows.where(F.col("reason") == reason) if reason else rows
    return rows.where("reason <> 'ok'") if only_bad else rows


def validation_summary(counts: DataFrame) -> DataFrame:
    """Tables in all, agreeing, disagreeing and without one side."""
    error = F.col("source_count").isNull() | F.col("replica_count").isNull()
    return counts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("matches").alias("matching"),
        F.count_if(~F.col("matches") & ~error).alias("mismatched"), F.count_if(error).alias("errors"),
    )


def sync_totals(results: DataFrame) -> DataFrame:
    """Totals over the result rows of table runs."""
    good = F.col("status") == "success"
    return results.agg(
        F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"),
        F.coalesce(F.sum(F.when(good, F.col("records"))), F.lit(0)).alias("records"),
        F.count_if(F.col("mode") == "incremental").alias("by_watermark"), F.count_if(F.col("mode") == "full").alias("sequential"),
    )


def profile_table(name: str, df: DataFrame, keys: Sequence[str], watermark: str | None, unsupported: Sequence[str] = ()) -> DataFrame:
    """Facts of one table in one pass: rows, whether the key is one, the watermark column's use.

    The watermark's quality is ``best`` for a column of update times, ``append-only`` for
    one of creation times, ``none`` without one or with NULLs in it.
    """
    parts = [F.count(F.lit(1)).alias("row_count")]
    parts.append(F.countDistinct(*keys).alias("distinct_keys") if keys else F.lit(None).cast("long").alias("distinct_keys"))
    stamp = F.col(watermark) if watermark else F.lit(None).cast("timestamp")
    parts += [F.count_if(stamp.isNull()).alias("null_marks"), F.min(stamp).cast("string").alias("first_mark"), F.max(stamp).cast("string").alias("last_mark")]
    updates = bool(watermark) and ("updat" in watermark.lower() or "modif" in watermark.lower())
    quality = F.when(F.lit(watermark is None) | (F.col("null_marks") > 0), "none").otherwise("best" if updates else "append-only")
    return df.agg(*parts).select(
        F.lit(name).alias("table_name"), "*", F.lit(",".join(keys)).alias("key_columns"), quality.alias("watermark_quality"),
        (F.lit(bool(keys)) & (F.col("distinct_keys") == F.col("row_count"))).alias("key_is_unique"), F.lit(len(unsupported)).alias("unsupported"),
    )


def profile_summary(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        F.count(F.lit(1)).alias("tables"), F.count_if(F.col("key_columns") != "").alias("with_key"),
        F.count_if(F.col("watermark_quality") != "none").alias("with_watermark"), F.sum("unsupported").alias("unsupported"), F.sum("row_count").alias("rows"),
    )


#: Tables of the mirror itself, and the words in the name of a table of facts.
METADATA_TABLES = ("sync_metadata", "sync_log")
FACT_WORDS = ("activity", "log", "event", "transaction", "audit", "history")


def classify_tables(counts: DataFrame, most_dimension_rows: int = 50_000, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """``metadata``, ``fact`` or ``dimension``: by ``overrides``, else by name and number of rows.

    A word of a fact's name stands alone between underscores, capitals or the name's ends,
    in the singular or the plural: ``catalog`` is no log.
    """
    spaced = F.lower(F.regexp_replace("table_name", "([a-z0-9])([A-Z])", "$1_$2"))
    words = "|".join([*FACT_WORDS, *(f"{w}s" for w in FACT_WORDS), "activities", "histories"])
    kind = (
        F.when(F.lower("table_name").isin(*METADATA_TABLES), "metadata")
        .when(spaced.rlike(f"(?:^|[^a-z])(?:{words})(?:$|[^a-z])") | (F.col("row_count") > most_dimension_rows), "fact")
        .otherwise("dimension")
    )
    for name, own in (overrides or {}).items():
        kind = F.when(F.col("table_name") == name, own).otherwise(kind)
    return counts.withColumn("kind", kind)
