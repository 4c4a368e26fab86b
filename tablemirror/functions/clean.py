"""Cleaning source values and adding lineage columns, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINEAGE = ("_sync_batch_id", "_sync_timestamp", "_sync_deleted", "_sync_schema_fingerprint", "_sync_seq")
#: How a change feed numbers its record types.
RECORD_TYPES = {"i": 0, "u": 1, "d": 2}


def clean_date(value: Column) -> Column:
    """Date from text; zero dates and impossible ones become NULL."""
    return F.try_to_date(F.substring(value.cast("string"), 1, 10), "yyyy-MM-dd")


def clean_timestamp(value: Column) -> Column:
    """Timestamp from text with all its fraction digits; zero dates become NULL."""
    return F.try_to_timestamp(F.regexp_replace(value.cast("string"), "T", " "))


def bit_text(value: Column) -> Column:
    """The unsigned integer of a bit string, as text; exact to 64 bits."""
    return F.conv(F.hex(value), 16, 10)


def normalize(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Columns in the form the mirror stores, by declared type: one projection.

    Dates and times that do not exist become NULL; bits become integer text, bytes
    base64, booleans 0/1, JSON text, 64-bit unsigned integers exact decimals.
    """
    return df.select(*[_normal(F.col(f"`{f.name}`"), f.dataType, declared.get(f.name, "")).alias(f.name) for f in df.schema.fields])


def _normal(c: Column, have: T.DataType, declared: str) -> Column:
    base = declared.lower().split("(")[0].split()[0] if declared.strip() else ""
    if base == "date":
        return clean_date(c) if isinstance(have, T.StringType) else c.cast("date")
    if base in ("datetime", "timestamp") and isinstance(have, T.StringType):
        cleaned = clean_timestamp(c)
        return cleaned.cast("timestamp_ntz") if base == "datetime" else cleaned
    if base == "bit":
        return bit_text(c)
    if isinstance(have, T.BinaryType):
        return F.base64(c)
    if base in ("bool", "boolean") or isinstance(have, T.BooleanType) or declared.lower().startswith("tinyint(1)"):
        return c.cast("int").cast("byte")
    if base == "bigint" and "unsigned" in declared.lower():
        return c.cast("decimal(20,0)")
    if isinstance(have, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c)
    return c


def sanitize(value: Column, declared: str) -> Column:
    """Stricter cleaning of text values: what stands for no value becomes NULL.

    Dates that are zero, blank, ``undefined`` or the epoch's first moment are NULL, and so
    is a time of 24 hours or more.
    """
    text = F.trim(value.cast("string"))
    base = declared.lower().split("(")[0].strip()
    if base in ("date", "datetime", "timestamp"):
        none = text.isin("", "undefined", "null", "Invalid Date") | text.startswith("0000-00-00") | text.startswith("1970-01-01T00:00:00")
        return F.when(none, F.lit(None)).otherwise(text)
    if base == "time":
        hour = F.try_to_number(F.regexp_extract(text, r"^(\d+):", 1), F.lit("999999"))
        return F.when((text == "") | (hour >= 24), F.lit(None)).otherwise(text)
    return value


def with_lineage(df: DataFrame, batch_id: str, fingerprint: str, at: Column, seq: Column | None = None) -> DataFrame:
    """Add the lineage columns; ``_sync_seq`` orders the rows of one batch."""
    return df.withColumns(
        {
            "_sync_batch_id": F.lit(batch_id),
            "_sync_timestamp": at,
            "_sync_deleted": F.lit(0).cast("byte"),
            "_sync_schema_fingerprint": F.lit(fingerprint),
            "_sync_seq": seq if seq is not None else F.monotonically_increasing_id(),
        }
    )


def with_change_metadata(df: DataFrame, uid: Column, source_ts: Column, record_type: Column | None = None, synced_at: Column | None = None) -> DataFrame:
    """Add a change feed's metadata; without a record type the rows are those of a snapshot."""
    kind = record_type if record_type is not None else F.lit(0)
    return df.withColumns(
        {
            "_change_uid": uid,
            "_change_source_ts": source_ts,
            "_change_type": kind.cast("int"),
            "_change_is_deleted": F.when(kind == RECORD_TYPES["d"], 1).otherwise(0).cast("int"),
            "_change_synced_at": synced_at if synced_at is not None else source_ts,
        }
    )


def live_rows(df: DataFrame) -> DataFrame:
    """View of a table without a key: the rows not marked as deleted, without the lineage columns."""
    return df.where("_sync_deleted = 0").drop(*LINEAGE)


def json_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """JSON columns as text: nested values are written out, text stays as it is."""
    nested = (T.StructType, T.MapType, T.ArrayType, T.VariantType)
    return df.withColumns({c: F.to_json(c) if isinstance(df.schema[c].dataType, nested) else F.col(c).cast("string") for c in columns})


def like_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Case-insensitive LIKE."""
    return df.where(F.col(column).ilike(pattern))


def last_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The largest key as text: the value of a single key, a JSON array of a composite one."""
    largest = F.max(F.struct(*keys)).alias("k")
    if len(keys) == 1:
        text = F.col(f"k.{keys[0]}").cast("string")
    else:
        # written by hand: an array has one element type, and keys may differ in theirs
        parts = [_json_value(F.col(f"k.{k}"), df.schema[k].dataType) for k in keys]
        text = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return df.agg(largest).select(text.alias("last_key"))


def _json_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.NumericType):
        return c.cast("string")
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"'))


def align_columns(df: DataFrame, target: T.StructType) -> DataFrame:
    """Columns by name in the target's order and types; missing ones are NULL, further ones are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields])
