"""What a mirrored table looks like: keys, watermark column, types, fingerprint."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Exact column names that are taken for a watermark, in order of preference.
WATERMARK_NAMES = ("updated_at", "updatedAt", "modified_at", "modifiedAt", "created_at", "createdAt", "timestamp")

_DECLARED = re.compile(r"^\s*([a-z]+)\s*(?:\(([^)]*)\))?(.*)$", re.S)
_INTEGERS = {
    "tinyint": (T.ByteType(), T.ShortType()),
    "smallint": (T.ShortType(), T.IntegerType()),
    "mediumint": (T.IntegerType(), T.LongType()),
    "int": (T.IntegerType(), T.LongType()),
    "integer": (T.IntegerType(), T.LongType()),
    "bigint": (T.LongType(), T.DecimalType(20, 0)),
}
_OTHERS = {
    "bool": T.ByteType(), "boolean": T.ByteType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "blob": T.BinaryType(), "tinyblob": T.BinaryType(),
    "mediumblob": T.BinaryType(), "longblob": T.BinaryType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(),
}


@dataclass(frozen=True)
class TableSpec:
    """A source table: its keys in index order, its watermark column and its declared types."""

    name: str
    keys: tuple[str, ...] = ()
    watermark: str | None = None
    declared: dict[str, str] = field(default_factory=dict)


def map_type(declared: str) -> T.DataType:
    """Spark type of a declared MySQL type; unsigned integers get the next wider type.

    ``tinyint(1)`` is a boolean kept as 0/1, a decimal keeps its declared precision, and
    what has no closer type (text, enum, set, json, time, year, bit) is a string.
    """
    match = _DECLARED.match(declared.lower())
    base, size, rest = match.groups() if match else ("", None, "")
    if base == "tinyint" and size == "1" and "unsigned" not in rest:
        return T.ByteType()
    if base in _INTEGERS:
        return _INTEGERS[base]["unsigned" in rest]
    if base in ("decimal", "numeric"):
        if not size:
            return T.DecimalType(38, 10)
        precision, _, scale = size.partition(",")
        return T.DecimalType(int(precision), int(scale or 0))
    return _OTHERS.get(base, T.StringType())


#: Declared types that are text here, without loss; all others that ``map_type`` has no closer type for are unsupported.
_TEXTS = (
    "char", "varchar", "text", "tinytext", "mediumtext", "longtext", "enum", "set", "json", "time", "year", "bit", "decimal", "numeric",
)


def is_supported(declared: str) -> bool:
    """Whether a declared type has a type of its own, or is text in the source too."""
    match = _DECLARED.match(declared.lower())
    base = match.group(1) if match else ""
    return base in _INTEGERS or base in _OTHERS or base in _TEXTS


def map_schema(declared: dict[str, str]) -> T.StructType:
    """Schema of declared columns; every column is nullable."""
    return T.StructType([T.StructField(name, map_type(kind), True) for name, kind in declared.items()])


def schema_fingerprint(schema: T.StructType, keys: tuple[str, ...] = ()) -> str:
    """SHA-256 over name, type, nullability and key place of every column."""
    facts = [[f.name, f.dataType.simpleString(), f.nullable, keys.index(f.name) if f.name in keys else None] for f in schema.fields]
    return hashlib.sha256(json.dumps(facts, separators=(",", ":")).encode()).hexdigest()


def schema_changed(schema: T.StructType, keys: tuple[str, ...], stored: str | None) -> bool:
    return stored is not None and schema_fingerprint(schema, keys) != stored


def _digits(kind: T.DataType) -> tuple[int, int] | None:
    """Digits before and behind the point that a number type holds exactly."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    whole = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}.get(type(kind))
    return None if whole is None else (whole, 0)


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The one of two types that holds the values of both, as files of the other can be read by it; None if neither does."""
    if a == b:
        return a
    for narrow, wide in ((a, b), (b, a)):
        small, large = _digits(narrow), _digits(wide)
        order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
        if type(narrow) in order and type(wide) in order:
            if order.index(type(narrow)) < order.index(type(wide)):
                return wide
        elif small and large and isinstance(wide, T.DecimalType) and large[0] >= small[0] and large[1] >= small[1]:
            return wide
        elif isinstance(narrow, T.FloatType) and isinstance(wide, T.DoubleType):
            return wide
        elif isinstance(narrow, T.DateType) and isinstance(wide, T.TimestampNTZType):
            return wide
    return None


def widened(a: T.StructType, b: T.StructType) -> T.StructType | None:
    """A schema with the columns of both, each of the wider type and nullable; None if a column's types do not go together."""
    new, fields = {f.name: f for f in b.fields}, []
    for f in a.fields:
        kind = wider_type(f.dataType, new[f.name].dataType) if f.name in new else f.dataType
        if kind is None:
            return None
        fields.append(T.StructField(f.name, kind, True))
    old = {f.name for f in a.fields}
    return T.StructType([*fields, *(T.StructField(f.name, f.dataType, True) for f in b.fields if f.name not in old)])


def detect_watermark(columns: list[str]) -> str | None:
    """The column whose name says when a row was last written; None if there is none."""
    return next((name for name in WATERMARK_NAMES if name in columns), None)


def watermark_quality(column: str | None) -> str:
    """``best`` for a column of update times, ``append-only`` for one of creation times, ``none`` without one."""
    if column is None:
        return "none"
    return "append-only" if column.lower().startswith("created") else "best"


def describe_table(df: DataFrame, keys: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """One row per column: ordinal, name, type, nullable, key, default."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable, "PRI" if f.name in keys else "", (defaults or {}).get(f.name))
        for i, f in enumerate(df.schema.fields, 1)
    ]
    schema = "ordinal int, column_name string, column_type string, nullable boolean, column_key string, column_default string"
    return df.sparkSession.createDataFrame(rows, schema)


def list_tables(spark: SparkSession, exclude: tuple[str, ...] = (), database: str | None = None) -> list[str]:
    """Names of the catalog's tables and views but the excluded ones, sorted."""
    return sorted(t.name for t in spark.catalog.listTables(database) if t.name not in exclude)


def visible_tables(names: list[str]) -> list[str]:
    """Without state tables (leading underscore) and raw version tables."""
    return [n for n in names if not n.startswith("_") and not n.endswith("__raw")]


def catalog_columns(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Column metadata of catalog tables as rows."""
    rows = [
        (t, i, c.name, c.dataType, "YES" if c.nullable else "NO", "")
        for t in tables
        for i, c in enumerate(spark.catalog.listColumns(t), 1)
    ]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string, is_nullable string, column_key string")


def catalog_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    rows = [(t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE", t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "table_name string, table_type string, is_temporary boolean")


def primary_key_columns(spark: SparkSession, url: str, table: str, **options: str) -> list[str]:
    """Key columns in index order, from the source's statistics view; empty when there is no key."""
    query = (
        "SELECT column_name AS c, seq_in_index AS n FROM information_schema.statistics "
        f"WHERE index_name = 'PRIMARY' AND table_schema = DATABASE() AND table_name = '{table.replace(chr(39), chr(39) * 2)}'"
    )
    rows = spark.read.format("jdbc").options(url=url, query=query, **options).load().collect()
    return [r["c"] for r in sorted(rows, key=lambda r: r["n"])]
