"""Result rows in the forms that clients read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; 64-bit integers and decimals as text, so that no client rounds them."""
    exact = (T.LongType, T.DecimalType)
    values = [(F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, exact) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("json"))


def text_value(c: Column, kind: T.DataType) -> Column:
    """One value as text: 1/0, hexadecimal bytes, milliseconds, JSON for nested values."""
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c)
    return c.cast("string")


def text_rows(df: DataFrame) -> DataFrame:
    return df.select(*[text_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
