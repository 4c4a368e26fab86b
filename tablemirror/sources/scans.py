"""Reading source tables: snapshots, pages, increments, counts, change feeds, SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.spec import detect_watermark

#: A page's default and largest number of rows.
PAGE_ROWS, MOST_PAGE_ROWS = 100, 10_000


def snapshot_scan(
    spark: SparkSession,
    path: str | None = None,
    *,
    url: str | None = None,
    table: str | None = None,
    split: tuple[str, Any, Any] | None = None,
    predicates: Sequence[str] | None = None,
    partitions: int = 8,
    options: Mapping[str, str] | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A whole table: Parquet files, or a JDBC table read in parallel.

    With a known ``schema`` no job has to open files to find it out.

    ``split`` (column, lowest, highest) cuts one numeric or date key into ranges of equal
    width (``balanced_jdbc_scan`` into ranges of equal row counts);
    ``predicates`` names the parts of any other table. Filters and columns that a plan
    asks for later reach the source in both cases.
    """
    if path is not None:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {}))
    if split is not None:
        column, low, high = split
        return reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)).load()
    if predicates:
        return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(options or {}))
    return reader.load()


def keyset_bounds(first_after: Callable[[Sequence[Any] | None, int], Sequence[Any] | None], step: int, most: int = 10_000) -> list[tuple[Any, ...]]:
    """Every ``step``-th key of a table, by skips over its key index: no row is read but one a bound.

    ``first_after(key, n)`` gives the ``n``-th key after a key (None: from the start), or
    None if there are fewer. More than ``most`` bounds are an error.
    """
    bounds: list[tuple[Any, ...]] = []
    while (key := first_after(bounds[-1] if bounds else None, step)) is not None:
        bounds.append(tuple(key))
        if len(bounds) > most:
            raise ValueError(f"steps of {step} rows cut the table into more than {most} parts")
    return bounds


def sql_literal(value: Any) -> str:
    """A value as SQL text that every JDBC source reads."""
    if value is None:
        return "NULL"
    if isinstance(value, bool) or isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise TypeError(f"{type(value).__name__} cannot be a bound of a split")


def key_predicates(keys: Sequence[str], bounds: Sequence[Sequence[Any]]) -> list[str]:
    """SQL conditions of the parts that key bounds cut a table into, in key order: each bound ends its part.

    They are in lexicographic order of all key columns, which are not NULL.
    """

    def after(bound: Sequence[Any]) -> str:
        steps = []
        for i in range(len(keys)):
            equal = [f"{k} = {sql_literal(v)}" for k, v in zip(keys[:i], bound[:i], strict=True)]
            steps.append("(" + " AND ".join([*equal, f"{keys[i]} > {sql_literal(bound[i])}"]) + ")")
        return f"({keys[0]} >= {sql_literal(bound[0])} AND ({' OR '.join(steps)}))"

    if not bounds:
        return ["1 = 1"]
    parts = [f"NOT {after(bounds[0])}"]
    parts += [f"{after(low)} AND NOT {after(high)}" for low, high in zip(bounds, bounds[1:], strict=False)]
    return [*parts, after(bounds[-1])]


#: The ``n``-th row of an ordered query, as sources write it.
NTH_ROW = {"mysql": "LIMIT 1 OFFSET {n}", "derby": "OFFSET {n} ROWS FETCH FIRST 1 ROWS ONLY"}


def balanced_jdbc_scan(
    spark: SparkSession, url: str, table: str, keys: Sequence[str], partition_rows: int, options: Mapping[str, str] | None = None, dialect: str = "mysql"
) -> DataFrame:
    """A JDBC table in partitions of equal row counts, whatever the distribution of its key, which may be composite.

    Bounds are found by skips over the key index, one small query each; every partition is
    then one range of the key.
    """
    names = ", ".join(keys)

    def first_after(key: Sequence[Any] | None, n: int) -> Sequence[Any] | None:
        where = f"WHERE {key_predicates(keys, [key])[1]} " if key is not None else ""
        query = f"SELECT {names} FROM {table} {where}ORDER BY {names} {NTH_ROW[dialect].format(n=n - 1)}"
        return spark.read.format("jdbc").options(url=url, query=query, **(options or {})).load().first()

    bounds = keyset_bounds(first_after, partition_rows)
    return spark.read.jdbc(url, table, predicates=key_predicates(keys, bounds), properties=dict(options or {}))


def _literal(df: DataFrame, column: str, value: Any) -> Column:
    return F.lit(value).cast(df.schema[column].dataType)


def after_key(df: DataFrame, keys: Sequence[str], after: Sequence[Any]) -> Column:
    """``(a, b, ...) > (x, y, ...)`` in lexicographic order, written out so that the source can use it."""
    steps = []
    for i, (key, value) in enumerate(zip(keys, after, strict=True)):
        equal = [F.col(k) == _literal(df, k, v) for k, v in zip(keys[:i], after[:i], strict=True)]
        steps.append(reduce(Column.__and__, [*equal, F.col(key) > _literal(df, key, value)]))
    # the first key alone bounds the scan, which row-group statistics can use
    return (F.col(keys[0]) >= _literal(df, keys[0], after[0])) & reduce(Column.__or__, steps)


def up_to_key(df: DataFrame, keys: Sequence[str], last: Sequence[Any]) -> Column:
    """``(a, b, ...) <= (x, y, ...)`` in lexicographic order; with ``after_key`` it cuts a table into pieces."""
    steps = []
    for i, (key, value) in enumerate(zip(keys, last, strict=True)):
        equal = [F.col(k) == _literal(df, k, v) for k, v in zip(keys[:i], last[:i], strict=True)]
        below = F.col(key) < _literal(df, key, value) if i + 1 < len(keys) else F.col(key) <= _literal(df, key, value)
        steps.append(reduce(Column.__and__, [*equal, below]))
    return (F.col(keys[0]) <= _literal(df, keys[0], last[0])) & reduce(Column.__or__, steps)


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence[Any] | None, n: int) -> DataFrame:
    """The next ``n`` rows after a key, in key order: a top-n, not a sort of the table."""
    rest = df if after is None else df.where(after_key(df, keys, after))
    return rest.orderBy(*keys).limit(n)


def resume_scan(df: DataFrame, keys: Sequence[str], cursor: Sequence[Any] | None) -> DataFrame:
    """All rows after a stored cursor."""
    return df if cursor is None else df.where(after_key(df, keys, cursor))


def offset_page(df: DataFrame, order_by: Sequence[str], limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """One page in a set order and ``has_more``: whether a further row follows."""
    if not 1 <= limit <= MOST_PAGE_ROWS:
        raise ValueError(f"a page has 1 to {MOST_PAGE_ROWS} rows, not {limit}")
    rows = df.orderBy(*order_by).offset(max(offset, 0)).limit(limit + 1)
    # the page has at most limit + 1 rows, so counting it in one task is bounded
    counted = rows.select("*", F.count(F.lit(1)).over(_whole()).alias("__n"), F.row_number().over(_whole(order_by)).alias("__r"))
    return counted.where(F.col("__r") <= limit).select(*df.columns, (F.col("__n") > limit).alias("has_more"))


def _whole(order_by: Sequence[str] = ()):
    from pyspark.sql import Window

    spec = Window.partitionBy(F.lit(0))
    return spec.orderBy(*order_by) if order_by else spec


def incremental_scan(df: DataFrame, ts_col: str, watermark: Any, lookback: timedelta | None = None) -> DataFrame:
    """Rows at or after a watermark: boundary rows come again, so none with an equal time is lost.

    ``lookback`` reads that much more, for rows that were committed late.
    """
    if watermark is None:
        return df
    if isinstance(watermark, str):
        watermark = datetime.fromisoformat(watermark)
    if lookback is not None:
        watermark = watermark - lookback
    return df.where(F.col(ts_col) >= _literal(df, ts_col, watermark))


def detected_incremental(df: DataFrame, since: Any, limit: int | None = None) -> DataFrame:
    """Rows written at or after a time, by the column whose name tells when a row was last written.

    With a ``limit`` the oldest of them, in order of that column. A table without such a
    column has no incremental read, which is an error.
    """
    column = detect_watermark(df.columns)
    if column is None:
        raise LookupError(f"none of the columns tells when a row was written: {', '.join(df.columns)}")
    rows = incremental_scan(df, column, since)
    return rows if limit is None else rows.orderBy(column).limit(limit)


def exact_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` of all tables in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def fast_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """The same from Parquet footers: the count is pushed into the scan, no column is read.

    Only Spark's V2 reader does that. Its settings hold in a session of their own, to which
    the result belongs.
    """
    read = footer_reader(spark)
    return exact_counts({name: read.parquet(path) for name, path in paths.items()})


def footer_reader(spark: SparkSession) -> DataFrameReader:
    """A reader, in a session of its own, that answers counts, minima and maxima from Parquet footers where they have them."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read


def change_feed(spark: SparkSession, path: str, schema: T.StructType | str, files_a_trigger: int | None = None) -> DataFrame:
    """A stream of row changes from files: ``_op`` (i, u, d), ``_seq``, ``_source_ts`` and the row."""
    reader = spark.readStream.schema(schema)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    return reader.parquet(path)


def run_query(spark: SparkSession, sql: str, params: Sequence[Any] = ()) -> DataFrame:
    """SQL with positional ``?``; the count of values has to match, which Spark alone does not ask for."""
    wanted = count_markers(sql)
    if wanted != len(params):
        raise ValueError(f"the statement has {wanted} parameters, {len(params)} values were given")
    return spark.sql(sql, args=list(params)) if params else spark.sql(sql)


def count_markers(sql: str) -> int:
    """Question marks outside of strings, quoted names and comments."""
    found, i, n = 0, 0, len(sql)
    while i < n:
        c = sql[i]
        if c in "'\"`":
            i += 1
            while i < n and sql[i] != c:
                i += 2 if sql[i] == "\\" and c != "`" else 1
        elif sql.startswith("--", i):
            i = sql.find("\n", i)
            if i < 0:
                break
        elif sql.startswith("/*", i):
            end = sql.find("*/", i + 2)
            i = n if end < 0 else end + 1
        elif c == "?":
            found += 1
        i += 1
    return found


def table_overview(source: Sequence[str], replica: Sequence[str], states: Mapping[str, str], spark: SparkSession, database: str) -> DataFrame:
    """One row: how many tables each side has and how many of them synced last time."""
    done = sum(1 for s in states.values() if s == "success")
    row = (database, len(source), len(replica), done, len(states) - done)
    return spark.createDataFrame([row], "database_name string, source_tables int, replica_tables int, synced int, failed int")
