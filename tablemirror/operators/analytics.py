"""Reporting queries over mirrored tables. Columns are passed by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = 2


def total_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def filtered_count(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition).agg(F.count(F.lit(1)).alias("n"))


def by_status(df: DataFrame, status: str, amount: str) -> DataFrame:
    return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(amount), MONEY).alias("avg_amount"))


def by_two_dims(df: DataFrame, one: str, two: str, amount: str, top: int = 20) -> DataFrame:
    found = df.groupBy(F.col(one).alias("dim_1"), F.col(two).alias("dim_2")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), MONEY).alias("total")
    )
    return found.orderBy(F.col("total").desc(), "dim_1", "dim_2").limit(top)


def monthly_revenue(df: DataFrame, date: str, amount: str, start: Any = None, end: Any = None) -> DataFrame:
    """Revenue by year and month of the dates in ``[start, end)``."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast(df.schema[date].dataType))
    if end is not None:
        df = df.where(F.col(date) < F.lit(end).cast(df.schema[date].dataType))
    return df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), MONEY).alias("revenue")
    )


def top_spenders(df: DataFrame, user: str, amount: str, top: int = 10) -> DataFrame:
    found = df.groupBy(F.col(user).alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), MONEY).alias("total"))
    return found.orderBy(F.col("total").desc(), "user_id").limit(top)


def regional_analytics(df: DataFrame, region: str, amount: str, user: str, approximate: bool = False) -> DataFrame:
    users = F.approx_count_distinct(user) if approximate else F.countDistinct(user)
    return df.groupBy(F.col(region).alias("region")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(amount), MONEY).alias("total"),
        F.round(F.avg(amount), MONEY).alias("avg_amount"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        users.alias("users"),
    )


def order_stats(df: DataFrame, amount: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), MONEY).alias("total"), F.round(F.avg(amount), MONEY).alias("avg_amount"),
        F.min(amount).alias("min_amount"), F.max(amount).alias("max_amount"),
    )


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows against distinct composite keys. Keys with a NULL part count as keys here."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.sum("__n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"))


def bucket_histogram(df: DataFrame, value: str, top: int = 20) -> DataFrame:
    """Rows per whole number below the value; ``floor``, because casts round differently in engines."""
    found = df.groupBy(F.floor(value).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.col("n").desc(), "bucket").limit(top)


def daily_counts(df: DataFrame, ts: str, since: Any) -> DataFrame:
    rows = df.where(F.col(ts) >= F.lit(since).cast(df.schema[ts].dataType))
    return rows.groupBy(F.date_trunc("day", ts).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def category_totals(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, category: str, amount: str) -> DataFrame:
    """Count and sum per category of a dimension; the fact is summed by key before the join."""
    partial = fact.groupBy(fact_key).agg(F.count(F.lit(1)).alias("__n"), F.sum(amount).alias("__s"))
    joined = partial.join(dim.select(dim_key, category), F.col(fact_key) == F.col(dim_key))
    return joined.groupBy(F.col(category).alias("category")).agg(F.sum("__n").alias("n"), F.round(F.sum("__s"), MONEY).alias("total"))


def range_stats(df: DataFrame, date: str, amount: str, start: Any, end: Any) -> DataFrame:
    kind = df.schema[date].dataType
    return df.where(F.col(date).between(F.lit(start).cast(kind), F.lit(end).cast(kind))).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(amount), MONEY).alias("avg_amount")
    )


def simple_aggs(df: DataFrame, value: str, key: str, condition: Column) -> DataFrame:
    return df.agg(
        F.round(F.sum(value), MONEY).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"),
        F.max(value).alias("most"), F.countDistinct(key).alias("keys"), F.count_if(condition).alias("n_if"),
        F.round(F.sum(F.when(condition, F.col(value))), MONEY).alias("total_if"),
    )


def join_revenue(fact: DataFrame, dim: DataFrame, on: Column, group: str, amount: str) -> DataFrame:
    """Count and sum of a fact per attribute of a dimension. Spark broadcasts the dimension if it is small."""
    return fact.join(dim, on).groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), MONEY).alias("revenue"))


def count_per_parent(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Children per parent, zero included. Children are counted before the join, so a large parent is no skew."""
    counts = child.groupBy(F.col(child_key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    joined = parent.join(counts, F.col(parent_key) == F.col("__key"), "left")
    return joined.select(F.col(parent_key).alias("parent_id"), F.coalesce("__n", F.lit(0)).cast("long").alias("children"))


def star_revenue(fact: DataFrame, dim: DataFrame, on: Column, date: str, amount: str, region: str, anchor: Any, days: int) -> DataFrame:
    """Daily revenue by an attribute of a dimension over the days before an anchor date."""
    start = F.date_sub(F.lit(anchor).cast("date"), days)
    rows = fact.where(F.col(date) >= start.cast(fact.schema[date].dataType)).join(dim, on)
    return rows.groupBy(F.date_trunc("day", date).cast("date").alias("day"), F.col(region).alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(amount), MONEY).alias("revenue")
    )


def generate_rows(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Numbered rows with made-up values, for load tests."""
    return spark.range(1, n + 1).select(
        F.col("id"), F.concat(F.lit("row-"), F.col("id")).alias("val"), F.round(F.rand(seed) * 1000, 2).alias("num")
    )


def top_k(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*by).limit(k)


def first_last(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """The rows with the smallest and the largest value."""
    row = F.struct(*columns)
    both = df.agg(F.min_by(row, by).alias("first"), F.max_by(row, by).alias("last"))
    return both.select(F.lit("first").alias("which"), "first.*").union(both.select(F.lit("last").alias("which"), "last.*"))


def counts_union(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [total_count(df).select(F.lit(name).alias("table_name"), F.col("n").alias("row_count")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def all_names(one: DataFrame, two: DataFrame, name: str) -> DataFrame:
    return one.select(name).union(two.select(name)).distinct()


def name_difference(one: DataFrame, two: DataFrame, name: str) -> DataFrame:
    return one.select(name).exceptAll(two.select(name))


def log_page(log: DataFrame, order: Sequence[Column], status: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A newest-first page of a log and the count of all matching entries.

    A page past the end has one row, of nulls but for the count.
    """
    rows = log if status is None else log.where(status)
    page = rows.orderBy(*order).offset(offset).limit(limit)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return total.join(page, F.lit(True), "left").select(*log.columns, "total")


def log_tail(log: DataFrame, id_col: str, level: str, since_id: int, levels: Sequence[str] | None = None, most: int = 1000) -> DataFrame:
    """The newest entries after an id, of given levels, in ascending order."""
    rows = log.where(F.col(id_col) > since_id)
    if levels:
        rows = rows.where(F.col(level).isin(*levels))
    return rows.orderBy(F.col(id_col).desc()).limit(most).orderBy(id_col)
