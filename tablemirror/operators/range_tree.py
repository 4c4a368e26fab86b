"""Reconciliation from coarse to fine: digests of key ranges first, rows only where they differ.

A digest does not depend on the order of rows: their number, and the exclusive or and the
sum of a 64-bit hash of each. Both sides' digests are combined in each task before
anything is shuffled, so equal tables cost one scan and a few rows; ranges that differ are
cut further, and in the end only they are read and joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.operators.reconcile import row_diff

#: Parts a range is cut into, rows of a range that is not cut further, and ranges in all: no cut goes beyond.
FAN_OUT, LEAF_ROWS, MOST_RANGES = 64, 100_000, 256

Range = tuple[Any, Any]


def key_axis(source: DataFrame, keys: Sequence[str]) -> Column:
    """What ranges are ranges of: the first key, which the scan can use, or a hash of the keys where it has no quantiles."""
    kinds = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return F.col(keys[0]) if isinstance(source.schema[keys[0]].dataType, kinds) else F.xxhash64(*keys)


def within(axis: Column, ranges: Sequence[Range]) -> Column:
    """Whether a value lies in one of the ranges ``[low, high)``; None is open, and NULL lies in the lowest."""

    def one(low: Any, high: Any) -> Column:
        above = F.lit(True) if low is None else axis >= F.lit(low)
        below = F.lit(True) if high is None else axis < F.lit(high)
        return above & below if low is not None else (axis.isNull() | below if high is not None else F.lit(True))

    return reduce(Column.__or__, (one(*r) for r in ranges), F.lit(False))


def _place(axis: Column, bounds: Sequence[Any], first: int = 0) -> Column:
    """How many of the sorted bounds are not above a value, by bisection; 0 for NULL."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    low, high = _place(axis, bounds[:middle], first), _place(axis, bounds[middle + 1 :], first + middle + 1)
    return F.when(axis >= F.lit(bounds[middle]), high).otherwise(low)


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in sorted(df.columns)])


def range_digests(source: DataFrame, replica: DataFrame, axis: Column, bounds: Sequence[Any], inside: Sequence[Range]) -> DataFrame:
    """``(place, source_rows, replica_rows, differs)`` of each part that the bounds cut the given ranges into."""
    sides = []
    for df, sign in ((source, 1), (replica, -1)):
        rows = df.where(within(axis, inside))
        sides.append(rows.select(_place(axis, bounds).alias("place"), _row_hash(df).alias("h"), F.lit(sign).alias("sign")))
    both = sides[0].unionAll(sides[1]).groupBy("place").agg(*_digest(F.col("h"), F.col("sign")))
    return both.select("place", "source_rows", "replica_rows", _differs().alias("differs"))


def _digest(h: Column, sign: Column) -> list[Column]:
    """Rows of both sides, and the exclusive or and the signed sums of both halves of their hashes."""
    halves = (F.shiftright(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31))  # signed, so that sums stay small
    rows = [F.count_if(sign > 0).alias("source_rows"), F.count_if(sign < 0).alias("replica_rows")]
    return [*rows, F.bit_xor(h).alias("x"), *(F.sum(half * sign).alias(name) for half, name in zip(halves, ("upper", "lower"), strict=True))]


def _differs() -> Column:
    return (F.col("source_rows") != F.col("replica_rows")) | (F.col("x") != 0) | (F.col("upper") != 0) | (F.col("lower") != 0)


def differing_ranges(
    source: DataFrame, replica: DataFrame, keys: Sequence[str], fan_out: int = FAN_OUT, leaf_rows: int = LEAF_ROWS, most: int = MOST_RANGES
) -> list[Range]:
    """Ranges of ``key_axis`` whose rows are not the same on both sides; an empty list if the tables are equal.

    Each level cuts the ranges that differ at their quantiles and scans only them. At most
    ``most`` ranges and ``fan_out`` bounds of each reach the driver. Rows that are equal but
    for the hash of 64 bits count as different; rows whose number, sum and exclusive or of
    hashes agree count as equal.
    """
    axis, cuts = key_axis(source, keys), [c / fan_out for c in range(1, fan_out)]
    quantiles = F.percentile_approx("a", cuts, 20 * fan_out).alias("b")
    open_: list[Range] = [(None, None)]
    # the first digest and the first quantiles are of all rows: one pass has both
    sides = [df.select(axis.alias("a"), _row_hash(df).alias("h"), F.lit(sign).alias("sign")) for df, sign in ((source, 1), (replica, -1))]
    first = sides[0].unionAll(sides[1]).agg(*_digest(F.col("h"), F.col("sign")), quantiles).select("*", _differs().alias("differs")).first()
    if not first["differs"]:
        return []
    if max(first["source_rows"], first["replica_rows"]) <= leaf_rows:
        return open_
    leaves, found = [], [first]
    while open_:
        edges = sorted({b for r in open_ for b in r if b is not None})
        if found is None:
            both = source.where(within(axis, open_)).select(axis.alias("a")).unionAll(replica.where(within(axis, open_)).select(axis.alias("a")))
            found = both.groupBy(_place(F.col("a"), edges).alias("place")).agg(quantiles).collect()
        bounds = sorted({b for r in found for b in (r["b"] or []) if b is not None} | set(edges))
        if len(bounds) == len(edges):  # nothing more to cut: one value fills each range
            return _joined(leaves + open_)
        parts = list(zip([None, *bounds], [*bounds, None], strict=True))
        differing = range_digests(source, replica, axis, bounds, open_).where("differs").collect()
        before, open_, found = set(open_), [], None
        for row in differing:
            part = parts[row["place"]]
            small = max(row["source_rows"], row["replica_rows"]) <= leaf_rows or part in before
            (leaves if small else open_).append(part)
        if len(open_) + len(leaves) >= most:
            return _joined(leaves + open_)
    return _joined(leaves)


def _joined(ranges: Sequence[Range]) -> list[Range]:
    """Neighbouring ranges as one."""
    lowest = [r for r in ranges if r[0] is None]
    ordered = lowest + sorted((r for r in ranges if r[0] is not None), key=lambda r: r[0])
    out: list[Range] = []
    for low, high in ordered:
        if out and out[-1][1] is not None and out[-1][1] == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def row_diff_by_ranges(
    source: DataFrame, replica: DataFrame, keys: Sequence[str], fan_out: int = FAN_OUT, leaf_rows: int = LEAF_ROWS, most: int = MOST_RANGES
) -> DataFrame:
    """``row_diff`` that reads and joins only the ranges which differ."""
    ranges = differing_ranges(source, replica, keys, fan_out, leaf_rows, most)
    axis = key_axis(source, keys)
    return row_diff(source.where(within(axis, ranges)), replica.where(within(axis, ranges)), keys)
