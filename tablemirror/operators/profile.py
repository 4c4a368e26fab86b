"""Profiles of tables from what is known without reading them: file footers, schemas, and sketches kept with the batches.

Row and NULL counts come from Parquet footers. Whether a key is unique is estimated from a
mergeable sketch of its hash; only where the sketch cannot tell is the key column read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.operators.store import Store
from tablemirror.sources.scans import footer_reader
from tablemirror.spec import TableSpec, detect_watermark, is_supported, watermark_quality

#: Size of a sketch as a power of two, and how many of its standard errors (1.04 / 2 ** (SKETCH / 2)) count as a difference.
SKETCH, ERRORS = 14, 5
#: Types whose least and greatest value Spark takes from Parquet footers.
_IN_FOOTERS = (T.IntegralType, T.FloatType, T.DoubleType, T.DateType)


def key_sketch(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: ``rows`` and ``sketch``, some kilobytes that merge with those of other batches (``merged_sketch``)."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.xxhash64(*keys), F.lit(SKETCH)).alias("sketch"))


def merged_sketch(sketches: DataFrame) -> DataFrame:
    """The sketch of all batches together: ``rows`` and ``distinct_keys``, the estimate."""
    return sketches.agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_keys"))


def key_is_unique(df: DataFrame, keys: Sequence[str], sketch: DataFrame | None = None) -> bool:
    """Whether no key repeats: no, if a sketch shows clearly fewer keys than rows; else found exactly, by one repeated key."""
    facts = merged_sketch(key_sketch(df, keys) if sketch is None else sketch).first()
    if not facts["rows"]:
        return True
    error = ERRORS * 1.04 / 2 ** (SKETCH / 2)
    if facts["distinct_keys"] < facts["rows"] * (1 - error):
        return False
    return df.groupBy(*keys).count().where("count > 1").first() is None


def footer_facts(spark: SparkSession, path: str, columns: Sequence[str]) -> dict[str, Any]:
    """Rows, NULLs of each column, and least and greatest values of those whose type footers have, without reading a row group."""
    rows = footer_reader(spark).parquet(path)
    kinds = {c: rows.schema[c].dataType for c in columns}
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, (c, kind) in enumerate(kinds.items()):
        parts.append(F.count(c).alias(f"known_{i}"))
        if isinstance(kind, _IN_FOOTERS):
            parts += [F.min(c).alias(f"low_{i}"), F.max(c).alias(f"high_{i}")]
    found = rows.agg(*parts).first().asDict()
    facts: dict[str, Any] = {"rows": found["rows"]}
    for i, c in enumerate(kinds):
        facts[c] = {"nulls": found["rows"] - found[f"known_{i}"], "low": found.get(f"low_{i}"), "high": found.get(f"high_{i}")}
    return facts


PROFILE = (
    "table_name string, row_count bigint, key_columns string, null_keys bigint, key_is_unique boolean, watermark_column string, watermark_quality string, "
    "null_marks bigint, first_mark string, last_mark string, unsupported bigint, unsupported_columns string"
)


def profile_files(spark: SparkSession, spec: TableSpec, path: str, sketch: DataFrame | None = None) -> DataFrame:
    """One row of facts of a Parquet table.

    The watermark is the spec's, else the column whose name says when a row was written;
    its quality is ``none`` if rows lack it. Unsupported are columns whose declared type has
    no counterpart. A time column's range is read from that column, if footers lack it.
    """
    df = spark.read.parquet(path)
    mark = spec.watermark or detect_watermark(df.columns)
    facts = footer_facts(spark, path, [*spec.keys, *([mark] if mark and mark not in spec.keys else [])])
    nulls, low, high = 0, None, None
    if mark:
        nulls, low, high = (facts[mark][k] for k in ("nulls", "low", "high"))
        if not isinstance(df.schema[mark].dataType, _IN_FOOTERS):
            low, high = df.agg(F.min(mark).cast("string"), F.max(mark).cast("string")).first()
    text = lambda v: None if v is None else str(v)
    odd = sorted(c for c, kind in spec.declared.items() if not is_supported(kind))
    quality = "none" if nulls else watermark_quality(mark)
    unique = key_is_unique(df, spec.keys, sketch) if spec.keys else None
    row = (
        spec.name, facts["rows"], ",".join(spec.keys), sum(facts[k]["nulls"] for k in spec.keys), unique, mark, quality, nulls, text(low), text(high),
        len(odd), ",".join(odd),
    )
    return spark.createDataFrame([row], PROFILE)


def sketch_batches(store: Store, spec: TableSpec) -> DataFrame:
    """``(folder, rows, sketch)`` of every batch of a table's live version; a batch is sketched once and its sketch kept in the state."""
    name, schema = f"sketches-{spec.name}", "folder string, rows bigint, sketch binary"
    where = f"{store.root}/_sketches/{name}"
    known = store.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(where) if store.exists(where) else store.spark.createDataFrame([], schema)
    folders = [b["folder"] for b in store.batches(spec.name)]
    have = {r["folder"] for r in known.select("folder").collect()}
    for batch in store.batches(spec.name):
        if batch["folder"] not in have:
            rows = key_sketch(store.read_batches(spec.name, [batch]), spec.keys).select(F.lit(batch["folder"]).alias("folder"), "rows", "sketch")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{where}/of-{batch['folder'].replace('/', '-').replace('=', '-')}")
    read = store.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(where)
    return read.where(F.col("folder").isin(folders))


def versions_per_key(store: Store, spec: TableSpec) -> float:
    """About how many stored versions a key has, from the sketches of the batches: how much a vacuum would drop."""
    facts = merged_sketch(sketch_batches(store, spec)).first()
    return facts["rows"] / max(facts["distinct_keys"], 1) if facts["rows"] else 0.0
