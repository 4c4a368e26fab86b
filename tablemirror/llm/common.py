"""Shared helpers: the shared scratch folder, written intermediate tables, id ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a single-process ``local`` session may go without it; it then gets a
    temporary folder. A cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="llm-shared-")
    return _OWN_DIRS[app]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` under the shared folder and read it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand Python so many rows at a time: for rows with long arrays, of which the usual 10,000 are hundreds of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add (its own win over clashing ones)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until ``df`` has no such column: for columns that are gone again in the end."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_bounds(df: DataFrame, id_col: str, rows_a_range: int, most: int = 256) -> list[int]:
    """Inner boundaries that cut the ids into ranges of about equal row counts.

    At most ``most - 1`` numbers reach the driver, whatever the input's size. They are
    plain values afterwards, so the range of a row depends on its id alone and a lost
    task recomputes to the same place.
    """
    n = df.agg(F.count(F.col(f"`{id_col}`"))).first()[0]
    ranges = max(1, min(most, -(-n // rows_a_range)))
    if ranges == 1:
        return []
    cuts = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(F.col(f"`{id_col}`"), cuts, 20 * most)).first()[0]
    return sorted(set(found or []))


def range_of(id_col: Column, bounds: list[int]) -> Column:
    """Index of the range an id falls into; a null id goes to range 0."""
    if not bounds:
        return F.lit(0)
    array = F.lit([int(b) for b in bounds]).cast("array<bigint>")
    return F.coalesce(F.size(F.filter(array, lambda b: b <= id_col)), F.lit(0))


#: A bitmap of ids has so many places, 8 MB of bits whatever the number of ids; it is made in parts of 32,768, which is
#: what Spark's aggregate makes, and sent in pieces of 512 places, so that a row that asks it copies 64 bytes.
PLACES, PART, PIECE = 1 << 26, 1 << 15, 1 << 9


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PLACES))


def key_bitmap(df: DataFrame, key: Column) -> DataFrame:
    """``(piece, bits)``: bits at the places of the hashed keys, at most 131,072 rows of 64 bytes.

    Of a bounded size, so it can be sent to all executors; more keys make it fuller, and a
    full one lets everything pass.
    """
    bits = F.bitmap_construct_agg(F.pmod("place", F.lit(PART)).cast("long")).alias("bits")
    parts = df.select(_place(key).alias("place")).groupBy((F.col("place") / PART).cast("long").alias("part")).agg(bits)
    each = parts.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(PART // PIECE - 1))))
    piece = F.substring("bits", F.col("n") * (PIECE // 8) + 1, F.lit(PIECE // 8)).alias("bits")
    found = each.select((F.col("part") * (PART // PIECE) + F.col("n")).alias("piece"), piece)
    return found.where(F.col("bits") != F.lit(bytes(PIECE // 8)))


def with_chance(df: DataFrame, key: Column, bitmap: DataFrame, out: str) -> DataFrame:
    """``df`` and a boolean ``out``: false if the key is surely not in the bitmap. No shuffle."""
    place, piece, bits = (free_name(df, n) for n in ("__place", "__piece", "__bits"))
    sent = F.broadcast(bitmap.select(F.col("piece").alias(piece), F.col("bits").alias(bits)))
    at = F.pmod(F.col(place), F.lit(PIECE)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = df.withColumn(place, _place(key)).join(sent, (F.col(place) / PIECE).cast("long") == F.col(piece), "left")
    return found.withColumn(out, F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False))).drop(place, piece, bits)
