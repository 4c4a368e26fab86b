"""Exact deduplication by a 128-bit content hash, in DataFrame functions only.

Texts are read once for their hashes. Only texts whose hash several rows have are read
again, for the comparison of their bytes, and only they are shuffled; which rows those are
is sent out as a bitmap of ids of a fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.common import free_name, key_bitmap, with_chance, written


def normalised(text: Column) -> Column:
    """The compared form of a text: each run of ASCII white space is one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(__id, sha256)`` of every row: 32 bytes, of which the first 16 are the content hash."""
    return df.select(F.col(f"`{id_col}`").alias("__id"), F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)).alias("sha256"))


def content_hash(sha256: str = "sha256") -> Column:
    return F.substring(sha256, 1, 16)


def duplicate_groups(df: DataFrame, hashed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text that several rows have: ``sha256``, ``keep_id``, ``group_size``.

    ``hashed`` has the digests of ``df``. Rows meet by their 128-bit hash; of the rows whose
    hash is not their own, the texts follow, and the text itself is the second grouping key,
    so two texts that share a hash stay two groups. All aggregates are combined before the
    shuffle, so a group that holds a third of all rows sends one row a task. ``keep_id`` is
    the smallest id that is not null.
    """
    several = hashed.groupBy(content_hash().alias("h128")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h128")
    ids = hashed.withColumn("h128", content_hash()).join(several, "h128", "left_semi")
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    asked = with_chance(rows, F.col("__id"), key_bitmap(ids, F.col("__id")), "__asked").where("__asked")
    norm = asked.select("__id", normalised(F.col("__text")).alias("__norm"))
    return (
        norm.withColumn("h128", F.substring(F.unhex(F.sha2("__norm", 256)), 1, 16))
        .groupBy("h128", "__norm")
        .agg(F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("__norm", 256)).alias("sha256"), "keep_id", "group_size")
    )


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Exactly one row of a group is kept: the one with the smallest id. Null and empty texts
    are one group. Rows that repeat both id and text count once each in ``group_size``, and
    one of them is kept. A group whose ids are all null keeps one row, with a null
    ``keep_id``. An empty table gives no rows. The digests are written to the shared folder,
    which runs a Spark job at once, and stay there for the result.
    """
    hashed, _ = written(digests(df, id_col, text_col), "digests")
    groups = duplicate_groups(df, hashed, id_col, text_col).withColumn("__several", F.lit(True))
    rows = hashed.groupBy("__id", "sha256").agg(F.count(F.lit(1)).cast("int").alias("__times"))
    keep = F.when(F.col("__several"), F.col("keep_id")).otherwise(F.col("__id"))
    # bytes were compared above; the digest now names a distinct text
    return (
        rows.join(groups, "sha256", "left")
        .withColumn("keep_id", keep)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(
            F.col("__id").alias(id_col),
            "keep_id",
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__copy") == 1)).alias("kept"),
            F.lower(F.hex("sha256")).alias("text_sha256"),
        )
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with its own columns; which stays, as in ``mark_duplicates``.

    Rows whose id is of none that goes stay where they are. The others are joined to the
    verdicts by id and digest; of rows that repeat both, one stays. Runs Spark jobs at once.
    """
    marked = mark_duplicates(df.select(id_col, text_col), id_col, text_col)
    going = marked.where("NOT kept").select(F.col(id_col).alias("__gone"), F.unhex("text_sha256").alias("__gone_sha"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("__again"))
    going, _ = written(going, "going")
    asked, sha, key = (free_name(df, n) for n in ("__asked", "__sha", "__key"))
    rows = with_chance(df, F.col(f"`{id_col}`"), key_bitmap(going, F.col("__gone")), asked)
    maybe = rows.where(asked).withColumn(sha, F.unhex(F.sha2(normalised(F.col(f"`{text_col}`")), 256)))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("__gone")) & (F.col(sha) == F.col("__gone_sha"))
    stay = maybe.join(going.where("NOT __again"), same, "left_anti").withColumn(key, F.xxhash64(F.col(f"`{id_col}`")))
    return rows.where(~F.col(asked)).drop(asked).unionByName(stay.dropDuplicates([key, sha]).drop(asked, sha, key))
