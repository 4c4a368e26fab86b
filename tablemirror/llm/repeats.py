"""Passages that repeat, by a radix sort of suffixes that goes as deep as a passage must be long.

A suffix is a place in a text and counts to ``depth`` bytes; two suffixes that are equal so
far are a repeated window. Suffixes are parted pass by pass, by one digit of many bytes in
each, and a suffix that no other shares its digits with leaves. After the last pass, equal
groups are exactly the repeated windows. Which bytes make a digit is chosen so that few
suffixes need to be written down at all:

1. The first digit of a suffix is its anchor, the least hash of the short grams inside its
   window (Schleimer, Wilkerson and Aiken 2003). Equal windows have the same anchor at the
   same distance, and neighbours mostly share theirs, so one record stands for some 190
   suffixes.
2. The second digit is what a block of neighbouring suffixes of one anchor has in common:
   all but ``BLOCK - 1`` bytes of each window. Blocks that are equal throughout are repeated
   as a whole and need no further pass.
3. The rest of the bytes: only suffixes in a block that shares its core with a different
   block are written down one by one. These are the ends of passages.

Equal texts are one text from the start. Groups meet by aggregates that combine before the
shuffle and by joins that adaptive execution can split, so no passage, however common, has
to fit a task. Cores are compared by 64-bit hashes, which can only cause more work; blocks
and windows by 128 bits of BLAKE2, texts by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.common import discard, free_name, replaced, written

#: Bytes of a repeated window, of the grams that anchors are chosen from, and suffixes of a block.
DEPTH, GRAM, BLOCK = 400, 24, 64
#: Text that a task takes apart at a time.
_STEP_BYTES = 1 << 20

_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_LETTER = _mixed(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BASE = _MIX2 | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, _STEP_BYTES + 1)
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        if size <= 4 * _STEP_BYTES:  # those for a very long text are not kept
            _POWERS[int(base)] = have
    return have[:n]


def gram_size(depth: int) -> int:
    return max(1, min(GRAM, depth // 4))


def block_size(depth: int) -> int:
    return max(1, min(BLOCK, depth // 4))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each place."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _powers(_BASE, len(data)), out=sums[1:])
    n = len(data) - size + 1
    return _mixed((sums[size:] - sums[:n]) * _powers(_INVERSE, n))


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbouring values (van Herk 1992)."""
    rows = -(-len(values) // window)
    padded = np.full(rows * window, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - window + 1
    return np.minimum(behind[:n], ahead[window - 1 : window - 1 + n])


def anchors(texts: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
    """``(owner, digit, at, low, high)`` of every anchor: suffixes ``at - high`` to ``at - low`` of the text have it.

    Each of the texts has at least ``depth`` bytes. Of equal grams in a window the first
    counts, so where a byte or a gram fills a whole window each suffix has its own anchor.
    """
    gram = gram_size(depth)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    digits = _grams(np.frombuffer(b"".join(texts), np.uint8), gram)
    ranked = (digits & ~_LOW) | np.arange(len(digits), dtype=np.uint64)
    least = _least(ranked, depth - gram + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    place = np.flatnonzero(np.arange(len(least)) + depth <= ends[owner])
    chosen = (least[place] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(new[1:], len(place)) - 1
    owner, at = owner[place[new]], chosen[new]
    return owner, digits[at].view(np.int64), at - (ends - sizes)[owner], at - place[last], at - place[new]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts, about a megabyte of text (or one row) at a time."""
    for batch in batches:
        start, filled = 0, 0
        for row, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
            filled += size
            if filled >= _STEP_BYTES or row == batch.num_rows - 1:
                part = batch.slice(start, row + 1 - start)
                yield part, part.column("text").to_pylist()
                start, filled = row + 1, 0


def _structs(part: pa.RecordBatch, column: str, *fields: str) -> tuple[np.ndarray, ...]:
    """The rows of a column of lists of structs, one after the other: the row's number, then its fields."""
    lists = part.column(column)
    flat = lists.flatten()
    owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    return owner, *(flat.field(f).to_numpy() for f in fields)


def _found_anchors(batches: Iterator[pa.RecordBatch], depth: int) -> Iterable[pa.RecordBatch]:
    for part, texts in _steps(batches):
        owner, digit, at, low, high = anchors(texts, depth)
        ints = [pa.array(x.astype(np.int32)) for x in (at, low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(digit), part.column("key").take(pa.array(owner)), *ints], ["digit", "key", "at", "low", "high"])


def _blocks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterable[pa.RecordBatch]:
    size = block_size(depth)
    for part, texts in _steps(batches):
        owner, at, low, high = _structs(part, "anchors", "at", "low", "high")
        times = high // size - low // size + 1
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        owner, at = np.repeat(owner, times), np.repeat(at, times)
        block = np.repeat(low // size, times) + nth
        first, last = np.maximum(np.repeat(low, times), block * size), np.minimum(np.repeat(high, times), block * size + size - 1)
        cores, spans = [], []
        for row, a, b, f, x in zip(owner.tolist(), at.tolist(), block.tolist(), first.tolist(), last.tolist(), strict=True):
            text, start = texts[row], a - b * size
            cores.append(xxhash.xxh3_64_intdigest(text[start : start - size + 1 + depth], b))
            spans.append(hashlib.blake2b(text[a - x : a - f + depth], digest_size=16, salt=struct.pack("<qq", f, x)).digest())
        ints = [pa.array(x.astype(np.int32)) for x in (at, first, last)]
        which = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(cores, np.uint64).view(np.int64)), pa.array(spans, pa.binary()), part.column("key").take(which), *ints, part.column("copied").take(which)],
            ["core", "span", "key", "at", "low", "high", "copied"],
        )


def _windows(batches: Iterator[pa.RecordBatch], depth: int) -> Iterable[pa.RecordBatch]:
    for part, texts in _steps(batches):
        owner, at, low, high, again = _structs(part, "blocks", "at", "low", "high", "again")
        times = high - low + 1
        start = np.repeat(at - high, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        owner, again = np.repeat(owner, times), np.repeat(again, times)
        made = [hashlib.blake2b(texts[row][s : s + depth], digest_size=16).digest() for row, s in zip(owner.tolist(), start.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(made, pa.binary()), part.column("key").take(pa.array(owner)), pa.array(start.astype(np.int32)), pa.array(again.astype(np.int32))],
            ["window", "key", "start", "again"],
        )


def joined_ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover; ranges that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
    return start[new], stop[np.append(new[1:], len(start)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    for part, texts in _steps(batches):
        owner, start, stop = _structs(part, "ranges", "start", "stop")
        at = np.searchsorted(owner, np.arange(part.num_rows + 1))
        spans, kept = [], []
        for row, text in enumerate(texts):
            a, b = joined_ranges(start[at[row] : at[row + 1]], stop[at[row] : at[row + 1]])
            spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            kept.append(b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)))
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["key", "spans", "kept"])


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256; null is as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def repeated_spans(df: DataFrame, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """``(key, spans, kept)`` of every distinct text with a byte in a repeated window, written to the shared folder.

    A window is ``depth`` bytes of UTF-8 that start at another place too, in this or in any
    other row; windows do not cross rows. ``spans`` are the maximal runs of bytes in such
    windows, ``kept`` the other bytes in order (a character may be cut). ``key`` is
    ``text_key``. A text of ``depth`` bytes or more that several rows have is one span. A
    null or shorter text has no row; ids and other columns are not looked at.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(text.alias("text")).where(F.octet_length("text") >= depth).withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    distinct = rows.groupBy("key").agg(F.first("text").alias("text"), (F.count(F.lit(1)) > 1).alias("copied"))
    # bucketed, so that what the passes find meets the texts without shuffling them again
    name = f"llm_texts_{uuid.uuid4().hex}"
    distinct.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").format("parquet").saveAsTable(name)
    texts = spark.table(name)

    first, first_path = written(
        texts.select("key", "text").mapInArrow(lambda b: _found_anchors(b, depth), "digit bigint, key binary, at int, low int, high int"), "anchors"
    )
    # what groups have in common is written down, so that the joins behind have plain inputs, whose hot keys Spark can split
    scratch = [first_path]

    def put_by(df: DataFrame) -> DataFrame:
        table, path = written(df, "shared")
        scratch.append(path)
        return table

    shared = put_by(first.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit"))
    lists = first.join(shared, "digit", "left_semi").groupBy("key").agg(F.collect_list(F.struct("at", "low", "high")).alias("anchors"))
    schema = "core bigint, span binary, key binary, at int, low int, high int, copied boolean"
    blocks, blocks_path = written(texts.join(lists, "key").mapInArrow(lambda b: _blocks(b, depth), schema), "blocks")

    one = F.min(F.struct("key", "at", "low", "high")).alias("one")
    classes = blocks.groupBy("core", "span").agg(F.count(F.lit(1)).alias("n"), F.max("copied").alias("copied"), one)
    mixed = put_by(classes.groupBy("core").agg(F.count(F.lit(1)).alias("spans")).where("spans > 1").select("core"))
    open_blocks = classes.join(mixed, "core", "left_semi").select("one.*", F.when((F.col("n") > 1) | F.col("copied"), 2).otherwise(1).alias("again"))
    lists = open_blocks.groupBy("key").agg(F.collect_list(F.struct("at", "low", "high", "again")).alias("blocks"))
    windows, windows_path = written(
        texts.join(lists, "key").select("key", "text", "blocks").mapInArrow(lambda b: _windows(b, depth), "window binary, key binary, start int, again int"), "windows"
    )
    equal = put_by(windows.groupBy("window").agg(F.sum("again").alias("n")).where("n > 1").select("window"))
    alone = windows.where("again = 1").join(equal, "window", "left_semi").select("key", "start", (F.col("start") + depth).alias("stop"))

    whole = put_by(classes.where("n > 1").select("core", "span"))
    runs = blocks.where(~F.col("copied")).join(whole, ["core", "span"], "left_semi")
    runs = runs.select("key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + depth).alias("stop"))
    copies = texts.where("copied").select("key", F.lit(0).alias("start"), F.octet_length("text").alias("stop"))
    ranges = runs.unionByName(alone).unionByName(copies).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    cut = texts.join(ranges, "key").select("key", "text", "ranges")
    found, _ = written(cut.mapInArrow(_cut, "key binary, spans array<struct<start: int, stop: int>>, kept binary"), "repeats")
    spark.sql(f"DROP TABLE {name}")
    discard(spark, *scratch, blocks_path, windows_path)
    return found


def remove_repeats(df: DataFrame, depth: int = DEPTH, text_col: str = "text") -> DataFrame:
    """``df`` with ``repeat_spans`` (the byte runs of repeated windows) and ``kept_bytes`` (the text's other bytes).

    Columns of these names are replaced. Rows with a null or empty text have no spans and
    no bytes; every row stays, whatever its id.
    """
    key = free_name(df, "__key")
    found = repeated_spans(df, depth, text_col).withColumnsRenamed({"key": key, "spans": "repeat_spans", "kept": "kept_bytes"})
    own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    joined = replaced(df, "repeat_spans", "kept_bytes").withColumn(key, text_key(F.col(f"`{text_col}`"))).join(found, key, "left")
    none = F.array().cast("array<struct<start: int, stop: int>>")
    return joined.withColumns({"repeat_spans": F.coalesce("repeat_spans", none), "kept_bytes": F.coalesce("kept_bytes", own)}).drop(key)
