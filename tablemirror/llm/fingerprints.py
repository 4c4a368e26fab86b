"""Document fingerprints from prefix polynomial hashes.

For each text an array holds the polynomial hash of every prefix, modulo two primes. The
hash of any span follows from two entries, so spans are compared in constant time, and
the longest common extension of two places is found by binary search. A fingerprint is
the text's length and whole hash, and for 64 bins the least hash of its 12-character
spans; likeness is estimated from the bins that agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.chunks import text_batches
from tablemirror.llm.common import id_bounds, range_of

#: The two moduli (primes below 2**31, so products fit 64 bits) and the base of the hashes.
PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
#: Characters of a span, and bins of a fingerprint.
SPAN, BINS = 12, 64
_EMPTY = 0xFFFF


class Powers:
    """Powers of the base and of its inverse modulo one prime, grown as texts need them."""

    def __init__(self, prime: int):
        self.prime = prime
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            half, p = len(self.up), np.uint64(self.prime)
            step, back = pow(BASE, half, self.prime), pow(pow(BASE, half, self.prime), -1, self.prime)
            self.up = np.concatenate([self.up, self.up * np.uint64(step) % p])
            self.down = np.concatenate([self.down, self.down * np.uint64(back) % p])
        return self.up[:n], self.down[:n]


_POWERS = [Powers(p) for p in PRIMES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        points = code_points(text) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for powers in _POWERS:
            up, _ = powers.of(self.n + 1)
            p = np.uint64(powers.prime)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * up[: self.n] % p, out=sums[1:])
            self.sums.append(sums % p)

    def span(self, start: int, length: int) -> tuple[int, int]:
        """Hash of a span; equal spans have equal hashes wherever they stand."""
        out = []
        for powers, sums in zip(_POWERS, self.sums, strict=True):
            down = int(powers.of(self.n + 1)[1][start])
            out.append((int(sums[start + length]) - int(sums[start])) % powers.prime * down % powers.prime)
        return tuple(out)

    def spans(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length modulo the first prime."""
        powers, sums = _POWERS[0], self.sums[0]
        if self.n < length:
            return np.zeros(0, np.uint64)
        p = np.uint64(powers.prime)
        _, down = powers.of(self.n + 1)
        return (sums[length:] + p - sums[:-length]) % p * down[: self.n - length + 1] % p

    def common(self, at: int, other: PrefixHashes, there: int) -> int:
        """Longest common extension of two places, by binary search on span equality."""
        low, high = 0, min(self.n - at, other.n - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at, middle) == other.span(there, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self) -> str:
        """Length, whole hash and bins as hexadecimal text."""
        whole = self.span(0, self.n)
        hashes = self.spans(min(SPAN, max(self.n, 1)))
        bins = np.full(BINS, _EMPTY, np.uint64)
        if len(hashes):
            mixed = hashes * np.uint64(0x9E3779B97F4A7C15)  # spreads neighbouring values over the bins
            mixed ^= mixed >> np.uint64(29)
            order = np.sort(np.unique(mixed))
            where = order >> np.uint64(65 - BINS.bit_length())
            first = np.concatenate([[True], where[1:] != where[:-1]])
            least = order[first]
            least ^= least >> np.uint64(31)
            bins[where[first].astype(np.int64)] = least * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
            bins[where[first].astype(np.int64)] -= bins[where[first].astype(np.int64)] == _EMPTY
        return f"{self.n:x}-{whole[0]:08x}{whole[1]:08x}-" + "".join(f"{b:04x}" for b in bins.tolist())


def likeness(one: str, other: str) -> float:
    """Estimated share of spans that two fingerprinted texts have in common, 0 to 1; 1 for equal texts."""
    if one == other:
        return 1.0
    a, b = one.rpartition("-")[2], other.rpartition("-")[2]
    empty, same, either = f"{_EMPTY:04x}", 0, 0
    for i in range(0, 4 * BINS, 4):
        x, y = a[i : i + 4], b[i : i + 4]
        if x != empty or y != empty:
            either += 1
            same += x == y
    return min(2 * same / (either + same), 0.999999) if either else 0.0


def with_next(df: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """Rows dealt by id range and sorted, each range followed by the row that comes next.

    The first row of a range is also sent to the range before it (that of the first range
    to the last one), marked ``ahead``. So a task sees every row and its successor, and
    texts are shuffled once. The boundaries are plain numbers: ``ranges`` of them at most.
    """
    bounds = id_bounds(df, id_col, 1, ranges)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    rows = rows.withColumn("__range", range_of(F.col("__id"), bounds))
    heads = {r["__range"]: r["__first"] for r in rows.groupBy("__range").agg(F.min("__id").alias("__first")).collect()}
    full = sorted(heads)
    sent_to = {r: full[i - 1] for i, r in enumerate(full)}
    ranked = F.lit([sent_to.get(r, r) for r in range(len(bounds) + 1)])
    first = F.lit([heads.get(r) for r in range(len(bounds) + 1)]).cast("array<bigint>")
    is_head = F.col("__id").eqNullSafe(F.get(first, F.col("__range")))
    here = F.struct(F.col("__range").alias("to"), F.lit(False).alias("ahead"))
    there = F.struct(F.get(ranked, F.col("__range")).alias("to"), F.lit(True).alias("ahead"))
    return (
        rows.withColumn("__sent", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))))
        .select("__id", "__text", F.col("__sent.to").alias("__to"), F.col("__sent.ahead").alias("__ahead"))
        .repartitionById(len(bounds) + 1, F.col("__to"))
        .sortWithinPartitions("__to", "__ahead", F.col("__id").asc_nulls_first())
    )


def fingerprint_with_edit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last half (rounded down) replaced by as many first characters
    of the next row in ascending id order (all of it if it is shorter; after the last row
    comes the first). Columns: id, ``n_chars``, ``edited_text``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, ``shared_prefix`` (the longest
    common extension of both texts' beginnings). Null counts as empty; null ids come
    first; rows with equal ids follow each other in no set order.
    """
    if ranges is None:
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def row(doc_id, text: str, hashes: PrefixHashes, print_: str, after: str, after_print: str) -> tuple:
        n = hashes.n
        edited = text[: n - n // 2] + after[: n // 2]
        edited_hashes = PrefixHashes(edited)
        edited_print = edited_hashes.fingerprint()
        shared = hashes.common(0, edited_hashes, 0)
        return doc_id, n, edited, print_, edited_print, likeness(print_, edited_print), likeness(print_, after_print), shared

    names = [id_col, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_prefix"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        before, out = None, []
        for batch, texts in text_batches(batches, "__text"):
            for doc_id, to, ahead, text in zip(*(batch.column(c).to_pylist() for c in ("__id", "__to", "__ahead")), texts, strict=True):
                if before is None and ahead:
                    continue  # a further copy of the row ahead
                hashes = PrefixHashes(text)
                print_ = hashes.fingerprint()
                if before is not None:
                    out.append(row(*before[:4], text, print_))
                before = None if ahead else (doc_id, text, hashes, print_)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []

    schema = (
        f"`{id_col}` bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, shared_prefix bigint"
    )
    return with_next(df, id_col, text_col, ranges).mapInArrow(run, schema)
