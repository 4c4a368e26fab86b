"""Token ids in shard files, each one wavelet matrix.

Documents are dealt to shards by ranges of their ids and sorted inside; a shard's ids, one
document after the other, are stored as bit-planes from the highest bit down, each plane
stably parted by the plane before it (Claude, Navarro and Ordonez 2015). With counts of
ones at regular places, a token is read, counted or found at any place without unpacking
the rest.

File layout of a shard, all little-endian: 4 bytes ``WMX2``; unsigned 32-bit counts of
documents and planes; an unsigned 64-bit count of ids; then length-prefixed (unsigned
64-bit) Zstandard frames: document ids (64-bit), a bit for each that is not null (lowest
bit first), their ids' end offsets (64-bit), and for each plane its ones before each 512th
place (32-bit) and its bits (lowest bit first). The shards are the ``payload`` column of Parquet files, so that they are written and committed
by Spark to any store it can reach.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.llm.chunks import ChunkMemo, byte_letters, held, text_batches

_BLOCK = 512
#: Text in a range of ids, and the most shards whose starts (24 bytes each) are sent to all executors.
RANGE_BYTES, MOST_SENT = 64 << 20, 200_000


class WaveletMatrix:
    """A sequence of small unsigned integers as bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.planes, self.ranks = n, planes, ranks
        self.zeros = [n - self._ones(k, n) for k in range(len(planes))]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, ranks, rest = [], [], values
        for shift in range(bits - 1, -1, -1):
            ones = (rest >> shift & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            planes.append(packed)
            ranks.append(cls._directory(packed))
            rest = np.concatenate([np.compress(~ones, rest), np.compress(ones, rest)])
        return cls(len(values), planes, ranks)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        """Ones before each block of 512 places."""
        size = _BLOCK // 8
        full = np.zeros(-(-max(len(packed), 1) // size) * size, np.uint8)
        full[: len(packed)] = packed
        ones = np.bitwise_count(full).reshape(-1, size).sum(axis=1, dtype=np.uint32)
        return np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][at >> 3]) >> (at & 7) & 1

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before place ``at``."""
        if at <= 0 or not len(self.planes[plane]):
            return 0
        block = min(at // _BLOCK, len(self.ranks[plane]) - 1)
        start, packed = block * _BLOCK, self.planes[plane]
        whole = packed[start >> 3 : at >> 3]
        count = int(self.ranks[plane][block]) + int(np.bitwise_count(whole).sum())
        return count + (int(packed[at >> 3]) & (1 << (at & 7)) - 1).bit_count() if at & 7 else count

    def access(self, at: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, at), self._ones(k, at)
            value = value << 1 | bit
            at = self.zeros[k] + ones if bit else at - ones
        return value

    def _down(self, token: int, at: int) -> int:
        for k in range(len(self.planes)):
            ones = self._ones(k, at)
            at = self.zeros[k] + ones if token >> (len(self.planes) - 1 - k) & 1 else at - ones
        return at

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in ``[start, end)``."""
        if token >> len(self.planes):
            return 0
        return self._down(token, self.n if end is None else end) - self._down(token, start)

    def select(self, token: int, nth: int) -> int:
        """Place of the ``nth`` occurrence (from 0) of a token; -1 if there are fewer."""
        if nth < 0 or nth >= self.count(token):
            return -1
        at = self._down(token, 0) + nth
        for k in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - k) & 1
            at = self._place(k, one, at - self.zeros[k] if one else at)
        return at

    def _place(self, plane: int, bit: int, nth: int) -> int:
        """Place of the ``nth`` place of a plane that holds ``bit``, by binary search on rank."""
        low, high = 0, self.n
        while low + 1 < high:
            middle = (low + high) // 2
            ones = self._ones(plane, middle)
            low, high = (middle, high) if (ones if bit else middle - ones) <= nth else (low, middle)
        return low

    def values(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        rest = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            above, zeros = np.empty_like(rest), self.zeros[k]
            above[np.flatnonzero(~ones)] = rest[:zeros]
            above[np.flatnonzero(ones)] = rest[zeros:] | rest.dtype.type(1 << (len(self.planes) - 1 - k))
            rest = above
        return rest


def pack_shard(doc_ids: list, sizes: list[int], values: np.ndarray) -> bytes:
    """The file of one shard."""
    bits = max(1, int(values.max(initial=0)).bit_length())
    matrix = WaveletMatrix.build(values, bits)
    known = np.packbits([d is not None for d in doc_ids], bitorder="little")
    parts = [np.array([0 if d is None else d for d in doc_ids], "<i8"), known, np.cumsum(sizes).astype("<u8")]
    for ranks, plane in zip(matrix.ranks, matrix.planes, strict=True):
        parts += [ranks.astype("<u4"), plane]
    frames = [zstandard.compress(p.tobytes(), 1) for p in parts]
    head = b"WMX2" + struct.pack("<IIQ", len(doc_ids), bits, len(values))
    return head + b"".join(struct.pack("<Q", len(f)) + f for f in frames)


def open_shard(payload: bytes) -> tuple[pa.Array, np.ndarray, WaveletMatrix]:
    """Document ids (null where one was), end offsets and the matrix of a shard file."""
    if payload[:4] != b"WMX2":
        raise ValueError("not a shard file")
    n_docs, bits, n = struct.unpack_from("<IIQ", payload, 4)
    at, frames = 20, []
    while at < len(payload):
        (size,) = struct.unpack_from("<Q", payload, at)
        frames.append(zstandard.decompress(payload[at + 8 : at + 8 + size]) if size else b"")
        at += 8 + size
    planes = [np.frombuffer(f, np.uint8) for f in frames[4::2]]
    ranks = [np.frombuffer(f, "<u4") for f in frames[3::2]]
    null = ~np.unpackbits(np.frombuffer(frames[1], np.uint8), count=n_docs, bitorder="little").view(bool)
    doc_ids = pa.array(np.frombuffer(frames[0], "<i8"), mask=null)
    return doc_ids, np.frombuffer(frames[2], "<u8").astype(np.int64), WaveletMatrix(n, planes[:bits], ranks)


#: A word of Latin letters and ASCII punctuation after it, between which byte-level pre-tokenizers always cut
#: (not an apostrophe: contractions begin with one).
_WORD_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: Words parted by single line ends, each of which is a piece of its own.
_LINES = re.compile(r"\S+(?:\n\S+)+")


def library_chunks(tokenizer_path: str) -> ChunkMemo:
    """The tokenizers library behind a memo of chunks; ids as little-endian unsigned 32-bit.

    A text that holds an added token is encoded whole, because the library cuts it there.
    A word of letters is one piece of the pre-tokenizer and goes to the library's model
    right away; a word with punctuation after it is two memo entries, so that words are
    shared. What is neither goes through the whole tokenizer.
    """

    def make() -> ChunkMemo:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(tokenizer_path)
        added = [t.content for t in library.get_added_tokens_decoder().values()]
        model = library.model.tokenize
        letters = {b: x for b, x in enumerate(byte_letters())}
        space, packed = letters[0x20], [struct.pack("<I", i) for i in range(max(library.get_vocab().values()) + 1)]

        def encode(text: str) -> bytes:
            ids = library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)

        def spaced(text: str) -> bytes:
            word = text.rstrip(_MARKS)
            if word.isascii() and word.isalpha():  # these letters stand for themselves
                if len(word) < len(text):
                    return memo.spaced[word] + memo.chunk[text[len(word) :]]
                return b"".join([packed[t.id] for t in model(space + word)])
            match = _WORD_AND_MARKS.fullmatch(text)
            if match:
                word, marks = match.groups()
                if marks:
                    return memo.spaced[word] + memo.chunk[marks]
                return b"".join([packed[t.id] for t in model((" " + word).encode().decode("latin-1").translate(letters))])
            if "\n" in text and _LINES.fullmatch(text):
                first, *lines = text.split("\n")
                return memo.chunk["\n"].join([memo.spaced[first], *map(memo.chunk.__getitem__, lines)])
            return encode(" " + text)

        memo = ChunkMemo(encode, lambda text: any(a in text for a in added), spaced)
        return memo

    return held(("store", tokenizer_path), make)


def write_shards(
    df: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 0,
    partitions: int | None = None,
    ids_a_shard: int = 1 << 20,
) -> None:
    """Encode the texts and write them as shard files in ascending id order.

    Rows are dealt by id range, so a shard holds neighbours and a task keeps at most one
    open shard of about ``ids_a_shard`` ids (one document is never cut). A null or empty
    text has only the end id. Rows with equal ids stay neighbours; null ids come first. An
    empty table gives no files with rows. Unless ``partitions`` says otherwise there are as
    many ranges as shuffle partitions, or more if a range would be over about 64 MB of text.
    """
    if partitions is None:
        size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
        partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        chunks, place = library_chunks(tokenizer_path), TaskContext.get().partitionId()
        ids, open_ids, size, nth = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(open_ids), "<u4")
            values = values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values
            payload = pack_shard(ids, [len(x) // 4 for x in open_ids], values)
            return pa.RecordBatch.from_pydict(
                {"range": [place], "nth": [nth], "n_docs": [len(ids)], "n_ids": [len(values)], "payload": [payload]}, out
            )

        out = pa.schema([("range", pa.int32()), ("nth", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        for batch, texts in text_batches(batches, text_col):
            for doc_id, text in zip(batch.column(id_col).to_pylist(), texts, strict=True):
                encoded = chunks(text) + end
                ids.append(doc_id)
                open_ids.append(encoded)
                size += len(encoded) // 4
                if size >= ids_a_shard:
                    yield shard()
                    ids, open_ids, size, nth = [], [], 0, nth + 1
        if ids:
            yield shard()

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    dealt = rows.repartitionByRange(partitions, F.col(f"`{id_col}`")).sortWithinPartitions(F.col(f"`{id_col}`"))
    schema = "range int, nth int, n_docs bigint, n_ids bigint, payload binary"
    dealt.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def shard_starts(files: DataFrame) -> DataFrame:
    """``(range, nth, shard_start)``: ids before each shard, summed over ranges and inside a range."""
    sizes = files.select("range", "nth", "n_ids")
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("__ids"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("range").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("range", F.coalesce(F.sum("__ids").over(earlier), F.lit(0)).alias("__before"))
    return (
        sizes.withColumn("__inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(before, "range")
        .select("range", "nth", (F.col("__before") + F.col("__inside")).alias("shard_start"))
    )


def read_shards(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the shard files: id, ``start`` (ids of all documents before it), ``token_ids`` (binary).

    Shards are unpacked one by one. The starts of shards are sent to them, unless there are
    more than ``MOST_SENT`` (counted first, which runs a Spark job); then both are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                starts = batch.column("shard_start")[row].as_py()
                doc_ids, ends, matrix = open_shard(batch.column("payload")[row].as_py())
                values = matrix.values().astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(doc_ids), 512):
                    spans = list(zip(begins[at : at + 512].tolist(), ends[at : at + 512].tolist(), strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc_ids[at : at + 512],
                            pa.array(begins[at : at + 512] + starts),
                            pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()),
                        ],
                        [id_col, "start", "token_ids"],
                    )

    starts = shard_starts(files)
    starts = F.broadcast(starts) if files.select("n_ids").count() <= MOST_SENT else starts
    placed = files.join(starts, ["range", "nth"]).select("shard_start", "payload")
    return placed.mapInArrow(run, f"{id_col} bigint, start bigint, token_ids binary")
