"""Which tokens of one tokenizer stand for which tokens of another.

Both tokenizers cut the same bytes. Where a token of both ends, the text can be cut, and
the tokens between two such cuts are one group. The cuts are found by divide and conquer:
near the middle of an interval a common end is looked for, each candidate by bisection in
the other tokenizer's ends, nearest first; both halves go on the same way, and an interval
without one is a leaf, a group. All intervals of a batch of texts advance together.

A link is a pair of tokens whose bytes overlap. Counting pairs over a corpus, and giving
each link its count again, meets very frequent pairs: the commonest ones, a fixed number,
are sent to all tasks and looked up there, and only links of rarer pairs are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.llm.chunks import byte_letters
from tablemirror.llm.common import discard, replaced, written

#: Pairs that are sent to all tasks: 16 bytes each, 4 MB in all.
SENT_PAIRS = 1 << 18
#: Stretches of text that a worker remembers with their groups, in each of two generations, and the longest of them.
MEMO_ENTRIES, LONGEST_KEY = 120_000, 40
#: A pair of ids is one number: the first tokenizer's id above so many bits of the second's.
_BITS = 32
_STEP_BYTES = 1 << 19
#: Candidates that are tried one by one before an interval's whole rest is tried at once.
_TRIES = 8

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(f"( ?)[{_LETTERS}]+")
#: ASCII marks that byte-level pre-tokenizers part from letters before them; an apostrophe may begin a contraction.
_MARKS = r"[!-&(-/:-=?@\[-`{-~]"
#: Where both kinds of tokenizers may always cut: before a space behind something that is not white space, and there or
#: between a letter and a mark or behind a single line end.
_AT_SPACES = re.compile(r"(?<=\S)(?= )")
_AT_MARKS = re.compile(rf"(?<=\S)(?= )|(?<=[{_LETTERS}])(?={_MARKS})|(?<=\S\n)(?=\S)")
#: What of the latter is inside words that spaces part.
_IN_WORDS = re.compile(rf"(?<=[{_LETTERS}])(?={_MARKS})|(?<=\S\n)(?=\S)")
#: Stands for the groups of a stretch that a tokenizer does not spell.
_UNSPELLED = "!"


class Tokens:
    """A tokenizer: ids of stretches of text, the bytes that each id stands for, and where it always cuts.

    A stretch begins with a space, or with a mark or letter behind a place where a text is
    always cut: before a space behind something else, between a letter and a mark, behind a
    line end.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], pieces: list[bytes], at_spaces: bool = True, at_marks: bool = True):
        self.encode, self.pieces, self.at_spaces, self.at_marks = encode, pieces, at_spaces, at_marks
        self.sizes = np.array([len(p) for p in pieces], np.int64)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@cache
def byte_level(path: str) -> Tokens:
    """A byte-level tokenizer of the tokenizers library, read with a space before the text; special strings are plain text.

    A word of letters, with a space before it or not, is one piece of the pre-tokenizer and
    goes to the library's model right away.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    model, letters = library.model.tokenize, byte_letters()
    to_letters, space = {b: x for b, x in enumerate(letters)}, letters[0x20]

    def piece(text: str) -> list[int]:
        return [t.id for t in model(text.encode().decode("latin-1").translate(to_letters))]

    def encode(text: str) -> list[int]:
        spaced = text[:1] == " "
        word = text[1:] if spaced else text
        if word.isascii() and word.isalpha():  # these letters stand for themselves
            return [t.id for t in model(space + word if spaced else word)]
        return piece(text) if _WORD.fullmatch(text) else library.encode(text, add_special_tokens=False).ids

    byte = {x: b for b, x in enumerate(letters)}
    vocabulary = library.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        pieces[i] = bytes(byte[x] for x in token) if all(x in byte for x in token) else token.encode()
    return Tokens(lambda texts: list(map(encode, texts)), pieces)


@cache
def sentence_pieces(path: str) -> Tokens:
    """A sentencepiece model that adds the space itself; U+2581 in a piece is a space."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    pieces = [bytes([int(n[3:5], 16)]) if library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    joined = [n for i, n in enumerate(names) if not library.is_control(i) and not library.is_byte(i)]
    at_spaces = not any(re.search("[^▁]▁", n) for n in joined)
    # a line end is a byte of its own, and no letter has the mark behind it in its piece
    at_marks = at_spaces and not any("\n" in n or re.search(f"[{_LETTERS}]{_MARKS}", n) for n in joined)
    start = library.encode("\n")

    def encode(texts: list[str]) -> list[list[int]]:
        found = library.encode([t[1:] if t[0] == " " else "\n" + t for t in texts], num_threads=1)
        return [ids if t[0] == " " else ids[len(start) :] for t, ids in zip(texts, found, strict=True)]

    return Tokens(encode, pieces, at_spaces, at_marks)


@cache
def tokens(path: str) -> Tokens:
    return byte_level(path) if path.endswith(".json") else sentence_pieces(path)


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray) -> np.ndarray:
    """Indexes of the tokens of A that end where one of B does, inside intervals of which only the last tokens are known to.

    Intervals are ranges of tokens of both, one for each text. A level halves all open ones.
    """
    found = []
    while True:
        open_ = (a_to - a_from > 1) & (b_to - b_from > 1)
        a_from, a_to, b_from, b_to = a_from[open_], a_to[open_], b_from[open_], b_to[open_]
        if not len(a_from):
            return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cut, at = _near_middle(a_ends, b_ends, a_from, a_to)
        split = cut >= 0
        a_from, a_to, b_from, b_to, cut, at = (x[split] for x in (a_from, a_to, b_from, b_to, cut, at))
        found.append(cut)
        a_from, a_to = np.concatenate([a_from, cut + 1]), np.concatenate([cut + 1, a_to])
        b_from, b_to = np.concatenate([b_from, at + 1]), np.concatenate([at + 1, b_to])


def _near_middle(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The common end nearest to each interval's middle, as indexes into A and B; -1 where there is none."""
    cut, at = np.full(len(a_from), -1), np.full(len(a_from), -1)
    first, last = a_from, a_to - 2  # an interval's last token ends it
    middle, left = (first + last) // 2, np.arange(len(a_from))
    for step in range(_TRIES):
        tried = middle[left] + (step + 1) // 2 * (1 if step % 2 else -1)
        inside = (tried >= first[left]) & (tried <= last[left])
        here, tried = left[inside], tried[inside]
        place = np.searchsorted(b_ends, a_ends[tried])
        common = b_ends[place] == a_ends[tried]
        cut[here[common]], at[here[common]] = tried[common], place[common]
        left = left[(cut[left] < 0) & (np.maximum(middle[left] - first[left], last[left] - middle[left]) > step // 2)]
    for i in left.tolist():
        tried = np.arange(first[i], last[i] + 1)
        place = np.searchsorted(b_ends, a_ends[tried])
        common = np.flatnonzero(b_ends[place] == a_ends[tried])
        if len(common):
            best = common[np.argmin(np.abs(tried[common] - middle[i]))]
            cut[i], at[i] = tried[best], place[best]
    return cut, at


def _ranges(sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    stop = np.cumsum(np.asarray(sizes, np.int64))
    return stop - sizes, stop


def group_ends(a: Tokens, b: Tokens, a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: Sequence[int], b_sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last token of A and of B in every group; the texts' ids stand one after the other, ``sizes`` of each.

    Each text must have the same bytes in both.
    """
    a_ends, b_ends = np.cumsum(a.sizes[a_ids]), np.cumsum(b.sizes[b_ids])
    (a_from, a_to), (b_from, b_to) = _ranges(a_sizes), _ranges(b_sizes)
    some = a_to > a_from
    inner = shared_cuts(a_ends, b_ends, a_from[some], a_to[some], b_from[some], b_to[some])
    last = np.sort(np.concatenate([inner, a_to[some] - 1]))
    return last, np.searchsorted(b_ends, a_ends[last])


def links(a: Tokens, b: Tokens, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into A and B of all overlapping tokens, in order: each stretch between neighbouring ends is one link."""
    a_ends, b_ends = np.cumsum(a.sizes[a_ids]), np.cumsum(b.sizes[b_ids])
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.concatenate([ends[1:] != ends[:-1], [True]])] if len(ends) else ends
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Remembered:
    """What was made of some texts, in two generations; the old one is forgotten but for what is asked for again."""

    def __init__(self, make: Callable[[list[str]], list[str]]):
        self.make = make
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.long: list[str] = []

    def __call__(self, texts: set[str]) -> dict[str, str]:
        """A dict that has all of them until the next call."""
        for text in self.long:
            del self.young[text]
        if len(self.young) >= MEMO_ENTRIES:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for text in texts.difference(young):
            value = old.get(text)
            if value is None:
                new.append(text)
            else:
                young[text] = value
        if new:
            young.update(zip(new, self.make(new), strict=True))
        self.long = [text for text in new if len(text) > LONGEST_KEY]
        return young


class Aligner:
    """Groups of texts. Where both tokenizers always cut, texts are cut at once, and equal stretches are grouped once.

    What is remembered of a stretch are its groups written as ``a1,a2|b1;a3|b2,b3;``. They
    are joined for a text, and the ids are read back from there.
    """

    def __init__(self, a: Tokens, b: Tokens):
        self.a, self.b = a, b
        self.names = [f"{i}{mark}" for side, marks in ((a, ",|"), (b, ",;")) for i in range(len(side.pieces)) for mark in marks]
        self.widths = np.array([len(n) for n in self.names], np.int64)
        self.cuts = (_AT_MARKS if a.at_marks and b.at_marks else _AT_SPACES) if a.at_spaces and b.at_spaces else None
        self.known = Remembered(self._grouped)

    def _stretches(self, text: str) -> list[str]:
        """The text cut, with the space before it; a text that ends with a space is one stretch."""
        if not text:
            return []
        if self.cuts is None or text.endswith(" "):
            return [" " + text]
        inside, out = self.cuts is _AT_MARKS, []
        for word in text.split(" "):
            if word.isalpha():
                out.append(" " + word)
            elif not word or word[-1].isspace():  # white space before a space, where nothing is cut
                return self.cuts.split(" " + text)
            elif inside:
                out += _IN_WORDS.split(" " + word)
            else:
                out.append(" " + word)
        return out

    def _spelled(self, texts: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> list[bool]:
        """Whether both tokenizers spell a text: all at once, and one by one if that fails."""
        whole = "".join(texts).encode()
        stops = np.cumsum([len(t) for t in texts] if whole.isascii() else [len(t.encode()) for t in texts])
        for side, found in ((self.a, a_ids), (self.b, b_ids)):
            ids = [*chain.from_iterable(found)]
            ends = np.cumsum([0, *map(len, found)])[1:]
            if side.spell(ids) != whole or not np.array_equal(np.concatenate([[0], np.cumsum(side.sizes[ids])])[ends], stops):
                return [self.a.spell(x) == self.b.spell(y) == t.encode() for t, x, y in zip(texts, a_ids, b_ids, strict=True)]
        return [True] * len(texts)

    def _grouped(self, texts: list[str]) -> list[str]:
        """All stretches in one divide and conquer, each an interval of its own."""
        found = self.a.encode(texts), self.b.encode(texts)
        spelled = self._spelled(texts, *found)
        if not all(spelled):
            found = tuple([x if ok else [] for x, ok in zip(f, spelled, strict=True)] for f in found)
        sizes = [np.array([*map(len, f)], np.int64) for f in found]
        ids = [np.array([*chain.from_iterable(f)], np.int64) for f in found]
        out = self._written_out(*ids, *group_ends(self.a, self.b, *ids, *sizes))
        shown = "".join(map(self.names.__getitem__, out.tolist()))
        stops = np.concatenate([[0], np.cumsum(self.widths[out])])[np.cumsum(sizes[0] + sizes[1])].tolist()
        return [shown[x:y] if ok else _UNSPELLED for ok, x, y in zip(spelled, [0, *stops], stops, strict=False)]

    def _written_out(self, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> np.ndarray:
        """Numbers of the names of all tokens, each with what follows it, in the order of ``a1,a2|b1;a3|b2,b3;``."""
        ends_a, ends_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        ends_a[a_last], ends_b[b_last] = 1, 1
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        out = np.empty(len(a_ids) + len(b_ids), np.int64)
        out[np.arange(len(a_ids)) + np.concatenate([[0], b_last + 1])[group_a]] = a_ids * 2 + ends_a
        out[np.arange(len(b_ids)) + (a_last + 1)[group_b]] = b_ids * 2 + ends_b + 2 * len(self.a.pieces)
        return out

    def __call__(self, texts: list[str]) -> list[tuple]:
        """For each text bytes of 32-bit numbers: ids of A and of B, sizes of its groups in both; its groups as text, and whether both spell it.

        All is empty where a tokenizer does not spell the text.
        """
        parts = [self._stretches(t) for t in texts]
        known = self.known(set(chain.from_iterable(parts)))
        shown = ["".join(map(known.__getitem__, p)) for p in parts]
        # what one stretch lacks another could have too much, so then the whole text decides
        shown = [self._grouped([" " + t])[0] if _UNSPELLED in s else s for t, s in zip(texts, shown, strict=True)]
        return _read(["" if s == _UNSPELLED else s for s in shown])


def _read(shown: list[str]) -> list[tuple]:
    """The numbers of groups that are written out, text by text."""
    raw = np.frombuffer("".join(shown).encode(), np.uint8)
    at = np.flatnonzero((raw < ord("0")) | (raw > ord("9")))  # each number has a mark behind it
    marks, digits = raw[at], np.diff(at, prepend=-1) - 1
    ids = np.zeros(len(at), np.int32)
    for k in range(int(digits.max(initial=0))):
        ids += np.where(digits > k, raw[at - 1 - k] - np.uint8(ord("0")), 0).astype(np.int32) * 10**k
    bars, ends = marks == ord("|"), marks == ord(";")
    of_a = np.cumsum(bars) - bars == np.cumsum(ends) - ends
    groups = [np.diff(np.flatnonzero(marks[side] == ord(mark)), prepend=-1).astype(np.int32) for side, mark in ((of_a, "|"), (~of_a, ";"))]
    numbers = np.searchsorted(at, np.cumsum([len(s) for s in shown]))
    n_a, n_groups = (np.concatenate([[0], np.cumsum(x)])[numbers] for x in (of_a, bars))
    sides = [(x.tobytes(), [0, *(4 * n).tolist()]) for x, n in zip((ids[of_a], ids[~of_a], *groups), (n_a, numbers - n_a, n_groups, n_groups), strict=True)]
    return [(*(x[stop[i] : stop[i + 1]] for x, stop in sides), s, bool(s)) for i, s in enumerate(shown)]


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(tokens(a_path), tokens(b_path))


def _steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows with their texts, about a megabyte (or one row) at a time; null is as empty."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        texts = (x or "" for at in range(0, batch.num_rows, 256) for x in batch.slice(at, 256).column(column).to_pylist())
        start, held, size = 0, [], 0
        for row, text in enumerate(texts):
            held.append(text)
            size += len(text)
            if size >= _STEP_BYTES or row == batch.num_rows - 1:
                yield batch.slice(start, row + 1 - start), held
                start, held, size = row + 1, [], 0


def align_texts(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """Replace the text by ``a_ids, b_ids`` (arrays), ``a_group, b_group`` (tokens of each group) and ``groups_sha256``.

    The digest is of the groups written as ``a1,a2|b1;a3|b2,b3``. A text that is null or
    empty, or whose tokens of either side do not spell a space and the text, has empty
    arrays and the digest ``''``. A map over rows without a shuffle; other columns stay, but
    for clashing ones.
    """
    import hashlib

    df = replaced(df, "a_ids", "b_ids", "a_group", "b_group", "groups_sha256")
    kept = [f for f in df.schema.fields if f.name != text_col]
    ints = T.ArrayType(T.IntegerType())
    names = ("a_ids", "b_ids", "a_group", "b_group")
    schema = T.StructType([*kept, *(T.StructField(n, ints) for n in names), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch, texts in _steps(batches, text_col):
            found = own(texts)
            lists = []
            for k in range(4):
                stop = np.cumsum([0, *(len(f[k]) // 4 for f in found)]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(stop), pa.array(np.frombuffer(b"".join(f[k] for f in found), np.int32))))
            digests = [hashlib.sha256(f[4][:-1].encode()).hexdigest() if f[4] else "" for f in found]
            columns = [*(batch.column(f.name) for f in kept), *lists, pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *names, "groups_sha256"])

    return df.mapInArrow(run, schema)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy())


def _linked(batch: pa.RecordBatch, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Row and pair of every link of a batch of aligned texts."""
    (a_ids, a_sizes), (b_ids, _) = (_flat(batch.column(c)) for c in ("a_ids", "b_ids"))
    x, y = links(a, b, a_ids, b_ids)
    return np.repeat(np.arange(batch.num_rows), a_sizes)[x], a_ids[x] << _BITS | b_ids[y]


def _token_steps(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows of about so many tokens of A at a time."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        start, held = 0, 0
        for row, size in enumerate(np.diff(batch.column("a_ids").offsets.to_numpy()).tolist()):
            held += size
            if held >= most or row == batch.num_rows - 1:
                yield batch.slice(start, row + 1 - start)
                start, held = row + 1, 0


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``(pair, a_id, b_id, n, best)`` of every pair of linked ids: its links over all rows, and whether no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        aligner.cache_clear()  # a worker that has aligned texts needs what it remembers no more
        a, b = tokens(a_path), tokens(b_path)
        for part in _token_steps(batches):
            pairs, counts = np.unique(_linked(part, a, b)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], ["pair", "n"])

    counted = aligned.select("a_ids", "b_ids").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    one = counted.select(
        "pair", F.shiftright("pair", _BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << _BITS) - 1).cast("int").alias("b_id"), "n"
    )
    most = one.groupBy("b_id").agg(F.max("n").alias("most"))  # a row an id: not more than the vocabulary has
    return one.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame, row_col: str, a_path: str, b_path: str, sent: int = SENT_PAIRS) -> DataFrame:
    """``(row_col, n_links, n_best, count_sum)``: links of each row, those of a best pair, and the sum of their pairs' counts.

    ``row_col`` tells rows apart. The ``sent`` most frequent pairs are looked up in each
    task, links of all others are joined; the result does not depend on it. Rows without
    links have no row.
    """
    spark = aligned.sparkSession
    top = counts.orderBy(F.desc("n"), "pair").limit(sent).select("pair", "n", "best").collect() if sent else []
    top.sort()
    table = [np.array([r[i] for r in top], kind) for i, kind in enumerate((np.int64, np.int64, bool))]
    known = spark.sparkContext.broadcast(table)
    field = T.StructField("row", aligned.schema[row_col].dataType)
    longs = [T.StructField(n, T.LongType()) for n in ("pair", "n_links", "n_best", "count_sum")]

    def run(batches: Iterator[pa.RecordBatch], known: Broadcast) -> Iterable[pa.RecordBatch]:
        aligner.cache_clear()
        a, b = tokens(a_path), tokens(b_path)
        pairs, n, best = known.value
        for part in _token_steps(batches):
            rows, pair = _linked(part, a, b)
            place = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[place] == pair if len(pairs) else np.zeros(len(pair), bool)
            size, at = part.num_rows, rows[hit]
            sums = np.zeros(size, np.int64)
            np.add.at(sums, at, n[place[hit]])
            have = np.flatnonzero(np.bincount(at, minlength=size))
            columns = [np.bincount(at, minlength=size)[have], np.bincount(at, best[place[hit]], size).astype(np.int64)[have], sums[have]]
            none = pa.nulls(len(have), pa.int64())
            own = part.column(row_col)
            yield pa.RecordBatch.from_arrays([own.take(pa.array(have)), none, *map(pa.array, columns)], ["row", "pair", "n_links", "n_best", "count_sum"])
            order = np.lexsort((pair[~hit], rows[~hit]))
            rest_rows, rest = rows[~hit][order], pair[~hit][order]
            new = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (rest_rows[1:] != rest_rows[:-1])])) if len(rest) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(rest)))
            none = pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [own.take(pa.array(rest_rows[new])), pa.array(rest[new]), pa.array(times), none, none], ["row", "pair", "n_links", "n_best", "count_sum"]
            )

    found = aligned.select(row_col, "a_ids", "b_ids").mapInArrow(lambda b: run(b, known), T.StructType([field, *longs]))
    found, path = written(found, "link-scores")
    rare = found.where("pair IS NOT NULL").select("row", "pair", "n_links").join(counts.select("pair", "n", "best"), "pair")
    rare = rare.select("row", "n_links", F.when(F.col("best"), F.col("n_links")).otherwise(0).alias("n_best"), (F.col("n_links") * F.col("n")).alias("count_sum"))
    both = found.where("pair IS NULL").select("row", "n_links", "n_best", "count_sum").unionByName(rare)
    sums = both.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    out, _ = written(sums.withColumnRenamed("row", row_col), "link-sums")
    known.unpersist()
    discard(spark, path)
    return out
