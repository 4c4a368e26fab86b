"""Phrases that stand together more often than their parts, mined by Toivonen's method.

A sample proposes phrases: those that are frequent in it at a lowered threshold. A full
pass then counts, exactly and at once, the proposals and their negative border, that is
every phrase whose two longest parts (without its last and without its first word) are
proposals. A border phrase that turns out frequent is a failure of the sample: longer
phrases may hang on it. Failures join the proposals, and a further pass counts what the
border has gained, until no pass finds another failure. A part of a phrase is at least as
frequent as the phrase, so nothing frequent is outside then.

Proposals travel as a bitmap of a fixed size (``PLACES`` bits). A place that two phrases
share only lets a phrase be counted that need not be; more proposals make the bitmap
fuller and the passes count more, and the counts are exact at every fill.

A pass reads the texts twice. First the 64-bit keys of its phrases are counted, which screens
out nearly all of the border; then what the screen leaves, among it everything frequent, is
counted by its words. There, inside a task, phrases are told apart by two 64-bit hashes,
between tasks by their words, so a key that two phrases share costs nothing but work.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.llm.common import written

#: Fixed values of the task: pieces end at these bytes, and words at these.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Words of the longest phrase.
MOST_WORDS = 5
#: Share of the documents that propose, and how far the threshold is lowered for it.
SAMPLE, LOWERED = 1 / 16, 0.5
#: Most places of the bitmap of proposals, 16 MB whatever the number of proposals, and the places a proposal has in a smaller one.
PLACES, SPARSE, _PART = 1 << 27, 64, 1 << 15
#: Text that a task takes apart at a time, and keys whose counts it holds before it passes them on.
_STEP_BYTES, _HELD_KEYS = 2 << 20, 2_000_000

_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t", bytes(range(97, 123)) + b" ")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, start: int) -> np.ndarray:
    return _mixed(np.arange(start + 1, start + n + 1, dtype=np.uint64) * _GOLDEN)


_IS_BREAK, _IS_SOLID = np.zeros(256, bool), np.ones(256, bool)
_IS_BREAK[list(BREAKS)] = True
_IS_SOLID[list(BREAKS + BLANKS)] = False
#: The bytes of a little-endian 64-bit number that belong to a word of so many bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_WEIGHTS = [_numbers(MOST_WORDS, 1000 + 100 * k) | np.uint64(1) for k in (0, 1)]
_SALTS = _numbers(MOST_WORDS + 1, 2000)


class Words:
    """The words of some texts: where each stands, its piece, its language, and two hashes of each."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        self.data = b"\n".join(texts).translate(_LOWER)
        letters = np.frombuffer(self.data + bytes(8), np.uint8)
        solid = np.zeros(len(self.data) + 2, bool)
        solid[1:-1] = _IS_SOLID[letters[:-8]]
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.lengths = self.ends - self.starts
        self.n = len(self.starts)
        self.piece = np.cumsum(_IS_BREAK[letters], dtype=np.int32)[self.starts]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(self.starts, begins)
        self.names = sorted(set(langs))
        place = {name: i for i, name in enumerate(self.names)}
        self.lang = np.repeat(np.array([place[x] for x in langs], np.int32), np.diff(first))
        salts = np.array([xxhash.xxh64_intdigest(x) for x in self.names], np.uint64)[self.lang] + self.lengths.astype(np.uint64)
        self.word = self._hashes(letters, salts)

    def _hashes(self, letters: np.ndarray, salts: np.ndarray) -> list[np.ndarray]:
        """Both hashes, from eight bytes of the words at a time."""
        eight = np.ndarray(len(letters) - 7, "<u8", letters, strides=(1,))
        found, at, left = [_mixed(salts), _mixed(salts ^ _GOLDEN)], np.arange(self.n), self.lengths
        start = self.starts
        while len(at):
            bytes_ = eight[start] & _MASKS[np.minimum(left, 8)]
            for k, factor in ((0, _MIX1), (1, _MIX2)):
                found[k][at] = _mixed((found[k][at] ^ bytes_) * factor + _GOLDEN)
            more = np.flatnonzero(left > 8)
            at, start, left = at[more], start[more] + 8, left[more] - 8
        return found

    def phrases(self, words: int, parts: np.ndarray | None = None) -> np.ndarray:
        """First words of the phrases of so many words inside one piece; if ``parts`` is given, of those whose two parts, one word shorter, it holds."""
        if self.n < words:
            return np.zeros(0, np.int64)
        last = self.n - words + 1
        inside = self.piece[:last] == self.piece[words - 1 :]
        return np.flatnonzero(inside if parts is None else inside & parts[:last] & parts[1 : last + 1])

    def keys(self, at: np.ndarray, words: int, k: int = 0) -> np.ndarray:
        """Hash of the phrase of so many words at each place; the language is part of it."""
        total = np.full(len(at), _SALTS[words], np.uint64)
        for i in range(words):
            total += self.word[k][at + i] * _WEIGHTS[k][i]
        return _mixed(total)

    def flags(self, at: np.ndarray) -> np.ndarray:
        """True at these places."""
        found = np.zeros(self.n, bool)
        found[at] = True
        return found

    def text(self, at: np.ndarray, words: int) -> list[bytes]:
        last = at + words - 1
        one_blank = self.ends[last] - self.starts[at] == self._length_sums[last + 1] - self._length_sums[at] + words - 1
        found = [self.data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[last].tolist(), strict=True)]
        for i in np.flatnonzero(~one_blank).tolist():
            found[i] = b" ".join(w for w in found[i].split(b" ") if w)
        return found

    @property
    def _length_sums(self) -> np.ndarray:
        if not hasattr(self, "_sums"):
            self._sums = np.concatenate([[0], np.cumsum(self.lengths)])
        return self._sums


def _counted(keys: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first of each distinct (key, second key), and how many there are."""
    order = np.argsort(keys, kind="stable")
    sorted_keys, sorted_second = keys[order], second[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    if (~new[1:] & (sorted_second[1:] != sorted_second[:-1])).any():  # two phrases with one key
        order = np.lexsort((second, keys))
        sorted_keys, sorted_second = keys[order], second[order]
        new[1:] = (sorted_keys[1:] != sorted_keys[:-1]) | (sorted_second[1:] != sorted_second[:-1])
    begins = np.flatnonzero(new)
    return order[begins], np.diff(np.append(begins, len(keys)))


class Proposals:
    """A set of phrase keys as bits; it may say that it holds a key which was not put in.

    The bitmap has as many places as its keys call for, and grows with them. A larger one
    holds all that the smaller one did, also what was not put in: what a pass has counted
    as a part stays one in the passes after it.
    """

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1024, np.uint8) if bits is None else bits

    def more(self, keys: np.ndarray) -> Proposals:
        """This set and the keys of a bitmap of all places."""
        wanted = SPARSE * int(np.bitwise_count(keys).sum() + np.bitwise_count(self.bits).sum())
        size = len(self.bits)
        while 8 * size < wanted and size < len(keys):
            size *= 2
        return Proposals(np.tile(self.bits, size // len(self.bits)) | np.bitwise_or.reduce(keys.reshape(-1, size)))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bits(keys: DataFrame) -> np.ndarray:
    """Bitmap of the ``key`` column: at most 16 MB reach the driver."""
    place = F.pmod("key", F.lit(PLACES))
    parts = keys.select(place.alias("place")).groupBy((F.col("place") / _PART).cast("long").alias("part"))
    found = np.zeros(PLACES // 8, np.uint8)
    for row in parts.agg(F.bitmap_construct_agg(F.pmod("place", F.lit(_PART)).cast("long")).alias("bits")).collect():
        at = row["part"] * (_PART // 8)
        found[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return found


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of the rows, some megabytes of text at a time."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                texts.append(text)
                langs.append(lang)
                size += len(text)
                if size >= _STEP_BYTES:
                    yield Words(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs)


def _proposed(rows: DataFrame, least: int) -> np.ndarray:
    """Keys of phrases that occur so often in the sample, as bits: words and pairs first, then what consists of found pairs."""

    def count(batches: Iterator[pa.RecordBatch], sizes: range, pairs: Broadcast | None) -> Iterable[pa.RecordBatch]:
        for step in _steps(batches):
            parts = None
            if pairs is not None:
                at = step.phrases(2)
                parts = step.flags(at[pairs.value.holds(step.keys(at, 2))])
            for words in sizes:
                at = step.phrases(words, parts)
                parts = step.flags(at)
                yield _key_batch(*np.unique(step.keys(at, words), return_counts=True))

    def often(sizes: range, pairs: Broadcast | None = None) -> np.ndarray:
        counts = rows.mapInArrow(lambda batches: count(batches, sizes, pairs), "key bigint, n bigint")
        return _bits(counts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))

    short = often(range(1, 3))
    sent = rows.sparkSession.sparkContext.broadcast(Proposals().more(short))
    found = short | often(range(3, MOST_WORDS), sent)
    sent.destroy()
    return found


def frequent_phrases(df: DataFrame, min_count: int, text_col: str = "text", lang_col: str = "lang", sample: float = SAMPLE) -> DataFrame:
    """``(lang, words, phrase, f, key)``: every phrase of 1 to 5 words with ``f >= min_count`` occurrences in its language.

    A row of 0 words and an empty phrase a language has its number of words, which is 0 for
    a language whose texts have none. Texts are lower-cased (A-Z), cut into pieces and
    words; occurrences overlap and do not cross pieces or documents. A null text is empty,
    a null language ``und``; other columns are not looked at, and ids not needed.

    ``sample`` is the share of rows that proposes. It decides how many passes are needed
    and nothing else: an empty sample or one without a frequent phrase costs up to four
    passes more.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    least = max(1, int(min_count * sample * LOWERED))
    now, found = Proposals().more(_proposed(rows.sample(sample, seed=7), least)), []
    schema = "lang string, words int, phrase string, n bigint, key bigint"

    def screen(batches: Iterator[pa.RecordBatch], new: Broadcast, old: Broadcast | None) -> Iterable[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for step in _steps(batches):
            held += [np.unique(keys, return_counts=True) for _, _, keys in _uncounted(step, new, old)]
            if sum(len(k) for k, _ in held) >= _HELD_KEYS:
                held = [_summed(held)]
                if len(held[0][0]) >= _HELD_KEYS // 2:  # little came together: the shuffle does the rest
                    yield _key_batch(*held.pop())
        if held:
            yield _key_batch(*_summed(held))

    def count(batches: Iterator[pa.RecordBatch], new: Broadcast, old: Broadcast | None, screened: Broadcast) -> Iterable[pa.RecordBatch]:
        for step in _steps(batches):
            if old is None:
                counts = np.bincount(step.lang, minlength=len(step.names))
                none = [0] * len(step.names)
                yield _batch(step.names, none, [""] * len(step.names), counts, none)
            for words, at, keys in _uncounted(step, new, old):
                take = screened.value.holds(keys)
                at, keys = at[take], keys[take]
                if len(at):
                    which, counts = _counted(keys, step.keys(at, words, 1))
                    names = pa.array(step.names, pa.string()).take(pa.array(step.lang[at[which]]))
                    text = pa.array(step.text(at[which], words), pa.binary()).cast(pa.string())
                    yield _batch(names, [words] * len(which), text, counts, keys[which].view(np.int64))

    def failed(batches: Iterator[pa.RecordBatch], new: Broadcast) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[~new.value.holds(keys.view(np.uint64))])], ["key"])

    send, new, old = spark.sparkContext.broadcast, None, None
    while True:
        old, new = new, send(now)
        sums = rows.mapInArrow(lambda batches, new=new, old=old: screen(batches, new, old), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        screened = send(Proposals().more(_bits(sums.where(F.col("n") >= min_count).select("key"))))
        counts = rows.mapInArrow(lambda batches, new=new, old=old, screened=screened: count(batches, new, old, screened), schema)
        whole = counts.groupBy("lang", "words", "phrase", "key").agg(F.sum("n").alias("f"))
        kept, _ = written(whole.where((F.col("f") >= min_count) | (F.col("words") == 0)), "phrases")
        found.append(kept)
        shorter = kept.where(F.col("words").between(1, MOST_WORDS - 1)).select("key")
        gained = _bits(shorter.mapInArrow(lambda batches, new=new: failed(batches, new), "key bigint"))
        for sent in [screened, *([old] if old is not None else [])]:
            sent.destroy()
        if not gained.any():
            new.destroy()
            return reduce(DataFrame.union, found).select("lang", "words", "phrase", "f", "key")
        now = now.more(gained)


def _uncounted(step: Words, new: Broadcast, old: Broadcast | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, places, keys)`` of the phrases that are proposals or in their border, but not in those of an earlier pass.

    The first pass has all words, of which the border of single words consists.
    """
    at, counted = step.phrases(1), None
    for words in range(1, MOST_WORDS + 1):
        keys = step.keys(at, words)
        if old is None:
            yield words, at, keys
        elif words > 1:
            fresh = np.flatnonzero(~counted[at])
            yield words, at[fresh], keys[fresh]
        if old is not None:  # what its parts made a candidate in the pass before, and them theirs
            held = old.value.holds(keys)
            before = step.flags(at[held if counted is None else held & counted[at]])
            counted = np.append(before[:-1] & before[1:], False)
        at = step.phrases(words + 1, step.flags(at[new.value.holds(keys)]))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[order][begins], np.add.reduceat(counts[order], begins) if len(keys) else counts


def _key_batch(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["key", "n"])


def _batch(lang: list | pa.Array, words: list, phrase: list | pa.Array, n: np.ndarray, key: list | np.ndarray) -> pa.RecordBatch:
    texts = [pa.array(x, pa.string()) if isinstance(x, list) else x for x in (lang, phrase)]
    columns = [texts[0], pa.array(words, pa.int32()), texts[1]]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(key, pa.int64())], ["lang", "words", "phrase", "n", "key"])


def collocations(phrases: DataFrame, top: int, cover_percent: int = 100) -> DataFrame:
    """The ``top`` phrases of each language by their weakest cut: ``lang, rank, phrase, a, l, r, n, score``.

    ``phrases`` is what ``frequent_phrases`` gives. A cut of a phrase with ``a`` occurrences
    into parts with ``l`` and ``r`` scores ``floor(1000 * a * n / (l * r))``, in decimals of
    38 digits; the least score counts, of equal ones the earliest cut. A phrase inside a
    longer one that is at least ``cover_percent`` percent as frequent is left out.
    """
    one = phrases.select("lang", "words", "phrase", F.col("f").alias("a"))
    some = one.where("words > 1")
    cuts = some.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("first", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))
    first = one.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rest = one.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    totals = one.where("words = 0").groupBy("lang").agg(F.sum("a").alias("n"))
    scored = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(1000 * cast(a AS decimal(19, 0)) * cast(n AS decimal(15, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(18, 0)))")
    weakest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("weakest")
    weakest_cuts = scored.groupBy("lang", "words", "phrase", "a", "n").agg(weakest)

    parts = F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    inside = some.where("words > 2").select("lang", "a", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    apart = weakest_cuts.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(21,0)") * 100 < F.col("a").cast("decimal(21,0)") * cover_percent)
    )
    order = Window.partitionBy("lang").orderBy(F.desc("weakest.score"), F.desc("a"), "phrase")
    ranked = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "weakest.l", "weakest.r", "n", "weakest.score")
