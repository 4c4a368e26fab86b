"""Exact token counts at every prefix, for a BPE whose words end in a marker.

Two tables are filled by dynamic programming. Inside a word, the last token of every
prefix of the word is found from the last tokens of shorter prefixes, once for prefixes
that go on and once for prefixes that end there (whose last token carries the end-of-word
marker); a token may follow another when the merges leave a boundary between them. Over
the text, counts add up at the spaces. So "how many tokens has this prefix" and "how long
may a prefix be for this budget" are lookups; nothing is encoded again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.llm.chunks import Memo, byte_letters, text_batches, with_columns
from tablemirror.llm.common import replaced

_BLANKS = re.compile(r"[\x09-\x0D\x20]+")
_SOLID = re.compile(r"[^\x09-\x0D\x20]+")
#: Chunks whose normal form is their lower case: printable ASCII and Latin letters up to U+024F.
_PLAIN = re.compile(r"[!-~¡-¬®-ɏ]+")


class WordPrefixes:
    """Token counts of every prefix of a word, by the merges of a tokenizer file."""

    def __init__(self, model: dict, suffix: str):
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.vocab, self.suffix = model["vocab"], suffix
        self.longest = max(len(t) - (len(suffix) if t.endswith(suffix) else 0) for t in self.vocab)
        self.letters = byte_letters()
        self.stands = Memo(lambda key: self.merged(*key) == 1)
        self.follows = Memo(lambda key: self.merged(key[0] + key[1], key[2], len(key[0])) == 2)

    def merged(self, letters: str, final: bool, boundary: int = 0) -> int:
        """Tokens that plain merging gives; 0 if ``boundary`` is not where one of them ends."""
        parts = list(letters)
        if final:
            parts[-1] += self.suffix
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, 1 << 60) for pair in zip(parts, parts[1:], strict=False)]
            lowest = min(ranks)
            if lowest == 1 << 60:
                break
            at = ranks.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts) if not boundary or len(parts[0]) == boundary else 0

    def counts(self, word: str) -> list[int]:
        """Token count of each non-empty prefix of the word's bytes, read as a whole word."""
        text = "".join(map(self.letters.__getitem__, word.encode()))
        last, going, ending = [""], [0], []
        for end in range(1, len(text) + 1):
            open_token, closed = None, None
            for start in range(max(0, end - self.longest), end):
                token, left = text[start:end], last[start]
                if start and not left:
                    continue
                if open_token is None and token in self.vocab and (self.follows[left, token, False] if start else self.stands[token, False]):
                    open_token = token, going[start] + 1
                if closed is None and token + self.suffix in self.vocab and (self.follows[left, token, True] if start else self.stands[token, True]):
                    closed = going[start] + 1
                if open_token and closed:
                    break
            last.append(open_token[0] if open_token else "")
            going.append(open_token[1] if open_token else 0)
            ending.append(closed)
        return ending


class PrefixCounter:
    """Counts for texts, with the tokenizer's own handling of what is not plain."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as file:
            settings = json.load(file)
        self.special = [t["content"] for t in settings["added_tokens"]]
        self.words = WordPrefixes(settings["model"], settings["model"]["end_of_word_suffix"])
        split = next(p for p in settings["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.word = Memo(lambda word: self.words.counts(word)[-1])
        self.chunk = Memo(self._chunk)

    def _chunk(self, chunk: str) -> int:
        total = 0
        for part in _BLANKS.split(chunk):
            if not part:
                continue
            if _PLAIN.fullmatch(part) and not any(s in part for s in self.special):
                total += sum(map(self.word.__getitem__, self.pattern.findall(part.lower())))
            else:  # other scripts and special strings: as the library normalises and splits them
                total += len(self.library.encode(part, add_special_tokens=False).ids)
        return total

    def prefixes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends (in characters) of the prefixes that stop before a space or at the end, and their token counts."""
        parts = text.split(" ")
        ends = np.fromiter(map(len, parts), np.int32, len(parts)).cumsum(dtype=np.int32)
        ends += np.arange(len(parts), dtype=np.int32)
        return ends, np.fromiter(map(self.chunk.__getitem__, parts), np.int32, len(parts)).cumsum(dtype=np.int32)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Length of the longest prefix with at most ``budget`` tokens, to the character.

        The space-bounded prefixes narrow it to one chunk, whose own prefix counts decide.
        """
        ends, counts = self.prefixes(text)
        fits = bisect_right(counts, budget)
        if fits == len(counts):
            return len(text)
        start = int(ends[fits - 1]) if fits else 0
        used = int(counts[fits - 1]) if fits else 0
        best = start + self._within(text[start : int(ends[fits])], budget - used)
        while best < len(text) and text[best].isspace():  # blanks cost nothing
            best += 1
        return best

    def _within(self, chunk: str, budget: int) -> int:
        """The same inside one chunk, from the stored counts of its words' prefixes."""
        begin = 0
        for match in _SOLID.finditer(chunk):  # counts add up at white space, so it narrows the chunk to one run
            count = self.chunk[match.group()]
            if count > budget:
                return max(begin, match.start() + self._within_run(match.group(), budget))
            budget, begin = budget - count, match.end()
        return len(chunk)

    def _within_run(self, chunk: str, budget: int) -> int:
        if not _PLAIN.fullmatch(chunk.strip()) or any(s in chunk for s in self.special):
            fits = (n for n in range(len(chunk), 0, -1) if self._chunk(chunk[:n]) <= budget)
            return next(fits, 0)
        best = 0
        for match in self.pattern.finditer(chunk.lower()):
            counts = self.words.counts(match.group())
            sizes = np.cumsum([len(c.encode()) for c in match.group()])
            for n, size in enumerate(sizes, 1):
                if counts[size - 1] is not None and counts[size - 1] <= budget:
                    best = max(best, match.start() + n)
            budget -= counts[-1]
            if budget < 0:
                break
        return best


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(tokenizer_path: str) -> PrefixCounter:
    if tokenizer_path not in _COUNTERS:
        _COUNTERS[tokenizer_path] = PrefixCounter(tokenizer_path)
    return _COUNTERS[tokenizer_path]


def prefix_counts(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Replace the text by ``prefix_ends`` and ``prefix_tokens``: arrays over its space-bounded prefixes.

    A map over rows without a shuffle. A null or empty text has the one prefix of length 0
    with 0 tokens. Other columns stay, but for clashing ones.
    """
    df = replaced(df, "prefix_ends", "prefix_tokens")
    ints = T.ArrayType(T.IntegerType())
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("prefix_ends", ints), T.StructField("prefix_tokens", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for batch, texts in text_batches(batches, text_col):
            pairs = [own.prefixes(t) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(e) for e, _ in pairs])]).astype(np.int32)
            ends, counts = (pa.ListArray.from_arrays(offsets, np.concatenate([p[i] for p in pairs])) for i in (0, 1))
            yield with_columns(batch, text_col, prefix_ends=ends, prefix_tokens=counts)

    return df.mapInArrow(run, schema)


def with_longest_prefix(df: DataFrame, tokenizer_path: str, budget_col: str, text_col: str = "text", out: str = "prefix_chars") -> DataFrame:
    """Add the characters of the longest prefix of at most ``budget_col`` tokens: where to truncate, to the character.

    Unlike ``chars_within`` it also cuts texts without spaces. A null budget gives null, a
    null text 0.
    """
    df = replaced(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for batch, texts in text_batches(batches, text_col):
            budgets = batch.column(budget_col).to_pylist()
            found = [None if b is None else own.longest_prefix(t, b) for t, b in zip(texts, budgets, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def total_tokens(tokens: str = "prefix_tokens") -> Column:
    return F.element_at(tokens, -1).cast("long")


def tokens_within(length: int, ends: str = "prefix_ends", tokens: str = "prefix_tokens") -> Column:
    """Tokens of the longest stored prefix of at most ``length`` characters."""
    fits = F.size(F.filter(F.col(ends), lambda e: e <= length))
    return F.when(fits > 0, F.element_at(tokens, F.greatest(fits, F.lit(1)))).otherwise(0).cast("long")


def chars_within(budget: int, ends: str = "prefix_ends", tokens: str = "prefix_tokens") -> Column:
    """Characters of the longest stored prefix of at most ``budget`` tokens: where to truncate."""
    fits = F.size(F.filter(F.col(tokens), lambda t: t <= budget))
    return F.when(fits > 0, F.element_at(ends, F.greatest(fits, F.lit(1)))).otherwise(0).cast("long")
