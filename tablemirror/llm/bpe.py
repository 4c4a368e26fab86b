"""Byte-level BPE as a finite-state transducer, and streaming decode.

The merges are compiled into a transducer that is determinised as texts need it. A state
holds every way in which the bytes read last may still be cut: for each start of a token
that could yet be completed, the token before it and the bytes since. Reading a byte
extends the open tokens; of those that end here exactly one is what the merges give for
the bytes so far, which is decided by its left neighbour alone: a token may follow another
when merging the two tokens' bytes gives just these two. A token is certain once all ways
go back to it, so the lookahead never exceeds the longest token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablemirror.llm.chunks import ChunkMemo, Memo, held, text_batches, with_columns
from tablemirror.llm.common import replaced

#: Bytes of one piece after which certain tokens are emitted and their bytes forgotten.
FLUSH = 4096
#: A way is one number: the token before it in the upper bits, the beginning read in these lower ones.
_BITS = 24
_MASK = (1 << _BITS) - 1
#: A move is one number too: the state after it, 8 bits for the byte read next, the last token.
_STATE_AT = _BITS + 8
#: States kept before the transducer starts anew; bounds memory, not the results.
MOST_STATES = 150_000
#: A way with more tokens ahead is taken to have one that can end it; the results do not depend on it.
MOST_TRIED = 6


def read_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks by token, from lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class LazyTransducer:
    """Encodes pieces byte by byte; transitions are worked out on first use."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = MOST_STATES):
        if max(ranks.values(), default=0) >= _MASK:
            raise ValueError(f"ids must be below {_MASK}")
        self.ranks, self.most_states = ranks, most_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._grow_trie()
        self.halves = Memo(self._halves)
        self.alone = Memo(lambda token: self.merged(self.tokens[token])[0] == [token])
        self.follows = Memo(lambda pair: self._follows((pair >> _BITS) - 1, pair & _MASK))
        self.alive = Memo(self._alive)
        self._restart()

    def _grow_trie(self) -> None:
        """Numbered beginnings of tokens: the one a byte longer, length, and the token or -1; ``below`` and ``beside`` list the longer ones."""
        self.longer: dict[int, int] = {}  # by beginning and byte
        self.depth, self.token_at, self.below, self.beside = array("i", [0]), array("i", [-1]), array("i", [0]), array("i", [0])
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                step = self.longer.get(node << 8 | byte)
                if step is None:
                    step = self.longer[node << 8 | byte] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                    self.below.append(0)
                    self.beside.append(self.below[node])
                    self.below[node] = step
                node = step
            self.token_at[node] = rank
        self.ahead = array("i", bytes(4 * len(self.depth)))  # tokens that go on from a beginning
        for way, step in reversed(self.longer.items()):  # longer ones have higher numbers
            self.ahead[way >> 8] += self.ahead[step] + (self.token_at[step] >= 0)

    def _steps(self, node: int) -> Iterator[int]:
        """The beginnings one byte longer."""
        step = self.below[node]
        while step:
            yield step
            step = self.beside[step]

    def _restart(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.states: list[bytes] = []  # the ways of each, 64 bits a way
        self.moves: dict[int, int] = {}
        self._state([0])

    def _state(self, ways: list[int]) -> int:
        """Number of a state: for each start of a token, the token before it plus 1 (0: none) and the beginning read since."""
        key = array("Q", ways).tobytes()
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
        return found

    @property
    def ways(self) -> Iterator[array]:
        """The ways of all states."""
        return (array("Q", ways) for ways in self.states)

    def merged(self, piece: bytes) -> tuple[list[int], tuple[bytes, bytes] | None]:
        """Tokens of a short byte string by merging the lowest-ranked pair again and again, and the last pair merged."""
        parts, last, rank = [piece[i : i + 1] for i in range(len(piece))], None, self.ranks.get
        while len(parts) > 1:
            ranks = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            lowest = min(ranks)
            if lowest == 1 << 60:
                break
            at = ranks.index(lowest)
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [last[0] + last[1]]
        return [self.ranks[p] for p in parts], last

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that a token is merged from; None for a single byte."""
        pair = self.merged(self.tokens[token])[1]
        return pair and (self.ranks[pair[0]], self.ranks[pair[1]])

    def _follows(self, left: int, right: int) -> bool:
        """Whether the merges leave a boundary between two tokens' bytes (``left`` -1: before the second nothing).

        Goes back in time along the boundary: undoes the later merge beside it, and asks
        whether the two parts then in contact would have merged before that moment. Of two
        merges of one rank the left one comes first.
        """
        if left < 0 or not self.alone[right]:
            return self.alone[right]
        before = 1 << 60
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < before:
                return False
            of_left, of_right = self.halves[left], self.halves[right]
            if of_left and (left > right or not of_right):
                left, before = of_left[1], left
            elif of_right:
                right, before = of_right[0], right + 1
            else:
                return True

    def _alive(self, way: int) -> bool:
        """Whether what a way has begun can end as a longer token behind the token before it."""
        left, open_ = (way >> _BITS) - 1, list(self._steps(way & _MASK))
        for step in open_:
            token = self.token_at[step]
            if token >= 0 and self._follows(left, token):
                return True
            open_ += self._steps(step)
        return False

    def _move(self, state: int, byte: int) -> int:
        """The state after a byte, and the last token of what has been read; never 0, since a state after a byte knows a token."""
        ways, ended, longer, token_at, ahead, alive = [], -1, self.longer, self.token_at, self.ahead, self.alive
        for way in array("Q", self.states[state]):
            node = way & _MASK
            step = longer.get(node << 8 | byte)
            if step is None:
                continue
            left = way - node
            if ahead[step] > MOST_TRIED or ahead[step] and alive[left + step]:  # the others would only tell states apart
                ways.append(left + step)
            if ended < 0:
                token = token_at[step]
                if token >= 0 and self.follows[left + token]:
                    ended = token
        if ended < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        ways.append(ended + 1 << _BITS)
        move = self.moves[state << 8 | byte] = self._state(ways) << _STATE_AT | ended
        return move

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece (one match of the pre-tokenizer's pattern).

        The last token of every prefix is noted; a token is certain when all ways of the
        current state go back to it, which is at most the longest token away.
        """
        if len(self.states) > self.most_states:
            self._restart()
        out: list[int] = []
        last: list[int] = []
        move, known, note = 0, self.moves.get, last.append
        for byte in piece:
            move = known(move >> _BITS | byte) or self._move(move >> _STATE_AT, byte)
            note(move)
            if len(last) >= FLUSH:
                out += self._certain(last, move >> _STATE_AT)
        return out + self._back(last, len(last))

    def _back(self, last: list[int], end: int) -> list[int]:
        """The tokens up to ``end``, followed back from it by the moves that were noted."""
        found, tokens = [], self.tokens
        while end > 0:
            token = last[end - 1] & _MASK
            found.append(token)
            end -= len(tokens[token])
        found.reverse()
        return found

    def _certain(self, last: list[int], state: int) -> list[int]:
        """Emit the tokens that all ways of a state share, and forget the bytes they cover."""
        ends = {len(last) - self.depth[way & _MASK] for way in array("Q", self.states[state])}
        while len(ends) > 1:  # step back from the furthest end until the ways meet
            furthest = max(ends)
            ends.remove(furthest)
            ends.add(furthest - len(self.tokens[last[furthest - 1] & _MASK]))
        meet = ends.pop()
        found = self._back(last, meet)
        del last[:meet]
        return found


#: Pieces and chunks of one generation that an encoder remembers.
MEMO_PIECES = 120_000


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks_path: str, pattern: str):
        self.transducer = LazyTransducer(read_ranks(ranks_path))
        # \s as the tokenizer's regex engine has it: the White_Space property, without U+001C to U+001F
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.letters_stay = all(self.pattern.findall(w) == [w] for w in (" word", "word", " Été", "日本"))
        self.piece = Memo(self._piece, MEMO_PIECES)
        self.text = ChunkMemo(self._chunk, entries=MEMO_PIECES)

    def _piece(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        return pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if self.letters_stay and chunk[chunk[:1] == " " :].isalpha():  # one run of letters is one piece
            return self._piece(chunk)
        out = []
        for piece in self.pattern.findall(chunk):
            word = piece[1:]
            known = self.letters_stay and piece[0] == " " and word.isalpha()
            out.append(self.text.spaced[word] if known else self.piece[piece])
        return b"".join(out)


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes arrive in any cuts, text leaves in whole characters.

    The state is the bytes of a character that has begun and not ended: at most three.
    Bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue  # a continuation byte: look further back for its lead
            needs = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
            if needs > back and lead < 0xF5:
                cut = len(data) - back
            break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


def decoded(ids: bytes, tokens: dict[int, bytes], at_once: int = 1 << 16) -> str:
    """Text of ids, decoded as a stream of ``at_once`` ids at a time."""
    stream, numbers, out = Utf8Stream(), np.frombuffer(ids, "<u4"), []
    for at in range(0, len(numbers), at_once):
        out.append(stream.feed(b"".join(map(tokens.__getitem__, numbers[at : at + at_once].tolist()))))
    out.append(stream.end())
    return "".join(out)


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder a worker, kept between tasks until another operator runs there."""
    return held(("bpe", ranks_path, pattern), lambda: Encoder(ranks_path, pattern))


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """Replace the text column by ``token_ids`` (binary, little-endian unsigned 32-bit).

    With ``decode`` also ``decoded``: the text that streaming decode gives for the ids. A
    map over rows without a shuffle; null and empty texts have no ids. The other columns
    stay, but for clashing ones. ``ranks_path`` is read on the executors.
    """
    df = replaced(df, "token_ids", "decoded")
    fields = [f for f in df.schema.fields if f.name != text_col] + [T.StructField("token_ids", T.BinaryType())]
    if decode:
        fields.append(T.StructField("decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        for batch, texts in text_batches(batches, text_col):
            ids = [own.text(t) for t in texts]
            more = {"token_ids": pa.array(ids, pa.binary())}
            if decode:
                more["decoded"] = pa.array([decoded(x, own.transducer.tokens) for x in ids], pa.string())
            yield with_columns(batch, text_col, **more)

    return df.mapInArrow(run, T.StructType(fields))
