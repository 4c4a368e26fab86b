"""Repeated passages against plain counting of windows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemirror.llm import repeats as R


def plain(texts: list[str | None], depth: int) -> list[tuple[list[tuple], bytes]]:
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + depth] for t in data for i in range(len(t) - depth + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if count[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\x01" * depth
        edges = np.flatnonzero(np.diff(np.frombuffer(b"\0" + bytes(gone) + b"\0", np.uint8).astype(int)))
        out.append((list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def some_texts(rng: random.Random, depth: int) -> list[str | None]:
    letters = "abcdé日 "
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common, texts = make(3 * depth), []
    for _ in range(60):
        text = make(rng.randrange(6 * depth))
        if rng.random() < 0.5:  # a piece of a common passage, of any length
            a = rng.randrange(len(common))
            at = rng.randrange(len(text) + 1)
            text = text[:at] + common[a : a + rng.randrange(2 * depth)] + text[at:]
        texts.append(text)
    for _ in range(25):  # near copies: one letter changed
        t = rng.choice(texts[:60])
        at = rng.randrange(len(t) + 1)
        texts.append(t[:at] + "#" + t[at + 1 :])
    texts += [texts[3], texts[3], texts[5] + "!", None, "", "short", "x" * (5 * depth), "xy" * (2 * depth), "x" * depth, make(2 * depth) * 2, common]
    return texts


@pytest.mark.parametrize("depth", [1, 5, 16, 120])
def test_spans_and_kept_bytes(spark, depth):
    texts = some_texts(random.Random(depth), depth)
    rows = [(None if i % 9 == 0 else i // 2, t, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept_bytes string").withColumns({"key": F.lit(1), "n": F.monotonically_increasing_id()})
    out = R.remove_repeats(df.repartition(4), depth)
    assert out.columns == ["doc_id", "text", "key", "n", "repeat_spans", "kept_bytes"]
    wanted = dict(zip(texts, plain(texts, depth), strict=True))
    found = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter(r[:2] for r in rows)
    for r in found:
        assert ([tuple(s) for s in r["repeat_spans"]], bytes(r["kept_bytes"])) == wanted[r["text"]], r["text"]


def test_no_rows_and_no_repeats(spark):
    empty = spark.createDataFrame([], "text string")
    assert R.repeated_spans(empty).count() == 0 and R.remove_repeats(empty).count() == 0
    assert R.repeated_spans(spark.createDataFrame([("a" * 399,), ("a" * 399,), (None,)], "text string")).count() == 0
    assert [tuple(map(tuple, r["spans"])) for r in R.repeated_spans(spark.createDataFrame([("a" * 401,)], "text string")).collect()] == [((0, 401),)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_texts_")]


def test_anchors_cover_every_suffix_once():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (50, 51, 70, 400)] + [b"a" * 90]
    owner, _, at, low, high = R.anchors(texts, 50)
    for i, t in enumerate(texts):
        mine = owner == i
        places = [p for a, x, y in zip(at[mine], low[mine], high[mine], strict=True) for p in range(a - y, a - x + 1)]
        assert sorted(places) == list(range(len(t) - 49))
    least = R._least(np.array([5, 3, 9, 1, 7, 7, 2], np.uint64), 3)
    assert least.tolist() == [3, 1, 1, 1, 2]
