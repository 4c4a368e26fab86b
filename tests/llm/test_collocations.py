"""Phrases and their scores against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemirror.llm import collocations as C

BREAK, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows: list[tuple]) -> dict[tuple, int]:
    found = Counter()
    for lang, text in rows:
        lang = lang or "und"
        found[lang, 0, ""] += 0
        for piece in BREAK.split((text or "").translate(LOWER)):
            words = WORD.findall(piece)
            found[lang, 0, ""] += len(words)
            for k in range(1, 6):
                found.update((lang, k, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    return found


def best(counts: dict[tuple, int], least: int, top: int, cover: int) -> list[tuple]:
    f = {(lang, p): n for (lang, k, p), n in counts.items() if k and n >= least}
    found = []
    for (lang, phrase), a in f.items():
        words = phrase.split(" ")
        if len(words) == 1:
            continue
        n, cuts = counts[lang, 0, ""], []
        for k in range(1, len(words)):
            left, right = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1000 * a * n // (left * right), k, left, right))
        inside = any(o == lang and f" {phrase} " in f" {q} " and q != phrase and 100 * b >= cover * a for (o, q), b in f.items())
        if not inside:
            score, _, left, right = min(cuts)
            found.append((lang, phrase, a, left, right, n, score))
    out = []
    for lang in sorted({r[0] for r in found}):
        mine = sorted((r for r in found if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return out


def texts(rng: random.Random) -> list[tuple]:
    words = [f"w{i}" for i in range(12)] + ["ÉÀ", "naïve", "New", "York", "日本", "x y"]
    rows = []
    for _ in range(400):
        body = [rng.choice(words) for _ in range(rng.randrange(40))]
        if rng.random() < 0.6:
            at = rng.randrange(len(body) + 1)
            body[at:at] = ["In", "the", "middle", "of", "nowhere"][: rng.randrange(2, 6)]
        gaps = [rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "; ", " ! "]) for _ in body]
        rows.append((rng.choice(["en", "fr", None]), "".join(w + g for w, g in zip(body, gaps, strict=True))))
    return rows + [("en", None), (None, ""), ("xx", " \t . "), ("de", "a " * 3000), ("en", "y" * 50_000)]


@pytest.mark.parametrize("sample", [1.0, 0.1, 1e-9])
def test_all_frequent_phrases_are_counted(spark, sample):
    rows = texts(random.Random(11))
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"key": F.lit(1), "n": F.lit("own")}).repartition(5)
    phrases = C.frequent_phrases(df, 20, sample=sample)
    counts = counted(rows)
    assert {(r["lang"], r["words"], r["phrase"]): r["f"] for r in phrases.collect()} == {k: n for k, n in counts.items() if n >= 20 or k[1] == 0}
    for top, cover in ((7, 100), (1000, 60)):
        found = sorted(tuple(r) for r in C.collocations(phrases, top, cover).collect())
        assert found == sorted(best(counts, 20, top, cover))


def test_no_rows(spark):
    phrases = C.frequent_phrases(spark.createDataFrame([], "lang string, text string"), 2)
    assert phrases.count() == 0 and C.collocations(phrases, 10).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [("en", 0, "", 4 * 10**12), ("en", 1, "a", 3 * 10**12), ("en", 1, "b", 2 * 10**12), ("en", 2, "a b", 10**12)]
    phrases = spark.createDataFrame([(*r, 0) for r in rows], "lang string, words int, phrase string, f bigint, key bigint")
    (row,) = C.collocations(phrases, 5).collect()
    assert row["score"] == 1000 * 10**12 * 4 * 10**12 // (3 * 10**12 * 2 * 10**12)


def test_proposals_only_grow():
    rng = np.random.default_rng(1)
    probe, held, own = rng.integers(0, 2**63, 200_000).astype(np.uint64), None, C.Proposals()
    for n in (0, 100, 20, 5_000, 300):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        full = np.zeros(C.PLACES // 8, np.uint8)
        place = (keys & np.uint64(C.PLACES - 1)).astype(np.int64)
        np.bitwise_or.at(full, place >> 3, (1 << (place & 7)).astype(np.uint8))
        own = own.more(full)
        assert own.holds(keys).all() and (held is None or own.holds(probe)[held].all())
        held = own.holds(probe)
        assert held.mean() < 0.04


def test_passes_count_every_candidate_once():
    """Also where bitmaps hold much that was not put in."""

    class Sent:
        def __init__(self, bits):
            self.value = C.Proposals(bits)

    rng = np.random.default_rng(6)
    text = " ".join(f"w{i}" for i in rng.integers(0, 40, 3000)).encode()
    step = C.Words([text, b"w1 w2. w3", b""], ["en", "fr", "en"])
    bits, sent = np.zeros(1024, np.uint8), []
    for _ in range(4):
        bits = bits | rng.integers(0, 256, 1024).astype(np.uint8) & rng.integers(0, 256, 1024).astype(np.uint8)
        sent.append(Sent(bits.copy()))
    counted = Counter()
    for new, old in zip(sent, [None, *sent], strict=False):
        counted.update((w, int(i)) for w, at, _ in C._uncounted(step, new, old) for i in at)
    assert set(counted.values()) == {1}
    assert set(counted) == {(w, int(i)) for w, at, _ in C._uncounted(step, sent[-1], None) for i in at}


def test_two_phrases_with_one_key():
    keys, second = np.array([5, 9, 5, 5, 9], np.uint64), np.array([1, 4, 2, 1, 4], np.uint64)
    which, counts = C._counted(keys, second)
    assert sorted((keys[i], second[i], n) for i, n in zip(which, counts, strict=True)) == [(5, 1, 2), (5, 2, 1), (9, 4, 2)]
