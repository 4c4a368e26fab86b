"""Groups and links of two tokenizers against a plain walk over their bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemirror.llm import alignment as A
from tablemirror.llm import queries as Q

P = pytest.importorskip("public_tokenizers")
PATHS = Q.vocabulary("byte_bpe_50k.json"), Q.vocabulary("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "x\n\ny \n z", "▁x", "tab\tsep", "naïve café", "日本語のテキスト and English", "é́ ß 😀👍🏽", "<|endoftext|> <s> </s>",
    "\x00nul", "x" * 3000, "word " * 3000, "ab" * 2000, "don't can't I'll THE END!!! ... 1234567 3.14", "a b c", "ﬁ ligature",
]


def plain(texts: list[str | None]) -> list[dict]:
    """By the libraries themselves and a byte-by-byte walk."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(PATHS[0])
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    shown = {x: b for b, x in enumerate(A.byte_letters())}
    found, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            got = a_lib.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(shown[x] for x in t)) for i, t in zip(got.ids, got.tokens, strict=True)]
            b = [(i, bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()) for i in b_lib.encode(text) for p in [b_lib.id_to_piece(i)]]
            whole = (" " + text).encode()
            if not whole == b"".join(t for _, t in a) == b"".join(t for _, t in b):
                a = b = []
        owners = [[k for k, (_, t) in enumerate(side) for _ in t] for side in (a, b)]
        links = sorted(set(zip(*owners, strict=True)))
        groups, first = [], (0, 0)
        for at in range(len(owners[0])):
            if at + 1 == len(owners[0]) or (owners[0][at] != owners[0][at + 1] and owners[1][at] != owners[1][at + 1]):
                last = owners[0][at] + 1, owners[1][at] + 1
                groups.append((a[first[0] : last[0]], b[first[1] : last[1]]))
                first = last
        counts.update((a[x][0], b[y][0]) for x, y in links)
        text_groups = ";".join("|".join(",".join(str(i) for i, _ in side) for side in g) for g in groups)
        found.append({"n_a": len(a), "n_b": len(b), "groups": groups, "links": [(a[x][0], b[y][0]) for x, y in links], "text": text_groups})
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for row in found:
        row["n_best"] = sum(counts[p] == most[p[1]] for p in row["links"])
        row["count_sum"] = sum(counts[p] for p in row["links"])
        row["sha"] = hashlib.sha256(row["text"].encode()).hexdigest() if row["text"] else ""
    return found


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(13)
    own = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    mixed = ["".join(rng.choice("aé日😀 b'.\n") for _ in range(rng.randrange(60))) for _ in range(150)]
    return ODD + mixed + own[:120] + ["same text"] * 5


@pytest.mark.parametrize("sent", [A.SENT_PAIRS, 3, 0])
def test_groups_links_and_counts(spark, texts, sent):
    rows = [(i, t, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row bigint, text string, a_ids string").withColumn("pair", F.lit("clash")).repartition(4)
    aligned = A.align_texts(df, *PATHS).cache()
    assert aligned.columns == ["row", "pair", "a_ids", "b_ids", "a_group", "b_group", "groups_sha256"]
    wanted = plain(texts)
    counts = A.pair_counts(aligned, *PATHS)
    expected = Counter(p for row in wanted for p in row["links"])
    assert {(r["a_id"], r["b_id"]): r["n"] for r in counts.collect()} == expected
    scores = {r["row"]: r for r in A.link_scores(aligned, counts, "row", *PATHS, sent=sent).collect()}
    for r in aligned.collect():
        row = wanted[r["row"]]
        assert (len(r["a_ids"]), len(r["b_ids"]), r["groups_sha256"]) == (row["n_a"], row["n_b"], row["sha"]), texts[r["row"]]
        assert (r["a_group"], r["b_group"]) == ([len(g[0]) for g in row["groups"]], [len(g[1]) for g in row["groups"]])
        got = scores.get(r["row"])
        assert (got is None) == (not row["links"])
        if got:
            assert (got["n_links"], got["n_best"], got["count_sum"]) == (len(row["links"]), row["n_best"], row["count_sum"])
    aligned.unpersist()


def test_cuts_of_random_intervals():
    """Also where the common ends are far from the middle, or there is none."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        end = int(rng.integers(2, 400))
        a = np.append(np.flatnonzero(rng.random(end - 1) < rng.choice([0.02, 0.5, 0.9])) + 1, end)
        b = np.append(np.flatnonzero(rng.random(end - 1) < rng.choice([0.02, 0.5, 0.9])) + 1, end)
        zero = np.zeros(1, int)
        found = A.shared_cuts(a, b, zero, zero + len(a), zero, zero + len(b))
        assert a[found].tolist() == sorted(set(a[:-1].tolist()) & set(b[:-1].tolist()))


def test_stretches_equal_the_libraries(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_lib.encode_special_tokens = True
    own = A.Aligner(*map(A.tokens, PATHS))
    for text, found in zip(texts, own([t or "" for t in texts]), strict=True):
        if found[5]:
            assert np.frombuffer(found[0], np.int32).tolist() == a_lib.encode(" " + text, add_special_tokens=False).ids, text
            assert np.frombuffer(found[1], np.int32).tolist() == b_lib.encode(text), text
        else:
            assert not text or "▁" in text


def test_no_rows(spark):
    empty = A.align_texts(spark.createDataFrame([], "row bigint, text string"), *PATHS)
    counts = A.pair_counts(empty, *PATHS)
    assert empty.count() == counts.count() == A.link_scores(empty, counts, "row", *PATHS).count() == 0
