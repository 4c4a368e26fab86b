"""Cases that a review found missing."""

from __future__ import annotations

import math
import random
import struct
import time
import tracemalloc
import weakref
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from test_operators import EDGES, SCHEMA, edited, linked

from tablemirror.llm import bpe, chunks, fingerprints, html_extract, minhash, mixing, queries, token_counts


def extracted(spark, bodies: list[str]) -> list[str]:
    rows = [(i, f"http://h.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    found = html_extract.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    return [r["text"] for r in found.orderBy("page_id").collect()]


def test_low_branches_inside_the_content_root_go(spark):
    body = "<main><div class=story><p>Story {0} has its own words and is the longest part of its page {0}</p></div><{1} class=hint>Same everywhere</{1}></main>"
    for tag in ("div", "p"):
        texts = extracted(spark, [body.format(i, tag) for i in range(6)])
        assert texts == [f"Story {i} has its own words and is the longest part of its page {i}" for i in range(6)]


@pytest.mark.parametrize(
    "html",
    [
        '<article class="post has-sidebar">{}</article>',
        '<main id="content" class="no-sidebar">{}</main>',
        '<div class="layout-with-sidebar"><article>{}</article></div>',
        '<div class="sidebar"><article>{}</article></div><div class="sidebar"><article>Teaser</article></div>',
        '<article class="category-social">{}</article>',
        '<div class="page-sidebar-left">{}</div>',
        '<article>{}<div class="post-share">Share</div></article><div class="related-posts"><article>A teaser of a longer and longer page of this host</article></div>',
        '<article>{}<section class="comments"><article>me too</article></section><p class="ad">Buy</p></article>',
    ],
)
def test_a_name_does_not_remove_the_main_text(html):
    text = "The main text of this page"
    assert html_extract.Page(f"<body>{html.format(f'<p>{text}</p>')}</body>").text(frozenset()) == text


def test_short_articles_lose_long_notices_and_copies_stay_whole(spark):
    notice = "<div class=legal><p>A notice on every page that is far longer than what the page itself says</p></div><div class=links><p>Links</p></div>"
    page = "<div class=text><p>{}</p></div>" + notice
    assert extracted(spark, [page.format(f"Text {i}") for i in range(6)]) == [f"Text {i}" for i in range(6)]
    # copies keep their text and lose the notice that other pages have too
    said = [f"Text {i}" for i in range(5)] + ["Copied text"] * 20
    assert extracted(spark, [page.format(t) for t in said]) == said
    copies = ["<div class=text><p>Only copies here</p></div>"] * 5
    assert extracted(spark, copies) == ["Only copies here"] * 5


def test_near_stage_removes_copies_of_similarity_0_8(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(words[:90] + [f"x{i}" for i in range(10)]), " ".join(words[:80] + [f"y{i}" for i in range(20)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")  # similarity to the first: 86/106 and 76/116
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs, "").collect()) == [0, 2]
    with pytest.raises(ValueError, match="60"):
        minhash.near_duplicates(docs, percent=60)


def test_small_sources_are_mixed_too(spark):
    rows = [(1, "large", 30_000_000_000), (2, "tiny", 1), (3, "small", 7), (4, "other", 20_000_000_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint")
    plan = {r["source"]: r for r in mixing.plan_mix(docs, "source", F.col("n")).sources.collect()}
    assert all(1 <= r["passes"] <= 2 and r["passes"] * r["tokens"] + r["rest"] <= 2 * r["tokens"] for r in plan.values())
    assert {r["doc_id"] for r in mixing.mix_rows(docs, "doc_id", "source", F.col("n")).collect()} == {1, 2, 3, 4}


def test_truncation_reaches_texts_without_spaces(spark):
    pytest.importorskip("public_tokenizers")
    path = queries.vocabulary("word_bpe_49k.json")
    texts = ["one\ntwo\nthree\nfour\nfive", "日本語のテキスト" * 2, "unbrokenwordsofsomelength", "one two three", None]
    rows = [(i, t, b) for i, t in enumerate(texts) for b in (3, 1000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, budget int")
    own = token_counts.counter(path)
    for r in token_counts.with_longest_prefix(docs, path, "budget").collect():
        text, cut = r["text"] or "", r["prefix_chars"]
        if r["budget"] is None:
            assert cut is None
            continue
        fits = [n for n in range(len(text) + 1) if int(own.prefixes(text[:n])[1][-1]) <= r["budget"]]
        assert cut == max(fits) and (cut > 0 or not text)


def test_importance_by_brute_force(spark):
    """Entropies of the merged tree from each page's nodes, by their definition."""
    rng = random.Random(4)
    bodies = []
    for i in range(30):
        said = f"<p>Own words of page {i % 24}</p>" + "<p>more</p>" * rng.randrange(3)  # some pages are copies
        side = f"<div class='rail r{i}'><p>Part {rng.randrange(4)}</p><ul>{'<li>x</li>' * rng.randrange(1, 3)}</ul></div>"
        bodies.append(f"<body><div class=text>{said}</div>{side}<section><p>Same</p></section></body>")
    rows = [(i, f"http://h{i % 2}.example:80/{i}", b) for i, b in enumerate(bodies)]
    seen = defaultdict(dict)
    for i, _, body in rows:
        page = html_extract.Page(body)
        for path, content, form in page.nodes():
            seen[f"h{i % 2}.example", path][page.content()] = content, form
    wanted = {}
    for node, pages in seen.items():
        m, parts = len(pages), []
        for k in (0, 1):
            counts = Counter(p[k] for p in pages.values())
            parts.append(-sum(n / m * math.log(n / m, m) for n in counts.values()) if m > 1 else 1.0)
        wanted[node] = m, html_extract.CONTENT_SHARE * parts[0] + (1 - html_extract.CONTENT_SHARE) * parts[1] if m > 1 else 1.0
    tree = html_extract.style_tree(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    found = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in tree.collect()}
    assert found.keys() == wanted.keys()
    assert all(found[k][0] == wanted[k][0] and found[k][1] == pytest.approx(wanted[k][1], abs=1e-9) for k in found)
    low = {k[1] for k, (n, x) in found.items() if x < html_extract.LEAST_IMPORTANCE and n >= html_extract.LEAST_PAGES}
    assert html_extract.path_id("section") in low and html_extract.path_id("div.text") not in low
    removed = sum(len(html_extract.Page(b).kept(frozenset())) - len(html_extract.Page(b).kept(frozenset(low))) for b in bodies)
    assert removed >= len(bodies)  # the tree takes the repeated section from every page


@pytest.mark.parametrize("html", ["<div>x" * 10_000, "<main>x" * 10_000, "<span>" * 5_000 + "<p>x" * 5_000, "<a b='" * 20_000, "<" * 50_000, "<!--" * 50_000, "<div>" * 9_000 + "</ul>" * 9_000])
def test_html_time_is_linear_in_nesting(html):
    start = time.process_time()
    page = html_extract.Page(html)
    page.text(frozenset([1]))
    assert sum(1 for _ in page.nodes()) <= 10_000 and time.process_time() - start < 2


def test_a_comment_that_does_not_end_hides_the_rest():
    assert html_extract.Page("<p>a</p><!-- b <b>c</b> d").text(frozenset()) == "a"
    assert html_extract.Page("<p>a</p>e<!-- b").text(frozenset()) == "a\n\ne"


@pytest.mark.parametrize("percent", [80, 85])
def test_a_common_passage_hides_no_link(spark, percent):
    """Every document holds one passage, which is most of many of them; among them are near copies and chains."""
    rng = random.Random(percent)
    passage = [f"p{i}" for i in range(26)]
    texts = []
    for i in range(900):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((3, 5, 8, 20, 60)))]
        cut = rng.randrange(len(own) + 1)
        texts.append(own[:cut] + passage + own[cut:])
    texts += [edited(rng.choice(texts[:900]), rng, 1) for _ in range(250)]
    base = [f"b{i}" for i in range(120)]
    for _ in range(150):  # random edits of one text: all alike, few of them linked
        texts.append(edited(base, rng, rng.randrange(1, 7)))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, percent=percent).collect()}
    assert found == linked(rows, percent)


def test_fingerprints_of_spans_and_likeness_by_brute_force(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c😀é") for _ in range(rng.randrange(60))) for _ in range(40)] + ["same text of some length"] * 3 + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_with_edit(rows, ranges=3).collect()}
    empty = f"{fingerprints._EMPTY:04x}"

    def bins(print_: str) -> list[str]:
        tail = print_.rpartition("-")[2]
        return [tail[i : i + 4] for i in range(0, len(tail), 4)]

    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)] or ""
        text = text or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        row, alone = found[i], lambda t: fingerprints.PrefixHashes(t).fingerprint()
        assert row["fingerprint"] == alone(text) and row["edited_fingerprint"] == alone(changed)
        for near, other in (("near_edited", row["edited_fingerprint"]), ("near_next", found[(i + 1) % len(texts)]["fingerprint"])):
            pairs = [(a, b) for a, b in zip(bins(row["fingerprint"]), bins(other), strict=True) if (a, b) != (empty, empty)]
            share = sum(a == b for a, b in pairs) / max(len(pairs), 1)
            wanted = 1.0 if row["fingerprint"] == other else min(2 * share / (1 + share), 0.999999)
            assert row[near] == pytest.approx(wanted) and 0 <= row[near] <= 1
        hashes = fingerprints.PrefixHashes(text)
        for _ in range(20):
            a, b, n = rng.randrange(len(text) + 1), rng.randrange(len(text) + 1), rng.randrange(6)
            if max(a, b) + n <= len(text):
                assert (hashes.span(a, n) == hashes.span(b, n)) == (text[a : a + n] == text[b : b + n])


def test_memos_do_not_keep_long_texts():
    memo = chunks.Memo(len, entries=10)
    assert memo["x" * 10**6] == 10**6 and memo["word"] == 4 and list(memo) == ["word"]


@pytest.mark.parametrize("rows", [EDGES, []], ids=["edges", "empty"])
def test_pipeline_stages_on_edges(spark, rows):
    pytest.importorskip("public_tokenizers")
    more = ("node", "name", "sha256", "keep_id", "pass", "shard", "__asked", "length", "comp")
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in more})
    ids = Counter(r[0] for r in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert sorted(out.columns) == sorted(docs.columns) and out.columns[:5] == docs.columns[:5], name
        got = out.collect()
        assert all(r[c] == "own" for r in got for c in more if c != "__asked" or c in out.columns)
        after = Counter(r["doc_id"] for r in got)
        assert set(after) <= set(ids)
        docs, ids = spark.createDataFrame(got, out.schema), after
    texts = {" ".join((r["text"] or "").split()) for r in docs.select("text").collect()}
    result = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert Counter(r["doc_id"] for r in result.collect()) == ids
    assert not rows or {"", "one two"} <= texts


def test_a_worker_remembers_for_one_operator_at_a_time():
    first = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN) is first
    gone = weakref.ref(first)
    del first
    list(minhash._small(iter([]), "text"))  # as a task of near dedup begins
    assert gone() is None


def test_the_transducer_drops_ways_that_cannot_end():
    own = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ing", "tion", "ción", "re", "th", "é", "日", "x", "0", " ", ".\n"]) for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert own.text(text) == struct.pack(f"<{len(library.encode_ordinary(text))}I", *library.encode_ordinary(text))
    for ways in own.transducer.ways:
        assert all(way & 0xFFFFFF == 0 or own.transducer.ahead[way & 0xFFFFFF] for way in ways)


def test_differences_of_one_component_are_not_dealt(spark):
    members = [(0, 1, 1, 50, 50, [5, 6], [], 10, True, 0), (0, 2, 1, 50, 50, [5], [], 10, True, 0), (0, 3, 1, 50, 50, [6], [], 10, False, 3)]
    schema = "hub long, node long, score long, n int, hub_n int, more array<long>, less array<long>, g int, linked boolean, comp long"
    found = minhash._finer(spark.createDataFrame(members, schema), 85).select("node", "x").distinct().collect()
    assert sorted(map(tuple, found)) == [(1, 6), (3, 6)]  # 5 was dealt as well


def test_words_of_the_store_equal_the_library():
    """Words that go to the model directly, with marks behind them or not, and the planes of many ids."""
    from tokenizers import Tokenizer

    from tablemirror.llm import token_store

    path = queries.vocabulary("byte_bpe_50k.json")
    library, chunks = Tokenizer.from_file(path), token_store.library_chunks(path)
    for word in ("word", "zorvaplent", "x" * 90, "café", "Ångström", "don't", "a_b", "日本"):
        for text in (f"at {word}", f"at {word}, {word}...) (", f"at {word}' {word}'s", f"{word}\n{word}! {word}\n"):
            assert np.frombuffer(chunks(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    values = np.random.default_rng(6).integers(0, 50_000, 70_000).astype(np.uint16)
    matrix = token_store.WaveletMatrix.build(values, 16)
    assert (matrix.values() == values).all() and matrix.access(69_999) == values[-1]


def test_encoding_in_the_pipeline_gets_small_batches(spark, monkeypatch):
    """10,000 texts at a time, beside the encoder's tables, were more than an executor may take."""

    def sizes(docs):
        return docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows]}) for b in batches), "rows bigint")

    monkeypatch.setattr(corpus_pipeline, "bpe_digests", sizes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(2500).coalesce(1).selectExpr("id AS doc_id", "'a' AS text")
    found = [r["rows"] for r in corpus_pipeline.encode(spark, docs, "").collect()]
    assert sum(found) == 2500 and max(found) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_the_aligner_remembers_groups_as_text():
    """One string a stretch; the ids are read back from the groups of a text."""
    from tablemirror.llm import alignment

    own = alignment.aligner(queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model"))
    texts = ["some words, and others.\nMore words", "", "▁x words", "words  and \n others", "x" * 100]
    found = own(texts)
    assert all(isinstance(value, str) for value in own.known.young.values())
    for text, (a, b, of_a, of_b, shown, spelled) in zip(texts, found, strict=True):
        a, b, of_a, of_b = (np.frombuffer(x, np.int32).tolist() for x in (a, b, of_a, of_b))
        assert (sum(of_a), sum(of_b)) == (len(a), len(b)) and spelled == bool(a)
        assert not spelled or own.a.spell(a) == own.b.spell(b) == f" {text}".encode()
        ends_a, ends_b = np.cumsum([0, *of_a]), np.cumsum([0, *of_b])
        groups = [f"{','.join(map(str, a[ends_a[i] : ends_a[i + 1]]))}|{','.join(map(str, b[ends_b[i] : ends_b[i + 1]]))};" for i in range(len(of_a))]
        assert "".join(groups) == shown
    again = own(texts)
    assert again == found and "x" * 100 not in " ".join(t for t in own.known.young if t not in own.known.long)


def test_members_of_near_copies_have_few_hubs(spark, monkeypatch):
    """The buckets of one group of near copies have many hubs; a member's differences to all of them were joined."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(edited(base, rng, rng.randrange(1, 6)))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    finer, hubs = minhash._finer, []

    def counted(star, percent):
        hubs.append(star.groupBy("node").count().agg(F.avg("count")).first()[0])
        return finer(star, percent)

    monkeypatch.setattr(minhash, "_finer", counted)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert found == linked(rows)
    assert hubs[0] < 3, hubs


def test_the_transducer_holds_its_states_as_numbers():
    """Tuples of ways and moves, and a dict for each beginning of a token, were too much for an executor beside its heap."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tracemalloc.start()
    try:
        own = bpe.LazyTransducer(ranks)
        trie = tracemalloc.get_traced_memory()[0]
        rng = random.Random(8)
        pieces = ["".join(rng.choice("abdeilmnorstu") for _ in range(9)).encode() for _ in range(9000)]
        for piece in pieces:
            own.encode(piece)
        own.follows.clear()
        own.alive.clear()
        own.halves.clear()
        own.alone.clear()
        states = tracemalloc.get_traced_memory()[0] - trie
    finally:
        tracemalloc.stop()
    assert trie < 20e6 and len(own.ids) > 20_000
    assert states < 260 * len(own.moves)
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(own.encode(p) == library.encode_ordinary(p.decode()) for p in pieces[:500])
