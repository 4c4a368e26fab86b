"""The style tree decides by itself where a host has pages enough."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tablemirror.llm import html_extract as H


def words(rng: random.Random, n: int) -> str:
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_the_tree_alone_removes_menus_adverts_and_footers(spark):
    """On the hosts of the larger table: names and tags switched off, the text is the same on every page."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    alone = H.extract_text(pages, marks=False).select("page_id", F.col("text").alias("alone"))
    both = H.extract_text(pages).join(alone, "page_id")
    assert both.where("NOT text <=> alone").count() == 0 and both.where("text <> ''").count() > 2400
    below = H.parted(H.style_tree(pages)).where("below")
    for steps in (("nav",), ("div.ad",), ("footer",), ("nav", "ul")):
        assert below.where(F.col("path") == H.path_id(*steps)).count() == 60, steps
    assert below.where(F.col("path") == H.path_id("article")).count() == 0


def test_neutral_names_and_varied_words(spark):
    """Boxes whose words are new on every page go by their form; what varies in form stays, with lists of one form inside it."""
    rng, rows = random.Random(2), []
    for i in range(12):
        body = "".join(f"<p>{words(rng, 12)}</p>" for _ in range(rng.randrange(2, 9)))
        html = (
            f"<div class=wrap><div class=alpha><ul><li>{words(rng, 1)}<li>{words(rng, 1)}</ul></div>"
            f"<div class=beta>{body}<ul><li>{words(rng, 3)}<li>{words(rng, 3)}</ul></div><section class=gamma><p>{words(rng, 4)}</p></section></div>"
        )
        rows.append((i, "http://a.example/x", html, body))
    df = spark.createDataFrame(rows, "page_id int, url string, html string, body string")
    for marks in (True, False):
        for r in H.extract_text(df, marks=marks).collect():
            kept = H.Page(f"<div>{r['body']}</div>").text(frozenset())
            assert r["text"].startswith(kept) and r["text"].count("\n\n") == kept.count("\n\n") + 2, r["text"]


def test_articles_of_one_form_stay(spark):
    rng, rows = random.Random(3), []
    for i in range(10):
        html = f"<nav><ul><li>{words(rng, 1)}</ul></nav><article><h1>{words(rng, 3)}</h1><p>{words(rng, 30)}</p></article><footer><p>{words(rng, 2)}</p></footer>"
        rows.append((i, "http://b.example/", html))
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert H.parted(H.style_tree(df)).count() == 0  # no gap, so nothing is parted
    assert all(r["text"].count(" ") == 31 for r in H.extract_text(df).collect())
    assert all(r["text"].count(" ") >= 31 for r in H.extract_text(df, marks=False).collect())


def test_hosts_with_few_pages_have_no_cut(spark):
    rows = [(0, "http://c.example/1", "<nav>a</nav><p>b</p>"), (1, "http://c.example/2", "<nav>c</nav><p>d</p>"), (2, None, None), (3, "", "")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert H.parted(H.style_tree(df)).count() == 0
    assert sorted((r["page_id"], r["text"]) for r in H.extract_text(df).collect()) == [(0, "b"), (1, "d"), (2, ""), (3, "")]
