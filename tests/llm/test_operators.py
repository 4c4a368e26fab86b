"""Operators on training text against plain Python, libraries and SQL."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, same_rows
from pyspark.sql import functions as F

from tablemirror.llm import bpe, exact_dedup, fingerprints, html_extract, minhash, mixing, queries, sharding, token_counts, token_store, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Nulls, empty and blank texts, repeated rows, equal ids, a very long text, other scripts.
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7),
    (5, "one  two", "en", "b", 8), (6, "x" * 200_000, "en", "b", 1), (7, "word " * 40_000, "en", "b", 1), (None, "one two", "en", "b", 7),
    (None, None, None, None, None), (8, "日本語 テキスト <|endoftext|> é́ ß", "ja", "c", 1), (-9, "You IDIOT!!! 1d10t", "en", "c", 1), (8, "other text", "en", "c", 1),
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY 1").fetchall()


@pytest.fixture(scope="module", params=["edges", "empty"])
def edge(request, spark):
    rows = EDGES if request.param == "edges" else []
    # columns whose names clash with what operators add
    more = ("shard", "slot", "kept", "token_ids", "prefix_tokens", "toxicity", "node", "fingerprint", "length")
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in more})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same_rows(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


def jump(key: int, n: int) -> int:
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b, key = j, key * 2862933555777941757 + 1 & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, edge):
    keys = spark.createDataFrame([(k,) for k in (0, 1, -1, 2**63 - 1, -(2**63), *range(500))], "k bigint")
    for n in (1, 2, 24, 1000):
        for r in sharding.assign_shards(keys, "k", n).collect():
            assert (r["shard"], r["grown_shard"]) == (jump(r["k"], n), jump(r["k"], n + 1))
            assert r["grown_shard"] in (r["shard"], n)
    slots = sharding.number_slots(sharding.assign_shards(edge, "doc_id", 3), "doc_id", 2)
    by = defaultdict(list)
    for r in slots.collect():
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sum(map(len, by.values())) == edge.count()
    assert sharding.assign_shards(edge, "text", 5).where("shard < 0 OR shard > 4").count() == 0


def test_mixing(spark, docs, edge):
    rows = [(s, d, t) for s, (n, size) in {"a": (40, 9), "b": (7, 11), "c": (3, 5)}.items() for d in range(n) for t in [size + d % 3]]
    df = spark.createDataFrame([(i, s, t) for i, (s, _, t) in enumerate(rows)], "id bigint, source string, tokens bigint")
    plan = mixing.plan_mix(df, "source", F.col("tokens"), max_repeats=2.0)
    found = mixing.mix_schedule(df, "id", "source", F.col("tokens"), plan).collect()
    total = Counter()
    for s, _, t in rows:
        total[s] += t
    weights = {k: (v / sum(total.values())) ** plan.exponent for k, v in total.items()}
    weights = {k: v / sum(weights.values()) for k, v in weights.items()}
    repeats = {k: weights[k] / total[k] for k in total}
    assert max(repeats.values()) / min(repeats.values()) <= 2.0001 and max(repeats.values()) / min(repeats.values()) > 1.99
    budget = max(total[k] / weights[k] for k in total)
    for s in total:
        mine = [r for r in found if r["source"] == s]
        got = sum(r["n_tokens"] for r in mine)
        assert weights[s] * budget - 1 <= got <= weights[s] * budget + 13  # the row that crosses the budget is taken
        assert {r["id"] for r in mine} == {i for i, (k, _, _) in enumerate(rows) if k == s}
        before = 0
        for r in sorted(mine, key=lambda r: r["tokens_before"]):
            assert r["tokens_before"] == before
            before += r["n_tokens"]
    mixed = mixing.mix_rows(df, "id", "source", F.col("tokens"), max_repeats=2.0)
    assert Counter(r["id"] for r in mixed.collect()) == Counter(r["id"] for r in found)
    flat = mixing.plan_mix(df, "source", F.col("tokens"), max_repeats=None)
    assert flat.exponent == 0.0
    aimed = mixing.plan_mix(df, "source", F.col("tokens"), target_entropy=0.9, max_repeats=None)
    w = [r["weight"] for r in aimed.sources.collect()]
    assert abs(-sum(x * np.log(x) for x in w) - 0.9) < 1e-4
    out = mixing.mix_rows(edge, "doc_id", "source", mixing.word_tokens(F.col("text")))
    assert out.columns == edge.columns and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in edge.collect()}


def shingle_set(text: str) -> frozenset:
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def linked(rows: list[tuple[int, str]], percent: int = 85) -> dict[int, int]:
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for s in sets[i]:
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in sets}


def edited(words: list[str], rng: random.Random, n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_near_duplicates(spark, docs):
    rng = random.Random(5)
    rows = list(docs)
    base = 10_000
    for size, edits, copies in ((60, 1, 60), (200, 3, 80), (30, 1, 20), (7, 1, 10), (400, 6, 40)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        group = [words] + [edited(words, rng, rng.randrange(edits + 1)) for _ in range(copies)]
        chain = [words]
        for _ in range(6):  # each close to the one before, the ends far apart
            chain.append(edited(chain[-1], rng, edits))
        for w in [*group, *chain]:
            rows.append((base, " ".join(w)))
            base += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    wanted = linked(rows)
    found = minhash.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(shingle_set(dict(rows)[r["doc_id"]])) for r in found[:100])
    kept = minhash.drop_near_duplicates(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted.values()))


def test_near_duplicate_edges(spark, edge):
    found = minhash.near_duplicates(edge).collect()
    assert len(found) == edge.count()
    by = {(r["doc_id"], r["n_shingles"]): r for r in found}
    if found:
        assert by[(2, 0)]["component_id"] == 2 and by[(3, 0)]["kept"] and by[(1, 0)]["component_id"] == 1
        assert by[(5, 1)]["component_id"] == 4 and by[(None, 1)]["component_id"] == 4 and not by[(None, 1)]["kept"]
        assert by[(8, 1)]["component_id"] == 8


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"{a:03}", f"{b:03}") for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(90)) if a != b] + [(f"x{i:03}", f"x{i + 1:03}") for i in range(60)]
    labels, _ = minhash.components(spark.createDataFrame(edges, "a string, b string"))
    root: dict[str, str] = {}

    def top(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    assert {r["node"]: r["label"] for r in labels.collect()} == {x: top(x) for x in root if top(x) != x}


def test_token_counts(spark, docs, edge):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    found = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, SF).collect()}
    assert found == {i: size(t) for i, t in docs}
    counted = token_counts.prefix_counts(edge, path).select("doc_id", "prefix_ends", token_counts.total_tokens().alias("n"), token_counts.chars_within(2).alias("c"))
    wanted = Counter((r[0], size(r[1] or "")) for r in (EDGES if counted.count() else []))
    assert Counter((r["doc_id"], r["n"]) for r in counted.collect()) == wanted
    own, rng = token_counts.counter(path), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["the ", "and", "ing'", "s ", "Ünder", "%%%", " 12", "3", "<|endoftext|>", "é", "日本 ", "\n"]) for _ in range(10))
        assert all(size(text[:e]) == n for e, n in zip(*own.prefixes(text), strict=True))
        for budget in (0, 1, 4, 9):
            n = own.longest_prefix(text, budget)
            assert size(text[:n]) <= budget
            assert not (re.fullmatch(r"[ -~\n]*", text) and "<|" not in text) or all(size(text[:m]) > budget for m in range(n + 1, len(text) + 1))


@pytest.fixture(scope="module")
def insults(spark):
    """Rows, labels and a model fitted to the first 400."""
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["zorgle", "zorglig", "moron", "bleckt"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int").coalesce(2)
    return df, labels, known, toxicity.fit(df, known.where("doc_id < 400"))


def test_toxicity(insults):
    df, labels, known, model = insults
    scores = {r["doc_id"]: r["toxicity"] for r in model.score(df).collect()}
    held = [(scores[i], t) for i, t in labels if i >= 400]
    right = sum((s >= 0.7) == bool(t) for s, t in held) / len(held)
    assert right >= 0.95 and all(0 <= s <= 1 for s in scores.values())
    nothing = toxicity.fit(df, known.where("toxic = 0"))
    assert {r["toxicity"] for r in nothing.score(df).collect()} == {0.0}
    weights = {"bad": 3.0}
    vector = dict(zip(toxicity.FEATURES, toxicity.Features(weights)("You are BAD b4d!"), strict=True))
    assert vector["near_second_person"] == 1.0 and vector["masked_hits"] == 1.0 and vector["capital_words"] > 0


def test_toxicity_edges(insults, edge):
    out = insults[3].score(edge)
    assert out.columns[-1] == "toxicity" and out.where("toxicity IS NULL").count() == 0 and out.count() == edge.count()
    assert out.where("length <> 'own' OR node <> 'own'").count() == 0  # a caller's columns stay, whatever a feature is called


def test_toxicity_without_rows_or_labels(insults, spark):
    df, _, known, _ = insults
    for rows, labels in ((df.limit(0), known), (df, known.limit(0)), (df, known.withColumn("toxic", F.lit(None).cast("int")))):
        assert {r["toxicity"] for r in toxicity.fit(rows, labels).score(df).collect()} == {0.0}


def plain_features(text: str, weights: dict) -> list[float]:
    """The features by their definitions, word by word."""
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    value = [max([weights.get(k, 0.0) for k in toxicity.keys_of(w)]) if len(w) > 2 else 0.0 for w in words]
    hits, second = [i for i, v in enumerate(value) if v], [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    masked = []
    for run in re.findall(r"[\w@$!*#+|.\-]+", text.lower()):
        inner = re.search(r"[^\W\d_].*[^\W\d_]", run, re.S)
        parts = re.split(r"[^\w@$!*#+|.\-]+", inner.group()) if inner else []
        masked += [p for p in parts if re.search(r"[\d@$!*#+|.\-_]", p)]
    plain = ["".join(c for c in m.translate(toxicity._UNMASK) if c.isalpha()) for m in masked]
    n, size = max(len(words), 1), max(len(text.encode()), 1)
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    stretched, at = 0, 0
    low = text.lower()
    while at < len(low) - 2:
        if low[at].isalpha() and low[at] == low[at + 1] == low[at + 2]:
            stretched, at = stretched + 1, at + 3
        else:
            at += 1
    return [
        100 * len(hits) / n, len({words[i] for i in hits}), max(value, default=0.0), 100 * sum(value) / n, 100 * sum(w in toxicity.INSULTS for w in set(words)) / n,
        sum(any(abs(i - j) <= 5 for j in second) for i in hits) / max(len(hits), 1), 100 * len(second) / n, upper / max(upper + lower, 1),
        sum(w.isupper() and len(w) > 2 for w in text.split()) / n if upper > 3 else 0.0,
        sum(33 <= ord(c) < 48 or 58 <= ord(c) < 65 or 91 <= ord(c) < 97 or 123 <= ord(c) < 127 for c in text) / size,
        100 * sum(c in "!?" for c in text) / size, 100 * len(masked) / n,
        sum(p in toxicity.INSULTS or (len(p) > 2 and max(weights.get(k, 0.0) for k in toxicity.keys_of(p)) > 0) for p in plain),
        100 * stretched / n, 100 * sum("0" <= c <= "9" for c in text) / size, np.log1p(len(words)),
    ]


def test_toxicity_features_by_brute_force(docs):
    weights, rng = {"bad": 3.0, "zorg-": 2.5, "idiot": 4.0}, random.Random(8)
    own = toxicity.Features(weights)
    bits = ["you ", "bad ", "zorgling ", "1d10t", " b4d!", "I D", "SHOUT ", "sooo ", "é日 ", "a_b", "-", ". ", "x.y.z ", "\n", "99 ", "YOUR", "w" * 30]
    for text in [t for _, t in docs[:60]] + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)]:
        assert own(text) == pytest.approx(plain_features(text, weights)), text


def test_toxicity_features_are_linear_in_long_words():
    own, start = toxicity.Features({}), time.process_time()
    for text in ("x" * 10**6, "日" * 10**6, "a1" * 500_000, "1" * 10**6, "a" + "1" * 10**6):
        own(text)
    assert time.process_time() - start < 10


def test_token_store(spark, docs, edge, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = sorted(queries.op6_token_store(spark, SF).collect())
    start = 0
    for (i, text), row in zip(docs, found, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        assert tuple(row) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_store.write_shards(edge, str(tmp_path / "shards"), path, partitions=3, ids_a_shard=64)
    back = token_store.read_shards(spark.read.parquet(str(tmp_path / "shards"))).collect()
    rows = [r for r in EDGES] if edge.count() else []
    wanted = Counter((r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in rows)
    assert Counter((r["doc_id"], bytes(r["token_ids"])) for r in back) == wanted
    assert sorted(r["start"] for r in back)[:1] == ([0] if rows else [])


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 50_000, 3000).astype(np.uint16), rng.integers(0, 5, 1100).astype(np.uint16), np.zeros(0, np.uint16), np.array([7], np.uint16)):
        ids, ends, m = token_store.open_shard(token_store.pack_shard([3], [len(values)], values))
        assert ids.tolist() == [3] and ends.tolist() == [len(values)]
        assert m.values().tolist() == values.tolist()
        for at in range(0, len(values), 97):
            assert m.access(at) == values[at]
        for token in {*values[:40].tolist(), 49_999, 70_000}:
            places = np.flatnonzero(values == token)
            assert m.count(token) == len(places) and m.count(token, 5, 900) == ((places >= 5) & (places < 900)).sum() if len(values) > 900 else True
            assert [m.select(token, n) for n in range(min(len(places), 5))] == places[:5].tolist() and m.select(token, len(places)) == -1


def test_exact_dedup(spark, edge):
    found = exact_dedup.mark_duplicates(edge).collect()
    rows = EDGES if found else []
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    assert len(found) == len(rows)
    for r in found:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == (min(ids) if ids else None)
    kept = Counter(r["text_sha256"] for r in found if r["kept"])
    assert set(kept.values()) <= {1} and len(kept) == len(groups)
    stay = exact_dedup.drop_duplicates(edge)
    assert stay.columns == edge.columns and Counter(norm(r["text"]) for r in stay.collect()) == Counter(dict.fromkeys(groups, 1))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav><!-- note --><div class="ad">Buy {n}</div>{main}<aside>More</aside>
<form><input value=x>Find</form><section id="comments"><article>me too</article></section><footer>&copy; all</footer></body></html>"""


def test_html(spark, edge):
    article = "<article><header><h1>A &amp; B</h1></header><p>One<br>two <b>th</b>ree&nbsp;four<p>Five &lt;6&gt;<ul><li>x<li>y</ul><div class='share'>Share</div></article>"
    plain = "<div class=text><p>Body {n} is long enough to be the page's own text</p></div><div class=rail><p>Same on every page</p></div>"
    rows = [(i, f"http://h.example/{i}", PAGE.format(n=i, main=plain.format(n=i))) for i in range(6)]
    rows += [(10, "http://one.example/", PAGE.format(n=1, main=article)), (11, None, None), (12, "x", ""), (13, "http://a.example", "no < markup & all")]
    rows += [(14 + i, "http://copy.example/", PAGE.format(n=1, main=article)) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("__removed", F.lit("own"))
    found = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    wanted = "A & B\n\nOne two three four\n\nFive <6>\n\nx\n\ny"
    assert found[10] == wanted and all(found[14 + i] == wanted for i in range(5))
    assert all(found[i] == f"Body {i} is long enough to be the page's own text" for i in range(6))
    assert found[11] == found[12] == "" and found[13] == "no < markup & all"
    tree = {(r["host"], r["path"]): r["importance"] for r in html_extract.style_tree(pages).collect()}
    at = html_extract.path_id
    assert tree["h.example", at("div.rail")] < 0.1 and tree["h.example", at("div.text")] > 0.8 and tree["one.example", at("article")] == 1.0
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_fingerprints(spark, docs, edge):
    found = {r["doc_id"]: r for r in queries.op9_fingerprints(spark, SF).collect()}
    assert len(found) == len(docs)
    likely = []
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        row = found[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert row["shared_prefix"] == next((n for n, (a, b) in enumerate(zip(text, changed, strict=False)) if a != b), min(len(text), len(changed)))
        spans = [{t[n : n + 12] for n in range(max(len(t) - 11, 1))} for t in (text, changed)]
        likely.append((row["near_edited"], 2 * len(spans[0] & spans[1]) / (len(spans[0]) + len(spans[1]))))
    assert np.corrcoef(np.array(likely).T)[0, 1] > 0.75
    assert abs(np.mean([a - b for a, b in likely])) < 0.05
    twice = fingerprints.fingerprint_with_edit(edge, ranges=3).collect()
    assert len(twice) == edge.count()
    by_text = defaultdict(set)
    for r, e in zip(sorted(twice, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)), sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0)), strict=False):
        assert r["doc_id"] == e[0]
        by_text[r["n_chars"], r["fingerprint"]].add(r["doc_id"])
    a, b = fingerprints.PrefixHashes("xx common part yy"), fingerprints.PrefixHashes("zcommon part?")
    assert a.common(3, b, 1) == 11 and a.span(3, 6) == b.span(1, 6) != a.span(4, 6)


def test_bpe(spark, docs, edge):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    packed = lambda t: np.array(library.encode_ordinary(t), "<u4").tobytes()
    for r in queries.op10_bpe(spark, SF).collect():
        text = dict(docs)[r["doc_id"]]
        assert r["n_tokens"] == len(packed(text)) // 4 and r["ids_sha256"] == hashlib.sha256(packed(text)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    out = bpe.encode_texts(edge, path, P.PATTERN, decode=True).collect()
    rows = EDGES if out else []
    assert Counter((r["doc_id"], bytes(r["token_ids"]), r["decoded"]) for r in out) == Counter((r[0], packed(r[1] or ""), r[1] or "") for r in rows)
    own, rng = bpe.encoder(path, P.PATTERN), random.Random(3)
    letters = "ab c\n\t 'sd  　\x1c\x85éß日本😀1²３’<|endoftext|>$%%%  \r\n"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert own.text(text) == packed(text), text
        assert bpe.decoded(packed(text), own.transducer.tokens, 3) == text
    for text in ("a" * 9000, "=-" * 6000, " " * 3000 + "x"):  # pieces longer than the flush size
        assert own.text(text) == packed(text)
    few = bpe.LazyTransducer(ranks, most_states=50)  # starts anew again and again
    assert [few.encode(t.encode()) for t in ("hello", "world", " thing") * 20] == [library.encode_ordinary(t) for t in ("hello", "world", " thing") * 20]
    stream = bpe.Utf8Stream()
    data = "é日😀a".encode() + b"\xff\xc3"
    assert "".join(stream.feed(data[i : i + 1]) for i in range(len(data))) + stream.end() == data.decode("utf-8", "replace")
