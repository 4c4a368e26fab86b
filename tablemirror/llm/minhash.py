"""Near-duplicate documents by one-permutation hashing.

A document is the set of its 5-word shingles, hashed to 64 bits. One permutation serves
all bins: the hash's upper bits name the bin and its least value there is the bin's
sample. Empty bins borrow from a bin that a fixed sequence of draws per bin finds (optimal
densification, Shrivastava 2017). Bands of bins make buckets; in a bucket every document
is a candidate of its hub only, a star, and candidates are confirmed on full sets. Hubs that a better hub
is near hand their members to it (``_gathered``), so that a member of a large group of near
copies has few hubs. Equal sets are one node from the start, so copies add no pairs.

Before, documents leave that cannot have a link at all, because too many of their shingles
are in no other document that shares a bucket.

A star can miss a pair whose members are both unlike the hub. What such members have in
common shows in their differences to the hub, which are far smaller than the sets: for
sets A and B and a hub H, the difference of A and B is the difference of (A - H, H - A) and
(B - H, H - B). A link bounds it, so two members that are linked, but not both to the hub,
must share some of these differences, and members are dealt to finer buckets by their
rarest ones (``_finer``), where another star follows. What finer buckets of the second star
still hold apart is compared directly, difference by difference, in the join that finds
it, so that only links come out of it. No pair that shares a bucket is left out: it was
compared, lies in one component, or cannot be a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.llm.chunks import release, text_batches
from tablemirror.llm.common import discard, free_name, key_bitmap, with_chance, written

WORDS = 5
#: 32 bands of 5 bins: a pair of similarity 0.85 shares no bucket with a chance of 7e-9, one of 0.80 with a chance of 3e-6.
BANDS, BAND_BINS = 32, 5
BINS = BANDS * BAND_BINS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The least percentage the bands serve: a pair at the limit is lost with a chance of at most 1e-5.
LEAST_PERCENT = next(p for p in range(1, 101) if (1 - (p / 100) ** BAND_BINS) ** BANDS <= 1e-5)
_BATCH_BYTES = 1 << 18

_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, start: int) -> np.ndarray:
    return _mixed(np.arange(start + 1, start + n + 1, dtype=np.uint64) * _GOLDEN)


_LETTER = _numbers(256, 0)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.cumprod(np.full(256, _MIX2, np.uint64))]
_WEIGHTS = _numbers(WORDS, 1000) | np.uint64(1)
_BAND_WEIGHTS = _numbers(BINS, 2000).reshape(BANDS, BAND_BINS) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.full(n, _MIX2, np.uint64))
    return _POWERS[0]


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty for a text without words."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_BLANK[data]
    place = np.flatnonzero(solid)
    if not len(place):
        return [np.zeros(0, np.uint64)] * len(texts)
    begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1] + 1]))
    lengths = np.diff(np.append(begins, len(place)))
    within = np.arange(len(place)) - np.repeat(begins, lengths)
    letters = _LETTER[data[place]] * _powers(int(lengths.max()) + 1)[within]
    words = _mixed(np.add.reduceat(letters, begins) + lengths.astype(np.uint64))
    owner = np.searchsorted(np.cumsum(sizes), place[begins], side="right")
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    runs = max(len(words) - WORDS + 1, 0)
    whole = np.zeros(runs, np.uint64)
    for k in range(WORDS if runs else 0):
        whole += words[k : k + runs] * _WEIGHTS[k]
    whole = _mixed(whole)
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:  # fewer words than a shingle has: the sequence itself, apart from all longer ones
            salt = _numbers(WORDS, 3000)[b - a - 1 : b - a]
            out.append(_mixed((words[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64, keepdims=True) + salt))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _draws(attempt: int) -> np.ndarray:
    """The bin that each bin tries to borrow from at an attempt."""
    return (_numbers(BINS, 10_000 + attempt * BINS) % np.uint64(BINS)).astype(np.int64)


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """The bucket of each set in each band, as signed 64-bit numbers; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    key = owner * BINS + ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    least = np.concatenate([[True], key[1:] != key[:-1]])
    samples = np.zeros(len(sets) * BINS, np.uint64)
    filled = np.zeros(len(sets) * BINS, bool)
    samples[key[least]], filled[key[least]] = values[least], True
    empty = np.flatnonzero(~filled)
    attempt = 0
    while len(empty):
        source = empty // BINS * BINS + _draws(attempt)[empty % BINS]
        found = filled[source]
        samples[empty[found]] = samples[source[found]]
        empty = empty[~found]
        attempt += 1
    bands = (samples.reshape(len(sets), BANDS, BAND_BINS) * _BAND_WEIGHTS).sum(axis=2, dtype=np.uint64)
    return _mixed(bands + _numbers(BANDS, 5000)).view(np.int64)


def _small(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches of at most about a quarter of a megabyte of text (or one row)."""
    release()
    for batch, texts in text_batches(batches, text):  # a batch of Spark's may hold 10,000 texts; not all of them are unpacked at once
        encoded = [t.encode() for t in texts]
        start, size = 0, 0
        for i, t in enumerate(encoded):
            if i > start and size + len(t) > _BATCH_BYTES:
                yield batch.slice(start, i - start), encoded[start:i]
                start, size = i, 0
            size += len(t)
        yield batch.slice(start), encoded[start:]


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__id, n_shingles, name, bands)`` per row; name is 128 bits of the set's hash, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch, texts in _small(batches, "__text"):
            sets = shingles(texts)
            full = [s for s in sets if len(s)]
            hashes = iter(band_hashes(full).tolist() if full else [])
            names = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            bands = [next(hashes) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["__id", "n_shingles", "name", "bands"],
            )

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(run, "__id bigint, n_shingles bigint, name binary, bands array<bigint>")


def full_sets(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)`` of the wanted nodes; ``wanted`` has (node, name, least), where least is an id with the set ``name``.

    Texts are not shuffled: the ids of the wanted ones are sent out as a bitmap, and the
    sets that pass it, a few too many, meet their names afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for _, texts in _small(batches, "__text"):
            sets = [s for s in shingles(texts) if len(s)]
            if sets:
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                names = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(offsets, np.concatenate(sets).view(np.int64))], ["name", "shingles"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    asked = with_chance(rows, F.col("__id"), key_bitmap(wanted, F.col("least")), "__asked").where("__asked").select("__text")
    found = asked.mapInArrow(run, "name binary, shingles array<bigint>")
    one = found.groupBy("name").agg(F.first("shingles").alias("shingles"))  # rows may repeat an id
    return one.join(wanted, "name").select("node", "shingles")


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """Label every node of ``(a, b)`` edges with the smallest node of its component.

    Alternating large- and small-star steps (Kiveris and others, 2014): each is one
    aggregate and one join on written edges, and the number of rounds grows with the
    logarithm of the graph's size. Columns ``node`` and ``label`` (roots do not appear).
    """
    spark = edges.sparkSession
    current, path = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest).distinct()
        after, new_path = written(small, "edges")
        discard(spark, path)
        current, path = after, new_path
        mark = tuple(current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")), path
        before = mark


def _able(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, n)`` of the nodes that may have a link.

    A node of n shingles, of which u are in no other node, shares at most n - u of them
    with any one, and a link takes ``percent`` of n. Counts are combined before the shuffle.
    """
    held = sets.select("node", F.explode("shingles").alias("s"))
    alone = held.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1")
    unshared = alone.groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    sizes = sets.select("node", F.size("shingles").alias("n"))
    return sizes.join(unshared, "node", "left").where(100 * (F.col("n") - F.coalesce("u", F.lit(0))) >= percent * F.col("n")).select("node", "n")


def _star(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compare ``(hub, node)`` pairs: differences both ways, and ``g``, which says how far they are from a link.

    Two sets are linked if (100 + p) * size of their difference <= (100 - p) * sum of their
    sizes; ``g`` is the part of that which is the node's, and a link to the hub is
    g <= (100 - p) * hub_n.
    """
    hubs = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("__h"))
    joined = pairs.join(sets.select("node", F.col("shingles").alias("__s")), "node").join(hubs, "hub")
    more, less = F.array_except("__s", "__h").alias("more"), F.array_except("__h", "__s").alias("less")
    found = joined.select("hub", "node", "score", "hub_score", F.size("__s").alias("n"), F.size("__h").alias("hub_n"), more, less)
    g = (100 + percent) * (F.size("more") + F.size("less")) - (100 - percent) * F.col("n")
    return found.withColumn("g", g).withColumn("linked", F.col("g") <= (100 - percent) * F.col("hub_n"))


def _gathered(star: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``star`` with fewer hubs: members of a hub that a better hub is near go to that one.

    The buckets of one group of near copies have many hubs, so a member has differences to
    many. Two members need to meet at one hub only, whichever it is, and all members of a
    hub move together. A hub moves to the best of its hubs that do not move themselves, so
    what a member's differences grow by is the distance of one hub to another near it.
    """
    near = star.where(F.col("linked") | (100 * (F.col("n") - F.size("more")) >= percent * F.col("n")))
    hubs = star.select(F.col("hub").alias("node")).distinct()
    ways = near.join(hubs, "node", "left_semi").select(F.col("node").alias("from"), F.col("hub").alias("to"), F.col("hub_score").alias("s"))
    ends = ways.join(ways.select(F.col("from").alias("to")).distinct(), "to", "left_anti")
    moved = ends.groupBy("from").agg(F.max(F.struct("s", "to")).alias("top")).select(F.col("from").alias("hub"), "top")
    pairs = star.select("hub", "node", "score", "hub_score").join(moved, "hub", "left")
    hub, score = F.coalesce("top.to", "hub").alias("hub"), F.coalesce("top.s", "hub_score").alias("hub_score")
    return _star(pairs.select(hub, "node", "score", score).where("hub <> node").distinct(), sets, percent)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``comp``, the component of ``node`` so far."""
    known = labels.select(F.col("node").alias("__x"), F.col("label").alias("__y"))
    return rows.join(known, rows["node"] == known["__x"], "left").withColumn("comp", F.coalesce("__y", "node")).drop("__x", "__y")


def _finer(star: DataFrame, percent: int) -> DataFrame:
    """Members of finer buckets: ``(hub, kind, x, node, comp, score)``.

    Of a hub's members that are still in several components, each is dealt to the buckets
    of its rarest differences to the hub, so many that it must meet every member of
    another component that it can be linked with:

    * members near the hub (it has ``percent`` of them) by all differences. A link between
      two takes (g + g') / 2 (100 + p) common differences, so each can leave out so many
      but one of its commonest, with the least g' there is. Members linked with the hub
      are of one component, so they need to meet the other near members only (kind 0),
      and these each other (kind 1).
    * with a member that is not near, by what is not in the hub: of such a member's own
      shingles, ``percent`` of n less those in the hub must be common. Near members have
      few shingles that are not in the hub and are dealt by all of them (kind 2).

    Differences that members of one component only have lead nowhere: what members of two
    share is held by both. They are counted, not dealt out.
    """
    most = F.ceil(F.col("n") * percent / 100).cast("int")
    near = F.col("n") - F.size("more") >= most
    ranked = star.withColumn("cls", F.when(F.col("linked"), 0).when(near, 1).otherwise(2))
    least = lambda c: F.min(F.when(F.col("cls") == c, F.col("g")))
    hubs = ranked.groupBy("hub").agg(
        (F.min("comp") < F.max("comp")).alias("mixed"), least(0).alias("g0"), least(1).alias("g1"), F.max("cls").alias("cls_most")
    ).where("mixed")
    members = ranked.join(hubs.drop("mixed"), "hub").withColumn("own", F.size("more"))
    own = F.transform("more", lambda x: F.struct(x.alias("x"), F.lit(True).alias("is_own")))
    lacks = F.transform("less", lambda x: F.struct(x.alias("x"), F.lit(False).alias("is_own")))
    dealt = F.explode(F.when(F.col("cls") == 2, own).otherwise(F.concat(own, lacks))).alias("d")
    each = members.select("hub", "node", "comp", dealt).select("hub", "node", "comp", "d.x", "d.is_own")
    common = each.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("c"), (F.min("comp") < F.max("comp")).alias("mixed")).where("mixed").drop("mixed")
    each = each.drop("comp")
    mine, mine_own = Window.partitionBy("hub", "node"), Window.partitionBy("hub", "node", "is_own")
    placed = each.join(common, ["hub", "x"]).select(
        "hub", "node", "x", "is_own",
        F.row_number().over(mine.orderBy("c", "x")).alias("at"), F.count(F.lit(1)).over(mine).alias("k"),
        F.row_number().over(mine_own.orderBy("c", "x")).alias("at_own"), F.count(F.lit(1)).over(mine_own).alias("k_own"),
    )
    facts = members.select("hub", "node", "score", "comp", "cls", "n", "g", "g0", "g1", "own", "cls_most")
    rows = placed.join(facts, ["hub", "node"])

    def within(other: str) -> Column:
        """Whether a difference is rare enough to be dealt by, with partners whose least g is ``other``."""
        takes = F.greatest(F.ceil((F.col("g") + F.col(other)) / (2 * (100 + percent))), F.lit(1))
        return F.coalesce(F.col("at") <= F.col("k") - takes + 1, F.lit(False))

    far = F.col("at_own") <= F.col("n") - most + 1 - (F.col("own") - F.col("k_own"))
    kinds = F.array(
        F.when(((F.col("cls") == 0) & within("g1")) | ((F.col("cls") == 1) & within("g0")), 0),
        F.when((F.col("cls") == 1) & within("g1"), 1),
        F.when((F.col("cls_most") == 2) & F.col("is_own") & ((F.col("cls") < 2) | far), 2),
    )
    return rows.select("hub", "x", "node", "comp", "score", "cls", F.explode(F.array_compact(kinds)).alias("kind"))


def _buckets(rows: DataFrame) -> DataFrame:
    """Finer buckets that hold a pair to compare, one of those with the same members, and the hub (``top``) of each."""
    found = rows.groupBy("hub", "kind", "x").agg(
        F.count(F.lit(1)).alias("c"), (F.min("comp") < F.max("comp")).alias("mixed"), F.min("cls").alias("cls0"), F.max("cls").alias("cls1"),
        F.bit_xor(F.xxhash64("node")).alias("s0"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s1"), F.max(F.struct("score", "node")).alias("top"),
    )
    useful = F.when(F.col("kind") == 0, (F.col("cls0") == 0) & (F.col("cls1") == 1)).when(F.col("kind") == 2, F.col("cls1") == 2).otherwise(True)
    one = found.where(F.col("mixed") & useful).groupBy("hub", "c", "s0", "s1").agg(F.min(F.struct("kind", "x")).alias("k"), F.min("top").alias("top"))
    return one.select("hub", "k.kind", "k.x", F.col("top.node").alias("top"), F.col("top.score").alias("top_score"))


def _compared(rows: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """Links between members of one finer bucket; pairs that are none do not leave the join."""
    held = star.select("hub", "node", "g", F.concat("more", "less").alias("d"))
    members = rows.join(_buckets(rows).drop("top", "top_score"), ["hub", "kind", "x"]).select("hub", "kind", "x", "node", "comp").join(held, ["hub", "node"])
    one = members.select("hub", "kind", "x", *(F.col(c).alias(f"{c}_a") for c in ("node", "comp", "g", "d")))
    two = members.select("hub", "kind", "x", *(F.col(c).alias(f"{c}_b") for c in ("node", "comp", "g", "d")))
    takes = F.col("g_a") + F.col("g_b")
    enough = lambda common: 2 * (100 + percent) * common >= takes
    linked = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b"))
    linked &= enough(F.least(F.size("d_a"), F.size("d_b"))) & enough(F.size(F.array_intersect("d_a", "d_b")))
    both = one.join(two, ["hub", "kind", "x"]).where(linked)
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (least id reachable by links), ``kept``.

    Words are runs of bytes other than ASCII white space, with A-Z lowered. Rows without
    words (null, empty and blank texts) are linked with nothing. Rows that repeat an id are
    each a document, and of a component's rows with the least id each is ``kept``; a null id
    counts as larger than any other, so a component of null ids only has a null
    component_id. An empty table gives no rows. Runs Spark jobs at once; its intermediate
    tables are written to the shared folder, and those that the result reads stay there. A
    ``percent`` that the bands cannot serve is refused.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}; {BANDS} bands of {BAND_BINS} bins serve {LEAST_PERCENT} to 100")
    scratch: list[str] = []

    def kept(rows: DataFrame, name: str) -> DataFrame:
        out, path = written(rows, name)
        scratch.append(path)
        return out

    def of_star(star: DataFrame) -> DataFrame:
        return star.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))

    sketch, _ = written(sketches(df, id_col, text_col), "sketches")
    named = sketch.where(F.col("name").isNotNull()).groupBy("name").agg(F.min("__id").alias("least"), F.first("bands").alias("bands"))
    nodes = kept(named.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written, so the numbers stay

    # documents that share a bucket and may have a link
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg((F.min("node") < F.max("node")).alias("shared")).where("shared").select("bucket")
    live = kept(members.join(shared, "bucket"), "buckets")
    wanted = nodes.select("node", "name", "least").join(live.select("node").distinct(), "node", "left_semi")
    sets = kept(full_sets(df, id_col, text_col, wanted), "sets")
    able = kept(_able(sets, percent), "able")
    live = live.join(able.select("node"), "node")
    live = kept(live.join(live.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket"), "buckets")

    # a star in every bucket; a document in many and large buckets is close to many: it makes the best hub
    scored = live.join(live.groupBy("node").agg(F.sum("size").alias("score")), "node").select("bucket", "node", "score")
    hubs = scored.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("top"))
    hubs = hubs.select("bucket", F.col("top.node").alias("hub"), F.col("top.score").alias("hub_score"))
    pairs = scored.join(hubs, "bucket").where("node <> hub").select("hub", "node", "score", "hub_score").distinct()
    star = kept(_star(pairs, sets, percent), "star")
    links = of_star(star)
    star = kept(_gathered(star, sets, percent), "star")
    labels, path = components(links.union(of_star(star)))
    scratch.append(path)

    # a star in every finer bucket
    rows = kept(_finer(_labelled(star, labels), percent), "finer")
    pairs = rows.join(_buckets(rows), ["hub", "kind", "x"]).where("node <> top")
    pairs = pairs.select(F.col("top").alias("hub"), "node", "score", F.col("top_score").alias("hub_score")).distinct()
    star = kept(_star(pairs, sets, percent), "star")
    known = labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(of_star(star))
    star = kept(_gathered(star, sets, percent), "star")
    labels, path = components(known.union(of_star(star)))
    scratch.append(path)

    # what is left in still finer ones
    star = _labelled(star, labels)
    links = kept(_compared(kept(_finer(star, percent), "finer"), star, percent), "links")
    known = labels.select(F.col("label").alias("a"), F.col("node").alias("b"))
    labels, path = components(known.union(links))
    scratch.append(path)

    of_node = labels.union(labels.select("label", "label").distinct()).join(nodes.select("node", "name", "least"), "node")
    smallest = of_node.groupBy("label").agg(F.min("least").alias("component"))
    joined, _ = written(of_node.join(smallest, "label").select("name", "component"), "components")
    least = nodes.select("name", "least").join(joined, "name", "left").select("name", F.coalesce("component", "least").alias("component"))
    least, _ = written(least, "components")
    discard(df.sparkSession, *scratch)
    return sketch.join(least, "name", "left").select(
        F.col("__id").alias(id_col),
        "n_shingles",
        F.when(F.col("name").isNull(), F.col("__id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("name").isNull(), True).otherwise(F.col("__id").eqNullSafe(F.col("component"))).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose document stays, with its own columns, whatever they are called.

    Of a component the rows with the least id stay: one, unless rows repeat an id. Null,
    empty and blank texts all stay. An empty table gives no rows. Runs Spark jobs at once.
    """
    key = free_name(df, "__kept")
    kept = near_duplicates(df.select(id_col, text_col), id_col, text_col, percent).where("kept").select(F.col(id_col).alias(key))
    return df.join(kept, df[id_col].eqNullSafe(kept[key]), "left_semi")
