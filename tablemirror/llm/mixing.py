"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source weights are token shares raised to an exponent and normalised. The exponent is
bisected until the weights have the wanted entropy, or until no source has to be repeated
more often than allowed. The weights are then realised as block permutations: each pass
over a source reads it in a pseudo-random order of hash blocks, and the last pass stops
where the source's token budget is spent.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemirror.llm.common import discard, replaced, written

#: Hash values are 60-bit numbers, so that products and comparisons stay inside a bigint.
_HASH_RANGE = 1 << 60
#: The exponents of this many bisection levels are evaluated in one pass over the sources.
_LEVELS = 4


@dataclass(frozen=True)
class MixPlan:
    """``sources``: one row per source with its tokens, weight, budget, whole passes, rest and blocks."""

    exponent: float
    sources: DataFrame
    path: str


def word_tokens(text: Column) -> Column:
    """The token measure used by default: words between ASCII white space; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_hash(row_id: Column, pass_no: Column, seed: int) -> Column:
    """60 bits of an MD5 over seed, pass and id: a row's place in one pass's permutation."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), pass_no.cast("string"), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _entropy_and_repeats(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """Entropy of the weights, and the most passes over a source, for each exponent: one small row."""
    parts = []
    for i, a in enumerate(exponents):
        raised = F.pow(F.col("share"), F.lit(a))
        parts += [
            F.sum(raised).alias(f"z{i}"),
            F.sum(raised * F.lit(a) * F.log("share")).alias(f"l{i}"),
            (F.max(raised / F.col("share")) / F.min(raised / F.col("share"))).alias(f"r{i}"),
        ]
    row = totals.agg(*parts).first()
    return [(math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"], row[f"r{i}"]) for i in range(len(exponents))]


def bisect_exponent(totals: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The smallest exponent in [0, 1] that obeys both limits.

    Entropy and repetition both fall as the exponent rises, so each limit holds above some
    point. ``target_entropy`` (nats) asks for weights no flatter than that;
    ``max_repeats`` for at most so many passes over any source. 32 bisection levels.
    """
    fits = lambda found: (target_entropy is None or found[0] <= target_entropy + 1e-12) and (
        max_repeats is None or found[1] <= max_repeats * (1 + 1e-9)
    )
    low, high = 0.0, 1.0
    if fits(_entropy_and_repeats(totals, [0.0])[0]):
        return 0.0
    for _ in range(32 // _LEVELS):
        step = (high - low) / (1 << _LEVELS)
        points = [low + step * i for i in range(1, 1 << _LEVELS)]
        found = dict(zip(points, _entropy_and_repeats(totals, points), strict=True))
        for _ in range(_LEVELS):
            middle = min(points, key=lambda p: abs(p - (low + high) / 2))
            low, high = (low, middle) if fits(found[middle]) else (middle, high)
    return round(high, 9)


def plan_mix(
    df: DataFrame,
    source_col: str,
    tokens: Column,
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget_tokens: int | None = None,
) -> MixPlan:
    """Weights, budgets and passes of every source.

    Without ``budget_tokens`` the budget is the smallest one that reads every source at
    least once, so nothing is lost and the flattened sources are repeated. A null source
    is a source of its own. Sources without tokens get weight 0 and one whole pass.
    """
    totals = df.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("rows")
    )
    totals, path = written(totals, "mix-totals")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    if not all_tokens:
        flat = totals.select(
            "source", "tokens", "rows", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"),
            F.lit(1).alias("passes"), F.lit(0).cast("long").alias("rest"), F.lit(1).cast("long").alias("blocks"),
        )
        return MixPlan(1.0, flat, path)
    shares = totals.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(all_tokens))
    exponent = bisect_exponent(shares, target_entropy, max_repeats)
    raised = F.pow(F.col("tokens") / F.lit(all_tokens), F.lit(exponent))
    facts = shares.agg(F.sum(F.pow("share", F.lit(exponent))), F.max(F.col("share") / F.pow("share", F.lit(exponent)))).first()
    scale = facts[0]
    budget = float(budget_tokens) if budget_tokens is not None else facts[1] * scale * all_tokens
    weight = F.when(F.col("tokens") > 0, raised / F.lit(scale)).otherwise(F.lit(0.0))
    # only the weight that is shown is rounded, since a small source's would become 0
    least = 0 if budget_tokens is not None else 1
    sources = (
        totals.withColumn("weight", F.round(weight, 9))
        .withColumn("budget", F.greatest(F.round(weight * F.lit(budget)).cast("long"), F.lit(0).cast("long")))
        # a budget within a millionth of a whole pass is one
        .withColumn("__ratio", F.when(F.col("tokens") > 0, F.round(F.col("budget") / F.col("tokens"), 6)).otherwise(F.lit(1.0)))
        .withColumn("passes", F.greatest(F.floor("__ratio").cast("int"), F.lit(least)))
        .withColumn(
            "rest",
            F.when(F.col("__ratio") > F.col("passes"), F.greatest(F.col("budget") - F.col("passes") * F.col("tokens"), F.lit(0))).otherwise(F.lit(0)).cast("long"),
        )
        .withColumn("blocks", F.ceil(F.sqrt(F.col("rows"))).cast("long"))
        .drop("__ratio")
    )
    return MixPlan(exponent, sources, path)


def mix_schedule(df: DataFrame, id_col: str, source_col: str, tokens: Column, plan: MixPlan, seed: int = 0) -> DataFrame:
    """One row per scheduled reading of a row.

    Columns: id, ``source``, ``n_tokens``, ``weight``, ``pass`` (from 0), ``block``,
    ``tokens_before`` (of its source, over all passes) and ``mix_position``: the middle of
    the row as a fraction of its source's scheduled tokens. Any prefix of the rows in
    order of ``mix_position`` holds the sources in the target proportions.

    A source may hold a third of all rows: its pass is cut into about sqrt(rows) hash
    blocks; sums run over the blocks of a source and over the rows of a block, never over
    all rows of a source. In the last, partial pass the row that crosses the budget is
    the last one taken. Rows that repeat an id are scheduled one by one.
    """
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{source_col}`").alias("source"), tokens.alias("n_tokens"))
    known = plan.sources.withColumnRenamed("source", "__source")
    planned = rows.join(known, rows["source"].eqNullSafe(known["__source"])).drop("__source")
    wanted = (
        planned.where("passes > 0 OR rest > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1))))
        .withColumn("__h", order_hash(F.col(id_col), F.col("pass"), seed))
        .withColumn("block", F.floor(F.col("__h") / (F.lit(_HASH_RANGE) / F.col("blocks"))).cast("long"))
    )
    in_block = wanted.groupBy("source", "pass", "block").agg(F.sum("n_tokens").alias("__sum"))
    earlier = Window.partitionBy("source", "pass").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_block.select(
        F.col("source").alias("__s"), F.col("pass").alias("__p"), F.col("block").alias("__b"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy("source", "pass", "block").orderBy("__h", F.col(id_col), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        wanted.withColumn("__within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("pass") == F.col("__p")) & (F.col("block") == F.col("__b")))
        .withColumn("__before", F.col("__start") + F.col("__within"))
        .where((F.col("pass") < F.col("passes")) | (F.col("__before") < F.col("rest")))
    )
    whole = F.greatest(F.col("passes") * F.col("tokens") + F.col("rest"), F.lit(1))
    before = F.col("pass") * F.col("tokens") + F.col("__before")
    return placed.select(
        id_col, "source", "n_tokens", "weight", "pass", "block", before.cast("long").alias("tokens_before"),
        F.round((before + F.col("n_tokens") / 2) / whole, 9).alias("mix_position"), F.col("__h").alias("order_hash"),
    )


def mix_rows(
    df: DataFrame,
    id_col: str,
    source_col: str,
    tokens: Column,
    target_entropy: float | None = None,
    max_repeats: float | None = 2.0,
    budget_tokens: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """The mixed rows themselves, with the columns of ``df``: each row as often as it is scheduled.

    Only the last pass over a source is partial, and it is a prefix of that pass's hash
    order. So one hash bound a source decides for every row, and texts are not shuffled.
    Null, empty and repeated rows are rows like others; a null source is a source of its
    own; rows with one id come in or stay out of the partial pass together. An empty table
    gives no rows.
    """
    plan = plan_mix(df, source_col, tokens, target_entropy, max_repeats, budget_tokens)
    last = mix_schedule(df, id_col, source_col, tokens, plan, seed)
    cuts = last.groupBy("source", "pass").agg(F.max("order_hash").alias("__cut"))
    known = plan.sources.select(F.col("source").alias("__source"), "passes", "rest")
    bounds = (
        known.join(cuts, known["__source"].eqNullSafe(cuts["source"]) & (known["passes"] == cuts["pass"]), "left")
        .select("__source", F.col("passes").alias("__passes"), F.when(F.col("rest") > 0, F.col("__cut")).alias("__cut"))
    )
    bounds, _ = written(bounds, "mix-bounds")
    discard(df.sparkSession, plan.path)
    names = [f"`{c}`" for c in df.columns]
    part = order_hash(F.col(f"`{id_col}`"), F.col("__passes"), seed) <= F.col("__cut")
    return (
        replaced(df, "__source", "__passes", "__cut")
        .join(bounds, F.col(f"`{source_col}`").eqNullSafe(F.col("__source")))
        .withColumn("__times", F.col("__passes") + F.coalesce(part.cast("int"), F.lit(0)))
        .where("__times > 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
        .select(*names)
    )
