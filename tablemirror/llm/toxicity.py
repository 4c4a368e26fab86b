"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are the densities of abusive words, how near they stand to a word
of the second person, and the rates of capitals, punctuation and obfuscated spellings.
Abusive words come from a short public list and from the labelled rows: words and word
beginnings that are many times as common in toxic rows as in others.

Trees see only features whose word weights came from other rows: the labelled rows are
halved, each half is featured with the words learned on the other, one half grows the
trees and the other calibrates them. The final words come from both halves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.llm.chunks import Memo, release, text_batches
from tablemirror.llm.common import discard, replaced, written

#: At most about so many labelled rows are learned from, chosen by a hash of their id.
MOST_LABELLED = 20_000
#: At most so many words and beginnings are learned, the strongest first; a bound on what is sent to all executors.
MOST_WORDS = 5_000
#: A learned word is at least so many times as common in toxic rows (natural logarithm).
LEAST_WEIGHT = 2.0

#: Common insults in English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash clown pathetic disgusting worthless garbage imbecile "
    "bastard bitch asshole fuck fucking shit crap retard whore slut pig freak "
    "dumm dummkopf trottel arschloch scheisse scheiße abschaum versager widerlich wertlos schwein "
    "connard connasse salaud salope débile crétin merde ordure imbécile stupide "
    "idiota imbécil estúpido estúpida basura escoria mierda cabrón puta tonto asqueroso".split()
)
#: Words of the second person in the same languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deiner ihr euch euer tu toi ton tes vous votre vos tú ti "
    "tus usted ustedes vosotros".split()
)
_WORD = re.compile(r"[^\W\d_]+")
#: Begins only where a run of letters does and gives nothing back, so the time is linear in long words too.
_MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[\d@$!*#+|.\-_]++[^\W\d_]++)++")
#: What stands for letters in masked words.
_UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
#: Words whose weights a worker remembers.
MEMO_WORDS = 150_000
_BEGINNINGS = (4, 5, 6)
_NEAR = 5

FEATURES = (
    "learned_density", "learned_words", "learned_most", "learned_sum", "listed_density", "near_second_person",
    "second_person", "capitals", "capital_words", "punctuation", "exclamations", "masked", "masked_hits", "stretched",
    "digits", "length",
)
#: The features' columns, named so that they meet no column of a caller.
_COLUMNS = [f"__feature_{name}" for name in FEATURES]


def keys_of(word: str) -> list[str]:
    """What a word is looked up by: itself, and its beginnings (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in _BEGINNINGS if len(word) >= n)]


class Features:
    """Feature vectors by given word weights."""

    def __init__(self, weights: dict[str, float]):
        get = weights.get
        self.weight = Memo(lambda w: max((get(k, 0.0) for k in keys_of(w)), default=0.0) if len(w) > 2 else 0.0, MEMO_WORDS)

    def __call__(self, text: str) -> list[float]:
        lowered = text.lower()
        words = _WORD.findall(lowered)
        n = max(len(words), 1)
        weights = np.fromiter(map(self.weight.__getitem__, words), np.float64, len(words))
        hits = np.flatnonzero(weights)
        second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], np.int64)
        near = 0
        if len(hits) and len(second):
            right = np.searchsorted(second, hits)
            after = second[np.minimum(right, len(second) - 1)]
            before = second[np.maximum(right - 1, 0)]
            near = int((np.minimum(abs(after - hits), abs(hits - before)) <= _NEAR).sum())
        data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
        size = max(int(data.sum()), 1)
        upper = int(data[65:91].sum())
        letters = max(upper + int(data[97:123].sum()), 1)
        punctuation = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
        masked = _MASKED.findall(lowered)
        unmasked = 0
        for m in masked:
            plain = _NOT_LETTERS.sub("", m.translate(_UNMASK))
            unmasked += plain in INSULTS or self.weight[plain] > 0
        return [
            100.0 * len(hits) / n,
            float(len({words[i] for i in hits})),
            float(weights.max(initial=0.0)),
            100.0 * float(weights.sum()) / n,
            100.0 * sum(w in INSULTS for w in {*words}) / n,
            near / max(len(hits), 1),
            100.0 * len(second) / n,
            upper / letters,
            sum(w.isupper() and len(w) > 2 for w in text.split()) / n if upper > 3 else 0.0,
            punctuation / size,
            100.0 * int(data[33] + data[63]) / size,
            100.0 * len(masked) / n,
            float(unmasked),
            100.0 * len(_STRETCHED.findall(lowered)) / n,
            100.0 * int(data[48:58].sum()) / size,
            math.log1p(len(words)),
        ]


def with_features(df: DataFrame, text_col: str, weights: list[dict[str, float]], choice: str | None = None) -> DataFrame:
    """Append the feature columns; ``choice`` names a column with the index of the weights to use."""
    df = replaced(df, *_COLUMNS)
    schema = T.StructType([*df.schema.fields, *(T.StructField(f, T.DoubleType()) for f in _COLUMNS)])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        release()
        own = [Features(w) for w in weights]
        for batch, texts in text_batches(batches, text_col):
            which = batch.column(choice).to_pylist() if choice else [0] * len(texts)
            table = np.array([own[i](t) for i, t in zip(which, texts, strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in table.T)], [*names, *_COLUMNS])

    return df.mapInArrow(run, schema)


def word_counts(labelled: DataFrame) -> DataFrame:
    """Rows with each word or beginning: ``key`` and toxic and clean counts in both halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]

        def out() -> pa.RecordBatch:
            keys = list(set().union(*counts))
            columns = [pa.array([c[k] for k in keys], pa.int64()) for c in counts]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *columns], ["key", "t0", "n0", "t1", "n1"])

        for batch, texts in text_batches(batches, "__text"):
            halves, toxic = batch.column("__half").to_pylist(), batch.column("__toxic").to_pylist()
            for text, half, label in zip(texts, halves, toxic, strict=True):
                seen = {k for w in set(_WORD.findall(text.lower())) if len(w) > 2 for k in keys_of(w)}
                counts[2 * half + (0 if label else 1)].update(seen)
            if sum(map(len, counts)) > 400_000:  # hand on what has been counted
                yield out()
                counts = [Counter() for _ in range(4)]
        yield out()

    parts = labelled.select("__text", "__half", "__toxic").mapInArrow(run, "key string, t0 bigint, n0 bigint, t1 bigint, n1 bigint")
    return parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("t0", "n0", "t1", "n1")))


@dataclass
class ToxicityModel:
    """Word weights, trees and calibration; without both labels a constant."""

    weights: dict[str, float]
    trees: Any
    calibration: Any
    constant: float = 0.0

    def score(self, df: DataFrame, text_col: str = "text", out: str = "toxicity") -> DataFrame:
        """``df`` and one more column: the calibrated score, 0 to 1. A map over rows; null counts as empty.

        Columns of the caller stay as they are, but for one called ``out``.
        """
        df = replaced(df, out)
        if self.trees is None:
            return df.withColumn(out, F.lit(self.constant))
        names = [f"`{c}`" for c in df.columns]
        featured = with_features(df, text_col, [self.weights])
        scored = self.calibration.transform(_raw(self.trees, featured))
        return scored.select(*names, F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0)).alias(out))


# Spark ML is imported where the driver uses it: the workers that make features need none of it, and it is half of their memory


def _raw(trees: Any, featured: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=_COLUMNS, outputCol="__vector").transform(featured)
    return trees.transform(vectors).withColumn("__raw", vector_to_array("__probability")[1])


def fit(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_labelled: int = MOST_LABELLED,
    seed: int = 17,
    most_words: int = MOST_WORDS,
) -> ToxicityModel:
    """Learn from the rows of ``df`` that ``labels`` (id, label 0 or 1) names.

    If there are more labelled rows than ``most_labelled``, that share of them is taken by
    a hash of the id. So the labels that are sent to all executors and the rows learned
    from are bounded. Rows with a null label are left out; of an id labelled more than
    once the largest label counts. Without both labels in both halves of the rows (an empty
    table, no labels) the model is the constant share of toxic rows, 0 without rows. Null
    texts count as empty; rows that repeat an id are each learned from.
    """
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__toxic"))
    )
    n = known.count()
    if n > most_labelled:
        parts = 1 << 20
        known = known.where(F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(parts)) < int(parts * most_labelled / n))
    half = F.pmod(F.xxhash64(F.lit(seed + 1), "__id"), F.lit(2)).cast("int")
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    labelled, labelled_path = written(rows.join(F.broadcast(known), "__id").withColumn("__half", half), "labelled")
    sizes = {(r["__half"], r["__toxic"]): r["count"] for r in labelled.groupBy("__half", "__toxic").count().collect()}
    total = sum(sizes.values())
    toxic = {h: sizes.get((h, 1), 0) for h in (0, 1)}
    clean = {h: sizes.get((h, 0), 0) for h in (0, 1)}
    if not all(toxic.values()) or not all(clean.values()):
        discard(df.sparkSession, labelled_path)
        return ToxicityModel({}, None, None, sum(toxic.values()) / total if total else 0.0)

    t, m = F.col("t0") + F.col("t1"), F.col("n0") + F.col("n1")
    odds = F.log((t + 0.5) / (sum(toxic.values()) + 1)) - F.log((m + 0.5) / (sum(clean.values()) + 1))
    strong = word_counts(labelled).where((t >= 2) & (odds >= LEAST_WEIGHT / 2)).orderBy((odds * F.log1p(t)).desc(), "key").limit(most_words)
    found = strong.collect()

    def weights(halves: tuple[int, ...]) -> dict[str, float]:
        tox, cln = sum(toxic[h] for h in halves), sum(clean[h] for h in halves)
        out = {}
        for r in found:
            a, b = sum(r[f"t{h}"] for h in halves), sum(r[f"n{h}"] for h in halves)
            weight = math.log((a + 0.5) / (tox + 1)) - math.log((b + 0.5) / (cln + 1))
            if a >= 1 + len(halves) and weight >= LEAST_WEIGHT:
                out[r["key"]] = weight
        return out

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    # half 0 is featured with the words of half 1, and the other way round
    featured, featured_path = written(with_features(labelled, "__text", [weights((1,)), weights((0,))], "__half").drop("__text"), "featured")
    featured = featured.coalesce(6).withColumn("__label", F.col("__toxic").cast("double"))
    vectors = VectorAssembler(inputCols=_COLUMNS, outputCol="__vector").transform(featured.where("__half = 0"))
    boosting = GBTClassifier(
        featuresCol="__vector", labelCol="__label", predictionCol="__predicted", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, seed=seed
    )
    trees = boosting.setProbabilityCol("__probability").setRawPredictionCol("__margin").fit(vectors)
    raw = _raw(trees, featured.where("__half = 1")).select("__raw", "__label")
    calibration = IsotonicRegression(featuresCol="__raw", labelCol="__label", predictionCol="__score").fit(raw)
    discard(df.sparkSession, labelled_path, featured_path)
    return ToxicityModel(weights((0, 1)), trees, calibration)
