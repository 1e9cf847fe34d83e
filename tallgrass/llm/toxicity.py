"""Operator 12: toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

1. Every text becomes the set of hashed character n-grams of its different
   words, edges marked, and of those that they hold more than once.  Over all labelled documents that are not held out, Spark counts the
   toxic and the other documents that hold each n-gram.
2. The log-count ratio of an n-gram is its weight in a naive Bayes classifier.
   N-grams that are too rare, or whose ratio is too small to tell, are left out.
3. A logistic regression on these features, each scaled by its ratio, is
   trained with elastic-net penalties on a bounded sample of the labelled
   documents, a fifth of which is kept apart to calibrate its scores.
4. Every whole text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, staged, table, text_rows

BUCKETS, GRAMS = 1 << 20, (2, 3, 4, 5, 6)
WORD = re.compile(r"\w+")
#: Documents that must hold an n-gram, the log-count ratio that it must reach, and most n-grams that are features (by ratio).
MIN_DOCS, MIN_RATIO, FEATURES = 3, 1.0, 200_000
#: Bound of the training sample: documents of each label.
SAMPLE_EACH = 4_000
L1, L2, STEPS, INTERPOLATION = 2e-4, 1e-3, 400, 0.25
THRESHOLD = 0.3
#: Places that are worked on at a time; numbers of the hash.
BLOCK = 1 << 18
_FACTOR, _LAST, _SHIFT = np.uint32(668265263), np.uint32(2654435761), np.uint32(32 - (BUCKETS.bit_length() - 1))
OUT = "doc_id long, held_out boolean, score double, predicted int"


def grams(text: str) -> np.ndarray:
    """Buckets of the n-grams of the different words of a whole text in lower case, edges marked; as often as they are met."""
    words = set(WORD.findall(text.lower()))
    if not words:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    ends = np.flatnonzero(codes == ord(">"))
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(codes)) + 1  # characters up to the end of the word
    out, most = [], max(GRAMS)
    for at in range(0, len(codes), BLOCK):
        part, room = codes[at : at + BLOCK + most - 1], left[at : at + BLOCK]
        mixed = np.zeros(len(room), np.uint32)
        for n in range(1, most + 1):
            # where fewer characters are left, what is read is not kept
            mixed = mixed[: max(0, len(part) - n + 1)] ^ part[n - 1 : n - 1 + len(mixed)]
            mixed *= _FACTOR
            mixed ^= mixed >> np.uint32(15)
            if n in GRAMS:
                out.append((mixed[room[: len(mixed)] >= n] * _LAST) >> _SHIFT)
    return np.concatenate(out)


@dataclass
class Places:
    """Which feature of the n-grams is which of a model (-1: none), and buckets that have one."""

    at: np.ndarray
    asked: np.ndarray

    @staticmethod
    def of(buckets: np.ndarray) -> Places:
        at = np.full(2 * BUCKETS, -1, np.int32)
        at[buckets] = np.arange(len(buckets))
        return Places(at, (at.reshape(-1, 2) >= 0).any(axis=1))


def features(text: str, place: Places | None = None) -> np.ndarray:
    """The features of a whole text, each once: for each n-gram that its different words hold it (twice its bucket), and that they hold it again (one more).

    Only those of a model, if its places are given.
    """
    found = grams(text)
    if place is not None:
        found = found[place.asked[found]]
    once, n = np.unique(found, return_counts=True)
    at = np.concatenate([2 * once, 2 * once[n > 1] + 1]).astype(np.int64)
    if place is None:
        return at
    at = place.at[at]
    return np.sort(at[at >= 0])


@dataclass
class Model:
    """Weights of features by bucket, already scaled by their ratios; without features every score is ``prior``."""

    place: Places = field(default_factory=lambda: Places.of(np.zeros(0, np.int64)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offset: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0

    def score(self, text: str) -> float:
        if not len(self.weights):
            return self.prior
        return float(logistic(self.slope * (self.weights[features(text, self.place)].sum() + self.offset) + self.shift))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out() -> Column:
    """Documents whose labels nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` (0 or 1) of the documents to learn from; of rows that differ, 1. Other values are no labels."""
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = some.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return some.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def gram_counts(learn: DataFrame) -> DataFrame:
    """``bucket, toxic, other``: the documents of either label that have a feature; bucket -1 has all documents. ``learn`` has text and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2 * BUCKETS + 1), np.int32)
        for b in batches:
            for text, y in zip(b["text"], b["toxic"].to_pylist(), strict=True):
                at = features(text.as_py())
                n[1 - y, at] += 1
                n[1 - y, -1] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == 2 * BUCKETS, -1, at), pa.int32()), pa.array(n[0, at], pa.int64()), pa.array(n[1, at], pa.int64())], ["bucket", "toxic", "other"])

    parts = learn.select("text", "toxic").mapInArrow(run, "bucket int, toxic long, other long")
    return parts.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def ratios(counts: DataFrame, most: int = FEATURES) -> DataFrame:
    """``bucket, ratio``: naive Bayes log-count ratios, smoothed by 1, of the n-grams that tell."""
    grams = counts.where(F.col("bucket") >= 0)
    total = grams.agg((F.sum("toxic") + F.count("*")).alias("_t"), (F.sum("other") + F.count("*")).alias("_o"))
    ratio = F.log((F.col("toxic") + 1) / F.col("_t")) - F.log((F.col("other") + 1) / F.col("_o"))
    told = grams.crossJoin(F.broadcast(total)).select("bucket", (F.col("toxic") + F.col("other")).alias("docs"), ratio.alias("ratio"))
    return told.where((F.col("docs") >= MIN_DOCS) & (F.abs("ratio") >= MIN_RATIO)).orderBy(F.abs("ratio").desc(), "bucket").limit(most).select("bucket", "ratio")


def drawn(known: DataFrame, each: int) -> DataFrame:
    """Of each label the ``each`` documents whose ids have the smallest hashes: a bounded table of ids."""
    hashed = known.select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(31)).alias("h"))
    some = [hashed.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(each) for y in (0, 1)]
    return some[0].union(some[1]).select("doc_id", "toxic")


def fitted(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights, scaled by the ratios, and an offset: accelerated proximal steps on the log loss with both penalties; examples count so that the labels weigh as in the corpus."""
    sizes = np.array([len(r) for r in rows])
    doc, at = np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.zeros(0, np.int64), *rows])
    scale = np.abs(ratio).max()
    x = ratio[at] / scale
    weight = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y == 0).sum()))
    w, u, b, c, t = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0, 1.0
    # the curvature of the loss is bounded by that of its rows
    rate = 1 / (0.25 * (weight * np.bincount(doc, x * x + 1, len(rows))).sum() + L2)
    for _ in range(STEPS):
        g = weight * (logistic(np.bincount(doc, x * u[at], len(rows)) + c) - y)
        new = u - rate * (np.bincount(at, x * g[doc], len(ratio)) + L2 * u)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
        new_b, new_t = c - rate * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    # towards plain naive Bayes, whose weights are all alike
    live = w != 0
    w = np.where(live, (1 - INTERPOLATION) * w + INTERPOLATION * np.abs(w[live]).mean() if live.any() else 0, 0)
    return w * ratio / scale, b


def calibrated(z: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps, each label with the weight that it has in the corpus."""
    a, b = 1.0, 0.0
    some, none = (y > 0).sum(), (y == 0).sum()
    goal = np.where(y > 0, (some + 1) / (some + 2), 1 / (none + 2))
    weight = np.where(y > 0, prior / max(1, some), (1 - prior) / max(1, none)) * len(y)
    for _ in range(50):
        p = logistic(a * z + b)
        v, g = weight * (p * (1 - p) + 1e-6), weight * (p - goal)
        step = np.linalg.solve([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]], [(g * z).sum(), g.sum()])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -3, 3)
    return float(max(a, 1e-3)), float(b)


def trained(sample: list[tuple[np.ndarray, int]], buckets: np.ndarray, ratio: np.ndarray, prior: float, seed: int = 0) -> Model:
    """A model of the sampled documents (places, label); every fifth calibrates only."""
    y = np.array([label for _, label in sample], float)
    apart = np.zeros(len(y), bool)
    for label in (0, 1):
        apart[np.random.default_rng(seed + label).permutation(np.flatnonzero(y == label))[::5]] = True
    if not len(ratio) or not 0 < y.sum() < len(y) or not 0 < y[~apart].sum() < (~apart).sum():
        return Model(prior=prior)
    w, b = fitted([r for (r, _), a in zip(sample, apart, strict=True) if not a], y[~apart], ratio, prior)
    z = np.array([w[r].sum() + b for (r, _), a in zip(sample, apart, strict=True) if a])
    slope, shift = calibrated(z, y[apart], prior)
    live = np.flatnonzero(w)
    return Model(Places.of(buckets[live]), w[live], b, slope, shift, prior)


def fit(docs: DataFrame, labels: DataFrame, sample_each: int = SAMPLE_EACH) -> Broadcast:
    """A model of the labelled documents that are not held out: ratios from all of them, weights from at most ``sample_each`` of each label."""
    spark, known = docs.sparkSession, staged(known_labels(labels), "known-labels")
    named = text_rows(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()))
    counts = staged(gram_counts(named.join(known.hint("shuffle_hash"), "doc_id")), "gram-counts")
    total = counts.where(F.col("bucket") < 0).first()
    prior = total["toxic"] / (total["toxic"] + total["other"]) if total else 0.0
    told = ratios(counts).toPandas().sort_values("bucket")
    buckets, ratio = told["bucket"].to_numpy(np.int64), told["ratio"].to_numpy(float)
    place = spark.sparkContext.broadcast(Places.of(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield arrow_rows(arrow_schema("doc_id long, toxic int, at array<int>"), [(i, y, features(t.as_py(), place.value).tolist()) for i, y, t in zip(b["doc_id"].to_pylist(), b["toxic"].to_pylist(), b["text"], strict=True)])

    ids = spark.createDataFrame(drawn(known, sample_each).collect(), "doc_id long, toxic int")  # 2 * sample_each rows at most
    sample = named.join(F.broadcast(ids), "doc_id").mapInArrow(run, "doc_id long, toxic int, at array<int>").dropDuplicates(["doc_id"])
    rows = sorted((tuple(r["at"]), r["toxic"], r["doc_id"]) for r in sample.collect())
    seen = dict.fromkeys((at, y) for at, y, _ in rows)  # copies count once
    return spark.sparkContext.broadcast(trained([(np.array(at, np.int64), y) for at, y in seen], buckets, ratio, prior))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_each: int = SAMPLE_EACH) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; ``labels`` has ``doc_id`` and ``toxic``.

    A null text is scored as an empty one, whose score is that of a text without
    features.  Without a label, or with labels of one kind, every score is the
    share of toxic labels (0 without any).  A null id is not held out and not
    learnt from; of rows that repeat an id all count towards the ratios and one
    is a sample; repeated rows return as they are, an empty table gives an empty
    one, other columns are dropped.
    """
    model = fit(docs, labels, sample_each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [model.value.score(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return text_rows(docs, held_out().alias("held_out")).mapInArrow(run, OUT)


def op12_bayes_scaled_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
