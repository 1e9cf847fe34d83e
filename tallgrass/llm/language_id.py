"""Operator 6: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all learning documents.  The weights are
trained with follow-the-regularised-leader and elastic-net penalties on a
bounded, stratified sample, a fifth of which is kept apart to fit the
temperature that calibrates the scores.  Every whole text is then predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BUCKETS, GRAMS = 1 << 15, (1, 2, 3)
#: Characters of a text whose n-grams are sorted rather than counted into all buckets.
FEW = 4_000
#: Bounds of the training sample: documents in all (but 50 of each language), and languages.
#: Documents beyond so many characters are drawn only where a language has too few others.
SAMPLE_DOCS, MOST_LANGS, SAMPLE_CHARS = 3_000, 200, 50_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 2
UNKNOWN = "und"
_FACTORS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of a whole text in lower case, and how often each is met."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    shift, found = np.uint32(32 - (buckets.bit_length() - 1)), []
    for n in GRAMS:
        if len(codes) >= n:
            mixed = np.full(len(codes) - n + 1, n * 374761393 & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                mixed ^= codes[k : len(codes) - n + 1 + k] * _FACTORS[k]
                mixed *= np.uint32(668265263)
            found.append(mixed >> shift)
    if len(codes) < FEW:  # sorting a few is cheaper than a count of all buckets
        at, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return at.astype(np.int64), n
    total = sum(np.bincount(f, minlength=buckets) for f in found)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """What prediction needs; ``langs`` may be empty, then all is unknown.

    ``weights`` has the buckets that the penalties leave; ``place`` tells a
    bucket's row, of which row 0 is empty.
    """

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    place: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = vector(*counts(text, len(self.idf)), self.idf)
        return x @ self.weights[self.place[at]]

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights by frequency in the text and rarity among texts, of length 1."""
    x = np.log1p(n) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(grams: list[tuple[np.ndarray, np.ndarray]], langs: list[str], idf: np.ndarray, seed: int = 0) -> Model:
    """FTRL-proximal on the ``counts`` of the sample; every fifth document calibrates only."""
    names = sorted(set(langs))
    w = np.zeros((len(idf), len(names)))
    if len(names) < 2:
        return Model(names, idf, w[:1], np.zeros(len(idf), np.int32))
    order = np.random.default_rng(seed).permutation(len(grams))
    rows = {i: (*vector(*grams[i], idf), names.index(langs[i])) for i in order}
    z, n = np.zeros_like(w), np.zeros_like(w)
    for _ in range(EPOCHS):
        for i in order[np.arange(len(order)) % 5 > 0]:
            at, x, y = rows[i]
            some_z, some_n = z[at], n[at]
            some_w = -np.sign(some_z) * np.maximum(np.abs(some_z) - L1, 0) / ((BETA + np.sqrt(some_n)) / ALPHA + L2)
            g = softmax(x @ some_w)
            g[y] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(some_n + g * g) - np.sqrt(some_n)) / ALPHA
            z[at], n[at] = some_z + g - sigma * some_w, some_n + g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    kept = [rows[i] for i in order[::5]]
    logits, truth = np.array([x @ w[at] for at, x, _ in kept]), np.array([y for _, _, y in kept])
    left = np.flatnonzero(w.any(axis=1))
    place = np.zeros(len(idf), np.int32)
    place[left] = np.arange(1, len(left) + 1)
    return Model(names, idf, np.vstack([np.zeros(len(names)), w[left]]), place, temperature(logits, truth))


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """Of a grid, the divisor of the logits with the least log loss."""
    grid = np.geomspace(0.05, 20, 80)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def frequencies(learn: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and documents in all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b["text"]:
                df[counts(text)[0]] += 1
                docs += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(df[at], docs)})

    found = learn.select("text").mapInPandas(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df, docs = np.zeros(BUCKETS), int(found.loc[found["bucket"] < 0, "df"].sum())
    found = found[found["bucket"] >= 0]
    df[found["bucket"]] = found["df"]
    return df, docs


def drawn(learn: DataFrame, sample_docs: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, buckets, counts) of a sample by a hash of the text: of every language as many different texts, at most, in a fixed order."""
    spark, h = learn.sparkSession, F.xxhash64("text", F.lit(17))
    sizes = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    if not sizes:
        return []
    each = max(50, sample_docs // len(sizes))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2 * each / max(n, 1)))) for k, n in sizes.items()])
    hashed = learn.select("lang", "text", h.alias("h"), (F.length("text") > SAMPLE_CHARS).alias("long")).where(F.pmod(h, F.lit(1 << 20)) < share * (1 << 20))
    order = Window.partitionBy("lang").orderBy("long", "h")
    first = hashed.select("lang", "h", "long").withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= each).select("lang", "h").distinct()
    named = spark.createDataFrame(first.collect(), "lang string, h long")  # each * languages rows at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counts(t) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "at": [a for a, _ in found], "n": [n for _, n in found]})

    one = hashed.join(F.broadcast(named), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = one.mapInPandas(run, "lang string, h long, at array<int>, n array<int>").toPandas().sort_values(["lang", "h"])
    return [(r.lang, np.asarray(r.at, np.int64), np.asarray(r.n, np.int64)) for r in found.itertuples(index=False)]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Broadcast:
    """A model from text and lang of the documents that are not held out; document frequencies count all of them."""
    learn = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("doc_id").isNotNull())
    learn = learn.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    df, n = frequencies(learn)
    idf, sample = np.log((1 + n) / (1 + df)) + 1, drawn(learn, sample_docs)
    return docs.sparkSession.sparkContext.broadcast(train([x[1:] for x in sample], [x[0] for x in sample], idf))


def held_out() -> Column:
    """Documents that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    A null text and one without a letter are ``und`` with score 0, as is every
    text where there is nothing to learn from; with one language learnt the
    score is 1.  A null ``doc_id`` is not held out and not learnt from,
    repeated rows return as they are, an empty table gives an empty one, other
    columns are dropped; ties go to the language first by name.  More than
    ``MOST_LANGS`` languages stop the run.
    """
    model = fit(docs, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = zip(*(model.value.predict(t.as_py()) for t in b["text"]), strict=True) if b.num_rows else ((), ())
            columns = [b["doc_id"], b["held_out"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, OUT)


def keep_language(docs: DataFrame, min_score: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` with a known language by a score of at least ``min_score``, all columns as they are.

    A null text and one without a letter go; where there is nothing to learn
    from, all go.  Repeated rows are kept or rejected together, rows with a null
    id are predicted but not learnt from, an empty table gives an empty one.
    """
    model = fit(docs, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.value.predict(t.as_py()) for t in b["text"]]
            yield b.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
