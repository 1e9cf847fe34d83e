"""Nearest vectors by cosine out of inverted lists over k-means cells, and rankings that blend them with words.

``build`` fits the cells on a bounded sample and writes every vector into the
list of its nearest cell.  ``search`` looks into the cells that are closest to a
query.  The exact way takes a floor from these and goes on to every cell whose
bound, by the angle between its middle and the query and by its width, is not
below it.  Lists are read in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.scratch import scratch_path
from .inverted_index import B, EPSILON, K1, best, collection_sizes, impact, rarity, term_counts
from .text import tokens

#: Bound of the sample that cells are fitted on, rounds of fitting, rows of a part of a list, queries that meet it at a time; cosines of queries and cells that a task works out at a time.
SAMPLE, ROUNDS, PART, QUERIES, COSINES = 20_000, 12, 8_192, 4_096, 65_536


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def sound(e: DataFrame) -> DataFrame:
    """Rows whose vector is there, has no null or other non-number, and has a length."""
    numbers = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return e.where(F.col("embedding").isNotNull()).where(numbers & F.exists("embedding", lambda x: x != 0))


def matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column])


def middles(rows: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Directions that unit vectors gather about: spherical k-means; a cell that loses all takes the vector that fits worst."""
    rows = np.unique(rows, axis=0)
    found = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]]
    for _ in range(ROUNDS):
        near = rows @ found.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, at, rows)
        empty = np.flatnonzero(np.bincount(at, minlength=len(found)) == 0)
        sums[empty] = rows[np.argsort(near.max(axis=1))[: len(empty)]]
        found = unit(sums)
    return found


@dataclass
class Cells:
    """Lists (cell, part, id, embedding, what the filter needs), the cells' middles, cosines of their widths, and parts of their lists."""

    lists: DataFrame
    middles: np.ndarray
    widths: np.ndarray
    parts: np.ndarray


def build(vectors: DataFrame, path: str, cells: int | None = None, *kept: str) -> Cells:
    """The index of (id, embedding) and the columns ``kept``, below ``path``; ``cells`` are the square root of the rows unless told.

    The cells are fitted on at most ``SAMPLE`` rows, drawn by a hash of the id;
    every row is listed.  Rows without a sound vector are left out.
    """
    spark, rows = vectors.sparkSession, sound(vectors.select("id", "embedding", *kept))
    n = rows.count()
    drawn = rows.select("embedding", F.xxhash64("id", F.lit(5)).alias("h")).where(F.pmod("h", F.lit(1 << 20)) < (1 << 20) * min(1.0, 2 * SAMPLE / max(1, n)))
    sample = [r["embedding"] for r in drawn.orderBy("h").limit(SAMPLE).collect()]
    if not sample:
        return Cells(rows.withColumns({"cell": F.lit(0), "part": F.lit(0)}), np.zeros((0, 0)), np.zeros(0), np.zeros(0, int))
    mids = middles(unit(np.array(sample, np.float64)), max(1, min(4096, cells or round(n**0.5))))
    sent = spark.sparkContext.broadcast(mids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = unit(matrix(b["embedding"].to_pylist())) @ sent.value.T if b.num_rows else np.zeros((0, len(sent.value)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.argmax(axis=1), pa.int32()), pa.array(near.max(axis=1), pa.float64())], [*b.schema.names, "cell", "near"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, near double"
    rows.mapInArrow(run, schema).write.parquet(f"{path}/assigned")
    placed = spark.read.parquet(f"{path}/assigned")
    widths, parts = np.ones(len(mids)), np.ones(len(mids), int)
    for r in placed.groupBy("cell").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect():  # a row for each cell
        widths[r["cell"]], parts[r["cell"]] = min(1.0, r["near"]), -(-r["n"] // PART)
    split = spark.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "cell int, parts int")
    listed = placed.join(F.broadcast(split), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts", "near")
    listed.write.parquet(f"{path}/lists")
    return Cells(spark.read.parquet(f"{path}/lists"), mids, widths, parts)


def looked_up(index: Cells, probes: DataFrame, k: int, others: bool) -> DataFrame:
    """``query, id, score``: the ``k`` best of each part of the cells that (query, vector, cell, floor) ask for, none below a query's floor; with ``others`` a query's own row is left out."""
    spark = probes.sparkSession
    # queries of a cell are cut in blocks as well, each of which meets every part of its list
    probes.write.parquet(path := scratch_path(spark, "asked"))
    probes = spark.read.schema(probes.schema).parquet(path)
    blocks = {r["cell"]: -(-r["n"] // QUERIES) for r in probes.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    split = spark.createDataFrame([(i, p, blocks.get(i, 0)) for i, n in enumerate(index.parts.tolist()) for p in range(n)], "cell int, part int, blocks int")
    asked = probes.join(F.broadcast(split), "cell").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).drop("blocks")
    lists = index.lists.join(F.broadcast(split.where(F.col("blocks") > 0)), ["cell", "part"])
    lists = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64"})
        rows = rows.sort_values("id", ignore_index=True)
        x, ids = unit(matrix(rows["embedding"])), rows["id"].to_numpy()
        asked, names = unit(matrix(queries["vector"])), queries["query"].to_numpy()
        floors, step = queries["floor"].fillna(-np.inf).to_numpy() - 1e-9, max(1, 16 * COSINES // len(x))
        out = []
        for c in range(0, len(asked), step):
            scores = np.round(asked[c : c + step] @ x.T, 6)
            if others:
                scores[names[c : c + step, None] == ids] = -np.inf
            for q, score, floor in zip(names[c : c + step], scores, floors[c : c + step], strict=True):
                at = np.flatnonzero((score >= floor) & (score > -np.inf))
                at = at[np.argsort(-score[at], kind="stable")[:k]]
                out.append((np.full(len(at), q), ids[at], score[at]))
        return pd.DataFrame(dict(zip(("query", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    by = ["cell", "part", "block"]
    return lists.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(run, "query long, id long, score double")


def cells_of(batches: Iterator[pd.DataFrame], mids: np.ndarray, widths: np.ndarray, probes: int, rest: bool) -> Iterator[pd.DataFrame]:
    """(query, vector, cell, floor) of (query, vector, floor), few at a time: each query's ``probes`` closest cells; or the ``rest`` of them, as far as their bound is not below its floor.

    The bound is the cosine that no vector of the cell exceeds.
    """
    size = max(1, COSINES // len(mids))
    for b in batches:
        for k in range(0, len(b), size):
            x = b[k : k + size]
            near = unit(matrix(x["vector"])) @ mids.T
            at = np.argsort(-near, axis=1, kind="stable")
            asked = np.zeros(near.shape, bool)
            np.put_along_axis(asked, at[:, probes:] if rest else at[:, :probes], True, axis=1)
            if rest:
                bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - widths, 0))
                asked &= bound >= x["floor"].fillna(-np.inf).to_numpy()[:, None] - 1e-6
            row, cell = np.nonzero(asked)
            yield pd.DataFrame({c: x[c].to_numpy()[row] for c in ("query", "vector", "floor")} | {"cell": cell.astype("int32")})[["query", "vector", "cell", "floor"]]


def probed(index: Cells, queries: DataFrame, probes: int, rest: bool = False) -> DataFrame:
    """``cells_of`` of a table (query, vector, floor)."""
    sent = queries.sparkSession.sparkContext.broadcast((index.middles, np.arccos(np.clip(index.widths, -1, 1))))
    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("query", "vector", "floor").mapInPandas(lambda batches: cells_of(batches, *sent.value, probes, rest), f"query long, vector {kind}, cell int, floor double")


def search(index: Cells, queries: DataFrame, k: int, probes: int = 8, exact: bool = True, others: bool = True) -> DataFrame:
    """``query, id, rank, score`` of the ``k`` vectors closest to each of (query, vector), by six digits, ties to the smaller id.

    ``probes`` cells are looked into; ``exact`` goes on to all whose bound is not
    below the k-th score that these give, and to all where they give fewer.
    """
    spark = queries.sparkSession
    if not len(index.middles):
        return spark.createDataFrame([], "query long, id long, rank int, score double")
    queries = sound(queries.select("query", F.col("vector").alias("embedding"))).withColumnRenamed("embedding", "vector")
    first = looked_up(index, probed(index, queries.withColumn("floor", F.lit(None).cast("double")), probes), k, others)
    if not exact:
        return best(first, k)
    first.write.parquet(path := scratch_path(spark, "first-found"))
    first = spark.read.parquet(path)
    floors = best(first, k).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    rest = probed(index, queries.join(floors, "query", "left"), probes, rest=True)
    return best(first.union(looked_up(index, rest, k, others)), k)


# --- queries: rows with an id divisible by 20 against all that the filter leaves --------------------------------------------

POOL, TOP, DENSE, SPARSE, CLOSE = 20, 6, 0.6, 0.4, 0.15


def filtered(e: DataFrame, probes: int = 8, exact: bool = True, k: int = POOL) -> DataFrame:
    """The ``k`` closest vectors, those labelled 2 left out, of every vector whose id is divisible by 20."""
    rows = e.select(F.col("vec_id").alias("id"), "embedding", "label")
    index = build(rows.where(F.col("label") != 2), scratch_path(e.sparkSession, "vector-index"))
    return search(index, rows.where(F.col("id") % 20 == 0).select(F.col("id").alias("query"), F.col("embedding").alias("vector")), k, probes, exact)


_CLOSEST = """c AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.label <> 2 AND e.vec_id <> q.vec_id),
p AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM c QUALIFY rank <= 20)"""


@query("ret3", "embeddings", sql=f"WITH {_CLOSEST} SELECT query, id, rank, score FROM p WHERE rank <= 10")
def vector_search(e: DataFrame) -> DataFrame:
    """The ten vectors closest to each query, by the exact way."""
    return filtered(e, k=10)


def blended(pool: DataFrame, texts: DataFrame, questions: DataFrame) -> DataFrame:
    """``query, id, dense, sparse, blend`` of a pool (query, id, score): Okapi scores over the texts of a query's own pool, the highest as 1, blended with the cosine.

    ``texts`` has (id, text), ``questions`` (query, text); a text that is not
    there has no words.
    """
    x = pool.select("query", "id", F.col("score").alias("dense")).join(texts.select("id", F.coalesce("text", F.lit("")).alias("text")), "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    x.write.parquet(path := scratch_path(pool.sparkSession, "pool"))
    x = pool.sparkSession.read.parquet(path)
    counts = term_counts(x, "query")
    rare = rarity(counts, collection_sizes(x, "query"), "query")
    asked = questions.select("query", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    parts = counts.join(rare, ["query", "term"]).join(asked, ["query", "term"])
    sums = parts.groupBy("query", "id").agg(F.sum(F.col("times") * impact(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("sparse"))
    y = x.select("query", "id", "dense").join(sums, ["query", "id"], "left").withColumn("sparse", F.coalesce("sparse", F.lit(0.0)))
    top = y.groupBy("query").agg(F.max("sparse").alias("top"))
    share = F.when(F.col("top") > 0, F.col("sparse") / F.col("top")).otherwise(0.0)
    return y.join(top, "query").select("query", "id", "dense", share.alias("sparse"), (DENSE * F.col("dense") + SPARSE * share).alias("blend"))


def ranked(e: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """The ``k`` best by the blend out of a pool of 20; a query's text is the first line of its own document."""
    texts = d.select(F.col("doc_id").alias("id"), "text")
    questions = texts.select(F.col("id").alias("query"), F.element_at(F.split("text", "\n"), 1).alias("text")).where(F.col("query") % 20 == 0)
    return best(blended(filtered(e), texts, questions).select("query", "id", F.col("blend").alias("score")), k)


_W = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda t: regexp_matches(t, '^[\pL\pN]+$'))"
_BLEND = f"""{_CLOSEST}, w AS (SELECT query, id, score, {_W.format("coalesce(text, '')")} AS t FROM p LEFT JOIN documents ON doc_id = id),
s AS (SELECT query, count(*) AS n, avg(len(t)) AS avgdl FROM w GROUP BY 1), tf AS (SELECT query, id, dl, term, count(*) AS tf FROM (SELECT query, id, len(t) AS dl, unnest(t) AS term FROM w) GROUP BY ALL),
df AS (SELECT query, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf JOIN s USING (query) GROUP BY query, term, n), i AS (SELECT query, term, CASE WHEN raw < 0 THEN {EPSILON} * avg(raw) OVER (PARTITION BY query) ELSE raw END AS idf FROM df),
q AS (SELECT doc_id AS query, term, count(*) AS times FROM (SELECT doc_id, unnest({_W.format("string_split(text, chr(10))[1]")}) AS term FROM documents WHERE doc_id % 20 = 0) GROUP BY ALL),
x AS (SELECT query, id, sum(times * idf * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avgdl))) AS sparse FROM tf JOIN i USING (query, term) JOIN q USING (query, term) JOIN s USING (query) GROUP BY 1, 2),
y AS (SELECT query, id, score AS dense, coalesce(sparse, 0) AS sparse, max(coalesce(sparse, 0)) OVER (PARTITION BY query) AS top FROM w LEFT JOIN x USING (query, id)),
z AS (SELECT query, id, round({DENSE} * dense + {SPARSE} * CASE WHEN top > 0 THEN sparse / top ELSE 0 END, 6) AS score FROM y), r AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank, score FROM z)"""


@query("ret5", "embeddings", "documents", sql=f"WITH {_BLEND} SELECT query, id, rank, score FROM r WHERE rank <= {TOP}")
def blended_search(e: DataFrame, d: DataFrame) -> DataFrame:
    """Of a pool of 20 the 12 best by the blend stay, of these the first six; ties go to the smaller id."""
    return ranked(e, d, 2 * TOP).where(F.col("rank") <= TOP)


@query("ret6", "embeddings", "documents", sql=f"WITH {_BLEND} SELECT query, count(*)::BIGINT AS n, round(max(score) - min(score), 6) AS spread, count(*) > {TOP} AND max(score) - min(score) < {CLOSE} AS rerank FROM r WHERE rank <= {2 * TOP} GROUP BY 1")
def rerank_gate(e: DataFrame, d: DataFrame) -> DataFrame:
    """Whether the blended list lies so close together that another ranking is worth its cost."""
    spread = F.max("score") - F.min("score")
    return ranked(e, d, 2 * TOP).groupBy("query").agg(F.count("*").alias("n"), F.round(spread, 6).alias("spread"), ((F.count("*") > TOP) & (spread < CLOSE)).alias("rerank"))
