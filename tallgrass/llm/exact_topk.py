"""Operator 3: exact top-k inner products over norm-sorted, SVD-rotated vectors.

1. Candidates are sorted by falling length and dealt in that order to shelves
   of bounded size.  Of equal vectors only as many stay as one query can return.
2. Every query meets the first shelf, the longest vectors, which gives it a
   floor: its k-th best score so far.
3. Shelves lie by falling length, so a query with floor f can find better ones
   only in the shelves before the first whose longest vector is below f / |q|.
   Queries are sorted by that bound into lists; a list and a shelf that it
   reaches meet in one task, queries in blocks.
4. There partial sums over the leading rotated dimensions are added up, and a
   pair is dropped once its sum plus the Cauchy-Schwarz bound on the rest is
   below the query's floor, which rises with what the task finds.  What is left
   is scored in integers.  Only each task's k best per query move on.

Work is that of all pairs of lists and shelves that the bounds leave, so for
vectors of like length it grows with the square of the input; a shelf moves
once for each list of ``LIST_ROWS`` queries, a query once for each shelf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import arrow_rows, arrow_schema, staged, table

SCALE, EVERY, K = 256, 50, 5
#: Candidates and queries of a block at most; numbers of a block, and of a shelf or a list, which is what one task holds.
BLOCK_ROWS, QUERY_ROWS, BLOCK_SIZE, SHELF_SIZE = 4096, 512, 1 << 18, 1 << 21
#: Shelves and lists at most (beyond, they grow; the driver sees three numbers of each), and as many as small inputs are split into.
MOST_SHELVES, FEW_SHELVES = 1 << 16, 32
BLOCKS = "shelf int, norm double, n int, ids binary, vectors binary"
LISTED = "list int, least double, n int, ids binary, vectors binary, floors binary"
RESULT = "query_id long, vec_id long, score long"


def scaled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v, norm2``: v is floor(scale * x) in doubles; vectors null, or with null or non-finite components, are left out."""
    x = F.col("embedding")
    whole = F.forall(x, lambda c: F.coalesce((F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c), F.lit(False)))
    good = embeddings.where(x.isNotNull() & whole & F.col("vec_id").isNotNull())
    # doubles of this size are whole numbers, and floor() would not hold them
    floor = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    v = F.transform(x, lambda c: floor(c.cast("double") * scale))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def without_copies(vectors: DataFrame, k: int) -> DataFrame:
    """Of equal vectors those with the ``k + 1`` smallest ids, each at most k times: no query returns others."""
    each = vectors.groupBy("v", "norm2", "vec_id").agg(F.count("*").alias("copies"))
    first = each.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return first.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))).select("vec_id", "v", "norm2")


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all vectors, by falling singular value, from their summed products (dims squared numbers)."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for b in batches:
            m = matrix(b["v"], dims)
            m /= np.maximum(np.abs(m).max(axis=1, keepdims=True), 1)  # any rotation is right; one vector is not to rule it
            total += m.T @ m
        yield pd.DataFrame({"row": np.arange(dims), "products": list(total)})

    rows = vectors.select("v").mapInPandas(products, "row int, products array<double>")
    summed = rows.select("row", F.posexplode("products").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((dims, dims))
    gram[summed["row"], summed["col"]] = summed["x"]
    _, axes = np.linalg.eigh((gram + gram.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


def matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    """Shorter vectors end with zeros."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def shelves(vectors: DataFrame, n: int, dims: int) -> DataFrame:
    """Blocks of vectors by falling length; a shelf is what one partition of that order holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, shelf, rows = arrow_schema(BLOCKS), TaskContext.get().partitionId(), block_rows(BLOCK_ROWS, dims)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                norm = float(np.sqrt(max(part["norm2"].to_pylist())))
                yield arrow_rows(schema, [(shelf, norm, part.num_rows, part["vec_id"].to_numpy().tobytes(), matrix(part["v"].to_pylist(), dims).tobytes())])

    order = [F.col("norm2").desc(), F.col("vec_id")]
    return vectors.repartitionByRange(n_parts(n, dims), *order).sortWithinPartitions(*order).mapInArrow(run, BLOCKS)


def block_rows(most: int, dims: int) -> int:
    return max(1, min(most, BLOCK_SIZE // dims))


def n_parts(n: int, dims: int) -> int:
    """Shelves or lists for so many vectors."""
    return max(1, min(MOST_SHELVES, max(-(-n * dims // SHELF_SIZE), min(FEW_SHELVES, -(-n * dims // BLOCK_SIZE)))))


def merged(df: DataFrame, name: str, sizes: list[tuple[int, int]], most: int) -> DataFrame:
    """Neighbours among the parts that column ``name`` tells become one as long as they have at most so many rows together."""
    places, now, held = [], -1, 0
    for part, n in sorted(sizes):
        if now < 0 or held + n > most:
            now, held = now + 1, 0
        held += n
        places.append((part, now))
    return df.join(df.sparkSession.createDataFrame(places, f"{name} int, place int"), name).drop(name).withColumnRenamed("place", name)


def unpack(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, dims)


class BestScores:
    """The k best candidates of each query of a block, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray, k: int, floors: np.ndarray | None = None) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.rotated = vectors @ axes
        self.norms = np.linalg.norm(vectors, axis=1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, candidate id), sorted
        self.floor = np.full(len(ids), -np.inf) if floors is None else floors.copy()
        dims = vectors.shape[1]
        self.cuts = sorted({max(1, dims // 4), max(1, dims // 2)})

    def reachable(self, norm: float) -> np.ndarray:
        return np.flatnonzero(~(self.norms * norm * (1 + 1e-9) + 1e-3 < self.floor))

    def meet(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray) -> None:
        norms = np.linalg.norm(vectors, axis=1)
        live = self.reachable(float(norms.max()))
        rotated = vectors @ axes
        rows = np.repeat(live, len(ids))
        cols = np.tile(np.arange(len(ids)), len(live))
        for cut in self.cuts:
            rest_q, rest_c = np.linalg.norm(self.rotated[:, cut:], axis=1), np.linalg.norm(rotated[:, cut:], axis=1)
            if cut == self.cuts[0]:
                bound = self.rotated[live, :cut] @ rotated[:, :cut].T + np.outer(rest_q[live], rest_c)
                keep = ~(bound + 1e-9 * np.outer(self.norms[live], norms) + 1e-3 < self.floor[live, None]).ravel()
            else:
                bound = np.concatenate([np.einsum("ij,ij->i", self.rotated[rows[i : i + 65536], :cut], rotated[cols[i : i + 65536], :cut]) for i in range(0, len(rows), 65536)] or [np.zeros(0)]) + rest_q[rows] * rest_c[cols]
                keep = ~(bound + 1e-9 * self.norms[rows] * norms[cols] + 1e-3 < self.floor[rows])
            rows, cols = rows[keep], cols[keep]
            if 2 * len(rows) > len(live) * len(ids):
                break  # too little goes to look again
        keep = ids[cols] != self.ids[rows]
        rows, cols = rows[keep], cols[keep]
        scores = self.exact(rows, cols, vectors)
        starts = np.searchsorted(rows, np.arange(len(self.ids) + 1))
        for q in np.unique(rows):
            s, c = scores[starts[q] : starts[q + 1]], ids[cols[starts[q] : starts[q + 1]]]
            if len(s) > self.k:
                high = s >= np.partition(s, -self.k)[-self.k]
                s, c = s[high], c[high]
            first = np.lexsort((c, -s))[: self.k]
            self.best[q] = sorted([*self.best[q], *zip((-s[first]).tolist(), c[first].tolist(), strict=True)])[: self.k]
            if len(self.best[q]) == self.k:
                self.floor[q] = max(self.floor[q], float(-self.best[q][-1][0]))

    def exact(self, rows: np.ndarray, cols: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Integer inner products: in doubles where every sum is a whole number below 2**53, else in Python's integers, which must end in a long."""
        a, b = self.vectors, vectors
        out = np.zeros(len(rows), np.int64)
        large = np.abs(a).max(axis=1, initial=0)[rows] * np.abs(b).max(axis=1, initial=0)[cols] * b.shape[1] >= 2**53
        small = np.flatnonzero(~large)
        for i in range(0, len(small), 65536):
            at = small[i : i + 65536]
            out[at] = np.einsum("ij,ij->i", a[rows[at]], b[cols[at]])
        for i in np.flatnonzero(large):
            score = sum(int(x) * int(y) for x, y in zip(a[rows[i]], b[cols[i]], strict=True))
            if not -(2**63) <= score < 2**63:
                raise OverflowError(f"no long holds the score of vectors {self.ids[rows[i]]} and number {cols[i]} of its block")
            out[i] = score
        return out

    def found(self) -> list[tuple[int, int, int]]:
        return [(int(q), c, -s) for q, some in zip(self.ids, self.best, strict=True) for s, c in some]


def top_k(embeddings: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query, all if there are fewer.

    Queries are the rows whose id ``every`` divides, one for each id (rows
    that repeat an id with another vector: the smallest vector); candidates
    are all rows with another id, repeated rows included.  Vectors of unequal
    length meet as if the shorter ended with zeros.  A score that no long can
    hold stops the run.  An empty table gives an empty result; other columns
    are dropped.
    """
    spark = embeddings.sparkSession
    vectors = staged(scaled(embeddings, scale), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, n_asked, dims = vectors.agg(F.count("*"), F.count_if(is_query), F.max(F.size("v"))).first()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, dims)
    axes = spark.sparkContext.broadcast(rotation(vectors, dims))
    placed = staged(shelves(without_copies(vectors, k), n, dims), "blocks")
    sizes = [tuple(r) for r in placed.groupBy("shelf").agg(F.sum("n")).collect()]
    placed = staged(merged(placed, "shelf", sizes, max(1, n // n_parts(n, dims))), "shelves", placed)
    longest = placed.where(F.col("shelf") == 0).orderBy(F.col("norm").desc()).limit(max(1, SHELF_SIZE // BLOCK_SIZE))
    longest = spark.sparkContext.broadcast([r.asDict() for r in longest.select("ids", "vectors").collect()])  # a shelf at most
    norms = np.array([r[1] for r in placed.groupBy("shelf").agg(F.max("norm")).orderBy("shelf").collect()])
    rows = block_rows(QUERY_ROWS, dims)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Floors of the queries by the longest candidates."""
        schema = arrow_schema("vec_id long, v array<double>, norm double, floor double")
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                best = BestScores(part["vec_id"].to_numpy(), matrix(part["v"].to_pylist(), dims), axes.value, k)
                for block in longest.value:
                    best.meet(*unpack(block, dims), axes.value)
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(best.norms), pa.array(best.floor)], schema=schema)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of queries by rising bound on the length of what they can return."""
        schema, number = arrow_schema(LISTED), TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                yield arrow_rows(schema, [(number, min(part["least"].to_pylist()), part.num_rows, part["vec_id"].to_numpy().tobytes(), matrix(part["v"].to_pylist(), dims).tobytes(), part["floor"].to_numpy().tobytes())])

    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).repartition(n_parts(n, dims))
    begun = asked.mapInArrow(begin, "vec_id long, v array<double>, norm double, floor double")
    least = F.when(F.col("norm") > 0, (F.col("floor") - 1e-3) / (F.col("norm") * (1 + 1e-9))).otherwise(float("-inf"))
    begun = staged(begun.withColumn("least", least), "queries", vectors)
    order = [F.col("least").desc(), F.col("vec_id")]
    blocks = staged(begun.repartitionByRange(n_parts(n_asked, dims), *order).sortWithinPartitions(*order).mapInArrow(listed, LISTED), "query-blocks", begun)
    sizes = [tuple(r) for r in blocks.groupBy("list").agg(F.sum("n")).collect()]

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shelves that each block of queries reaches: those with a vector long enough, which are the first ones."""
        for b in batches:
            reached = [list(range(int((norms >= x).sum()))) for x in b["least"].to_pylist()]
            yield b.append_column("shelves", pa.array(reached, pa.list_(pa.int32())))

    right = merged(blocks, "list", sizes, max(1, n_asked // n_parts(n_asked, dims)))
    right = right.mapInArrow(reaching, StructType([*right.schema, StructField("shelves", ArrayType(IntegerType()))])).withColumn("shelf", F.explode("shelves")).drop("shelves")
    right = staged(right, "reached", blocks)
    left = placed.join(right.select(F.col("list").alias("list"), F.col("shelf").alias("shelf")).distinct(), "shelf")

    def meet(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found, ordered = [], candidates.sort_values("norm", ascending=False).to_dict("records")
        for query in queries.to_dict("records"):
            best = BestScores(*unpack(query, dims), axes.value, k, np.frombuffer(query["floors"], np.float64))
            for block in ordered:
                if not len(best.reachable(block["norm"])):
                    break
                best.meet(*unpack(block, dims), axes.value)
            found += best.found()
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    pairs = left.groupBy("list", "shelf").cogroup(right.groupBy("list", "shelf")).applyInPandas(meet, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
