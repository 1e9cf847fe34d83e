"""Operator 2: near-duplicates by bottom-k sketches of one hash function.

1. Every document becomes its set of hashed word shingles, a digest of the set
   and its smallest hashes, of which the first k are its sketch.  Documents with
   equal sets form a class, which its smallest id stands for.
2. Inverted lists: two sets that are similar enough share at least ``need`` of
   their k retained values (but for a chance of ``MISS``).  A document that
   shares fewer with all others together has no partner; what gets through is
   held against its ``WIDE`` smallest hashes in the same way, which parts texts
   that have no more than a passage in common.  Of each sketch only
   the rarest values are listed, as many as must include one shared value.  A
   list is read twice: a document that shares all but a few values with an
   earlier leader of no greater need follows it, others lead; then every overlap
   that a link needs connects a document and a leader, and less where a follower's
   partner could have less with its leader, by no more edges than
   the list has documents.  So all pairs that share ``need`` values are in one
   group.  Long lists are cut by salt, and parts of their leaders meet in pairs.
3. Groups are verified in units of bounded size: the union sketch estimates a
   pair's similarity, full sets of the texts decide.  A unit returns no more
   links than it has documents.  In a large group every block of documents first
   meets a few pivots; what these links connect is one cluster, and only
   documents outside of the largest cluster then meet all the others, in pairs
   of blocks.
4. Components of the links, joined back to classes and documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, staged, table, text_rows
from .components import components

K, MISS = 24, 1e-6
#: Values that are kept of a document's set: the first ``K`` are its sketch, all of them tell whether it can have a partner.
WIDE = 96
#: Values that a follower may lack of its leader's; documents of a block; length at which a list is cut; leaders of a part; pivots of a large group.
SLACK, BLOCK, LIST, MEET, PIVOTS = 4, 512, 4096, 1024, 64
#: Rows that move from Python to Spark at once.
ROWS = 256
_PAD = np.iinfo(np.int64).max


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text in lower case (A-Z); a shorter text is one shingle."""
    import xxhash

    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    width = min(width, len(words))
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, width * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((mixed ^ (mixed >> np.uint64(31))).view(np.int64))


@lru_cache(maxsize=16)
def shared_at_least(k: int, percent: int) -> int:
    """The most values that two full sketches of sets this similar share but for a chance of ``MISS``."""
    p, tail, c = percent / 100, 0.0, 0
    while c < k and (tail := tail + comb(k, c) * p**c * (1 - p) ** (k - c)) <= MISS:
        c += 1
    return max(1, c)


def need(size: int, k: int, percent: int) -> int:
    """Shared values that a sketch of so many values needs; whole sets that fit in a sketch need their share exactly."""
    return min(shared_at_least(k, percent), ceil(percent * size / 100))


def need_column(size: Column, k: int, percent: int) -> Column:
    return F.least(F.lit(shared_at_least(k, percent)), F.ceil(size * percent / 100)).cast("int")


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """``doc_id, n_shingles, digest, sketch`` of every row: the ``k`` smallest hashes of its set."""

    def mark(text: str) -> tuple[int, bytes, np.ndarray]:
        full = shingle_set(text, width)  # only its head outlives the call
        return len(full), hashlib.blake2b(full.tobytes(), digest_size=16).digest(), full[:k].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes, digests, heads = zip(*(mark(t.as_py()) for t in part["text"]), strict=True)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "sketch"])

    return text_rows(docs).mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def read_lists(postings: DataFrame, k: int, percent: int, slack: int) -> DataFrame:
    """Edges (a, b) inside each list, and its leaders as rows with b null; ``postings`` (value, salt, doc, size, shared, led) are sorted by list.

    ``led``: whether others follow a document, which may then lack ``SLACK``
    values of what these share with a partner.
    """

    def overlaps(by_value: dict[int, list[int]], shared: list[int]) -> dict[int, int]:
        found: dict[int, int] = {}
        for v in shared:
            for i in by_value.get(v, ()):
                found[i] = found.get(i, 0) + 1
        return found

    def one(rows: list[tuple]) -> Iterator[tuple]:
        leaders: list[tuple] = []
        followed: list[bool] = []
        place: list[int | None] = []
        by_value: dict[int, list[int]] = {}
        for doc, size, shared, led in rows:
            own = need(size, k, percent)
            # a leader is met again by its own need, which must ask no more than that of any document behind it
            behind = [i for i, n in overlaps(by_value, shared).items() if n >= size - slack and need(leaders[i][1], k, percent) <= own]
            for i in behind:
                followed[i] = True
            place.append(None if behind else len(leaders))
            if not behind:
                for v in shared:
                    by_value.setdefault(v, []).append(len(leaders))
                followed.append(led)
                leaders.append((doc, size, shared))
        # edges, now that it is known who is followed: only the needs of these are loose
        above = list(range(len(leaders)))  # leaders that edges already connect

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = i = above[above[i]]
            return i

        by_value = {}
        for (doc, size, shared, led), at in zip(rows, place, strict=True):
            own, met = need(size, k, percent) - SLACK * (led and slack == 0), set()
            for i, n in overlaps(by_value, shared).items():
                asked = min(own, need(leaders[i][1], k, percent) - SLACK * (led and slack == 0)) - SLACK * followed[i]
                if n >= max(1, asked) or (at is None and n >= size - slack):
                    met.add(top(i))
            for i in met:  # one edge to each group of leaders, which it joins
                yield doc, leaders[i][0], size, shared, False
                above[i] = min(met)
            if at is not None:
                for v in shared:
                    by_value.setdefault(v, []).append(at)
                above[at] = min(met, default=at)
        for (doc, size, shared), has in zip(leaders, followed, strict=True):
            yield doc, None, size, shared, has

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, out = None, [], []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["value", "a", "b", "size", "shared", "led"]).astype({"b": "Int64"})
            out.clear()
            return made

        for batch in batches:
            for value, salt, doc, size, shared, led in zip(*(batch[c] for c in ("value", "salt", "doc", "size", "shared", "led")), strict=True):
                if (value, salt) != now:
                    if now:
                        out += [(now[0], *x) for x in one(rows)] if len(rows) > 1 else [(now[0], rows[0][0], None, *rows[0][1:])]
                    now, rows = (value, salt), []
                rows.append((doc, size, shared.tolist(), bool(led)))
            if len(out) > 10_000:
                yield frame()
        if now:
            out += [(now[0], *x) for x in one(rows)] if len(rows) > 1 else [(now[0], rows[0][0], None, *rows[0][1:])]
        yield frame()

    return postings.mapInPandas(run, "value long, a long, b long, size int, shared array<long>, led boolean")


def shared_enough(entries: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, size, value): values that more than one document has (value, n), as a table; and ``doc_id, size, kept`` of the documents with as many of these as a partner would share."""
    counts = staged(entries.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > 1), "value-counts")
    kept = entries.join(counts, "value").groupBy("doc_id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("kept"))
    return counts, kept.where(F.size("kept") >= need_column(F.col("size"), k, percent))


def with_partners(marks: DataFrame, kept: DataFrame, wide: int, percent: int) -> DataFrame:
    """The rows of ``kept`` that can have a partner by their ``wide`` smallest hashes, too.

    Texts with a passage in common share values of it but not those of their own
    words; the more values are kept, the less a share that is too small gets
    through.  Only documents that the sketch has let through count, as a partner
    is one of these.
    """
    some = marks.join(kept.select("doc_id"), "doc_id", "left_semi")
    entries = some.select("doc_id", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    twice = entries.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("value")
    enough = entries.join(twice, "value").groupBy("doc_id", "size").agg(F.count("*").alias("n")).where(F.col("n") >= need_column(F.col("size"), wide, percent))
    return kept.join(enough.select("doc_id"), "doc_id", "left_semi")


def candidate_groups(marks: DataFrame, k: int, percent: int, wide: int = WIDE) -> DataFrame:
    """``node, component``: groups of class representatives that hold every pair sharing enough retained values, as a written table."""
    entries = marks.select("doc_id", F.least(F.size("sketch"), F.lit(k)).alias("size"), F.explode(F.slice("sketch", 1, k)).alias("value"))
    counts, kept = shared_enough(entries, k, percent)
    kept = staged(kept, "kept-values")
    likely = with_partners(marks, kept, wide, percent)
    least = need_column(F.col("size"), k, percent)
    likely = likely.withColumn("prefix", F.slice("kept", 1, F.size("kept") - least + 1))
    listed = likely.select(F.col("doc_id").alias("doc"), "size", F.col("kept.value").alias("shared"), F.explode("prefix").alias("p"))
    salt = F.pmod(F.xxhash64("doc"), F.ceil(F.col("p.n") / LIST))
    postings = listed.select(F.col("p.value").alias("value"), salt.alias("salt"), "doc", "size", "shared", F.lit(False).alias("led"))
    order = ["value", "salt", "doc"]
    short = read_lists(postings.repartition("value", "salt").sortWithinPartitions(*order), k, percent, SLACK)
    first = staged(short.join(counts.where(F.col("n") > LIST).select("value", F.lit(True).alias("cut")), "value", "left").where(F.col("b").isNotNull() | F.col("cut")), "list-edges", kept)
    # leaders of the parts of a cut list meet; those that others follow are loose on either side
    leaders = first.where(F.col("b").isNull()).select("value", F.col("a").alias("doc"), "size", "shared", "led")
    number = leaders.groupBy("value").agg(F.ceil(F.count("*") / MEET).alias("parts"))
    met = leaders.join(number, "value").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least("part", j) * F.col("parts") + F.greatest("part", j))
    met = met.select("value", F.explode(pair).alias("salt"), "doc", "size", "shared", "led")
    second = read_lists(met.repartition("value", "salt").sortWithinPartitions(*order), k, percent, 0)
    edges = first.select("a", "b").union(second.select("a", "b")).where(F.col("b").isNotNull())
    return components(edges, first, counts)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``b``: values in both sketches among the k smallest of their union, over that number."""
    z = np.sort(np.concatenate([np.broadcast_to(a, b.shape), b], axis=1), axis=1)
    same = np.zeros(z.shape, bool)
    same[:, 1:] = (z[:, 1:] == z[:, :-1]) & (z[:, 1:] != _PAD)
    rank = np.cumsum(~same & (z != _PAD), axis=1)
    return (same & (rank <= k)).sum(axis=1) / np.maximum(np.minimum(rank[:, -1], k), 1)


def links_among(ids: list[int], sets: list[np.ndarray], sides: np.ndarray, k: int, percent: int) -> list[tuple[int, int]]:
    """Links that connect the documents; only pairs of unlike sides where there are two sides.

    Pairs that links already connect are not looked at.
    """
    m, out = len(ids), []
    sketch = np.full((m, k), _PAD)
    for i, s in enumerate(sets):
        sketch[i, : min(k, len(s))] = s[:k]
    sizes, root, two = np.array([len(s) for s in sets]), np.arange(m), len(set(sides.tolist())) > 1
    least = min(shared_at_least(k, percent) / k, percent / 100)
    for i in range(m - 1):
        js = np.arange(i + 1, m)
        fit = (root[js] != root[i]) & (100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i]))
        if two:
            fit &= sides[js] != sides[i]
        js = js[fit]
        if len(js):
            estimate = union_estimate(sketch[i], sketch[js], k)
            js = js[np.argsort(-estimate, kind="stable")][: int((estimate >= least - 1e-9).sum())]
        step = 8
        while len(js):  # the likeliest first: a link settles all that are connected to it
            now, js, step = js[:step], js[step:], 4 * step
            flat = np.concatenate([sets[j] for j in now])
            at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            shared = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[now])[:-1]]))
            for j in now[100 * shared >= percent * (sizes[i] + sizes[now] - shared)]:
                if root[j] != root[i]:
                    out.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
            js = js[root[js] != root[i]]
    return out


def verified_links(docs: DataFrame, groups: DataFrame, width: int, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what is similar enough inside each group, by full sets, as a written table; ``groups`` is deleted."""
    # written, so that the join on a large group can be split
    sizes = staged(groups.groupBy("component").agg(F.count("*").alias("n")), "group-sizes")
    texts = text_rows(docs).join(groups.join(sizes, "component").hint("shuffle_hash"), F.col("doc_id") == F.col("node"))
    texts = staged(texts.select("text", "node", "component", "n"), "group-texts", groups, sizes)
    units = max(1, ceil(texts.count() / BLOCK))
    no = F.lit(-1).cast("long")

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in unit.groupby("component", sort=False):
            out += links_among(group["node"].tolist(), [shingle_set(t, width) for t in group["text"]], group["side"].to_numpy(), k, percent)
        return pd.DataFrame(out, columns=["a", "b"])

    def linked(rows: DataFrame) -> DataFrame:
        return rows.groupBy("unit", "i", "j").applyInPandas(run, "a long, b long")

    # small groups as they are; blocks of large ones with pivots, which are a side of their own
    small = texts.where(F.col("n") <= BLOCK).select("text", "node", "component", no.alias("side"), F.pmod(F.xxhash64("component"), F.lit(units)).alias("unit"), no.alias("i"), no.alias("j"))
    large = texts.where(F.col("n") > BLOCK)
    if large.isEmpty():
        return staged(linked(small), "links", texts)
    blocks, is_pivot = F.ceil(F.col("n") / BLOCK), F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")) < PIVOTS
    at = F.when(is_pivot, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks)))
    star = large.select("text", "node", "component", is_pivot.cast("long").alias("side"), F.col("component").alias("unit"), F.explode(at).alias("i"), no.alias("j"))
    links = staged(linked(small.union(star)), "first-links")

    # documents outside of their group's largest cluster, in pairs of blocks with all others
    found = components(links)
    clusters = large.select("node", "component", "n").join(found.select("node", F.col("component").alias("cluster")), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    clusters = staged(clusters, "clusters", found)
    sizes = clusters.groupBy("component", "cluster").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("component").agg(F.max_by("cluster", F.struct("m", "cluster")).alias("main"), (F.sum("m") - F.max("m")).alias("n_open"))
    largest = staged(largest.where(F.col("n_open") > 0), "largest-clusters")
    named = clusters.join(largest, "component")
    named = staged(large.select("node", "text").join(named, "node"), "open-groups", clusters, largest, texts)
    if named.isEmpty():
        dropped(named)
        return links
    n_open, n_main = F.ceil(F.col("n_open") / BLOCK), F.ceil((F.col("n") - F.col("n_open")) / BLOCK)
    hashed, zero = F.xxhash64("node"), F.lit(0).cast("long")
    own, main = F.pmod(hashed, n_open), F.pmod(hashed, n_main)
    with_open = F.transform(F.sequence(zero, n_open - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    with_main = F.transform(F.sequence(zero, n_main - 1), lambda j: F.struct(own.alias("i"), (-1 - j).alias("j")))
    from_main = F.transform(F.sequence(zero, n_open - 1), lambda i: F.struct(i.alias("i"), (-1 - main).alias("j")))
    at = F.when(F.col("cluster") == F.col("main"), from_main).otherwise(F.concat(with_open, with_main))
    rows = named.select("text", "node", "component", F.col("cluster").alias("side"), F.col("component").alias("unit"), F.explode(at).alias("at"))
    return staged(links.union(linked(rows.select("text", "node", "component", "side", "unit", "at.i", "at.j"))), "links", links, named)


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    Links are sets with ``100 * |A & B| >= percent * |A | B|``.  A document
    without words, with a null text or with a null id is linked with nothing
    (its component is its own id, null for a null id).  A row that repeats an
    id with another text is linked by its own text.  Repeated rows return as
    they are, an empty table gives an empty one, other columns are dropped.
    """
    marks = staged(sketches(docs, width, max(k, WIDE)), "sketches")
    live = marks.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = staged(live.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "classes")
    firsts = classes.withColumnRenamed("first_id", "doc_id")
    standing = staged(live.join(firsts, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"]).select("doc_id", "sketch"), "representatives")
    groups = candidate_groups(standing, k, percent)
    dropped(standing)
    links = verified_links(docs, groups, width, k, percent)
    found = components(links, links)
    out = marks.join(classes, "digest", "left").withColumn("first_id", F.when(F.col("n_shingles") > 0, F.col("first_id")))
    out = out.join(found.withColumnRenamed("node", "first_id"), "first_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first_id", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """``near_components`` with ``kept``: the document that stands for its component (with a null id: always)."""
    return near_components(docs, width, percent, k).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their components; of rows that repeat an id, one."""
    kept = staged(near_duplicates(docs, width, percent).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id"), "kept")
    named = docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    if not kept.groupBy("doc_id").count().where(F.col("count") > 1).isEmpty():
        named = named.dropDuplicates(["doc_id"])
    return named.union(docs.where(F.col("doc_id").isNull()))


def op2_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(words[i:i + 2], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id
), c AS (SELECT h, min(doc_id) AS r, min(n) AS n FROM n GROUP BY h
), f AS (
  SELECT s.doc_id, g, c.n FROM s JOIN c ON s.doc_id = c.r
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p
), t AS (
  SELECT r AS node, r AS root FROM c
  UNION
  SELECT e.b, t.root FROM t JOIN e ON t.node = e.a
), m AS (SELECT node, min(root) AS root FROM t GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, w.doc_id) AS component_id,
       w.doc_id = coalesce(m.root, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON n.h = c.h LEFT JOIN m ON c.r = m.node
"""
