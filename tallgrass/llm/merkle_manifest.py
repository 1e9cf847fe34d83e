"""Operator 13: a Merkle manifest of a table, with a proof and a fold for every row.

1. Every row becomes a leaf, in SQL functions.  Leaves are sorted by group and
   id in ranges, numbered, and written once.
2. Blocks of 2 ** ``LEVELS`` neighbours become one hash each, in tasks.  Blocks of
   blocks follow until no more than ``TOP`` are left, so that at any size of the
   table the top tree is small.
3. The driver builds the top tree from these: the rest of every group's tree and
   the tree of the groups' roots.  (Of more groups than ``TOP`` the roots are
   reduced by blocks in their turn.)  It sends the executors the suffix path of each
   block, from its hash to the root.
4. Executors go through the blocks once more, finish every row's proof with its
   block's suffix path and fold it.

A node is SHA-256 of its children's lower-case hex digests; a child without a
partner is hashed alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, dropped, staged, table

#: Levels of a block, and its leaves; hashes that the driver's top tree stands on at most.
LEVELS, TOP = 12, 16_384
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(c: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows are written alike; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(columns: tuple[str, ...], instead: dict[str, Column] | None = None) -> Column:
    return F.sha2(F.concat(*[value((instead or {}).get(c, F.col(c))) for c in columns]), 256)


def parents(nodes: list[str]) -> list[str]:
    return [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def tree(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """All levels above ``nodes``, themselves first: up to one hash, or so many levels."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append(parents(out[-1]))
    return out


def path(levels: list[list[str]], at: int) -> list[str]:
    """From a node up, one step for each level: ``L`` or ``R``, the side of the sibling, and its digest; ``-`` where there is none."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append("-" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at >>= 1
    return out


def fold(node: str, steps: list[str]) -> str:
    """The root that a node and its steps give."""
    for s in steps:
        node = H(s[1:], node) if s[0] == "L" else H(node, s[1:])
    return node


def block_levels(n: int, levels: int) -> int:
    """Levels inside a block of a group of ``n`` nodes: all that a small group has, else ``levels``."""
    return min(levels, (n - 1).bit_length())


def numbered(leaves: DataFrame, group: str, by: list[str]) -> DataFrame:
    """``leaves`` with ``at``, the place of a row in its group by the order ``by``, and ``n``, the rows of the group.

    Rows are sorted in ranges and counted; a range learns how many rows of its
    group lie before it from the counts, one for each range and group.
    """
    order = [F.col(c).asc_nulls_first() for c in (group, *by)]
    x = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    x = staged(x.withColumn("_at", F.monotonically_increasing_id()), "leaves-sorted", leaves)
    x = x.withColumn("_part", F.shiftright("_at", 33))
    g = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(g.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = x.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_n").over(g).alias("n"))
    x = x.join(sizes, x[group].eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return x.withColumn("at", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_g", "_p", "_first", "_before")


def of_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """The hash of each block of ``nodes`` (lang, at, n, h) as nodes again."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        n, at = block["n"][0].as_py(), block["at"][0].as_py()
        top = tree(block["h"].to_pylist(), block_levels(n, levels))[-1][0]
        return pa.table([block["lang"][:1], [at >> levels], [-(-n >> levels)], [top]], schema=arrow_schema("lang string, at long, n long, h string"))

    rows = nodes.select("lang", "at", "n", "h", F.shiftright("at", levels).alias("block"))
    return rows.groupBy("lang", "block").applyInArrow(run, "lang string, at long, n long, h string")


@dataclass
class Top:
    """What the driver builds: for every block the steps from its hash to the root, and the roots."""

    suffix: dict[tuple[str | None, int], list[str]]
    subroots: dict[str | None, str]
    root: str


def top_tree(nodes: list[tuple[str | None, int, str]]) -> Top:
    """The top tree on (group, place, hash); groups are ordered null first, then by their bytes in UTF-8."""
    if not nodes:
        return Top({}, {}, "")
    groups: dict[str | None, list[str]] = {}
    for g, _, h in sorted(nodes, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1])):
        groups.setdefault(g, []).append(h)
    inner = {g: tree(hs) for g, hs in groups.items()}
    outer = tree([levels[-1][0] for levels in inner.values()])
    suffix = {(g, at): path(levels, at) + path(outer, k) for k, (g, levels) in enumerate(inner.items()) for at in range(len(levels[0]))}
    return Top(suffix, {g: levels[-1][0] for g, levels in inner.items()}, outer[-1][0])


#: Columns of ``manifest``; ``steps`` are the siblings with their sides.
OUT = "doc_id long, lang string, leaf string, subroot string, root string, steps array<string>, folded_root string"


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tampered: dict[str, Column] | None = None, altered: Column | None = None, levels: int = LEVELS, most: int = TOP) -> DataFrame:
    """``doc_id, lang, leaf, subroot, root, steps, folded_root`` of every row of ``docs``.

    Rows of a ``lang`` are leaves by ``doc_id`` (null first, ties by their
    digest); a leaf covers ``columns``.  ``steps`` are the siblings from the leaf
    to the root, each behind its side (``L``, ``R``; ``-``: there is none).
    ``folded_root`` is the root that the steps give for the row as it is, or with
    the columns ``tampered`` where ``altered`` holds.  Rows that repeat are leaves
    of their own, a null text or lang is not an empty one, an empty table gives an
    empty one; columns that are not named do not count, whatever their names.
    """
    own = leaf(columns)
    shown = F.when(altered, leaf(columns, tampered)) if altered is not None else F.lit(None).cast("string")
    tie = F.monotonically_increasing_id()  # repeated rows may lie in several ranges
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), own.alias("h"), shown.alias("shown"), tie.alias("tie"))
    leaves = staged(numbered(staged(x, "leaves"), "lang", ["doc_id", "h", "tie"]).drop("tie"), "leaves-numbered")
    rounds, left = reduced(leaves, levels, most)
    if left is not None:
        found = finished(rounds[:-1], top_tree(left), levels)
    else:  # more groups than the driver is to hold: their roots are the leaves of one more tree
        roots = rounds[-1].select(F.lit(None).cast("string").alias("lang"), F.col("lang").alias("name"), "h")
        roots = staged(numbered(staged(roots, "subroots"), "lang", ["name"]), "subroots-numbered")
        outer, last = reduced(roots, levels, most)
        top = top_tree(last)
        steps = staged(finished(outer[:-1], top, levels, only_steps=True), "subroot-steps", *outer[1:])
        above = roots.join(steps.select("at", "steps"), "at").select(F.col("name").alias("lang"), F.lit(0).cast("long").alias("at"), "steps")
        found = finished(rounds[:-1], Top({}, {}, top.root), levels, above, roots.select("name", F.col("h").alias("subroot")))
    dropped(*rounds[1:])
    return found


def reduced(leaves: DataFrame, levels: int, most: int) -> tuple[list[DataFrame], list[tuple[str | None, int, str]] | None]:
    """The nodes of each round of blocks, ``leaves`` first, and those of the last for the driver; None if every group has come to its root and these are more than ``most``."""
    rounds = [leaves]
    while True:
        rounds.append(staged(of_blocks(rounds[-1], levels), "merkle-blocks"))
        left = rounds[-1].limit(most + 1).collect()
        if len(left) <= most:
            return rounds, [(r["lang"], r["at"], r["h"]) for r in left]
        if rounds[-1].where("n > 1").isEmpty():
            return rounds, None


STEPS = "lang string, at long, steps array<string>"


def finished(rounds: list[DataFrame], top: Top, levels: int, above: DataFrame | None = None, subroots: DataFrame | None = None, only_steps: bool = False) -> DataFrame:
    """Every leaf with its steps, by way of the blocks of each round from the last to the first.

    ``top`` has the steps of the last blocks, or else ``above`` (lang, at, steps),
    with ``subroots`` (name, subroot).
    """
    spark = rounds[0].sparkSession
    sent = spark.sparkContext.broadcast(top)

    def walked(block: pa.Table, above: list[str] | None) -> tuple[pa.Table, list[list[str]]]:
        block = block.sort_by("at")
        n, at, lang = (block[c][0].as_py() for c in ("n", "at", "lang"))
        rest = sent.value.suffix[(lang, at >> levels)] if above is None else above
        own = tree(block["h"].to_pylist(), block_levels(n, levels))
        return block, [path(own, i) + rest for i in range(block.num_rows)]

    def inner(block: pa.Table) -> pa.Table:
        block, steps = walked(block, block["above"][0].as_py() if "above" in block.column_names else None)
        return pa.table([block["lang"], block["at"], pa.array(steps, pa.list_(pa.string()))], schema=arrow_schema(STEPS))

    def leaves(block: pa.Table) -> pa.Table:
        block, steps = walked(block, block["above"][0].as_py() if "above" in block.column_names else None)
        lang = block["lang"][0].as_py()
        subroot = block["subroot"][0].as_py() if "subroot" in block.column_names else sent.value.subroots[lang]
        rows = [
            (doc_id, lang, h, subroot, sent.value.root, s, fold(shown or h, s))
            for doc_id, h, shown, s in zip(block["doc_id"].to_pylist(), block["h"].to_pylist(), block["shown"].to_pylist(), steps, strict=True)
        ]
        return pa.Table.from_batches([arrow_rows(arrow_schema(OUT), rows)])

    for k in range(len(rounds) - 1, -1, -1):
        x = rounds[k].withColumn("block", F.shiftright("at", levels))
        if above is not None:
            names = above.select(F.col("lang").alias("_lang"), F.col("at").alias("_at"), F.col("steps").alias("above"))
            x = x.join(names, x["lang"].eqNullSafe(F.col("_lang")) & (F.col("block") == F.col("_at"))).drop("_lang", "_at")
        if k == 0 and subroots is not None:
            x = x.join(subroots, x["lang"].eqNullSafe(F.col("name"))).drop("name")
        grouped = x.groupBy("lang", "block")
        if k == 0:
            return grouped.applyInArrow(inner, STEPS) if only_steps else grouped.applyInArrow(leaves, OUT)
        above = staged(grouped.applyInArrow(inner, STEPS), "merkle-steps")
    raise AssertionError


def proof(steps: Column) -> Column:
    """The siblings without their sides, from the leaf up, left to right."""
    return F.array_join(F.transform(F.filter(steps, lambda s: s != "-"), lambda s: F.substring(s, 2, 64)), "")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    x = manifest(docs, tampered={"n_chars": F.col("n_chars") + 1}, altered=altered)
    return x.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 40) -> str:
    def value(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(({c})::VARCHAR), ':', ({c})::VARCHAR) END"

    leaf = lambda n: f"sha256(concat({', '.join(value(n if c == 'n_chars' else c) for c in COLUMNS)}))"
    up = lambda t, by: f"""SELECT {by}, pos // 2 AS pos, level + 1 AS level, ((n + 1) // 2)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h
  FROM {t} WHERE n > 1 GROUP BY {by}, pos // 2, level, n"""  # noqa: E731
    side = "CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < x.pos >> x.level THEN 'L' || s.h ELSE 'R' || s.h END"
    # an altered n_chars only counts where doc_id is divisible; crc32 is not in this SQL, so it is worked out bit by bit
    return f"""
WITH RECURSIVE bits AS (
  SELECT doc_id, i, 4294967295::BIGINT AS c, doc_id::VARCHAR AS s, 0 AS i0 FROM (SELECT DISTINCT doc_id, 0 AS i FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, i + 1, list_reduce(list_prepend(xor(c, ascii(s[i + 1])::BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), s, 0
  FROM bits WHERE i < strlen(s)
), crc AS (SELECT doc_id, xor(c, 4294967295::BIGINT) AS crc FROM bits WHERE i = strlen(s)
), d AS (
  SELECT doc_id, lang, {leaf('n_chars')} AS h, {leaf('n_chars + 1')} AS shown FROM documents
), l AS (
  SELECT d.doc_id, lang, d.h, CASE WHEN crc % 7 = 0 THEN shown ELSE d.h END AS shown, row_number() OVER (PARTITION BY lang ORDER BY d.doc_id NULLS FIRST, d.h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM d LEFT JOIN crc USING (doc_id)
), t AS (
  SELECT coalesce('+' || lang, '') AS lang, pos, 0 AS level, n, h FROM l
  UNION ALL
  {up('t', 'lang')}
), tops AS (SELECT lang, max(level) AS height, arg_max(h, level) AS subroot FROM t GROUP BY lang
), r0 AS (SELECT lang, height, subroot, row_number() OVER (ORDER BY encode(lang)) - 1 AS pos, count(*) OVER () AS n FROM tops
), r AS (
  SELECT 0 AS one, pos, 0 AS level, n, subroot AS h FROM r0
  UNION ALL
  {up('r', 'one')}
), tip AS (SELECT max(level) AS height, arg_max(h, level) AS root FROM r
), x AS (
  SELECT l.doc_id, l.h, l.shown, l.pos, lang, unnest(range({levels})) AS level, row_number() OVER () AS row FROM (SELECT doc_id, h, shown, pos, coalesce('+' || lang, '') AS lang FROM l) l
), p AS (
  SELECT x.row, list({side} ORDER BY x.level) AS steps FROM x JOIN r0 USING (lang) LEFT JOIN t s ON s.lang = x.lang AND s.level = x.level AND s.pos = xor(x.pos >> x.level, 1)
  WHERE x.level < r0.height GROUP BY x.row
), y AS (SELECT lang, r0.pos, unnest(range({levels})) AS level FROM r0
), q AS (
  SELECT x.lang, list({side} ORDER BY x.level) AS steps FROM y x, tip LEFT JOIN r s ON s.level = x.level AND s.pos = xor(x.pos >> x.level, 1) WHERE x.level < tip.height GROUP BY x.lang
), w AS (
  SELECT x.doc_id, x.h AS leaf, x.shown, subroot, root, list_concat(coalesce(p.steps, []), coalesce(q.steps, [])) AS steps
  FROM x JOIN r0 USING (lang) CROSS JOIN tip LEFT JOIN p ON p.row = x.row LEFT JOIN q ON q.lang = x.lang WHERE x.level = 0
), z AS (
  SELECT *, list_reduce(list_prepend(shown, steps), lambda a, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) WHEN 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root FROM w
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'), lambda s: s[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z
"""


OP13_SQL = _sql()
