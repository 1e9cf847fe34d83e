"""Hierarchies by dotted paths: prefix joins turned into equi joins on exploded ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import append_child, depth, is_ancestor, parent_path, sanitize_label, valid_path
from ..plans.catalog import query
from ..sources.scratch import scratch_path


def ancestors(path: Column) -> Column:
    """All prefixes of a path, itself included."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, F.lit(1), i)))


@query("jn12", "entity_node", sql="SELECT p.id AS parent_id, p.path AS parent_path, c.id AS child_id, c.path AS child_path FROM entity_node p JOIN entity_node c ON c.parent_id = p.id")
def tree_edges(n: DataFrame) -> DataFrame:
    p, c = n.alias("p"), n.alias("c")
    return c.join(p, F.col("c.parent_id") == F.col("p.id")).select(F.col("p.id").alias("parent_id"), F.col("p.path").alias("parent_path"), F.col("c.id").alias("child_id"), F.col("c.path").alias("child_path"))


@query("jn13", "entity_node", sql="SELECT a.id AS ancestor, b.id AS descendant FROM entity_node a JOIN entity_node b ON b.path = a.path OR starts_with(b.path, a.path || '.')")
def subtree_pairs(n: DataFrame) -> DataFrame:
    """Nodes with all nodes at or below them; each node meets only its own ancestors."""
    below = n.select(F.col("id").alias("descendant"), F.explode(ancestors(F.col("path"))).alias("path"))
    return below.join(n.select(F.col("id").alias("ancestor"), "path"), "path").select("ancestor", "descendant")


@query("ag14", "entity_node", sql="SELECT a.id, sum(b.headcount)::BIGINT AS headcount, round(sum(b.revenue), 2) AS revenue, count(*)::BIGINT AS nodes FROM entity_node a JOIN entity_node b ON b.path = a.path OR starts_with(b.path, a.path || '.') GROUP BY 1")
def rollup(n: DataFrame) -> DataFrame:
    """Headcount, revenue and nodes at or below each node, summed by ancestor path before the join."""
    sums = n.select("headcount", "revenue", F.explode(ancestors(F.col("path"))).alias("path")).groupBy("path").agg(F.sum("headcount").alias("headcount"), F.round(F.sum("revenue"), 2).alias("revenue"), F.count("*").alias("nodes"))
    return n.select("id", "path").join(sums, "path").select("id", "headcount", "revenue", "nodes")


@query("ag15", "entity_node", sql="SELECT split_part(path, '.', 1) AS root, count(*)::BIGINT AS nodes, max(len(string_split(path, '.')))::BIGINT AS depth, count(*) FILTER (kind = 'LEGAL_ENTITY')::BIGINT AS entities FROM entity_node GROUP BY 1")
def tree_stats(n: DataFrame) -> DataFrame:
    return n.groupBy(F.substring_index("path", ".", 1).alias("root")).agg(F.count("*").alias("nodes"), F.max(depth(F.col("path")).cast("long")).alias("depth"), F.count_if(F.col("kind") == "LEGAL_ENTITY").alias("entities"))


@query("flt9", "entity_node", sql="SELECT id, starts_with(path, 'asia.') AS below, starts_with(path, 'asia') AS bare FROM entity_node WHERE starts_with(path, 'asia')")
def prefix_filters(n: DataFrame, prefix: str = "asia") -> DataFrame:
    """The bare prefix, which also takes siblings with a longer label, and the dotted one."""
    return n.where(F.col("path").startswith(prefix)).select("id", F.col("path").startswith(prefix + ".").alias("below"), F.col("path").startswith(prefix).alias("bare"))


@query("sc_s1", "entity_node", sql=r"""
SELECT id, lower(regexp_replace(trim(id || ' X-1'), '[^A-Za-z0-9_]+', '_', 'g')) AS label, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\.[^.]*$', '') END AS parent,
 len(string_split(path, '.'))::INT AS depth, starts_with(path, 'europe.') AS in_europe, concat(path, '.', 'child') AS child, regexp_matches(path, '^[a-z0-9_]+(\.[a-z0-9_]+)*$') AS valid FROM entity_node""")
def path_functions(n: DataFrame) -> DataFrame:
    p = F.col("path")
    return n.select("id", sanitize_label(F.concat("id", F.lit(" X-1"))).alias("label"), parent_path(p).alias("parent"), depth(p).alias("depth"), is_ancestor(F.lit("europe"), p).alias("in_europe"), append_child(p, F.lit("child")).alias("child"), valid_path(p).alias("valid"))


@query("sc_s2", "entity_node", sql="SELECT id, CASE WHEN path = 'europe' OR starts_with(path, 'europe.') THEN 'world.europe' || substr(path, 7) ELSE path END AS path FROM entity_node")
def move_subtree(n: DataFrame, old: str = "europe", new: str = "world.europe") -> DataFrame:
    p = F.col("path")
    moved = F.concat(F.lit(new), F.substring(p, F.lit(len(old) + 1), F.length(p)))
    return n.select("id", F.when((p == old) | p.startswith(old + "."), moved).otherwise(p).alias("path"))


def climbed(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(node, up, steps) after as many doublings as there may be levels, and the number of rows with ``up``: those never come to a root.

    ``nodes`` is (id, parent_id); a parent that is not there makes a root, an id
    that is there twice takes its smallest parent.  A round joins each pointer
    with that of the node it points to, so a chain of n nodes needs log2(n) rounds.
    """
    spark = nodes.sparkSession
    one = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    known = one.select(F.col("id").alias("_id"))
    x = one.join(known, F.col("parent_id") == F.col("_id"), "left").select(F.col("id").alias("node"), F.col("_id").alias("up"), F.when(F.col("_id").isNotNull(), 1).otherwise(0).cast("long").alias("steps"))
    x.write.parquet(path := scratch_path(spark, "pointers"))
    x = spark.read.schema(x.schema).parquet(path)
    n = x.count()
    left = x.where(F.col("up").isNotNull()).count()
    for _ in range(n.bit_length() + 1):
        if not left:
            break
        above = x.select(F.col("node").alias("_n"), F.col("up").alias("_u"), F.col("steps").alias("_s"))
        further = x.where(F.col("up").isNotNull()).join(above, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up"), (F.col("steps") + F.col("_s")).alias("steps"))
        further.union(x.where(F.col("up").isNull())).write.parquet(path := scratch_path(spark, "pointers"))
        x = spark.read.schema(x.schema).parquet(path)
        left = x.where(F.col("up").isNotNull()).count()
    return x, left


def depths(nodes: DataFrame) -> DataFrame:
    """``id, depth`` of (id, parent_id), so that parents come before children; a cycle is an error that names its nodes."""
    x, left = climbed(nodes)
    if left:
        # a pointer that has gone further than there are nodes stands on a cycle, and every node of a cycle is pointed to
        on = [r["up"] for r in x.where(F.col("up").isNotNull()).select("up").distinct().orderBy("up").limit(10).collect()]
        raise ValueError(f"cycle at {', '.join(map(str, on))}")
    return x.select(F.col("node").alias("id"), F.col("steps").cast("int").alias("depth"))


@query("srt10", "entity_node", sql="""
WITH RECURSIVE t AS (SELECT id, 0 AS depth FROM entity_node WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM entity_node) UNION ALL SELECT n.id, t.depth + 1 FROM entity_node n JOIN t ON n.parent_id = t.id)
SELECT id, depth::INT AS depth FROM t""")
def topological(n: DataFrame) -> DataFrame:
    """Depth from the root by parent ids alone."""
    return depths(n.select("id", "parent_id"))


#: Which kinds of node may stand below which.
CHILDREN = {"GROUP": ("LEGAL_ENTITY", "BUSINESS_UNIT"), "LEGAL_ENTITY": ("BUSINESS_UNIT", "FACILITY"), "BUSINESS_UNIT": ("FACILITY",)}


@query("stm4", "entity_node", sql="SELECT c.id, p.kind AS parent_kind, c.kind, (p.kind, c.kind) IN (('GROUP', 'LEGAL_ENTITY'), ('GROUP', 'BUSINESS_UNIT'), ('LEGAL_ENTITY', 'BUSINESS_UNIT'), ('LEGAL_ENTITY', 'FACILITY'), ('BUSINESS_UNIT', 'FACILITY')) AS allowed FROM entity_node c JOIN entity_node p ON c.parent_id = p.id")
def parent_kinds(n: DataFrame) -> DataFrame:
    pairs = n.sparkSession.createDataFrame([(p, c, True) for p, cs in CHILDREN.items() for c in cs], "parent_kind string, kind string, allowed boolean")
    edges = n.alias("c").join(n.alias("p"), F.col("c.parent_id") == F.col("p.id")).select("c.id", F.col("p.kind").alias("parent_kind"), F.col("c.kind").alias("kind"))
    return edges.join(F.broadcast(pairs), ["parent_kind", "kind"], "left").select("id", "parent_kind", "kind", F.coalesce("allowed", F.lit(False)).alias("allowed"))
