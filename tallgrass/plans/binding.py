"""Domain frames over the driver's tables, written once in Spark SQL functions and once as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order and line number alone do not name a line item of these tables.
_ID_SQL = "l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_shipdate::DATE, '-', l_quantity::BIGINT"


def line_id() -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string"), F.col("l_quantity").cast("long").cast("string"))


def metric_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact per line item: key by flag and status, month of shipment as period, approval by order status."""
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    e = line.join(orders, line.l_orderkey == orders.o_orderkey)
    key = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "ghg_scope1_total")
        .when(F.col("l_returnflag") == "A", "ghg_scope2_location")
        .when(F.col("l_linestatus") == "F", "ghg_scope2_market")
        .when(F.col("l_linenumber") <= 3, "purchased_electricity_kwh")
        .otherwise(F.concat(F.lit("ghg_scope3_cat"), (F.col("l_partkey") % 15 + 1).cast("string")))
    )
    day = F.col("l_shipdate").cast("date")
    return e.select(
        line_id().alias("id"),
        (F.col("l_suppkey") % 8).cast("long").alias("tenant_id"),
        F.col("l_suppkey").alias("scope_node_id"),
        F.col("l_orderkey").alias("document_id"),
        key.alias("canonical_key"),
        F.col("l_quantity").alias("value"),
        F.when(key == "purchased_electricity_kwh", "kWh").otherwise("tCO2e").alias("unit"),
        F.trunc(day, "MM").alias("period_start"),
        F.last_day(day).alias("period_end"),
        F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "P", "LOCKED").otherwise("DRAFT").alias("status"),
    )


METRIC_EVENT = f"""
SELECT concat({_ID_SQL}) AS id, (l_suppkey % 8)::BIGINT AS tenant_id, l_suppkey AS scope_node_id,
       l_orderkey AS document_id,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'ghg_scope1_total' WHEN l_returnflag = 'A' THEN 'ghg_scope2_location'
            WHEN l_linestatus = 'F' THEN 'ghg_scope2_market' WHEN l_linenumber <= 3 THEN 'purchased_electricity_kwh'
            ELSE concat('ghg_scope3_cat', l_partkey % 15 + 1) END AS canonical_key,
       l_quantity AS value,
       CASE WHEN NOT (l_returnflag = 'R' AND l_linestatus = 'F') AND l_returnflag <> 'A' AND l_linestatus <> 'F' AND l_linenumber <= 3 THEN 'kWh' ELSE 'tCO2e' END AS unit,
       date_trunc('month', l_shipdate)::DATE AS period_start, last_day(l_shipdate) AS period_end,
       CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'LOCKED' ELSE 'DRAFT' END AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""


def extraction_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extracted field per line item, with a confidence and a review status."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f-"), line_id()).alias("id"),
        (F.col("l_orderkey") % 500).alias("document_id"),
        F.element_at(F.array(*map(F.lit, KEYS)), (F.col("l_partkey") % len(KEYS) + 1).cast("int")).alias("canonical_key"),
        F.col("l_quantity").alias("value_num"),
        F.when(F.col("l_linenumber") % 5 == 0, F.col("l_returnflag")).alias("value_text"),
        F.round(F.lit(1.0) - F.col("l_discount") * 5, 4).alias("confidence"),
        F.when(F.col("l_returnflag") == "R", "REJECTED").when(F.col("l_linestatus") == "F", "APPROVED").otherwise("NEEDS_REVIEW").alias("status"),
        F.col("l_shipdate").alias("created_at"),
    )


KEYS = ("electricity_kwh", "diesel_l", "water_kl", "waste_t", "headcount_total", "headcount_female", "scope1", "revenue")
EXTRACTION_FIELD = f"""
SELECT concat('f-', {_ID_SQL}) AS id, l_orderkey % 500 AS document_id,
       {list(KEYS)!r}[(l_partkey % {len(KEYS)} + 1)::INT] AS canonical_key, l_quantity AS value_num,
       CASE WHEN l_linenumber % 5 = 0 THEN l_returnflag END AS value_text, round(1.0 - l_discount * 5, 4) AS confidence,
       CASE WHEN l_returnflag = 'R' THEN 'REJECTED' WHEN l_linestatus = 'F' THEN 'APPROVED' ELSE 'NEEDS_REVIEW' END AS status,
       l_shipdate AS created_at
FROM lineitem
"""


def entity_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of region, nation and supplier with dotted paths."""
    r, n, s = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    label = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9_]+", "_"))
    top = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), label("r_name").alias("path"), F.lit("GROUP").alias("kind"), F.lit(0).cast("long").alias("headcount"), F.lit(0.0).alias("revenue"))
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    mid = nr.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.concat_ws(".", label("r_name"), label("n_name")).alias("path"), F.lit("LEGAL_ENTITY").alias("kind"), F.col("n_nationkey").cast("long").alias("headcount"), F.lit(0.0).alias("revenue"))
    leaf = s.join(nr, s.s_nationkey == nr.n_nationkey).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("parent_id"), F.concat_ws(".", label("r_name"), label("n_name"), label("s_name")).alias("path"), F.lit("FACILITY").alias("kind"), (F.col("s_suppkey") % 100).cast("long").alias("headcount"), F.col("s_acctbal").alias("revenue"))
    return top.union(mid).union(leaf)


ENTITY_NODE = """
SELECT concat('r', r_regionkey) AS id, NULL::VARCHAR AS parent_id, lower(regexp_replace(r_name, '[^A-Za-z0-9_]+', '_', 'g')) AS path, 'GROUP' AS kind, 0::BIGINT AS headcount, 0.0::DOUBLE AS revenue FROM region
UNION ALL
SELECT concat('n', n_nationkey), concat('r', n_regionkey), concat(lower(regexp_replace(r_name, '[^A-Za-z0-9_]+', '_', 'g')), '.', lower(regexp_replace(n_name, '[^A-Za-z0-9_]+', '_', 'g'))), 'LEGAL_ENTITY', n_nationkey::BIGINT, 0.0 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('s', s_suppkey), concat('n', n_nationkey), concat(lower(regexp_replace(r_name, '[^A-Za-z0-9_]+', '_', 'g')), '.', lower(regexp_replace(n_name, '[^A-Za-z0-9_]+', '_', 'g')), '.', lower(regexp_replace(s_name, '[^A-Za-z0-9_]+', '_', 'g'))), 'FACILITY', (s_suppkey % 100)::BIGINT, s_acctbal
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def supplier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per supplier and year of shipment, from mean discount and line count."""
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("supplier_id"), F.year("l_shipdate").cast("long").alias("fy")).agg((F.sum(F.col("l_quantity").cast("long")) % 101).cast("long").alias("composite"), F.max("l_shipdate").alias("computed_at"))


SUPPLIER_SCORE = "SELECT l_suppkey AS supplier_id, year(l_shipdate)::BIGINT AS fy, (sum(l_quantity::BIGINT) % 101)::BIGINT AS composite, max(l_shipdate) AS computed_at FROM lineitem GROUP BY ALL"


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 8).cast("long").alias("tenant_id"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("u"), "user_id")).alias("actor_id"), F.col("event_type").alias("action"), F.concat(F.lit("Obj"), (F.col("event_id") % 3).cast("string")).alias("target_type"), F.sha2(F.col("event_id").cast("string"), 256).alias("target_id"), F.col("value"), F.col("ts").alias("created_at"))


AUDIT_LOG = "SELECT event_id AS id, (user_id % 8)::BIGINT AS tenant_id, CASE WHEN user_id % 5 <> 0 THEN concat('u', user_id) END AS actor_id, event_type AS action, concat('Obj', event_id % 3) AS target_type, sha256(event_id::VARCHAR) AS target_id, value, ts AS created_at FROM events"

FRAMES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "metric_event": (metric_event, METRIC_EVENT),
    "extraction_field": (extraction_field, EXTRACTION_FIELD),
    "entity_node": (entity_node, ENTITY_NODE),
    "supplier_score": (supplier_score, SUPPLIER_SCORE),
    "audit_log": (audit_log, AUDIT_LOG),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return FRAMES[name][0](spark, sf_dir) if name in FRAMES else read(spark, sf_dir, name)


def with_frames(names: tuple[str, ...], sql: str) -> str:
    """``sql`` with the frames that it names defined before it; a leading WITH goes on from there."""
    parts = [f"{n} AS ({FRAMES[n][1]})" for n in names if n in FRAMES]
    sql = sql.strip()
    if not parts:
        return sql
    recursive = sql[:15].upper() == "WITH RECURSIVE "
    rest = ", " + sql[15 if recursive else 5 :] if sql[:5].upper() == "WITH " else " " + sql
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)}{rest}"
