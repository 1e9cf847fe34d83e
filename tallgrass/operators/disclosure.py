"""Disclosure resolution: mappings to events to answers with evidence; crosswalks and framework keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.scratch import scratch_path
from .emissions import USABLE_SQL, usable

#: (mapping, disclosure, keys, rule): literal mapping rows of our own, one for each rule that resolution knows.
MAPPINGS = (
    ("m1", "P6-E1", ("ghg_scope1_total",), "SUM"),
    ("m2", "P6-E2", ("ghg_scope2_location", "ghg_scope2_market"), "MAX"),
    ("m3", "P6-E3", ("ghg_scope3_cat1", "ghg_scope3_cat2", "ghg_scope3_cat3"), "SUM"),
    ("m4", "P6-E4", ("purchased_electricity_kwh",), "LATEST"),
    ("m5", "P3-S1", ("ghg_scope3_cat4",), "MIN"),
    ("m6", "P3-S2", ("ghg_scope3_cat5",), "FIRST"),
    ("m7", "P2-G1", ("ghg_scope3_cat6",), "COUNT"),
    ("m8", "P2-G2", ("ghg_scope3_cat7",), "WEIGHTED_AVG"),
    ("m9", "intro", ("headcount_total",), "SUM"),
    ("m10", "P9-C1", ("ghg_scope3_cat8", "never_reported"), "SUM"),
)
_VALUES = ", ".join(f"('{m}', '{d}', {list(k)!r}, '{r}')" for m, d, k, r in MAPPINGS)
MAPPING_SQL = f"mapping AS (SELECT * FROM (VALUES {_VALUES}) t(mapping_id, disclosure, keys, rule))"


def mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, d, list(k), r) for m, d, k, r in MAPPINGS], "mapping_id string, disclosure string, keys array<string>, rule string")


def exploded(spark: SparkSession) -> DataFrame:
    return F.broadcast(mappings(spark).select("mapping_id", "disclosure", "rule", F.explode("keys").alias("canonical_key")))


def by_rule(rule: Column) -> Column:
    """An aggregate by name. WEIGHTED_AVG and COUNT give the sum, as the reporting service does; strict variants are ``by_rule_strict``."""
    at = F.struct("period_end", "id")
    return (
        F.when(rule == "MIN", F.min("value")).when(rule == "MAX", F.max("value"))
        .when(rule == "LATEST", F.max_by("value", at)).when(rule == "FIRST", F.min_by("value", at)).otherwise(F.sum("value"))
    )


def by_rule_strict(rule: Column) -> Column:
    return F.when(rule == "COUNT", F.count("value").cast("double")).when(rule == "WEIGHTED_AVG", F.avg("value")).otherwise(by_rule(rule))


RULE_SQL = "CASE rule WHEN 'MIN' THEN min(value) WHEN 'MAX' THEN max(value) WHEN 'LATEST' THEN max_by(value, (period_end, id)) WHEN 'FIRST' THEN min_by(value, (period_end, id)) {extra} ELSE sum(value) END"


def resolved(e: DataFrame, rule: Column) -> DataFrame:
    rows = usable(e).join(exploded(e.sparkSession), "canonical_key").groupBy("mapping_id", "disclosure", "rule").agg(F.round(rule, 6).alias("answer"), F.count("*").alias("n_events"))
    named = mappings(e.sparkSession).select("mapping_id", "disclosure", "rule")
    return named.join(rows, ["mapping_id", "disclosure", "rule"], "left").select("mapping_id", "disclosure", "rule", "answer", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def _resolve_sql(extra: str = "") -> str:
    return f"""WITH {MAPPING_SQL},
x AS (SELECT mapping_id, disclosure, rule, unnest(keys) AS canonical_key FROM mapping),
r AS (SELECT mapping_id, rule, round({RULE_SQL.format(extra=extra)}, 6) AS answer, count(*)::BIGINT AS n_events FROM x JOIN metric_event USING (canonical_key) WHERE {USABLE_SQL} GROUP BY mapping_id, rule)
SELECT mapping_id, disclosure, m.rule, answer, coalesce(n_events, 0) AS n_events FROM mapping m LEFT JOIN r USING (mapping_id)"""


@query("ag10", "metric_event", sql=_resolve_sql())
def resolve(e: DataFrame) -> DataFrame:
    """Answers by mapping and rule; a mapping without events has none."""
    return resolved(e, by_rule(F.col("rule")))


@query("ag10_strict", "metric_event", sql=_resolve_sql("WHEN 'COUNT' THEN count(value)::DOUBLE WHEN 'WEIGHTED_AVG' THEN avg(value)"))
def resolve_strict(e: DataFrame) -> DataFrame:
    return resolved(e, by_rule_strict(F.col("rule")))


@query("ag11", "metric_event", sql=f"""WITH {MAPPING_SQL}, x AS (SELECT mapping_id, unnest(keys) AS canonical_key FROM mapping)
SELECT mapping_id, tenant_id, scope_node_id, md5(concat(count(*), '-', sum(('0x' || substr(md5(id), 1, 15))::BIGINT))) AS evidence, count(DISTINCT document_id)::BIGINT AS n_documents
FROM x JOIN metric_event USING (canonical_key) WHERE {USABLE_SQL} GROUP BY ALL""")
def evidence(e: DataFrame) -> DataFrame:
    """Evidence of each mapping by scope node: a digest of its event ids in any order (of their number and the sum of their 60-bit hashes), and distinct documents."""
    rows = usable(e).join(exploded(e.sparkSession), "canonical_key")
    hashed = F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("decimal(20, 0)")
    return rows.groupBy("mapping_id", "tenant_id", "scope_node_id").agg(F.md5(F.concat_ws("-", F.count("*").cast("string"), F.sum(hashed).cast("string"))).alias("evidence"), F.count_distinct("document_id").alias("n_documents"))


@query("ag12", "metric_event", sql=f"""WITH {MAPPING_SQL}, x AS (SELECT mapping_id, unnest(keys) AS canonical_key FROM mapping),
r AS (SELECT DISTINCT mapping_id FROM x JOIN metric_event USING (canonical_key) WHERE {USABLE_SQL})
SELECT coalesce(nullif(regexp_extract(disclosure, '^P\\d+'), ''), 'General') AS principle, count(*)::BIGINT AS total, count(r.mapping_id)::BIGINT AS answered FROM mapping m LEFT JOIN r USING (mapping_id) GROUP BY 1""")
def by_principle(e: DataFrame) -> DataFrame:
    principle = F.coalesce(F.nullif(F.regexp_extract("disclosure", r"^P\d+", 0), F.lit("")), F.lit("General"))
    return resolve(e).groupBy(principle.alias("principle")).agg(F.count("*").alias("total"), F.count(F.when(F.col("n_events") > 0, 1)).alias("answered"))


@query("jn4", "metric_event", sql=f"WITH {MAPPING_SQL}, x AS (SELECT mapping_id, unnest(keys) AS canonical_key FROM mapping) SELECT mapping_id, id, value FROM x JOIN metric_event USING (canonical_key) WHERE status = 'LOCKED'")
def mapping_events(e: DataFrame) -> DataFrame:
    return e.where(F.col("status") == "LOCKED").join(exploded(e.sparkSession), "canonical_key").select("mapping_id", "id", "value")


@query("jn23", "metric_event", sql=f"WITH {MAPPING_SQL}, x AS (SELECT DISTINCT unnest(keys) AS canonical_key FROM mapping WHERE disclosure LIKE 'P6%') SELECT canonical_key, count(*)::BIGINT AS n FROM metric_event SEMI JOIN x USING (canonical_key) GROUP BY 1")
def framework_keys(e: DataFrame) -> DataFrame:
    keys = mappings(e.sparkSession).where(F.col("disclosure").startswith("P6")).select(F.explode("keys").alias("canonical_key")).distinct()
    return e.join(F.broadcast(keys), "canonical_key", "left_semi").groupBy("canonical_key").agg(F.count("*").alias("n"))


#: Pairs that are known without a mapping.
GOLDEN = (("ghg_scope1_total", "GRI-305-1"), ("ghg_scope2_location", "GRI-305-2"))
_CROSSWALK = "w AS (SELECT canonical_key, string_agg(disclosure, ',' ORDER BY disclosure) AS disclosures FROM (SELECT unnest(keys) AS canonical_key, disclosure FROM mapping UNION " + " UNION ".join(f"SELECT '{k}', '{d}'" for k, d in GOLDEN) + ") GROUP BY 1)"


def crosswalk(spark: SparkSession) -> DataFrame:
    """Keys to disclosures: inverted mappings merged with literal pairs, as a table that is written and read."""
    golden = spark.createDataFrame(list(GOLDEN), "canonical_key string, disclosure string")
    pairs = mappings(spark).select(F.explode("keys").alias("canonical_key"), "disclosure").union(golden)
    rows = pairs.groupBy("canonical_key").agg(F.concat_ws(",", F.sort_array(F.collect_set("disclosure"))).alias("disclosures"))
    rows.write.parquet(path := scratch_path(spark, "crosswalk"))
    return spark.read.schema(rows.schema).parquet(path)


@query("jn22", "metric_event", sql=f"WITH {MAPPING_SQL}, {_CROSSWALK} SELECT coalesce(e.canonical_key, w.canonical_key) AS canonical_key, disclosures, count(e.canonical_key)::BIGINT AS n FROM metric_event e FULL JOIN w ON e.canonical_key = w.canonical_key GROUP BY 1, 2")
def covered_keys(e: DataFrame) -> DataFrame:
    """Which disclosures the keys of events serve, and how many events a key has; keys of either side alone stay."""
    by = e.groupBy("canonical_key").agg(F.count("*").alias("n"))
    return by.join(crosswalk(e.sparkSession), "canonical_key", "full").select("canonical_key", "disclosures", F.coalesce("n", F.lit(0)).alias("n"))


@query("set1", "metric_event", sql=f"WITH {MAPPING_SQL}, x AS (SELECT DISTINCT unnest(keys) AS canonical_key FROM mapping), r AS (SELECT DISTINCT canonical_key FROM metric_event) SELECT coalesce(x.canonical_key, r.canonical_key) AS canonical_key, x.canonical_key IS NOT NULL AS mapped, r.canonical_key IS NOT NULL AS reported FROM x FULL JOIN r ON x.canonical_key = r.canonical_key")
def union_distinct(e: DataFrame) -> DataFrame:
    """All keys of mappings and events, each once, and where they are from."""
    mapped = mappings(e.sparkSession).select(F.explode("keys").alias("canonical_key"), F.lit(True).alias("mapped"), F.lit(False).alias("reported"))
    both = mapped.union(e.select("canonical_key", F.lit(False), F.lit(True)))
    return both.groupBy("canonical_key").agg(F.max("mapped").alias("mapped"), F.max("reported").alias("reported"))


@query("set3", "metric_event", sql=f"WITH {MAPPING_SQL}, x AS (SELECT left(disclosure, 2) AS framework, unnest(keys) AS k FROM mapping UNION SELECT 'P6', canonical_key FROM metric_event WHERE canonical_key LIKE 'ghg_scope3%') SELECT framework, string_agg(k, ',' ORDER BY k) AS keys FROM x GROUP BY 1")
def union_by_framework(e: DataFrame) -> DataFrame:
    """Of each framework the keys of its mappings and those derived from events, each once."""
    derived = e.where(F.col("canonical_key").startswith("ghg_scope3")).select(F.lit("P6").alias("framework"), F.col("canonical_key").alias("k")).distinct()
    both = mappings(e.sparkSession).select(F.substring("disclosure", 1, 2).alias("framework"), F.explode("keys").alias("k")).union(derived)
    return both.groupBy("framework").agg(F.concat_ws(",", F.sort_array(F.collect_set("k"))).alias("keys"))


@query("set4", "metric_event", sql=f"WITH {MAPPING_SQL}, x AS (SELECT DISTINCT unnest(keys) AS k FROM mapping), t AS (SELECT DISTINCT tenant_id FROM metric_event) SELECT tenant_id, count(*)::BIGINT AS missing FROM t CROSS JOIN x WHERE NOT EXISTS (SELECT 1 FROM metric_event e WHERE e.tenant_id = t.tenant_id AND canonical_key = k) GROUP BY 1")
def missing_keys(e: DataFrame) -> DataFrame:
    """Expected keys that a tenant has not reported, by array difference."""
    expected = F.lit([k for _, _, ks, _ in MAPPINGS for k in ks])
    have = e.groupBy("tenant_id").agg(F.collect_set("canonical_key").alias("have"))
    return have.select("tenant_id", F.size(F.array_except(expected, "have")).cast("long").alias("missing"))


@query("set5", "metric_event", sql="SELECT scope_node_id, count(DISTINCT canonical_key) FILTER (canonical_key IN ('ghg_scope1_total', 'ghg_scope2_location', 'ghg_scope2_market')) = 3 AS covered FROM metric_event GROUP BY 1")
def covered(e: DataFrame) -> DataFrame:
    required = F.lit(["ghg_scope1_total", "ghg_scope2_location", "ghg_scope2_market"])
    return e.groupBy("scope_node_id").agg(F.collect_set("canonical_key").alias("have")).select("scope_node_id", (F.size(F.array_except(required, "have")) == 0).alias("covered"))
