"""Assurance: lineage, sampling, audit chains and Merkle anchors, state machines, access."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.numbered import numbered
from ..sources.scratch import scratch_path
from .emissions import USABLE_SQL, usable


def drawn(*columns: str, seed: int = 7):
    """A hash that stands for a random draw, the same in every run."""
    return F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))


@query("smp1", "metric_event", sql="SELECT id, value FROM metric_event ORDER BY md5(concat_ws('|', id, '7')), id LIMIT 25")
def random_sample(e: DataFrame, n: int = 25) -> DataFrame:
    return e.orderBy(drawn("id"), "id").limit(n).select("id", "value")


@query("smp2", "metric_event", sql="SELECT id, value FROM metric_event ORDER BY value DESC, id LIMIT 25")
def highest_values(e: DataFrame, n: int = 25) -> DataFrame:
    return e.orderBy(F.col("value").desc(), "id").limit(n).select("id", "value")


@query("smp3", "metric_event", sql="""WITH k AS (SELECT count(DISTINCT canonical_key) AS strata FROM metric_event), r AS (SELECT id, canonical_key, row_number() OVER (PARTITION BY canonical_key ORDER BY md5(concat_ws('|', id, '7')), id) AS rn FROM metric_event)
SELECT id, canonical_key FROM r, k WHERE rn <= greatest(1, floor(60 / strata)) ORDER BY canonical_key, rn LIMIT 60""")
def stratified_sample(e: DataFrame, n: int = 60) -> DataFrame:
    """Equal shares of each key, cut to ``n``; the window keeps a group's first rows before it shuffles."""
    strata = F.broadcast(e.agg(F.count_distinct("canonical_key").alias("strata")))
    w = Window.partitionBy("canonical_key").orderBy(drawn("id"), "id")
    ranked = e.select("id", "canonical_key").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return ranked.join(strata).where(F.col("rn") <= F.greatest(F.lit(1), F.floor(n / F.col("strata")))).orderBy("canonical_key", "rn").limit(n).select("id", "canonical_key")


@query("jn3", "metric_event", "extraction_field", "orders", sql=f"""SELECT e.id, f.id AS field_id, f.confidence, o_orderkey AS document_id, CASE WHEN e.status = 'LOCKED' THEN concat('run-', e.tenant_id) END AS calc_run
FROM metric_event e LEFT JOIN extraction_field f ON f.id = concat('f-', e.id) AND f.status = 'APPROVED' LEFT JOIN orders ON o_orderkey = e.document_id AND o_totalprice > 100000 WHERE e.{USABLE_SQL}""")
def lineage(e: DataFrame, f: DataFrame, o: DataFrame) -> DataFrame:
    """Events with the field, document and run that they come from, where there are such."""
    fields = f.where(F.col("status") == "APPROVED").select(F.col("id").alias("field_id"), "confidence")
    docs = o.where(F.col("o_totalprice") > 100000).select(F.col("o_orderkey").alias("doc"))
    x = usable(e).join(fields, F.concat(F.lit("f-"), "id") == F.col("field_id"), "left").join(docs, F.col("document_id") == F.col("doc"), "left")
    return x.select("id", "field_id", "confidence", F.col("doc").alias("document_id"), F.when(F.col("status") == "LOCKED", F.concat(F.lit("run-"), F.col("tenant_id").cast("string"))).alias("calc_run"))


@query("jn8", "lineitem", "orders", sql="SELECT l_orderkey, l_linenumber FROM lineitem SEMI JOIN (SELECT * FROM orders WHERE o_custkey % 8 = 3) o ON l_orderkey = o_orderkey")
def by_parent_tenant(line: DataFrame, o: DataFrame) -> DataFrame:
    return line.join(o.where(F.col("o_custkey") % 8 == 3), line.l_orderkey == o.o_orderkey, "left_semi").select("l_orderkey", "l_linenumber")


@query("jn9", "customer", "orders", sql="SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def row_security(c: DataFrame, o: DataFrame) -> DataFrame:
    return c.join(o.where(F.col("o_orderstatus") == "F"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("jn10", "customer", "orders", sql="SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_owned(c: DataFrame, o: DataFrame) -> DataFrame:
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("jn11", "extraction_field", "metric_event", sql="SELECT id FROM extraction_field f WHERE status = 'APPROVED' AND NOT EXISTS (SELECT 1 FROM metric_event e WHERE concat('f-', e.id) = f.id AND e.status = 'LOCKED')")
def to_promote(f: DataFrame, e: DataFrame) -> DataFrame:
    done = e.where(F.col("status") == "LOCKED").select(F.concat(F.lit("f-"), "id").alias("id"))
    return f.where(F.col("status") == "APPROVED").join(done, "id", "left_anti").select("id")


@query("jn2", "metric_event", "extraction_field", sql=f"SELECT e.id, f.document_id FROM metric_event e LEFT JOIN extraction_field f ON f.id = concat('f-', e.id) WHERE e.{USABLE_SQL} AND e.canonical_key = 'ghg_scope1_total'")
def event_documents(e: DataFrame, f: DataFrame) -> DataFrame:
    fields = f.select(F.col("id").alias("fid"), F.col("document_id").alias("doc"))
    return usable(e).where(F.col("canonical_key") == "ghg_scope1_total").join(fields, F.concat(F.lit("f-"), "id") == F.col("fid"), "left").select("id", F.col("doc").alias("document_id"))


@query("jn1", "extraction_field", "orders", sql="SELECT f.id, f.canonical_key, o_orderdate AS document_date FROM extraction_field f JOIN orders ON f.document_id = o_orderkey")
def field_documents(f: DataFrame, o: DataFrame) -> DataFrame:
    return f.join(o.select("o_orderkey", F.col("o_orderdate").alias("document_date")), F.col("document_id") == F.col("o_orderkey")).select("id", "canonical_key", "document_date")


#: Fixed values: (from, action, to) of metric events.
TRANSITIONS = (("DRAFT", "submit", "SUBMITTED"), ("SUBMITTED", "approve", "APPROVED"), ("SUBMITTED", "reject", "DRAFT"), ("APPROVED", "lock", "LOCKED"))
_TRANS = ", ".join(map(str, TRANSITIONS))


@query("stm1", "metric_event", sql=f"""WITH t AS (SELECT * FROM (VALUES {_TRANS}) t(status, action, next)), x AS (SELECT id, status, ['submit', 'approve', 'reject', 'lock'][(scope_node_id % 4 + 1)::INT] AS action, tenant_id % 3 AS submitter, scope_node_id % 3 AS actor FROM metric_event)
SELECT id, x.status, x.action, CASE WHEN x.action = 'approve' AND submitter = actor THEN NULL ELSE next END AS next FROM x LEFT JOIN t ON x.status = t.status AND x.action = t.action""")
def transitions(e: DataFrame) -> DataFrame:
    """The state after an action; null where it is not allowed, or where one approves what one has submitted."""
    t = F.broadcast(e.sparkSession.createDataFrame(list(TRANSITIONS), "status string, action string, next string"))
    x = e.withColumn("action", F.element_at(F.lit(["submit", "approve", "reject", "lock"]), (F.col("scope_node_id") % 4 + 1).cast("int")))
    own = (F.col("action") == "approve") & (F.col("tenant_id") % 3 == F.col("scope_node_id") % 3)
    return x.join(t, ["status", "action"], "left").select("id", "status", "action", F.when(~own, F.col("next")).alias("next"))


@query("stm2", "orders", sql="SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' WHEN o_custkey % 2 = 0 THEN 'RESPONDED' ELSE 'OPEN' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS closed_at FROM orders")
def exception_states(o: DataFrame) -> DataFrame:
    closed = F.col("o_orderstatus") == "F"
    return o.select("o_orderkey", F.when(closed, "CLOSED").when(F.col("o_custkey") % 2 == 0, "RESPONDED").otherwise("OPEN").alias("status"), F.when(closed, F.col("o_orderdate")).alias("closed_at"))


ZERO = b"\0" * 32


def chained(rows: DataFrame, by: list[str], order: list[str], data: str, out: list[str]) -> DataFrame:
    """``out`` columns of ``rows`` with ``place``, ``prev_hash`` and ``row_hash``: SHA-256 of the hash before it, zeros at first, and the bytes ``data``, along each group.

    Rows of a group come sorted to one task, which holds no more than a batch of them.
    """
    names = [*dict.fromkeys([*by, *out])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prev, k = None, ZERO, 0
        for b in batches:
            places, before, own = [], [], []
            for key, x in zip(zip(*(b[c].to_pylist() for c in by), strict=True), b["_data"].to_pylist(), strict=True):
                if key != now:
                    now, prev, k = key, ZERO, 0
                places.append(k)
                k += 1
                before.append(prev.hex())
                prev = hashlib.sha256(prev + x).digest()
                own.append(prev.hex())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(places, pa.int64()), pa.array(before, pa.string()), pa.array(own, pa.string())], [*names, "place", "prev_hash", "row_hash"])

    x = rows.withColumn("_data", F.col(data).cast("binary")).repartition(*by).sortWithinPartitions(*by, *order).select(*names, "_data")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.drop("_data").schema)
    return x.mapInArrow(run, f"{schema}, place long, prev_hash string, row_hash string")


def payload():
    return F.concat_ws("|", "id", "tenant_id", F.coalesce("actor_id", F.lit("")), "target_type", "target_id", "action")


_PAYLOAD = "concat_ws('|', id, tenant_id, coalesce(actor_id, ''), target_type, target_id, action)"
_ZERO = "'" + ZERO.hex() + "'"


@query("wn6", "audit_log", sql=f"""
WITH RECURSIVE e AS (SELECT tenant_id, date_trunc('hour', created_at) AS hour, id, {_PAYLOAD} AS payload, row_number() OVER (PARTITION BY tenant_id, date_trunc('hour', created_at) ORDER BY created_at, id) AS k FROM audit_log),
c AS (SELECT tenant_id, hour, k, id, {_ZERO} AS prev_hash, sha256(unhex({_ZERO}) || encode(payload)) AS row_hash FROM e WHERE k = 1
UNION ALL SELECT e.tenant_id, e.hour, e.k, e.id, c.row_hash, sha256(unhex(c.row_hash) || encode(e.payload)) FROM c JOIN e ON c.tenant_id = e.tenant_id AND c.hour = e.hour AND e.k = c.k + 1),
h AS (SELECT tenant_id, hour, arg_max(row_hash, k) AS last, row_number() OVER (PARTITION BY tenant_id ORDER BY hour) AS k FROM c GROUP BY 1, 2),
a AS (SELECT tenant_id, hour, k, sha256(unhex({_ZERO}) || unhex(last)) AS anchor FROM h WHERE k = 1 UNION ALL SELECT h.tenant_id, h.hour, h.k, sha256(unhex(a.anchor) || unhex(h.last)) FROM a JOIN h ON a.tenant_id = h.tenant_id AND h.k = a.k + 1)
SELECT c.tenant_id, id, prev_hash, row_hash, anchor FROM c JOIN a ON c.tenant_id = a.tenant_id AND c.hour = a.hour""")
def hash_chain(log: DataFrame) -> DataFrame:
    """Each row's hash covers the hash of the row before it, for each tenant.

    A chain is sequential by its nature, so it has two levels: rows of an hour
    are chained from zeros, and the last hashes of a tenant's hours are chained
    in ``anchor``, which covers all hours up to the row's own; a row or a whole
    hour that is changed or left out breaks every later anchor.  The largest
    group is a tenant's busiest hour, or the number of its hours.
    """
    rows = log.select("tenant_id", F.date_trunc("hour", "created_at").alias("hour"), "id", "created_at", payload().alias("payload"))
    links = chained(rows, ["tenant_id", "hour"], ["created_at", "id"], "payload", ["id"])
    links.write.parquet(path := scratch_path(log.sparkSession, "hash-chain"))
    links = log.sparkSession.read.schema(links.schema).parquet(path)
    last = links.groupBy("tenant_id", "hour").agg(F.unhex(F.max_by("row_hash", "place")).alias("last"))
    anchored = chained(last, ["tenant_id"], ["hour"], "last", ["hour"]).select(F.col("tenant_id").alias("_tenant"), F.col("hour").alias("_hour"), F.col("row_hash").alias("anchor"))
    same = F.col("tenant_id").eqNullSafe(F.col("_tenant")) & F.col("hour").eqNullSafe(F.col("_hour"))
    return links.join(anchored, same).select("tenant_id", "id", "prev_hash", "row_hash", "anchor")


#: Hashes that one task folds: so many levels of a tree at a time.
LEVELS = 10


def merkle(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """(by, leaves, root) of the hashes ``h``: pairs are hashed level by level, an odd one pairs with itself.

    Blocks of 1,024 neighbours become one hash each until one is left, so no
    task holds a whole tree.
    """
    spark, size = rows.sparkSession, 1 << LEVELS
    x = numbered(rows, by, order).select(*by, "h", "place", F.col("n").alias("leaves"), "n")

    def fold(block: pd.DataFrame) -> pd.DataFrame:
        nodes, levels = [bytes.fromhex(h) for h in block.sort_values("place")["h"]], 0
        whole = block["n"].iloc[0] <= size
        while len(nodes) > 1 or (not whole and levels < LEVELS):
            nodes = [hashlib.sha256(nodes[i] + nodes[min(i + 1, len(nodes) - 1)]).digest() for i in range(0, len(nodes), 2)]
            levels += 1
        return block.head(1).assign(h=nodes[0].hex(), place=block["place"].iloc[0] // size)[list(block.columns)]

    while True:
        x.write.parquet(path := scratch_path(spark, "merkle"))
        x = spark.read.schema(x.schema).parquet(path)
        if (x.agg(F.max("n")).first()[0] or 0) <= 1:
            return x.select(*by, "leaves", F.col("h").alias("root"))
        schema = x.withColumn("block", F.lit(0).cast("long")).schema
        x = x.withColumn("block", F.floor(F.col("place") / size)).groupBy(*by, "block").applyInPandas(fold, schema)
        x = x.drop("block").withColumn("n", F.ceil(F.col("n") / size))


def _roots(rows: str, by: str) -> str:
    """Common table expressions up to ``roots`` (by, leaves, root) over ``rows`` (by, h, place, n)."""
    return f"""t AS (SELECT {by}, place, n AS leaves, n, h FROM {rows}
UNION ALL SELECT {by}, place // 2, leaves, (n + 1) // 2, sha256(unhex(arg_min(h, place)) || unhex(arg_max(h, place))) FROM t WHERE n > 1 GROUP BY {by}, place // 2, leaves, n),
roots AS (SELECT {by}, leaves, h AS root FROM t WHERE n = 1)"""


@query("wn16", "audit_log", sql=f"""WITH RECURSIVE l AS (SELECT tenant_id, strftime(created_at, '%Y-%m-%d') AS day, sha256({_PAYLOAD}) AS h, row_number() OVER (PARTITION BY tenant_id, created_at::DATE ORDER BY created_at, id) - 1 AS place, count(*) OVER (PARTITION BY tenant_id, created_at::DATE) AS n FROM audit_log),
{_roots('l', 'tenant_id, day')} SELECT tenant_id, day, leaves, root FROM roots""")
def merkle_roots(log: DataFrame) -> DataFrame:
    """A Merkle root for each tenant and day."""
    rows = log.select("tenant_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "id", "created_at", F.sha2(payload(), 256).alias("h"))
    return merkle(rows, ["tenant_id", "day"], ["created_at", "id"])


@query("str7", "audit_log", sql=f"""WITH RECURSIVE d AS (SELECT max(created_at)::DATE - 1 AS day FROM audit_log), l AS (SELECT tenant_id, id, sha256({_PAYLOAD}) AS h, row_number() OVER (PARTITION BY tenant_id ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY tenant_id) AS n FROM audit_log, d WHERE created_at::DATE = day),
{_roots('l', 'tenant_id')} SELECT tenant_id, strftime((SELECT day FROM d), '%Y-%m-%d') AS day, leaves, root, sha256(root) AS chained, first_id, last_id FROM roots JOIN (SELECT tenant_id, min(id) AS first_id, max(id) AS last_id FROM l GROUP BY 1) USING (tenant_id)""")
def daily_anchor(log: DataFrame, today: str | None = None) -> DataFrame:
    """The anchor of the day before ``today`` (unset: the newest day of the table) for each tenant: root, its hash, and the first and last id."""
    newest = F.lit(today).cast("date") if today else F.lit(log.agg(F.max(F.to_date("created_at"))).first()[0])
    rows = log.where(F.to_date("created_at") == F.date_sub(newest, 1)).select("tenant_id", "id", F.sha2(payload(), 256).alias("h"))
    ends = rows.groupBy("tenant_id").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    roots = merkle(rows, ["tenant_id"], ["id"])
    return roots.join(ends, "tenant_id").select("tenant_id", F.date_format(F.date_sub(newest, 1), "yyyy-MM-dd").alias("day"), "leaves", "root", F.sha2("root", 256).alias("chained"), "first_id", "last_id")


@query("jn7", "customer", sql="""WITH r AS (SELECT * FROM (VALUES ('admin', 'read'), ('admin', 'write'), ('admin', 'approve'), ('auditor', 'read'), ('editor', 'read'), ('editor', 'write')) t(role, permission)),
a AS (SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN ['auditor'] WHEN 1 THEN ['auditor', 'editor'] ELSE ['admin'] END) AS role FROM customer)
SELECT c_custkey, string_agg(DISTINCT permission, ',' ORDER BY permission) AS permissions FROM a JOIN r USING (role) GROUP BY 1""")
def granted(c: DataFrame) -> DataFrame:
    """The union of the permissions of a user's roles."""
    roles = c.sparkSession.createDataFrame([("admin", ["read", "write", "approve"]), ("auditor", ["read"]), ("editor", ["read", "write"])], "role string, permissions array<string>")
    mine = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("auditor"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("auditor"), F.lit("editor"))).otherwise(F.array(F.lit("admin")))
    x = c.select("c_custkey", F.explode(mine).alias("role")).join(F.broadcast(roles), "role").select("c_custkey", F.explode("permissions").alias("p"))
    return x.groupBy("c_custkey").agg(F.concat_ws(",", F.sort_array(F.collect_set("p"))).alias("permissions"))


@query("set6", "customer", sql="SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'approve,write' WHEN 1 THEN 'approve' ELSE '' END AS missing FROM customer")
def missing_permissions(c: DataFrame) -> DataFrame:
    have = F.split("permissions", ",")
    return granted(c).select("c_custkey", F.concat_ws(",", F.array_except(F.lit(["approve", "write"]), have)).alias("missing"))


@query("prj3", "audit_log", sql="SELECT id, coalesce(actor_id, 'system') AS actor, concat(target_type, ' / ', right(target_id, 6)) AS target FROM audit_log")
def activity(log: DataFrame) -> DataFrame:
    return log.select("id", F.coalesce("actor_id", F.lit("system")).alias("actor"), F.concat_ws(" / ", "target_type", F.right("target_id", F.lit(6))).alias("target"))


@query("srt9", "audit_log", sql="SELECT id, created_at FROM audit_log ORDER BY created_at DESC, id DESC LIMIT 20")
def latest_activity(log: DataFrame) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(20).select("id", "created_at")


@query("srt4", "supplier", sql="SELECT s_suppkey, s_name FROM supplier ORDER BY s_name, s_suppkey LIMIT 20 OFFSET 40")
def page(s: DataFrame, take: int = 20, skip: int = 40) -> DataFrame:
    return s.orderBy("s_name", "s_suppkey").offset(skip).limit(min(max(take, 1), 200)).select("s_suppkey", "s_name")


@query("srt5", "audit_log", sql="SELECT id, to_base64(encode(concat(strftime(created_at, '%Y-%m-%d'), '|', id))) AS cursor FROM audit_log WHERE id > 1000 ORDER BY id LIMIT 100")
def keyset(log: DataFrame, last: int = 1000, n: int = 100) -> DataFrame:
    """Rows behind a cursor, by key rather than by offset."""
    cursor = F.base64(F.concat_ws("|", F.date_format("created_at", "yyyy-MM-dd"), "id").cast("binary"))
    return log.where(F.col("id") > last).orderBy("id").limit(n).select("id", cursor.alias("cursor"))


@query("flt1", "audit_log", sql="SELECT id FROM audit_log WHERE tenant_id = 3 AND target_type = 'Obj1'")
def optional_filters(log: DataFrame, tenant: int | None = 3, action: str | None = None, target: str | None = "Obj1") -> DataFrame:
    """Filters that are not given do not filter."""
    for name, value in (("tenant_id", tenant), ("action", action), ("target_type", target)):
        if value is not None:
            log = log.where(F.col(name) == value)
    return log.select("id")


@query("flt8", "customer", sql="SELECT c_custkey FROM customer WHERE c_name ILIKE '%1%' OR c_mktsegment ILIKE '%auto%'")
def contains_any_case(c: DataFrame) -> DataFrame:
    return c.where(F.col("c_name").ilike("%1%") | F.col("c_mktsegment").ilike("%auto%")).select("c_custkey")


@query("ag36", "events", sql="SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (value <= 10)::BIGINT AS le_10, count(*) FILTER (value <= 50)::BIGINT AS le_50, count(*) FILTER (value <= 100)::BIGINT AS le_100 FROM events GROUP BY 1")
def latency_buckets(e: DataFrame) -> DataFrame:
    return e.groupBy("event_type").agg(F.count("*").alias("n"), *(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (10, 50, 100)))
