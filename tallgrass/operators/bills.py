"""Bills and sheets as text: labels of tables, headers, cells with units, pattern ladders, meters, cross-field checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PII, redact
from ..functions.units import gwp_rows
from ..plans.catalog import query


def bill(line: DataFrame) -> DataFrame:
    """A line of bill text for each line item."""
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    day = F.date_format("l_shipdate", "dd-MM-yyyy")
    text = F.concat(F.element_at(F.lit(["Units Consumed: ", "Net Units ", "Water supplied ", "Scrap lifted "]), (F.col("l_linenumber") % 4 + 1).cast("int")), q, F.lit(" kWh Bill Period: "), day, F.lit(" to "), F.date_format(F.date_add(F.col("l_shipdate").cast("date"), 29), "dd-MM-yyyy"), F.lit(" Meter "), n)
    return line.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", text.alias("text"))


@query("sc_s5", "lineitem", sql="SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::DOUBLE AS number, CASE l_linenumber % 3 WHEN 0 THEN 'kwh' WHEN 1 THEN 't' END AS unit FROM lineitem")
def cells(line: DataFrame) -> DataFrame:
    """A cell into number and unit; a cell without a unit has none."""
    unit = F.element_at(F.lit([" kWh", " t", ""]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    cell = F.concat(F.col("l_quantity").cast("long").cast("string"), unit)
    p = r"^\s*([\d,.]+)\s*([A-Za-z]*)\s*$"
    return line.select("l_orderkey", "l_linenumber", F.regexp_extract(cell, p, 1).try_cast("double").alias("number"), F.nullif(F.lower(F.regexp_extract(cell, p, 2)), F.lit("")).alias("unit"))


@query("sc_s4", "part", sql=r"SELECT p_partkey, trim(regexp_replace(lower(concat(' ', p_type, ' (', p_brand, ') ')), '[^a-z0-9]+', ' ', 'g')) AS header, regexp_matches(lower(p_name), '^(grand )?total') AS total_row, lower(p_type) IN ('unit', 'uom') AS unit_column FROM part")
def headers(p: DataFrame) -> DataFrame:
    """Headers in one spelling; rows of totals and columns of units."""
    h = F.trim(F.regexp_replace(F.lower(F.concat(F.lit(" "), "p_type", F.lit(" ("), "p_brand", F.lit(") "))), "[^a-z0-9]+", " "))
    return p.select("p_partkey", h.alias("header"), F.lower("p_name").rlike("^(grand )?total").alias("total_row"), F.lower("p_type").isin("unit", "uom").alias("unit_column"))


@query("sc_s12", "customer", sql=r"SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^[A-Za-z#0-9 ]{3,40}$') THEN trim(replace(c_name, '#', ' ')) END AS name, abs(c_acctbal) < 1e6 AS plausible FROM customer")
def plausible_values(c: DataFrame) -> DataFrame:
    return c.select("c_custkey", F.when(F.col("c_name").rlike("^[A-Za-z#0-9 ]{3,40}$"), F.trim(F.replace("c_name", F.lit("#"), F.lit(" ")))).alias("name"), (F.abs("c_acctbal") < 1e6).alias("plausible"))


@query("doc7", "customer", sql="SELECT c_custkey, 'segment' AS label, c_mktsegment AS value, NULL::VARCHAR AS unit FROM customer UNION ALL SELECT c_custkey, 'balance', floor(c_acctbal)::BIGINT::VARCHAR, 'INR' FROM customer")
def label_value_tables(c: DataFrame) -> DataFrame:
    """Rows of label, value and perhaps unit."""
    rows = F.array(F.array(F.lit("segment"), "c_mktsegment"), F.array(F.lit("balance"), F.floor("c_acctbal").cast("long").cast("string"), F.lit("INR")))
    x = c.select("c_custkey", F.explode(rows).alias("r"))
    return x.select("c_custkey", F.get("r", F.lit(0)).alias("label"), F.get("r", F.lit(1)).alias("value"), F.get("r", F.lit(2)).alias("unit"))


@query("doc17", "extraction_field", sql="WITH d AS (SELECT document_id, max(value_num) FILTER (canonical_key = 'headcount_total') AS t, max(value_num) FILTER (canonical_key = 'headcount_female') AS f, max(value_num) FILTER (canonical_key = 'scope1') AS s, max(value_num) FILTER (canonical_key = 'diesel_l') AS l FROM extraction_field GROUP BY 1) SELECT document_id, coalesce(f > t, false) AS women_over_total, coalesce(s > 0 AND l IS NULL, false) AS scope1_without_fuel, coalesce(abs(s - l * 0.00268) > 0.1 * s, false) AS fuel_mismatch FROM d")
def cross_checks(f: DataFrame) -> DataFrame:
    """Checks across the fields of a document, from one pivot."""
    d = f.groupBy("document_id").pivot("canonical_key", ["headcount_total", "headcount_female", "scope1", "diesel_l"]).agg(F.max("value_num"))
    ok = lambda c: F.coalesce(c, F.lit(False))
    s, fuel = F.col("scope1"), F.col("diesel_l")
    return d.select("document_id", ok(F.col("headcount_female") > F.col("headcount_total")).alias("women_over_total"), ok((s > 0) & fuel.isNull()).alias("scope1_without_fuel"), ok(F.abs(s - fuel * 0.00268) > 0.1 * s).alias("fuel_mismatch"))


#: Fixed values: (from, action, to) of reports; a creator does not approve an own report.
REPORT_STEPS = (("DRAFT", "approve", "APPROVED"), ("GENERATED", "approve", "APPROVED"), ("IN_REVIEW", "approve", "APPROVED"), ("APPROVED", "file", "FILED"))


@query("stm3", "orders", sql=f"WITH t AS (SELECT * FROM (VALUES {', '.join(map(str, REPORT_STEPS))}) t(status, action, next)), x AS (SELECT o_orderkey, ['DRAFT', 'GENERATED', 'APPROVED'][(o_orderkey % 3 + 1)::INT] AS status, CASE WHEN o_custkey % 2 = 0 THEN 'approve' ELSE 'file' END AS action, o_custkey % 4 = 0 AS own FROM orders) SELECT o_orderkey, CASE WHEN NOT (own AND x.action = 'approve') THEN next END AS next FROM x LEFT JOIN t ON x.status = t.status AND x.action = t.action")
def report_steps(o: DataFrame) -> DataFrame:
    steps = F.broadcast(o.sparkSession.createDataFrame(list(REPORT_STEPS), "status string, action string, next string"))
    x = o.select("o_orderkey", F.element_at(F.lit(["DRAFT", "GENERATED", "APPROVED"]), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("status"), F.when(F.col("o_custkey") % 2 == 0, "approve").otherwise("file").alias("action"), (F.col("o_custkey") % 4 == 0).alias("own"))
    return x.join(steps, ["status", "action"], "left").select("o_orderkey", F.when(~(F.col("own") & (F.col("action") == "approve")), F.col("next")).alias("next"))


@query("sc_m6", "lineitem", sql="SELECT l_orderkey, l_linenumber, round(l_quantity * 29.8, 4)::DOUBLE AS ar6, round(l_quantity * 30, 4)::DOUBLE AS ar5 FROM lineitem")
def methane(line: DataFrame) -> DataFrame:
    """CO2e of methane by two assessment reports."""
    gwp = gwp_rows(line.sparkSession).where(F.col("gas") == "CH4_FOSSIL").groupBy().pivot("basis", ["AR5", "AR6_100"]).agg(F.first("gwp"))
    x = line.join(F.broadcast(gwp))
    return x.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("AR6_100"), 4).alias("ar6"), F.round(F.col("l_quantity") * F.col("AR5"), 4).alias("ar5"))


@query("ret10", "conversations", "embeddings")
def redact_then_embed(c: DataFrame, e: DataFrame) -> DataFrame:
    """Redacted turns with the vector, of length 1, that is stored for the conversation; null where there is none."""
    clean = redact(c.select("conv_id", "turn", "text"), "text", PII[:4])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    vectors = e.select(F.col("vec_id").alias("conv_id"), F.transform("embedding", lambda x: x / norm).alias("vector"))
    return clean.join(vectors, "conv_id", "left").select("conv_id", "turn", F.md5("text").alias("text_md5"), F.size("vector").alias("dims"), "vector")
