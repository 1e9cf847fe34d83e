"""Emission analytics over metric events: filters, totals, trends, pathways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query

USABLE = ("APPROVED", "LOCKED")
#: Fixed value: tonnes of CO2e for a kWh of purchased electricity.
GRID_FACTOR = 0.000716
USABLE_SQL = "status IN ('APPROVED', 'LOCKED')"


def fiscal_year(day: Column) -> Column:
    """The year in which the fiscal year (from 1 April) of a day starts."""
    return (F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)).cast("long")


def fy_label(start: Column) -> Column:
    return F.concat(F.lit("FY"), start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


FY = "(year(period_end) - CASE WHEN month(period_end) < 4 THEN 1 ELSE 0 END)::BIGINT"


def usable(e: DataFrame) -> DataFrame:
    return e.where(F.col("status").isin(*USABLE))


def key_sum(*keys: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("canonical_key").isin(*keys), F.col("value"))), F.lit(0.0))


@query("ag1", "metric_event", sql=f"SELECT tenant_id, canonical_key, round(sum(value), 6) AS total, min(unit) AS unit FROM metric_event WHERE {USABLE_SQL} GROUP BY ALL")
def sum_by_key(e: DataFrame) -> DataFrame:
    """Sums by key; a key with more than one unit stops the run."""
    sums = usable(e).groupBy("tenant_id", "canonical_key").agg(F.round(F.sum("value"), 6).alias("total"), F.min("unit").alias("unit"), F.max("unit").alias("other"))
    checked = F.when(F.col("unit") != F.col("other"), F.raise_error(F.concat(F.lit("mixed units for "), "canonical_key"))).otherwise(F.col("unit"))
    return sums.select("tenant_id", "canonical_key", "total", checked.cast("string").alias("unit"))


@query("ag2", "metric_event", sql=f"""
SELECT CASE WHEN canonical_key = 'ghg_scope1_total' THEN 1 WHEN canonical_key LIKE 'ghg_scope2%' THEN 2 ELSE 3 END::INT AS scope, canonical_key, round(sum(value), 6) AS total
FROM metric_event WHERE {USABLE_SQL} AND canonical_key LIKE 'ghg_scope%' GROUP BY ALL""")
def sum_by_scope(e: DataFrame) -> DataFrame:
    scope = F.when(F.col("canonical_key") == "ghg_scope1_total", 1).when(F.col("canonical_key").startswith("ghg_scope2"), 2).otherwise(3)
    return usable(e).where(F.col("canonical_key").startswith("ghg_scope")).groupBy(scope.alias("scope"), "canonical_key").agg(F.round(F.sum("value"), 6).alias("total"))


OVERVIEW = f"""
SELECT fy, round(s1, 3) AS scope1, round(s2l + kwh * {GRID_FACTOR}, 3) AS scope2_location, round(s2m, 3) AS scope2_market, round(s3, 3) AS scope3,
       round(s1 + s2l + kwh * {GRID_FACTOR} + s3, 3) AS total
FROM (SELECT {FY} AS fy,
  coalesce(sum(value) FILTER (canonical_key = 'ghg_scope1_total'), 0) AS s1, coalesce(sum(value) FILTER (canonical_key = 'ghg_scope2_location'), 0) AS s2l,
  coalesce(sum(value) FILTER (canonical_key = 'ghg_scope2_market'), 0) AS s2m, coalesce(sum(value) FILTER (canonical_key LIKE 'ghg_scope3_cat%'), 0) AS s3,
  coalesce(sum(value) FILTER (canonical_key = 'purchased_electricity_kwh'), 0) AS kwh
  FROM metric_event WHERE {USABLE_SQL} GROUP BY 1)"""


@query("ag3", "metric_event", sql=OVERVIEW)
def overview(e: DataFrame) -> DataFrame:
    """Scope totals by fiscal year in one aggregate; purchased electricity always counts into location-based scope 2, market-based scope 2 stays out of the total."""
    s3 = F.coalesce(F.sum(F.when(F.col("canonical_key").startswith("ghg_scope3_cat"), F.col("value"))), F.lit(0.0))
    sums = usable(e).groupBy(fiscal_year(F.col("period_end")).alias("fy")).agg(key_sum("ghg_scope1_total").alias("s1"), key_sum("ghg_scope2_location").alias("s2l"), key_sum("ghg_scope2_market").alias("s2m"), s3.alias("s3"), key_sum("purchased_electricity_kwh").alias("kwh"))
    location = F.col("s2l") + F.col("kwh") * GRID_FACTOR
    return sums.select("fy", F.round("s1", 3).alias("scope1"), F.round(location, 3).alias("scope2_location"), F.round("s2m", 3).alias("scope2_market"), F.round("s3", 3).alias("scope3"), F.round(F.col("s1") + location + F.col("s3"), 3).alias("total"))


@query("ag4", "metric_event", sql=f"""
SELECT strftime(period_end, '%Y-%m') AS month, round(sum(CASE WHEN canonical_key = 'purchased_electricity_kwh' THEN value * {GRID_FACTOR} ELSE value END), 3) AS total
FROM metric_event WHERE {USABLE_SQL} GROUP BY 1""")
def monthly_trend(e: DataFrame) -> DataFrame:
    """Tonnes by month; unlike the overview's total it includes market-based scope 2."""
    tonnes = F.when(F.col("canonical_key") == "purchased_electricity_kwh", F.col("value") * GRID_FACTOR).otherwise(F.col("value"))
    return usable(e).groupBy(F.date_format("period_end", "yyyy-MM").alias("month")).agg(F.round(F.sum(tonnes), 3).alias("total"))


@query("ag5", "metric_event", sql=f"""
WITH t AS (SELECT tenant_id, {FY} AS fy, sum(value) AS total FROM metric_event WHERE {USABLE_SQL} AND canonical_key LIKE 'ghg_scope%' GROUP BY ALL),
p AS (SELECT a.tenant_id, a.fy, a.total, coalesce(b.total, 0) AS prior FROM t a LEFT JOIN t b ON a.tenant_id = b.tenant_id AND a.fy = b.fy + 1)
SELECT tenant_id, fy, round(total, 3) AS total, round(prior, 3) AS prior, CASE WHEN prior <= 0 THEN 0.0 ELSE round((total - prior) / prior * 100, 1) END AS delta_pct FROM p""")
def dashboard_delta(e: DataFrame) -> DataFrame:
    """Total and prior year's total; the change is 0 where there is no positive prior. Both scope 2 figures are in the total."""
    sums = usable(e).where(F.col("canonical_key").startswith("ghg_scope")).groupBy("tenant_id", fiscal_year(F.col("period_end")).alias("fy")).agg(F.sum("value").alias("total"))
    w = Window.partitionBy("tenant_id").orderBy("fy")
    before = F.when(F.lag("fy").over(w) == F.col("fy") - 1, F.lag("total").over(w))
    t = sums.withColumn("prior", F.coalesce(before, F.lit(0.0)))
    change = F.when(F.col("prior") <= 0, 0.0).otherwise(F.round((F.col("total") - F.col("prior")) / F.col("prior") * 100, 1))
    return t.select("tenant_id", "fy", F.round("total", 3).alias("total"), F.round("prior", 3).alias("prior"), change.alias("delta_pct"))


@query("ag6", "metric_event", sql=f"""
WITH y AS (SELECT DISTINCT {FY} AS fy FROM metric_event WHERE {USABLE_SQL}),
m AS (SELECT fy, unnest(generate_series(make_date(fy::INT, 4, 1)::TIMESTAMP, make_date(fy::INT + 1, 3, 1)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM y),
s AS (SELECT period_start, sum(value) AS total FROM metric_event WHERE {USABLE_SQL} AND canonical_key LIKE 'ghg_scope%' GROUP BY 1)
SELECT fy, strftime(month, '%Y-%m') AS month, round(coalesce(total, 0), 3) AS total FROM m LEFT JOIN s ON month = period_start""")
def sparkline(e: DataFrame) -> DataFrame:
    """Twelve months of each fiscal year, 0 where there is nothing."""
    e = usable(e)
    years = e.select(fiscal_year(F.col("period_end")).alias("fy")).distinct()
    first = F.make_date(F.col("fy").cast("int"), F.lit(4), F.lit(1))
    months = years.select("fy", F.explode(F.sequence(first, F.add_months(first, 11), F.expr("interval 1 month"))).alias("month"))
    sums = e.where(F.col("canonical_key").startswith("ghg_scope")).groupBy(F.col("period_start").alias("month")).agg(F.sum("value").alias("total"))
    return months.join(sums, "month", "left").select("fy", F.date_format("month", "yyyy-MM").alias("month"), F.round(F.coalesce("total", F.lit(0.0)), 3).alias("total"))


@query("ag7", "metric_event", sql=f"""
SELECT tenant_id, count(DISTINCT canonical_key)::BIGINT AS with_data, round(count(DISTINCT canonical_key) / 20.0 * 100, 2) AS pct, floor(count(DISTINCT canonical_key) / 20.0 * 100 * 0.8 + 0.5)::BIGINT AS score
FROM metric_event WHERE {USABLE_SQL} GROUP BY 1""")
def completeness(e: DataFrame, mapped: int = 20) -> DataFrame:
    pct = F.col("with_data") / mapped * 100
    return usable(e).groupBy("tenant_id").agg(F.count_distinct("canonical_key").alias("with_data")).select("tenant_id", "with_data", F.round(pct, 2).alias("pct"), F.floor(pct * 0.8 + 0.5).cast("long").alias("score"))


@query("ag8", "metric_event", sql="SELECT DISTINCT tenant_id, canonical_key FROM metric_event")
def distinct_keys(e: DataFrame) -> DataFrame:
    return e.select("tenant_id", "canonical_key").distinct()


@query("ag9", "metric_event", sql=f"SELECT tenant_id, round(coalesce(sum(value) FILTER (canonical_key = 'purchased_electricity_kwh'), 0) / 1000, 2) AS mwh FROM metric_event WHERE {USABLE_SQL} GROUP BY 1")
def energy_mwh(e: DataFrame) -> DataFrame:
    return usable(e).groupBy("tenant_id").agg(F.round(key_sum("purchased_electricity_kwh") / 1000, 2).alias("mwh"))


@query("ag13", "extraction_field", sql="""
SELECT status, count(*)::BIGINT AS n, count(*) FILTER (confidence < 0.85)::BIGINT AS low, count(*) FILTER (created_at > (SELECT max(created_at) FROM extraction_field) - INTERVAL 1 DAY)::BIGINT AS last_day FROM extraction_field GROUP BY 1""")
def status_histogram(f: DataFrame) -> DataFrame:
    """Rows by status, of low confidence, and of the last 24 hours before the newest row."""
    newest = f.agg(F.max("created_at").alias("newest"))
    return f.join(F.broadcast(newest)).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.85).alias("low"), F.count_if(F.col("created_at") > F.col("newest") - F.expr("interval 1 day")).alias("last_day"))


@query("ag19", "metric_event", sql="SELECT year(period_end)::BIGINT AS year, round(sum(value), 3) AS baseline FROM metric_event WHERE canonical_key LIKE 'ghg_%' GROUP BY 1")
def baselines(e: DataFrame) -> DataFrame:
    """Baseline by year of period end, of any status."""
    return e.where(F.col("canonical_key").startswith("ghg_")).groupBy(F.year("period_end").cast("long").alias("year")).agg(F.round(F.sum("value"), 3).alias("baseline"))


@query("ag20", "metric_event", sql=f"""
SELECT tenant_id, canonical_key, round(sum(value), 3) AS total, min(unit) AS unit FROM metric_event
WHERE {USABLE_SQL} AND canonical_key IN ('ghg_scope1_total', 'ghg_scope2_location', 'ghg_scope2_market', 'purchased_electricity_kwh', 'ghg_scope3_cat1') GROUP BY ALL""")
def kpi_totals(e: DataFrame) -> DataFrame:
    keys = ("ghg_scope1_total", "ghg_scope2_location", "ghg_scope2_market", "purchased_electricity_kwh", "ghg_scope3_cat1")
    return usable(e).where(F.col("canonical_key").isin(*keys)).groupBy("tenant_id", "canonical_key").agg(F.round(F.sum("value"), 3).alias("total"), F.min("unit").alias("unit"))


@query("ag21", "metric_event", sql=f"""
SELECT strftime(period_start, '%Y-%m') AS month, round(coalesce(sum(value) FILTER (canonical_key = 'ghg_scope1_total'), 0), 3) AS scope1,
 round(coalesce(sum(value) FILTER (canonical_key LIKE 'ghg_scope2%'), 0), 3) AS scope2, round(coalesce(sum(value) FILTER (canonical_key LIKE 'ghg_scope3%'), 0), 3) AS scope3
FROM metric_event WHERE {USABLE_SQL} AND canonical_key LIKE 'ghg_scope%' GROUP BY 1""")
def scope_matrix(e: DataFrame) -> DataFrame:
    """Months by scopes, one pass."""
    scope = F.concat(F.lit("scope"), F.substring("canonical_key", 10, 1))
    by_month = usable(e).where(F.col("canonical_key").startswith("ghg_scope")).withColumn("scope", scope).groupBy(F.date_format("period_start", "yyyy-MM").alias("month"))
    wide = by_month.pivot("scope", ["scope1", "scope2", "scope3"]).agg(F.sum("value"))
    return wide.select("month", *(F.round(F.coalesce(F.col(c), F.lit(0.0)), 3).alias(c) for c in ("scope1", "scope2", "scope3")))


@query("ag34", "metric_event", sql="SELECT tenant_id, count(*)::BIGINT AS members, count(CASE WHEN document_id % 3 = 0 THEN document_id END)::BIGINT AS with_evidence FROM metric_event WHERE status = 'LOCKED' GROUP BY 1")
def snapshot_counts(e: DataFrame) -> DataFrame:
    return e.where(F.col("status") == "LOCKED").groupBy("tenant_id").agg(F.count("*").alias("members"), F.count(F.when(F.col("document_id") % 3 == 0, F.col("document_id"))).alias("with_evidence"))


@query("flt3", "metric_event", sql="SELECT id, canonical_key, value FROM metric_event WHERE period_start >= DATE '1995-04-01' AND period_end <= DATE '1996-03-31'")
def contained_in_period(e: DataFrame, start: str = "1995-04-01", end: str = "1996-03-31") -> DataFrame:
    """Events whose whole period lies inside."""
    return e.where((F.col("period_start") >= F.lit(start).cast("date")) & (F.col("period_end") <= F.lit(end).cast("date"))).select("id", "canonical_key", "value")


@query("flt4", "metric_event", sql=f"SELECT status, count(*)::BIGINT AS n FROM metric_event WHERE {USABLE_SQL} GROUP BY 1")
def usable_facts(e: DataFrame) -> DataFrame:
    return usable(e).groupBy("status").agg(F.count("*").alias("n"))


@query("flt10", "metric_event", sql=r"SELECT canonical_key, count(*)::BIGINT AS n FROM metric_event WHERE regexp_matches(canonical_key, '^ghg_scope3_cat\d+$') GROUP BY 1")
def scope3_keys(e: DataFrame) -> DataFrame:
    return e.where(F.col("canonical_key").rlike(r"^ghg_scope3_cat\d+$")).groupBy("canonical_key").agg(F.count("*").alias("n"))


@query("wn5", "metric_event", sql=f"""
WITH t AS (SELECT {FY} AS fy, sum(value) AS total FROM metric_event WHERE {USABLE_SQL} GROUP BY 1)
SELECT fy, round(total, 3) AS total, round(lag(total) OVER (ORDER BY fy), 3) AS prior FROM t""")
def year_over_year(e: DataFrame) -> DataFrame:
    """Totals with the prior year's; the window runs over years, a handful of rows."""
    sums = usable(e).groupBy(fiscal_year(F.col("period_end")).alias("fy")).agg(F.sum("value").alias("total"))
    return sums.select("fy", F.round("total", 3).alias("total"), F.round(F.lag("total").over(Window.orderBy("fy")), 3).alias("prior"))


@query("wn7", "metric_event", sql="""
WITH b AS (SELECT tenant_id, sum(value) AS baseline FROM metric_event WHERE year(period_end) = 1995 AND canonical_key LIKE 'ghg_%' GROUP BY 1)
SELECT tenant_id, y::BIGINT AS year, round(greatest(0, baseline - baseline * 0.9 / 25 * (y - 1995)), 3) AS pathway FROM b, range(1995, 2021) t(y)""")
def pathway(e: DataFrame, base: int = 1995, target: int = 2020, cut: float = 0.9) -> DataFrame:
    """A straight line from the baseline year to the target year, one row a year."""
    b = e.where((F.year("period_end") == base) & F.col("canonical_key").startswith("ghg_")).groupBy("tenant_id").agg(F.sum("value").alias("baseline"))
    year = b.select("tenant_id", "baseline", F.explode(F.sequence(F.lit(base).cast("long"), F.lit(target).cast("long"))).alias("year"))
    line = F.col("baseline") - F.col("baseline") * cut / (target - base) * (F.col("year") - base)
    return year.select("tenant_id", "year", F.round(F.greatest(F.lit(0.0), line), 3).alias("pathway"))


@query("jn24", "metric_event", "entity_node", sql=f"""
WITH a AS (SELECT concat('s', scope_node_id) AS id, sum(value) FILTER (canonical_key LIKE 'ghg_%') AS emissions, sum(value) FILTER (canonical_key = 'purchased_electricity_kwh') AS energy FROM metric_event WHERE {USABLE_SQL} GROUP BY 1)
SELECT n.id, n.path, round(coalesce(emissions, 0), 3) AS emissions, round(coalesce(energy, 0), 3) AS energy, CASE WHEN energy > 0 THEN round(coalesce(emissions, 0) / energy, 6) END AS intensity
FROM entity_node n LEFT JOIN a USING (id) WHERE kind = 'FACILITY'""")
def facility_intensity(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Emissions and energy of every facility; intensity is null without energy."""
    sums = usable(e).groupBy(F.concat(F.lit("s"), "scope_node_id").alias("id")).agg(F.sum(F.when(F.col("canonical_key").startswith("ghg_"), F.col("value"))).alias("emissions"), F.sum(F.when(F.col("canonical_key") == "purchased_electricity_kwh", F.col("value"))).alias("energy"))
    x = nodes.where(F.col("kind") == "FACILITY").join(sums, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.select("id", "path", F.round(zero("emissions"), 3).alias("emissions"), F.round(zero("energy"), 3).alias("energy"), F.when(F.col("energy") > 0, F.round(zero("emissions") / F.col("energy"), 6)).alias("intensity"))


_BY_EMISSIONS = f"SELECT scope_node_id, round(sum(value), 3) AS emissions FROM metric_event WHERE {USABLE_SQL} AND canonical_key LIKE 'ghg_%' GROUP BY 1 ORDER BY 2 DESC, 1"


@query("srt7", "metric_event", sql=_BY_EMISSIONS)
def facilities_by_emissions(e: DataFrame) -> DataFrame:
    """All facilities with emissions, the largest first."""
    sums = usable(e).where(F.col("canonical_key").startswith("ghg_")).groupBy("scope_node_id").agg(F.round(F.sum("value"), 3).alias("emissions"))
    return sums.orderBy(F.col("emissions").desc(), "scope_node_id")
