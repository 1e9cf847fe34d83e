"""Fiscal periods as column expressions; years start on 1 April, all dates are UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.emissions import fiscal_year, fy_label
from ..plans.catalog import query

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def parse_period(text: Column) -> Column:
    """A struct (start, end) of ``a..b``, ``Q1 FY2024-25``, ``FY2024-25``, ``Apr 2024`` or ``2024-04``; null for anything else."""
    t = F.trim(text)
    part = lambda p, i: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    number = lambda p, i: part(p, i).cast("int")
    months = lambda first, n: F.struct(first.alias("start"), F.date_sub(F.add_months(first, n), 1).alias("end"))
    pair, quarter, fy, named, iso = r"^(\d{4}-\d{2}-\d{2})\.\.(\d{4}-\d{2}-\d{2})$", r"(?i)^Q([1-4])\s+FY(\d{4})-(\d{2})$", r"(?i)^FY(\d{4})-(\d{2})$", r"^([A-Za-z]{3,9})\s+(\d{4})$", r"^(\d{4})-(\d{2})$"
    month = F.array_position(F.lit(list(MONTHS)), F.lower(F.substring(part(named, 1), 1, 3))).cast("int")
    return (
        F.when(t.rlike(pair), F.struct(part(pair, 1).try_cast("date").alias("start"), part(pair, 2).try_cast("date").alias("end")))
        .when(t.rlike(quarter), months(F.add_months(F.make_date(number(quarter, 2), F.lit(4), F.lit(1)), (number(quarter, 1) - 1) * 3), 3))
        .when(t.rlike(fy), months(F.make_date(number(fy, 1), F.lit(4), F.lit(1)), 12))
        .when(t.rlike(named) & (month > 0), months(F.make_date(number(named, 2), month, F.lit(1)), 1))
        .when(t.rlike(iso) & number(iso, 2).between(1, 12), months(F.make_date(number(iso, 1), number(iso, 2), F.lit(1)), 1))
    )


def format_period(start: Column, end: Column) -> Column:
    return F.concat_ws("..", F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd"))


def days_in_period(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def overlap_days(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.least(e1, e2), F.greatest(s1, s2)) + 1)


def split_into_months(start: Column, end: Column) -> Column:
    """An array of (start, end), one for each month met, the first and last clipped."""
    firsts = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return F.transform(firsts, lambda m: F.struct(F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end")))


ORDER_DAY = "o_orderdate::DATE"
_FY = f"(year({ORDER_DAY}) - CASE WHEN month({ORDER_DAY}) < 4 THEN 1 ELSE 0 END)"


@query("sc_d1", "orders", sql=f"SELECT o_orderkey, concat('FY', {_FY}, '-', lpad((({_FY} + 1) % 100)::VARCHAR, 2, '0')) AS label, make_date({_FY}::INT, 4, 1) AS start, make_date({_FY}::INT + 1, 3, 31) AS \"end\" FROM orders")
def fiscal_years(o: DataFrame) -> DataFrame:
    start = fiscal_year(F.col("o_orderdate").cast("date"))
    return o.select("o_orderkey", fy_label(start).alias("label"), F.make_date(start.cast("int"), F.lit(4), F.lit(1)).alias("start"), F.make_date(start.cast("int") + 1, F.lit(3), F.lit(31)).alias("end"))


def _texts(o: DataFrame) -> DataFrame:
    d, y = F.col("o_orderdate").cast("date"), F.year("o_orderdate")
    fy = F.concat(F.lit("FY"), y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(".."), F.date_format(F.date_add(d, 40), "yyyy-MM-dd"))).when(k == 1, F.concat(F.lit("Q"), (F.col("o_custkey") % 4 + 1).cast("string"), F.lit(" "), fy)).when(k == 2, fy).when(k == 3, F.concat(F.date_format(d, "MMM"), F.lit(" "), y.cast("string"))).when(k == 4, F.date_format(d, "yyyy-MM")).otherwise("someday")
    return o.select("o_orderkey", "o_custkey", d.alias("day"), text.alias("period"))


@query("sc_d2", "orders", sql=f"""
WITH d AS (SELECT o_orderkey, o_custkey, {ORDER_DAY} AS day, o_orderkey % 6 AS k, year(o_orderdate)::INT AS y FROM orders),
s AS (SELECT *, CASE k WHEN 0 THEN day WHEN 1 THEN (make_date(y, 4, 1) + to_months((o_custkey % 4 * 3)::INT))::DATE WHEN 2 THEN make_date(y, 4, 1) WHEN 3 THEN date_trunc('month', day)::DATE WHEN 4 THEN date_trunc('month', day)::DATE END AS s FROM d)
SELECT o_orderkey, strftime(s, '%Y-%m-%d') AS start, strftime(CASE k WHEN 0 THEN day + 40 WHEN 1 THEN (s + INTERVAL 3 MONTH)::DATE - 1 WHEN 2 THEN make_date(y + 1, 3, 31) ELSE last_day(s) END, '%Y-%m-%d') AS "end" FROM s""")
def parsed_periods(o: DataFrame) -> DataFrame:
    p = _texts(o).select("o_orderkey", parse_period(F.col("period")).alias("p"))
    return p.select("o_orderkey", F.date_format("p.start", "yyyy-MM-dd").alias("start"), F.date_format("p.end", "yyyy-MM-dd").alias("end"))


@query("sc_d3", "orders", sql=f"SELECT o_orderkey, concat(strftime({ORDER_DAY}, '%Y-%m-%d'), '..', strftime({ORDER_DAY} + 30, '%Y-%m-%d')) AS period FROM orders")
def formatted(o: DataFrame) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", format_period(d, F.date_add(d, 30)).alias("period"))


@query("sc_d4", "metric_event", sql="SELECT id, (period_end - period_start + 1)::INT AS days FROM metric_event")
def period_days(e: DataFrame) -> DataFrame:
    return e.select("id", days_in_period(F.col("period_start"), F.col("period_end")).alias("days"))


@query("sc_d5", "orders", sql=f"SELECT o_orderkey, greatest(0, least({ORDER_DAY} + 45, DATE '1995-12-31') - greatest({ORDER_DAY}, DATE '1995-01-01') + 1)::INT AS days FROM orders")
def overlaps(o: DataFrame) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", overlap_days(d, F.date_add(d, 45), F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date")).alias("days"))


@query("sc_d6", "orders", sql=f"""
WITH m AS (SELECT o_orderkey, {ORDER_DAY} AS s, {ORDER_DAY} + 70 AS e, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', {ORDER_DAY} + 70), INTERVAL 1 MONTH))::DATE AS m FROM orders)
SELECT o_orderkey, greatest(m, s) AS start, least(last_day(m), e) AS "end" FROM m""")
def months(o: DataFrame) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", F.explode(split_into_months(d, F.date_add(d, 70))).alias("m")).select("o_orderkey", "m.start", "m.end")


@query("sc_d7", "metric_event", sql="WITH x AS (SELECT tenant_id, max(period_end) AS d FROM metric_event WHERE status = 'APPROVED' GROUP BY 1) SELECT tenant_id, (year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END)::BIGINT AS fy FROM x")
def latest_year(e: DataFrame) -> DataFrame:
    return e.where(F.col("status") == "APPROVED").groupBy("tenant_id").agg(fiscal_year(F.max("period_end")).alias("fy"))


@query("sc_d8", "orders", sql=f"SELECT o_orderkey, concat('FY', lpad(({_FY} % 100)::VARCHAR, 2, '0'), '-', lpad((({_FY} + 1) % 100)::VARCHAR, 2, '0')) AS label FROM orders")
def short_labels(o: DataFrame) -> DataFrame:
    fy = fiscal_year(F.col("o_orderdate").cast("date"))
    two = lambda y: F.lpad((y % 100).cast("string"), 2, "0")
    return o.select("o_orderkey", F.concat(F.lit("FY"), two(fy), F.lit("-"), two(fy + 1)).alias("label"))


def parse_fy(text: Column, fallback: int = 2024) -> Column:
    """The start year of ``FY24-25``, ``2024-2025`` or a year; else a fallback."""
    short, long, year = r"(?i)^FY(\d{2})-\d{2}$", r"^(\d{4})-\d{2,4}$", r"^(\d{4})$"
    got = lambda p: F.regexp_extract(text, p, 1)
    return F.when(text.rlike(short), 2000 + got(short).try_cast("int")).when(text.rlike(long), got(long).try_cast("int")).when(text.rlike(year), got(year).try_cast("int")).otherwise(fallback).cast("long")


@query("sc_d9", "orders", sql="SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2000 + year(o_orderdate) % 100 WHEN 1 THEN year(o_orderdate) WHEN 2 THEN year(o_orderdate) ELSE 2024 END::BIGINT AS fy FROM orders")
def parsed_years(o: DataFrame) -> DataFrame:
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    two = lambda x: F.lpad((x % 100).cast("string"), 2, "0")
    text = F.when(k == 0, F.concat(F.lit("FY"), two(y), F.lit("-"), two(y + 1))).when(k == 1, F.concat_ws("-", y.cast("string"), (y + 1).cast("string"))).when(k == 2, y.cast("string")).otherwise("this year")
    return o.select("o_orderkey", parse_fy(text).alias("fy"))


@query("sc_d10", "orders", sql="SELECT o_orderkey, greatest(1, round((epoch(o_orderdate + to_hours((o_custkey % 100)::INT)) - epoch(o_orderdate)) / 86400.0))::BIGINT AS days FROM orders")
def exclusive_days(o: DataFrame) -> DataFrame:
    seconds = F.lit(3600) * (F.col("o_custkey") % 100)
    return o.select("o_orderkey", F.greatest(F.lit(1), F.round(seconds / 86400.0).cast("long")).cast("long").alias("days"))


@query("sc_d12", "orders", sql="SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END, '%Y-%m-%d') AS day FROM orders")
def lenient_dates(o: DataFrame) -> DataFrame:
    """Day, month and year in one of three spellings; null for anything else."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k == 1, F.date_format("o_orderdate", "dd MMM yyyy")).when(k == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("n/a")
    day = F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("date") for p in ("dd-MM-yyyy", "dd MMM yyyy", "dd/MM/yyyy")))
    return o.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"))
