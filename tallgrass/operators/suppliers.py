"""Supplier scores, materiality surveys, carbon projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.scratch import scratch_path
from ..sources.upsert import created, partitions, upsert


def js_round(x: Column) -> Column:
    """Half up towards positive infinity."""
    return F.floor(x + 0.5).cast("long")


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 50, "C").when(score >= 30, "D").otherwise("F")


GRADE = "CASE WHEN composite >= 85 THEN 'A' WHEN composite >= 70 THEN 'B' WHEN composite >= 50 THEN 'C' WHEN composite >= 30 THEN 'D' ELSE 'F' END"
LATEST = "l AS (SELECT * FROM supplier_score QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY computed_at DESC, fy DESC) = 1)"


def latest(scores: DataFrame) -> DataFrame:
    """The newest score of each supplier: a partial aggregate, not a sort of the group."""
    newest = F.max_by(F.struct("fy", "composite", "computed_at"), F.struct("computed_at", "fy"))
    return scores.groupBy("supplier_id").agg(newest.alias("s")).select("supplier_id", "s.*")


@query("jn5", "supplier", "supplier_score", sql=f"WITH {LATEST} SELECT s_suppkey, s_name, fy, composite FROM supplier LEFT JOIN l ON s_suppkey = supplier_id")
def supplier_latest(s: DataFrame, scores: DataFrame) -> DataFrame:
    return s.join(latest(scores), s.s_suppkey == F.col("supplier_id"), "left").select("s_suppkey", "s_name", "fy", "composite")


@query("wn1", "supplier_score", sql=f"WITH {LATEST} SELECT supplier_id, fy, composite FROM l")
def latest_scores(scores: DataFrame) -> DataFrame:
    return latest(scores).select("supplier_id", "fy", "composite")


@query("ag17", "lineitem", sql="""
WITH t AS (SELECT l_suppkey AS supplier_id, floor(100.0 * count(*) FILTER (l_returnflag = 'A') / count(*) + 0.5)::BIGINT AS e, floor(100.0 * count(*) FILTER (l_returnflag = 'N') / count(*) + 0.5)::BIGINT AS s,
 floor(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*) + 0.5)::BIGINT AS g FROM lineitem GROUP BY 1)
SELECT *, floor((e + s + g) / 3.0 + 0.5)::BIGINT AS composite FROM t""")
def score_shares(line: DataFrame) -> DataFrame:
    """Shares of answers by kind, and their rounded mean; the answers themselves do not count."""
    share = lambda k: js_round(F.count_if(F.col("l_returnflag") == k) * 100.0 / F.count("*"))
    t = line.groupBy(F.col("l_suppkey").alias("supplier_id")).agg(share("A").alias("e"), share("N").alias("s"), share("R").alias("g"))
    return t.withColumn("composite", js_round((F.col("e") + F.col("s") + F.col("g")) / 3.0))


@query("ag18", "supplier_score", sql=f"WITH {LATEST} SELECT {GRADE} AS grade, count(*)::BIGINT AS n, round(avg(composite), 6) AS mean FROM l GROUP BY 1")
def grade_histogram(scores: DataFrame) -> DataFrame:
    return latest(scores).groupBy(grade(F.col("composite")).alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("composite"), 6).alias("mean"))


@query("snk3", "supplier_score", sql="SELECT supplier_id, fy, (composite + CASE WHEN fy >= 1996 THEN 1 ELSE 0 END)::BIGINT AS composite FROM supplier_score")
def upsert_scores(scores: DataFrame) -> DataFrame:
    """A table of scores by year, and new scores of some years upserted into it by supplier and year."""
    path = scratch_path(scores.sparkSession, "scores")
    rows = scores.select("supplier_id", "composite", "computed_at", "fy")
    created(rows, path, "fy")
    upsert(rows.where(F.col("fy") >= 1996).withColumn("composite", F.col("composite") + 1), path, ["supplier_id"], "fy", "computed_at")
    return partitions(scores.sparkSession, path, rows.schema).select("supplier_id", "fy", "composite")


#: A survey response holds scores as JSON.
def responses(orders: DataFrame) -> DataFrame:
    scores = F.to_json(F.struct(F.array(F.struct(F.col("o_orderpriority").alias("topic"), (F.col("o_custkey") % 5 + 1).alias("importance"))).alias("scores")))
    return orders.select("o_orderkey", (F.col("o_custkey") % 10).alias("survey_id"), scores.alias("responses"))


@query("ag16", "orders", sql="SELECT o_orderpriority AS topic, round(avg(o_custkey % 5 + 1), 6) AS importance, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def topic_importance(orders: DataFrame) -> DataFrame:
    """Mean importance of each topic out of JSON scores."""
    parsed = F.from_json("responses", "scores array<struct<topic string, importance double>>")
    rows = responses(orders).select(F.explode(parsed["scores"]).alias("s"))
    return rows.groupBy("s.topic").agg(F.round(F.avg("s.importance"), 6).alias("importance"), F.count("*").alias("n"))


@query("jn6", "orders", sql="SELECT o_custkey % 10 AS survey_id, count(*)::BIGINT AS n_responses FROM orders WHERE o_custkey % 10 < 7 GROUP BY 1")
def surveys(orders: DataFrame) -> DataFrame:
    open_surveys = orders.sparkSession.range(7).withColumnRenamed("id", "survey_id")
    return responses(orders).join(F.broadcast(open_surveys), "survey_id").groupBy("survey_id").agg(F.count("*").alias("n_responses"))


@query("srt6", "part", sql="SELECT p_type AS topic, round(avg(p_size), 6) AS score FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def top_topics(part: DataFrame) -> DataFrame:
    return part.groupBy(F.col("p_type").alias("topic")).agg(F.round(F.avg("p_size"), 6).alias("score")).orderBy(F.col("score").desc(), "topic").limit(12)


@query("sc_j1", "orders", sql="SELECT o_orderkey, (o_custkey % 5 + 1)::BIGINT AS importance FROM orders")
def json_path(orders: DataFrame) -> DataFrame:
    return responses(orders).select("o_orderkey", F.get_json_object("responses", "$.scores[0].importance").cast("long").alias("importance"))


def annuity(capex: Column, opex: Column, reduction: Column, years: Column, rate: float = 0.08) -> Column:
    """Cost of a tonne over a project's life; 0 where nothing is reduced."""
    yearly = capex / ((1 - F.pow(F.lit(1 + rate), -years)) / rate)
    return F.when(reduction > 0, (yearly + opex) / reduction).otherwise(0.0)


MAC = "SELECT p_partkey AS id, p_size::DOUBLE AS reduction, CASE WHEN p_size > 0 THEN (p_retailprice / ((1 - pow(1.08, -(p_partkey % 10 + 1))) / 0.08) + 10) / p_size ELSE 0 END AS mac FROM part"


def mac_frame(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("reduction"), annuity(F.col("p_retailprice"), F.lit(10.0), F.col("p_size"), F.col("p_partkey") % 10 + 1).alias("mac"), (F.col("p_partkey") % 16).alias("group"))


@query("sc_m7", "part", sql=f"SELECT id, round(mac, 4) AS mac FROM ({MAC})")
def marginal_cost(part: DataFrame) -> DataFrame:
    return mac_frame(part).select("id", F.round("mac", 4).alias("mac"))


_BY_COST = f"SELECT id, round(mac, 4) AS mac FROM ({MAC}) ORDER BY 2, 1"


@query("srt8", "part", sql=_BY_COST)
def cost_curve_all(part: DataFrame) -> DataFrame:
    """All projects by rising cost of a tonne."""
    return mac_frame(part).select("id", F.round("mac", 4).alias("mac")).orderBy("mac", "id")


@query("wn8", "part", sql=f"SELECT id, id % 16 AS portfolio, sum(reduction) OVER (PARTITION BY id % 16 ORDER BY round(mac, 4), id) AS cumulative FROM ({MAC})")
def cost_curve_position(part: DataFrame) -> DataFrame:
    """Cumulative reduction by rising cost within a portfolio."""
    w = Window.partitionBy("group").orderBy(F.round("mac", 4), "id").rowsBetween(Window.unboundedPreceding, 0)
    return mac_frame(part).select("id", F.col("group").alias("portfolio"), F.sum("reduction").over(w).alias("cumulative"))


@query("ag35", "part", sql="SELECT p_brand AS status, sum(p_size)::BIGINT AS tonnes, round(sum(p_retailprice), 2) AS capex, count(*) FILTER (p_size > 25)::BIGINT AS large FROM part GROUP BY 1")
def project_totals(part: DataFrame) -> DataFrame:
    return part.groupBy(F.col("p_brand").alias("status")).agg(F.sum("p_size").alias("tonnes"), F.round(F.sum("p_retailprice"), 2).alias("capex"), F.count_if(F.col("p_size") > 25).alias("large"))
