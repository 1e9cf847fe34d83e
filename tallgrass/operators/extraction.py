"""Extracted fields: confidence, priors, deduplication, agreement, promotion, and the rule pack over pivoted documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.binding import KEYS
from ..plans.catalog import query
from ..sources.scratch import scratch_path


def level(confidence: Column) -> Column:
    return F.when(confidence < 0.65, "LOW").when(confidence < 0.85, "MEDIUM").otherwise("HIGH")


LEVEL = "CASE WHEN confidence < 0.65 THEN 'LOW' WHEN confidence < 0.85 THEN 'MEDIUM' ELSE 'HIGH' END"


@query("ag33", "extraction_field", sql=f"SELECT {LEVEL} AS level, count(*)::BIGINT AS n FROM extraction_field GROUP BY 1")
def level_histogram(f: DataFrame) -> DataFrame:
    return f.groupBy(level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))


@query("sc_m9", "extraction_field", sql=f"SELECT id, {LEVEL} AS level, CASE WHEN confidence < 0.5 THEN 'VERY_LOW' WHEN confidence < 0.75 THEN 'LOW' WHEN confidence < 0.9 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM extraction_field")
def bands(f: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return f.select("id", level(c).alias("level"), F.when(c < 0.5, "VERY_LOW").when(c < 0.75, "LOW").when(c < 0.9, "MEDIUM").otherwise("HIGH").alias("band"))


def clamped(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.5).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


@query("sc_m10", "extraction_field", sql="SELECT id, round(least(greatest(confidence, 0), 1) * least(greatest(value_num / 40, 0), 1), 6) AS product FROM extraction_field")
def confidence_product(f: DataFrame) -> DataFrame:
    return f.select("id", F.round(clamped(F.col("confidence")) * clamped(F.col("value_num") / 40), 6).alias("product"))


def geometric_mean(parts: list[Column], floor: float = 1e-3) -> Column:
    total = sum((F.ln(F.greatest(p, F.lit(floor))) for p in parts[1:]), F.ln(F.greatest(parts[0], F.lit(floor))))
    return F.exp(total / len(parts))


@query("ag25", "extraction_field", sql="SELECT id, round(exp((ln(greatest(confidence, 0.001)) + ln(greatest(value_num / 50, 0.001)) + ln(0.9)) / 3), 6) AS score FROM extraction_field")
def composite_score(f: DataFrame) -> DataFrame:
    return f.select("id", F.round(geometric_mean([F.col("confidence"), F.col("value_num") / 50, F.lit(0.9)]), 6).alias("score"))


@query("ag26", "extraction_field", sql="SELECT id, round(exp(0.7 * ln(least(greatest(confidence, 1e-6), 1)) + 0.3 * ln(least(greatest(value_num / 50, 1e-6), 1))), 6) AS geometric, round(0.7 * confidence + 0.3 * value_num / 50, 6) AS arithmetic FROM extraction_field")
def weighted_means(f: DataFrame) -> DataFrame:
    part = lambda x: F.ln(F.least(F.greatest(x, F.lit(1e-6)), F.lit(1.0)))
    c, v = F.col("confidence"), F.col("value_num") / 50
    return f.select("id", F.round(F.exp(0.7 * part(c) + 0.3 * part(v)), 6).alias("geometric"), F.round(0.7 * c + 0.3 * F.col("value_num") / 50, 6).alias("arithmetic"))


@query("ag28", "extraction_field", sql="WITH w AS (SELECT *, CASE WHEN canonical_key IN ('electricity_kwh', 'scope1') THEN 3 ELSE 1 END AS w FROM extraction_field) SELECT document_id, round(sum(w * confidence) / sum(w), 6) AS confidence FROM w GROUP BY 1")
def document_confidence(f: DataFrame) -> DataFrame:
    """Weighted mean; critical fields count three times."""
    w = F.when(F.col("canonical_key").isin("electricity_kwh", "scope1"), 3).otherwise(1)
    return f.groupBy("document_id").agg(F.round(F.sum(w * F.col("confidence")) / F.sum(w), 6).alias("confidence"))


PRIOR = "OVER (PARTITION BY canonical_key, document_id ORDER BY created_at, id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"


@query("src15", "extraction_field", sql="SELECT canonical_key, id, value_num FROM extraction_field QUALIFY row_number() OVER (PARTITION BY canonical_key ORDER BY created_at DESC, id) <= 8")
def last_priors(f: DataFrame, n: int = 8) -> DataFrame:
    w = Window.partitionBy("canonical_key").orderBy(F.col("created_at").desc(), "id")
    return f.select("canonical_key", "id", "value_num", F.row_number().over(w).alias("rn")).where(F.col("rn") <= n).drop("rn")


@query("wn2", "extraction_field", sql="SELECT document_id, canonical_key, id FROM extraction_field QUALIFY row_number() OVER (PARTITION BY document_id, canonical_key ORDER BY created_at DESC, id) <= 8")
def last_per_document(f: DataFrame) -> DataFrame:
    w = Window.partitionBy("document_id", "canonical_key").orderBy(F.col("created_at").desc(), "id")
    return f.select("document_id", "canonical_key", "id", F.row_number().over(w).alias("rn")).where(F.col("rn") <= 8).drop("rn")


def priors():
    """Up to eight rows before this one."""
    return Window.partitionBy("canonical_key", "document_id").orderBy("created_at", "id").rowsBetween(-8, -1)


def deviation(values: Column) -> Column:
    """Sample deviation of an array, null below two values: Welford's update in their order, as the SQL has it.

    Spark's ``stddev_samp`` rounds its steps otherwise, which tells where a value
    lies just three deviations away.
    """

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["squares"] / (s["n"] - 1))))


@query("ag24", "extraction_field", sql="SELECT canonical_key, round(avg(value_num), 6) AS mean, round(stddev_samp(value_num), 6) AS sd, min(value_num) AS low, max(value_num) AS high FROM extraction_field GROUP BY 1")
def prior_statistics(f: DataFrame) -> DataFrame:
    return f.groupBy("canonical_key").agg(F.round(F.avg("value_num"), 6).alias("mean"), F.round(F.stddev_samp("value_num"), 6).alias("sd"), F.min("value_num").alias("low"), F.max("value_num").alias("high"))


_STATS = f"s AS (SELECT id, value_num AS v, count(*) {PRIOR} AS n, avg(value_num) {PRIOR} AS mean, stddev_samp(value_num) {PRIOR} AS sd FROM extraction_field)"


def with_priors(f: DataFrame) -> DataFrame:
    w = priors()
    return f.select("id", F.col("value_num").alias("v"), F.count("*").over(w).alias("n"), F.avg("value_num").over(w).alias("mean"), deviation(F.collect_list("value_num").over(w)).alias("sd"))


@query("wn3", "extraction_field", sql=f"WITH {_STATS} SELECT id, CASE WHEN n < 3 THEN false WHEN sd < 1e-9 THEN abs(v - mean) > greatest(1, 0.5 * abs(mean)) ELSE abs(v - mean) / sd > 3 END AS outlier FROM s")
def outliers(f: DataFrame) -> DataFrame:
    """More than three deviations from up to eight priors (at least three); with no deviation, more than half the mean away."""
    gap = F.abs(F.col("v") - F.col("mean"))
    far = F.when(F.col("n") < 3, False).when(F.col("sd") < 1e-9, gap > F.greatest(F.lit(1.0), 0.5 * F.abs("mean"))).otherwise(gap / F.col("sd") > 3)
    return with_priors(f).select("id", far.alias("outlier"))


@query("wn4", "extraction_field", sql=f"WITH {_STATS} SELECT id, round(CASE WHEN n < 2 THEN 0.7 WHEN sd < 1e-9 THEN CASE WHEN abs(v - mean) < 1e-9 THEN 1.0 ELSE 0.5 END ELSE exp(-pow((v - mean) / sd, 2) / 4.5) END, 6) AS confidence FROM s")
def prior_confidence(f: DataFrame) -> DataFrame:
    gap = F.col("v") - F.col("mean")
    c = F.when(F.col("n") < 2, 0.7).when(F.col("sd") < 1e-9, F.when(F.abs(gap) < 1e-9, 1.0).otherwise(0.5)).otherwise(F.exp(-F.pow(gap / F.col("sd"), F.lit(2)) / 4.5))
    return with_priors(f).select("id", F.round(c, 6).alias("confidence"))


@query("wn13", "extraction_field", sql="""SELECT document_id, canonical_key, id, confidence, evidence FROM (SELECT *, row_number() OVER (PARTITION BY document_id, canonical_key ORDER BY confidence DESC, value_text IS NULL, id) AS rn,
 least(6, count(*) OVER (PARTITION BY document_id, canonical_key))::INT AS evidence FROM extraction_field) WHERE rn = 1""")
def keep_best(f: DataFrame) -> DataFrame:
    """The best field of each key and document, with up to six pieces of evidence."""
    w = Window.partitionBy("document_id", "canonical_key").orderBy(F.col("confidence").desc(), F.col("value_text").isNull(), "id")
    n = Window.partitionBy("document_id", "canonical_key")
    ranked = f.withColumn("rn", F.row_number().over(w)).withColumn("evidence", F.least(F.lit(6), F.count("*").over(n)).cast("int"))
    return ranked.where(F.col("rn") == 1).select("document_id", "canonical_key", "id", "confidence", "evidence")


@query("wn14", "extraction_field", sql="SELECT canonical_key, max_by(value_num, (confidence, id)) AS value FROM extraction_field GROUP BY 1")
def best_by_key(f: DataFrame) -> DataFrame:
    return f.groupBy("canonical_key").agg(F.max_by("value_num", F.struct("confidence", "id")).alias("value"))


@query("wn15", "extraction_field", sql="SELECT id, (count(DISTINCT value_num) OVER (PARTITION BY document_id, canonical_key) - 1)::BIGINT AS others FROM extraction_field")
def siblings(f: DataFrame) -> DataFrame:
    """How many other values of its key a document has."""
    w = Window.partitionBy("document_id", "canonical_key")
    return f.select("id", (F.size(F.collect_set("value_num").over(w)) - 1).cast("long").alias("others"))


@query("sc_m11", "extraction_field", sql="SELECT document_id, canonical_key, round(exp(-6 * (max(value_num) - min(value_num)) / greatest(abs(max(value_num)), 1e-9)), 6) AS agreement FROM extraction_field GROUP BY ALL")
def agreement(f: DataFrame) -> DataFrame:
    high, low = F.max("value_num"), F.min("value_num")
    return f.groupBy("document_id", "canonical_key").agg(F.round(F.exp(-6 * (high - low) / F.greatest(F.abs(high), F.lit(1e-9))), 6).alias("agreement"))


@query("ag29", "extraction_field", sql="""WITH x AS (SELECT *, year(created_at)::BIGINT AS year, coalesce(value_text, '') AS dimension, length(value_num::BIGINT::VARCHAR) AS size FROM extraction_field),
d AS (SELECT document_id, canonical_key, year, dimension, round(value_num, 4) AS v, min(id) AS first, min((-confidence, size, id)) AS best FROM x GROUP BY ALL),
g AS (SELECT document_id, canonical_key, year, dimension, count(*) AS n, min_by(v, first) AS base, max(v) AS hi, min(v) AS lo, min(best) AS best FROM d GROUP BY ALL),
t AS (SELECT *, n < 2 OR CASE WHEN base = 0 THEN greatest(abs(hi), abs(lo)) < 1e-9 ELSE greatest(abs(hi - base), abs(lo - base)) / abs(base) <= 0.02 END AS agree FROM g)
SELECT document_id, canonical_key, year, dimension, best[3] AS id, false AS needs_review FROM t WHERE agree UNION ALL
SELECT document_id, canonical_key, year, dimension, first, true FROM (SELECT d.*, row_number() OVER (PARTITION BY document_id, canonical_key, year, dimension ORDER BY first) AS r FROM d JOIN t USING (document_id, canonical_key, year, dimension) WHERE NOT agree) WHERE r <= 2""")
def merge_fields(f: DataFrame) -> DataFrame:
    """One field for each key, period and dimension of a document where its values are within 2 per cent of the first: the surest, then the shortest, then the first.

    Where they are not, the first two different values stay, both for review.
    """
    by = ["document_id", "canonical_key", "year", "dimension"]
    x = f.withColumns({"year": F.year("created_at").cast("long"), "dimension": F.coalesce("value_text", F.lit("")), "v": F.round("value_num", 4), "size": F.length(F.col("value_num").cast("long").cast("string"))})
    values = x.groupBy(*by, "v").agg(F.min("id").alias("first"), F.min(F.struct((-F.col("confidence")).alias("c"), "size", "id")).alias("best"))
    g = values.groupBy(*by).agg(F.count("*").alias("n"), F.min_by("v", "first").alias("pivot"), F.max("v").alias("hi"), F.min("v").alias("lo"), F.min("best").alias("best"))
    pivot = F.col("pivot")
    far = F.when(pivot == 0, F.greatest(F.abs("hi"), F.abs("lo")) < 1e-9).otherwise(F.greatest(F.abs(F.col("hi") - pivot), F.abs(F.col("lo") - pivot)) / F.abs(pivot) <= 0.02)
    g = g.withColumn("agree", (F.col("n") < 2) | far)
    two = values.join(g.where(~F.col("agree")).select(*by), by).withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("first"))).where(F.col("r") <= 2)
    return g.where("agree").select(*by, F.col("best.id").alias("id"), F.lit(False).alias("needs_review")).union(two.select(*by, F.col("first").alias("id"), F.lit(True).alias("needs_review")))


@query("snk9", "extraction_field", sql="SELECT document_id, count(*) FILTER (confidence < 0.85)::BIGINT AS needs_review, CASE WHEN avg(confidence) < 0.85 THEN 'NEEDS_REVIEW' ELSE 'EXTRACTED' END AS status FROM extraction_field GROUP BY 1")
def document_status(f: DataFrame) -> DataFrame:
    return f.groupBy("document_id").agg(F.count_if(F.col("confidence") < 0.85).alias("needs_review"), F.when(F.avg("confidence") < 0.85, "NEEDS_REVIEW").otherwise("EXTRACTED").alias("status"))


@query("stm5", "extraction_field", "orders", sql="SELECT f.id, canonical_key, value_num FROM extraction_field f SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON f.document_id = o_orderkey WHERE status = 'APPROVED' AND value_num > 0 AND value_text IS NULL AND confidence >= 0.65 AND canonical_key <> 'revenue'")
def promotable(f: DataFrame, o: DataFrame) -> DataFrame:
    ok = (F.col("status") == "APPROVED") & (F.col("value_num") > 0) & F.col("value_text").isNull() & (F.col("confidence") >= 0.65) & (F.col("canonical_key") != "revenue")
    done = o.where(F.col("o_orderstatus") == "F")
    return f.where(ok).join(done, f.document_id == done.o_orderkey, "left_semi").select("id", "canonical_key", "value_num")


@query("stm6", "metric_event", sql="SELECT id, CASE WHEN canonical_key LIKE 'ghg_scope3%' AND unit <> 'kgCO2e' AND value > 45 THEN 'NEEDS_REVIEW' ELSE status END AS status FROM metric_event")
def unit_review(e: DataFrame) -> DataFrame:
    """A unit that the registry does not allow for the key asks for review."""
    allowed = e.sparkSession.createDataFrame([(f"ghg_scope3_cat{i}", ["kgCO2e"]) for i in range(1, 16)], "canonical_key string, allowed array<string>")
    x = e.join(F.broadcast(allowed), "canonical_key", "left")
    bad = F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("unit")) & (F.col("value") > 45)
    return x.select("id", F.when(bad, "NEEDS_REVIEW").otherwise(F.col("status")).alias("status"))


@query("prj2", "extraction_field", sql="SELECT id, coalesce(value_text, value_num::BIGINT::VARCHAR) AS value, coalesce(confidence, 0) AS confidence FROM extraction_field")
def client_shape(f: DataFrame) -> DataFrame:
    return f.select("id", F.coalesce("value_text", F.col("value_num").cast("long").cast("string")).alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


@query("prj4", "metric_event", sql="SELECT DISTINCT canonical_key, array_to_string(list_transform(string_split(canonical_key, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM metric_event")
def pretty_keys(e: DataFrame) -> DataFrame:
    return e.select("canonical_key").distinct().select("canonical_key", F.initcap(F.replace("canonical_key", F.lit("_"), F.lit(" "))).alias("label"))


@query("srt2", "extraction_field", sql="SELECT id, confidence FROM extraction_field WHERE status = 'NEEDS_REVIEW' ORDER BY confidence, created_at, id LIMIT 200")
def review_queue(f: DataFrame) -> DataFrame:
    return f.where(F.col("status") == "NEEDS_REVIEW").orderBy("confidence", "created_at", "id").limit(200).select("id", "confidence")


SEVERITIES = ("LOW", "MEDIUM", "HIGH")


_RANKED = f"SELECT id, level, row_number() OVER (ORDER BY list_position({list(SEVERITIES)!r}, level) DESC, id)::BIGINT AS rank FROM (SELECT id, {LEVEL} AS level FROM extraction_field)"


@query("srt3", "extraction_field", sql=_RANKED)
def by_ordinal_all(f: DataFrame) -> DataFrame:
    """Ranks of all rows by the place of a level in its list, not by its name.

    Rows are numbered within sorted ranges; the window that gives a range its
    offset runs over one row for each range.
    """
    spark, path, order = f.sparkSession, scratch_path(f.sparkSession, "ranges"), (F.col("place").desc(), F.col("id"))
    x = f.select("id", level(F.col("confidence")).alias("level"))
    x = x.withColumn("place", F.array_position(F.lit(list(SEVERITIES)), F.col("level")))
    x = x.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "level", F.monotonically_increasing_id().alias("at"))
    x.write.parquet(path)
    # the upper bits of ``at`` are the range, the lower 33 the place in it
    x = spark.read.schema(x.schema).parquet(path).select("id", "level", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = x.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return x.join(F.broadcast(offsets), "part").select("id", "level", (F.col("before") + F.col("at") + 1).alias("rank"))


@query("flt12", "extraction_field", sql="SELECT id FROM extraction_field WHERE confidence < 0.85 AND status = 'NEEDS_REVIEW'")
def low_confidence(f: DataFrame) -> DataFrame:
    return f.where((F.col("confidence") < 0.85) & (F.col("status") == "NEEDS_REVIEW")).select("id")


@query("flt13", "extraction_field", sql="SELECT id, value_num >= CASE canonical_key WHEN 'revenue' THEN 10 ELSE 0 END - 1e-9 AND value_num <= CASE canonical_key WHEN 'scope1' THEN 40 ELSE 1000 END + 1e-9 AS inside FROM extraction_field")
def in_bounds(f: DataFrame) -> DataFrame:
    rows = [(k, 10.0 if k == "revenue" else 0.0, 40.0 if k == "scope1" else 1000.0) for k in KEYS]
    bounds = F.broadcast(f.sparkSession.createDataFrame(rows, "canonical_key string, low double, high double"))
    return f.join(bounds, "canonical_key", "left").select("id", F.col("value_num").between(F.col("low") - 1e-9, F.col("high") + 1e-9).alias("inside"))


# --- the rule pack: every rule is one column over a document's pivoted fields -------------------------------------------

# Who complains.
GROUPS = ("employees", "consumers", "workers", "community", "shareholders", "value_chain")
COMPLAINTS = tuple(f"complaints_{what}_{g}" for g in GROUPS for what in ("received", "resolved"))
FIELDS = (
    "headcount_total headcount_female headcount_male lgbtq pwd women_mgmt_pct gender_pay_gap_pct renewable_kwh grid_kwh electricity_kwh "
    "water_consumed water_withdrawn water_recycled water_discharged waste_recycled waste_haz waste_non scope2_location scope2_market women_directors directors "
    "independent_directors certified_independent diesel_l fatalities safety_trained hr_trained capex turnover csr_spend pat cost_inr period_days"
).split() + list(COMPLAINTS)


@dataclass(frozen=True)
class Rule:
    """``fails`` is true where a document breaks the rule; a missing field never does."""

    name: str
    severity: str
    fails: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


CONSUMED = "electricity_kwh renewable_kwh grid_kwh diesel_l water_consumed water_withdrawn water_recycled water_discharged waste_recycled waste_haz waste_non".split()
COUNTED = "headcount_total headcount_female headcount_male lgbtq pwd directors women_directors independent_directors fatalities".split() + list(COMPLAINTS)


def _any(names: list[str], fails: Callable[[Column], Column]) -> Column:
    return reduce(lambda a, b: a | b, (fails(_c(n)) for n in names))


# Names, severities and limits of the rules.
RULES = (
    Rule("PHY_NON_NEGATIVE", "E", lambda: _any(CONSUMED, lambda c: c < 0)),
    Rule("PHY_COUNT_INTEGER", "W", lambda: _any(COUNTED, lambda c: F.abs(c - F.round(c)) > 1e-6)),
    Rule("PHY_PERCENT_RANGE", "E", lambda: (_c("women_mgmt_pct") < 0) | (_c("women_mgmt_pct") > 100) | (F.abs("gender_pay_gap_pct") > 100)),
    Rule("LOG_GENDER_SUM_LE_TOTAL", "E", lambda: _c("headcount_male") + _c("headcount_female") > _c("headcount_total") + 0.5),
    Rule("LOG_LGBTQ_PWD_SUM_LE_TOTAL", "W", lambda: _c("lgbtq") + _c("pwd") > _c("headcount_total") + 0.5),
    Rule("LOG_COMPLAINTS_RESOLVED_LE_RECEIVED", "E", lambda: reduce(lambda a, b: a | b, (_c(f"complaints_resolved_{g}") > _c(f"complaints_received_{g}") + 0.5 for g in GROUPS))),
    Rule("LOG_WOMEN_MGMT_VS_WORKFORCE", "W", lambda: _c("women_mgmt_pct") > 100 * _c("headcount_female") / F.nullif(_c("headcount_total"), F.lit(0.0)) + 25),
    Rule("LOG_RENEWABLE_LE_TOTAL_ELEC", "E", lambda: _c("renewable_kwh") > _c("electricity_kwh") * 1.001),
    Rule("LOG_GRID_RENEW_SUM_EQ_TOTAL", "W", lambda: F.abs(_c("grid_kwh") + _c("renewable_kwh") - _c("electricity_kwh")) > 0.05 * F.greatest(_c("electricity_kwh"), F.lit(1e-9))),
    Rule("LOG_WATER_CONSUMED_LE_WITHDRAWN", "E", lambda: _c("water_consumed") > _c("water_withdrawn") * 1.001),
    Rule("LOG_WATER_RECYCLED_LE_BASIS", "W", lambda: _c("water_recycled") > (_c("water_consumed") + _c("water_discharged")) * 1.001),
    Rule("LOG_WASTE_RECYCLED_LE_TOTAL", "E", lambda: (_c("waste_haz") + _c("waste_non") > 0) & (_c("waste_recycled") > (_c("waste_haz") + _c("waste_non")) * 1.001)),
    Rule("LOG_SCOPE2_MARKET_LE_LOCATION", "W", lambda: _c("scope2_market") > _c("scope2_location") * 1.2),
    Rule("LOG_WOMEN_DIRECTORS_LE_BOARD", "E", lambda: _c("women_directors") > _c("directors") + 0.5),
    Rule("LOG_INDEPENDENT_DIRECTORS_LE_BOARD", "E", lambda: _c("independent_directors") > _c("directors") + 0.5),
    Rule("LOG_INDEP_CERTS_LE_INDEPENDENT", "W", lambda: _c("certified_independent") > _c("independent_directors") + 0.5),
    Rule("PER_END_AFTER_START", "E", lambda: _c("period_days") <= 0),
    Rule("PER_SPAN_LE_12MO", "W", lambda: _c("period_days") > 380),
    Rule("UNIT_ELECTRICITY_SUSPECT_MWH", "W", lambda: _c("electricity_kwh") > 5e7),
    Rule("DOC_UTILITY_BILL_MISSING_ELEC", "W", lambda: _c("electricity_kwh").isNull() & _c("cost_inr").isNotNull()),
    Rule("DOC_HR_PAYROLL_MISSING_HC", "W", lambda: _c("headcount_total").isNull() & _c("headcount_female").isNotNull()),
    Rule("DOC_FUEL_INVOICE_MISSING_FUEL", "W", lambda: _c("diesel_l").isNull() & _c("capex").isNotNull()),
    Rule("IND_TARIFF_SANITY", "I", lambda: ~(_c("cost_inr") / F.nullif(_c("electricity_kwh"), F.lit(0.0))).between(3, 25)),
    Rule("LOG_FATALITIES_LE_WORKFORCE", "E", lambda: _c("fatalities") > _c("headcount_total")),
    Rule("LOG_SAFETY_TRAINING_LE_TOTAL", "W", lambda: _c("safety_trained") > _c("headcount_total") * 1.001),
    Rule("LOG_HR_TRAINING_LE_TOTAL", "W", lambda: _c("hr_trained") > _c("headcount_total") * 1.001),
    Rule("LOG_CAPEX_VS_TURNOVER", "I", lambda: _c("capex") > 5 * _c("turnover")),
    Rule("IND_CSR_SPEND_VS_PAT", "I", lambda: _c("csr_spend") / F.nullif(_c("pat"), F.lit(0.0)) > 0.25),
    Rule("LOG_INDEP_PLUS_WOMEN_LE_BOARD", "I", lambda: F.greatest("independent_directors", "women_directors") > _c("directors") + 0.5),
)


def pivoted(line: DataFrame) -> DataFrame:
    """One row per document (order) with a column per field, each the last value of its key: by date of shipment, then by what names the line."""
    key = F.element_at(F.lit(FIELDS), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5 + F.col("l_partkey")) % len(FIELDS) + 1).cast("int"))
    rows = line.select((F.col("l_orderkey") % 1000).alias("document_id"), key.alias("k"), (F.col("l_quantity") - 2).alias("v"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("at"))
    return rows.groupBy("document_id").pivot("k", FIELDS).agg(F.max_by("v", "at"))


def apply_rules(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(document_id, rule, severity) for every broken rule, from one projection."""
    broken = F.filter(F.array(*(F.when(F.coalesce(r.fails(), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules)), lambda x: x.isNotNull())
    return documents.select("document_id", F.explode(broken).alias("r")).select("document_id", "r.*")


_PIVOT = "d AS (SELECT document_id, " + ", ".join(f"max_by(v, place) FILTER (k = '{f}') AS {f}" for f in FIELDS) + f" FROM (SELECT l_orderkey % 1000 AS document_id, {FIELDS!r}[((l_orderkey * 7 + l_linenumber * 5 + l_partkey) % {len(FIELDS)} + 1)::INT] AS k, l_quantity - 2 AS v, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM lineitem) GROUP BY 1)"
_RULE_SQL = {
    "PHY_NON_NEGATIVE": " OR ".join(f"{c} < 0" for c in CONSUMED), "PHY_COUNT_INTEGER": " OR ".join(f"abs({c} - round({c})) > 1e-6" for c in COUNTED), "PHY_PERCENT_RANGE": "women_mgmt_pct < 0 OR women_mgmt_pct > 100 OR abs(gender_pay_gap_pct) > 100",
    "LOG_GENDER_SUM_LE_TOTAL": "headcount_male + headcount_female > headcount_total + 0.5", "LOG_LGBTQ_PWD_SUM_LE_TOTAL": "lgbtq + pwd > headcount_total + 0.5", "LOG_COMPLAINTS_RESOLVED_LE_RECEIVED": " OR ".join(f"complaints_resolved_{g} > complaints_received_{g} + 0.5" for g in GROUPS),
    "LOG_WOMEN_MGMT_VS_WORKFORCE": "women_mgmt_pct > 100 * headcount_female / nullif(headcount_total, 0) + 25", "LOG_RENEWABLE_LE_TOTAL_ELEC": "renewable_kwh > electricity_kwh * 1.001",
    "LOG_GRID_RENEW_SUM_EQ_TOTAL": "abs(grid_kwh + renewable_kwh - electricity_kwh) > 0.05 * greatest(electricity_kwh, 1e-9)", "LOG_WATER_CONSUMED_LE_WITHDRAWN": "water_consumed > water_withdrawn * 1.001",
    "LOG_WATER_RECYCLED_LE_BASIS": "water_recycled > (water_consumed + water_discharged) * 1.001", "LOG_WASTE_RECYCLED_LE_TOTAL": "waste_haz + waste_non > 0 AND waste_recycled > (waste_haz + waste_non) * 1.001",
    "LOG_SCOPE2_MARKET_LE_LOCATION": "scope2_market > scope2_location * 1.2", "LOG_WOMEN_DIRECTORS_LE_BOARD": "women_directors > directors + 0.5", "LOG_INDEPENDENT_DIRECTORS_LE_BOARD": "independent_directors > directors + 0.5",
    "LOG_INDEP_CERTS_LE_INDEPENDENT": "certified_independent > independent_directors + 0.5", "PER_END_AFTER_START": "period_days <= 0", "PER_SPAN_LE_12MO": "period_days > 380", "UNIT_ELECTRICITY_SUSPECT_MWH": "electricity_kwh > 5e7",
    "DOC_UTILITY_BILL_MISSING_ELEC": "electricity_kwh IS NULL AND cost_inr IS NOT NULL", "DOC_HR_PAYROLL_MISSING_HC": "headcount_total IS NULL AND headcount_female IS NOT NULL", "DOC_FUEL_INVOICE_MISSING_FUEL": "diesel_l IS NULL AND capex IS NOT NULL",
    "IND_TARIFF_SANITY": "NOT (cost_inr / nullif(electricity_kwh, 0) BETWEEN 3 AND 25)", "LOG_FATALITIES_LE_WORKFORCE": "fatalities > headcount_total", "LOG_SAFETY_TRAINING_LE_TOTAL": "safety_trained > headcount_total * 1.001",
    "LOG_HR_TRAINING_LE_TOTAL": "hr_trained > headcount_total * 1.001", "LOG_CAPEX_VS_TURNOVER": "capex > 5 * turnover", "IND_CSR_SPEND_VS_PAT": "csr_spend / nullif(pat, 0) > 0.25",
    "LOG_INDEP_PLUS_WOMEN_LE_BOARD": "(CASE WHEN independent_directors IS NULL THEN women_directors WHEN women_directors IS NULL THEN independent_directors ELSE greatest(independent_directors, women_directors) END) > directors + 0.5",
}
_ISSUES = f"{_PIVOT}, i AS (" + " UNION ALL ".join(f"SELECT document_id, '{r.name}' AS rule, '{r.severity}' AS severity FROM d WHERE {_RULE_SQL[r.name]}" for r in RULES) + ")"


@query("rules", "lineitem", sql=f"WITH {_ISSUES} SELECT document_id, rule, severity FROM i")
def rule_issues(line: DataFrame) -> DataFrame:
    return apply_rules(pivoted(line))


# --- rules over single fields -------------------------------------------------------------------------------------------

#: The day that the period rule takes as today.
TODAY = "1997-07-01"
# Forms of registration numbers.
CIN, PAN = "^[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$", "^[A-Z]{5}[0-9]{4}[A-Z]$"


def _shaped(name: str, pattern: str) -> Column:
    text = F.upper(F.trim("text"))
    return (F.col("canonical_key") == name) & (text != "") & ~text.rlike(pattern)


def _off_priors() -> Column:
    gap = F.abs(F.col("value") - F.col("mean"))
    return F.when(F.col("n") >= 3, F.when(F.col("sd") < 1e-9, gap > F.greatest(F.lit(1.0), 0.5 * F.abs("mean"))).otherwise(gap / F.col("sd") > 3))


def field_rules(today: str = TODAY) -> tuple[Rule, ...]:
    """Rules over (canonical_key, value, unit, text, period_end, n, mean, sd, low, high)."""
    year, unit = F.year(F.lit(today).cast("date")), F.lower(F.trim("unit"))
    return (
        Rule("PER_IN_CURRENT_OR_PRIOR_FY", "W", lambda: ~F.year("period_end").between(year - 2, year + 1)),
        Rule("STAT_POP_ZSCORE", "W", _off_priors),
        Rule("UNIT_DIESEL_SUSPECT_TONNES", "W", lambda: (F.col("canonical_key") == "diesel_l") & (F.contains(unit, F.lit("tonne")) | unit.isin("mt", "t"))),
        Rule("IND_CIN_FORMAT", "E", lambda: _shaped("cin", CIN)),
        Rule("IND_PAN_FORMAT", "E", lambda: _shaped("pan", PAN)),
        Rule("REG_VALUE_CONSTRAINTS", "W", lambda: (F.col("value") < F.col("low") - 1e-9) | (F.col("value") > F.col("high") + 1e-9)),
    )


_TEXTS = ["L12345MH2001PLC123456", "l12345mh2001plc123456 ", "X12345MH2001PLC123456", "ABCDE1234F", "ABCD1234F", ""]
_UNITS = ["L", "tonnes", "MT", " t ", "kL"]


def field_rows(f: DataFrame) -> DataFrame:
    """Extracted fields with their priors and the bounds of their key; every seventh document holds registration numbers in place of values."""
    v, doc = F.col("value_num"), F.col("document_id")
    key = F.when(doc % 7 == 0, "cin").when(doc % 7 == 1, "pan").otherwise(F.col("canonical_key"))
    bounds = f.sparkSession.createDataFrame([(k, 10.0 if k == "revenue" else 0.0, 40.0 if k == "scope1" else 1000.0) for k in KEYS], "canonical_key string, low double, high double")
    w = priors()
    text, unit = (F.element_at(F.lit(xs), (v.cast("long") % len(xs) + 1).cast("int")) for xs in (_TEXTS, _UNITS))
    stats = f.select("id", "document_id", "canonical_key", "value_num", "created_at", F.count("value_num").over(w).alias("n"), F.avg("value_num").over(w).alias("mean"), deviation(F.collect_list("value_num").over(w)).alias("sd"))
    x = stats.select("id", key.alias("canonical_key"), F.when(doc % 7 > 1, v).alias("value"), F.when(doc % 7 < 2, text).alias("text"), unit.alias("unit"), F.col("created_at").cast("date").alias("period_end"), "n", "mean", "sd")
    return x.join(F.broadcast(bounds), "canonical_key", "left")


def apply_field_rules(fields: DataFrame, today: str = TODAY) -> DataFrame:
    """(id, rule, severity) for every broken rule of every field."""
    return apply_rules(fields.withColumnRenamed("id", "document_id"), field_rules(today)).withColumnRenamed("document_id", "id")


_FIELD_SQL = f"""WITH s AS (SELECT *, count(value_num) {PRIOR} AS n, avg(value_num) {PRIOR} AS mean, stddev_samp(value_num) {PRIOR} AS sd FROM extraction_field),
x AS (SELECT id, n, mean, sd, CASE document_id % 7 WHEN 0 THEN 'cin' WHEN 1 THEN 'pan' ELSE canonical_key END AS k, CASE WHEN document_id % 7 > 1 THEN value_num END AS v, CASE WHEN document_id % 7 < 2 THEN upper(trim({_TEXTS!r}[(value_num::BIGINT % 6 + 1)::INT])) END AS t,
 lower(trim({_UNITS!r}[(value_num::BIGINT % 5 + 1)::INT])) AS u, year(created_at) AS y FROM s)
SELECT id, 'PER_IN_CURRENT_OR_PRIOR_FY' AS rule, 'W' AS severity FROM x WHERE y NOT BETWEEN 1995 AND 1998
UNION ALL SELECT id, 'STAT_POP_ZSCORE', 'W' FROM x WHERE n >= 3 AND CASE WHEN sd < 1e-9 THEN abs(v - mean) > greatest(1, 0.5 * abs(mean)) ELSE abs(v - mean) / sd > 3 END
UNION ALL SELECT id, 'UNIT_DIESEL_SUSPECT_TONNES', 'W' FROM x WHERE k = 'diesel_l' AND (contains(u, 'tonne') OR u IN ('mt', 't'))
UNION ALL SELECT id, 'IND_CIN_FORMAT', 'E' FROM x WHERE k = 'cin' AND t <> '' AND NOT regexp_matches(t, '{CIN}')
UNION ALL SELECT id, 'IND_PAN_FORMAT', 'E' FROM x WHERE k = 'pan' AND t <> '' AND NOT regexp_matches(t, '{PAN}')
UNION ALL SELECT id, 'REG_VALUE_CONSTRAINTS', 'W' FROM x WHERE k NOT IN ('cin', 'pan') AND (v < CASE k WHEN 'revenue' THEN 10 ELSE 0 END - 1e-9 OR v > CASE k WHEN 'scope1' THEN 40 ELSE 1000 END + 1e-9)"""


@query("rules_field", "extraction_field", sql=_FIELD_SQL)
def field_issues(f: DataFrame) -> DataFrame:
    return apply_field_rules(field_rows(f))


@query("sc_m12", "lineitem", "extraction_field", sql=f"""WITH {_ISSUES}, j AS ({_FIELD_SQL}), k AS (SELECT document_id, severity FROM i UNION ALL SELECT document_id, severity FROM j JOIN (SELECT id, document_id FROM extraction_field) USING (id)),
c AS (SELECT d.document_id, count(*) FILTER (severity = 'E')::BIGINT AS errors, count(*) FILTER (severity = 'W')::BIGINT AS warnings FROM d LEFT JOIN k USING (document_id) GROUP BY 1)
SELECT *, CASE errors WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, round(greatest(0, 1 - 0.5 * errors - 0.1 * warnings), 6)::DOUBLE AS layer_score, errors + warnings > 0 AS needs_review FROM c""")
def rule_score(line: DataFrame, f: DataFrame) -> DataFrame:
    """Scores of a document by the errors, and by errors and warnings, of all rules over its fields together and over each; any of them asks for review."""
    docs = pivoted(line)
    single = apply_field_rules(field_rows(f)).join(f.select("id", "document_id"), "id")
    issues = apply_rules(docs).select("document_id", "severity").union(single.select("document_id", "severity"))
    counts = issues.groupBy("document_id").agg(F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"))
    x = docs.select("document_id").join(counts, "document_id", "left").select("document_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))
    score = F.when(F.col("errors") == 0, 1.0).when(F.col("errors") == 1, 0.5).otherwise(0.0)
    layer = F.round(F.greatest(F.lit(0.0), 1 - 0.5 * F.col("errors") - 0.1 * F.col("warnings")), 6)
    return x.withColumns({"score": score, "layer_score": layer, "needs_review": F.col("errors") + F.col("warnings") > 0})
