"""Tables out of documents and the benchmarks of their fields: label joins, column sums, meters, bill checks, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.matching import longest_alias
from ..functions.units import FUELS
from ..plans.catalog import query

#: Aliases of our own for the labels that joins look up.
LABELS = (("electricity consumed", "electricity_kwh"), ("electricity", "electricity_kwh"), ("diesel used", "diesel_l"), ("diesel", "diesel_l"), ("water", "water_kl"), ("headcount", "headcount_total"))
_LABEL_SQL = "a AS (SELECT * FROM (VALUES " + ", ".join(map(str, LABELS)) + ") t(alias, key))"
_SEEN = "['Electricity consumed (kWh)', 'diesel', 'Total water drawn', 'Headcount', 'Something else', 'Diesel used in gensets'][(l_partkey % 6 + 1)::INT]"
SEEN = ["Electricity consumed (kWh)", "diesel", "Total water drawn", "Headcount", "Something else", "Diesel used in gensets"]


def alias_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, k, i) for i, (a, k) in enumerate(LABELS)], "alias string, key string, place int")


def resolved_labels(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``: the exact alias, else the longest one inside the label. Labels are made distinct before they meet the aliases."""
    best = longest_alias(rows.select("label").distinct(), alias_rows(rows.sparkSession)).select("label", "key")
    return rows.join(best, "label", "left")


@query("jn15", "extraction_field", sql="SELECT id, CASE WHEN canonical_key IN ('revenue', 'scope1') THEN 'strict' ELSE 'plain' END AS kind FROM extraction_field")
def with_registry(f: DataFrame) -> DataFrame:
    registry = f.sparkSession.createDataFrame([("revenue", "strict"), ("scope1", "strict")], "canonical_key string, kind string")
    return f.join(F.broadcast(registry), "canonical_key", "left").select("id", F.coalesce("kind", F.lit("plain")).alias("kind"))


@query("jn14", "extraction_field", sql="WITH d AS (SELECT document_id, max(value_num) FILTER (canonical_key = 'headcount_total') AS t, max(value_num) FILTER (canonical_key = 'headcount_female') AS w FROM extraction_field GROUP BY 1) SELECT document_id, t, w, coalesce(w > t + 0.5, false) AS fails FROM d")
def sibling_lookup(f: DataFrame) -> DataFrame:
    """Fields of one document side by side, by a pivot rather than a self-join."""
    d = f.groupBy("document_id").pivot("canonical_key", ["headcount_total", "headcount_female"]).agg(F.max("value_num"))
    t, w = F.col("headcount_total"), F.col("headcount_female")
    return d.select("document_id", t.alias("t"), w.alias("w"), F.coalesce(w > t + 0.5, F.lit(False)).alias("fails"))


_FUELS = [*FUELS, "dung"]
_FUEL_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (_, a, b) in FUELS.items()) + ") t(fuel, burnt, upstream))"


@query("jn19", "lineitem", sql=f"WITH f AS {_FUEL_SQL}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {_FUELS!r}[(l_partkey % {len(_FUELS)} + 1)::INT] AS fuel FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * burnt, 4) AS burnt, round(l_quantity * upstream, 4) AS upstream FROM x LEFT JOIN f USING (fuel)")
def fuel_factors(line: DataFrame) -> DataFrame:
    """kg of CO2e burnt and on the way to the tank; null for a fuel that is not known."""
    factors = line.sparkSession.createDataFrame([(k, a, b) for k, (_, a, b) in FUELS.items()], "fuel string, burnt double, upstream double")
    x = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.element_at(F.lit(_FUELS), (F.col("l_partkey") % len(_FUELS) + 1).cast("int")).alias("fuel"))
    kg = lambda c: F.round(F.col("l_quantity") * F.col(c), 4).alias(c)
    return x.join(F.broadcast(factors), "fuel", "left").select("l_orderkey", "l_linenumber", "l_partkey", kg("burnt"), kg("upstream"))


@query("ag22", "lineitem", sql=f"WITH {_LABEL_SQL}, x AS (SELECT l_orderkey % 500 AS sheet, {_SEEN} AS label, l_quantity - 10 AS v FROM lineitem), d AS (SELECT DISTINCT label FROM x), h AS (SELECT label, max_by(key, (lower(label) = alias, length(alias), alias)) AS key FROM d JOIN a ON contains(lower(label), alias) GROUP BY 1) SELECT sheet, key, round(sum(v), 4) AS total FROM x JOIN h USING (label) GROUP BY ALL HAVING sum(v) > 0")
def column_sums(line: DataFrame) -> DataFrame:
    """Sums of mapped columns of a sheet; none where the sum is not positive."""
    rows = line.select((F.col("l_orderkey") % 500).alias("sheet"), F.element_at(F.lit(SEEN), (F.col("l_partkey") % 6 + 1).cast("int")).alias("label"), (F.col("l_quantity") - 10).cast("string").alias("cell"))
    x = resolved_labels(rows).where(F.col("key").isNotNull())
    return x.groupBy("sheet", "key").agg(F.sum(F.col("cell").try_cast("double")).alias("s")).where(F.col("s") > 0).select("sheet", "key", F.round("s", 4).alias("total"))


@query("ag23", "customer", sql="SELECT c_nationkey AS sheet, count(*)::BIGINT AS n, count(*) FILTER (g IN ('m', 'male'))::BIGINT AS male, count(*) FILTER (g IN ('f', 'female', 'woman'))::BIGINT AS female, count(*) FILTER (g NOT IN ('m', 'male', 'f', 'female', 'woman'))::BIGINT AS other FROM (SELECT c_nationkey, lower(trim([' M', 'Female ', 'woman', 'x', 'male'][(c_custkey % 5 + 1)::INT])) AS g FROM customer) GROUP BY 1")
def headcounts(c: DataFrame) -> DataFrame:
    g = F.lower(F.trim(F.element_at(F.lit([" M", "Female ", "woman", "x", "male"]), (F.col("c_custkey") % 5 + 1).cast("int"))))
    male, female = g.isin("m", "male"), g.isin("f", "female", "woman")
    return c.groupBy(F.col("c_nationkey").alias("sheet")).agg(F.count("*").alias("n"), F.count_if(male).alias("male"), F.count_if(female).alias("female"), F.count_if(~male & ~female).alias("other"))


@query("ag27", "pages", sql="SELECT page_id % 50 AS document_id, round(avg(least(1, length(html) / 5000.0)), 6) AS quality FROM pages GROUP BY 1")
def page_quality(p: DataFrame) -> DataFrame:
    return p.groupBy((F.col("page_id") % 50).alias("document_id")).agg(F.round(F.avg(F.least(F.lit(1.0), F.length("html") / 5000.0)), 6).alias("quality"))


_BENCH = """b AS (SELECT coalesce(p.fixture, e.fixture) AS fixture, p.k AS pk, e.k AS ek, p.v AS pv, e.v AS ev FROM
 (SELECT l_orderkey % 200 AS fixture, l_linenumber AS k, max(l_quantity) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) p FULL JOIN
 (SELECT l_orderkey % 200 AS fixture, l_linenumber AS k, max(l_quantity) - 1.5 AS v FROM lineitem WHERE l_returnflag <> 'A' GROUP BY ALL) e ON p.fixture = e.fixture AND p.k = e.k),
s AS (SELECT fixture, count(*) FILTER (pk IS NOT NULL AND ek IS NOT NULL AND (abs(pv - ev) <= 1 OR abs(pv - ev) <= 0.05 * abs(ev)))::BIGINT AS tp, count(pk)::BIGINT AS n_predicted, count(ek)::BIGINT AS n_expected FROM b GROUP BY 1)"""


def fixture_scores(line: DataFrame) -> DataFrame:
    """True positives, predicted and expected fields of each fixture, by a full outer join; a value matches within 1 or 5 per cent."""
    by = [(F.col("l_orderkey") % 200).alias("fixture"), F.col("l_linenumber").alias("k")]
    p = line.where(F.col("l_linestatus") == "F").groupBy(*by).agg(F.max("l_quantity").alias("pv"))
    e = line.where(F.col("l_returnflag") != "A").groupBy(*by).agg((F.max("l_quantity") - 1.5).alias("ev"))
    x = p.join(e, ["fixture", "k"], "full")
    gap = F.abs(F.col("pv") - F.col("ev"))
    return x.groupBy("fixture").agg(F.count_if((gap <= 1) | (gap <= 0.05 * F.abs("ev"))).alias("tp"), F.count("pv").alias("n_predicted"), F.count("ev").alias("n_expected"))


@query("jn27", "lineitem", sql=f"WITH {_BENCH} SELECT fixture, tp, n_predicted - tp AS fp, n_expected - tp AS fn FROM s")
def predicted_and_expected(line: DataFrame) -> DataFrame:
    return fixture_scores(line).select("fixture", "tp", (F.col("n_predicted") - F.col("tp")).alias("fp"), (F.col("n_expected") - F.col("tp")).alias("fn"))


_PRF = "m AS (SELECT fixture % 5 AS grp, coalesce(tp / nullif(n_predicted, 0), 0) AS p, coalesce(tp / nullif(n_expected, 0), 0) AS r FROM s)"


def _quality(line: DataFrame) -> DataFrame:
    ratio = lambda n: F.coalesce(F.try_divide(F.col("tp"), F.col(n)), F.lit(0.0))
    return fixture_scores(line).select((F.col("fixture") % 5).alias("grp"), ratio("n_predicted").alias("p"), ratio("n_expected").alias("r"))


@query("ag30", "lineitem", sql=f"WITH {_BENCH}, {_PRF} SELECT coalesce(grp::VARCHAR, 'all') AS grp, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall FROM m GROUP BY ROLLUP (grp)")
def macro_averages(line: DataFrame) -> DataFrame:
    """By group and over all, in one rollup."""
    x = _quality(line).rollup("grp").agg(F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("r"), 6).alias("recall"))
    return x.select(F.coalesce(F.col("grp").cast("string"), F.lit("all")).alias("grp"), "precision", "recall")


@query("ben1", "lineitem", sql=f"WITH {_BENCH}, {_PRF} SELECT grp, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6)::DOUBLE AS f1 FROM m GROUP BY 1")
def benchmark_f1(line: DataFrame) -> DataFrame:
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return _quality(line).groupBy("grp").agg(F.round(F.avg(f1), 6).alias("f1"))


@query("ag31", "extraction_field", "labels", sql="SELECT CASE WHEN confidence < 0.65 THEN 'LOW' WHEN confidence < 0.85 THEN 'MEDIUM' ELSE 'HIGH' END AS level, count(*)::BIGINT AS total, sum(quality)::BIGINT AS correct FROM extraction_field JOIN labels ON document_id = doc_id GROUP BY 1")
def calibration(f: DataFrame, labels: DataFrame) -> DataFrame:
    from .extraction import level

    x = f.join(labels, F.col("document_id") == F.col("doc_id"))
    return x.groupBy(level(F.col("confidence")).alias("level")).agg(F.count("*").alias("total"), F.sum("quality").alias("correct"))


@query("doc6", "lineitem", sql=f"""WITH {_LABEL_SQL}, x AS (SELECT l_orderkey % 300 AS table_id, l_linenumber AS row, {_SEEN} AS label, max(l_quantity) AS v FROM lineitem GROUP BY ALL), d AS (SELECT DISTINCT label FROM x),
h AS (SELECT label, max_by(key, (lower(label) = alias, length(alias), alias)) AS key FROM d JOIN a ON contains(lower(label), alias) GROUP BY 1) SELECT table_id, row, key, v, CASE WHEN label LIKE '%(%)%' THEN 0.88 ELSE 0.78 END::DOUBLE AS confidence FROM x JOIN h USING (label)""")
def table_fields(line: DataFrame) -> DataFrame:
    """Cells of wide tables as fields: headers to keys by alias, more confidence where the header has a unit."""
    wide = line.withColumn("label", F.element_at(F.lit(SEEN), (F.col("l_partkey") % 6 + 1).cast("int"))).groupBy((F.col("l_orderkey") % 300).alias("table_id"), F.col("l_linenumber").alias("row")).pivot("label", SEEN).agg(F.max("l_quantity"))
    long = wide.unpivot(["table_id", "row"], [F.col(f"`{c}`") for c in SEEN], "label", "v").where(F.col("v").isNotNull())
    return resolved_labels(long).where(F.col("key").isNotNull()).select("table_id", "row", "key", "v", F.when(F.contains("label", F.lit("(")), 0.88).otherwise(0.78).alias("confidence"))


@query("doc12", "lineitem", sql="""WITH r AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS n FROM lineitem GROUP BY 1), t AS (SELECT l_orderkey, n[i] AS current, n[j] AS previous, n[k] AS consumed FROM r, range(1, 40) a(i), range(1, 40) b(j), range(1, 40) c(k) WHERE i <= len(n) AND j <= len(n) AND k <= len(n) AND i <> j AND j <> k AND i <> k AND n[i] > n[j] AND abs(n[i] - n[j] - n[k]) <= 0.5)
SELECT l_orderkey, max(current) AS current, max_by(consumed, (current, consumed)) AS consumed FROM t GROUP BY 1""")
def meter_triples(line: DataFrame) -> DataFrame:
    """Readings of a row that fit together: current less previous is consumption; inside the row's own array."""
    rows = line.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("n"))
    def at(name):
        return F.posexplode("n").alias(f"p{name}", name)

    t = rows.select("l_orderkey", "n", at("c")).select("l_orderkey", "n", "pc", "c", at("p")).where(F.col("c") > F.col("p")).select("l_orderkey", "pc", "c", "pp", "p", at("u"))
    t = t.where((F.col("pc") != F.col("pp")) & (F.col("pp") != F.col("pu")) & (F.col("pc") != F.col("pu")) & (F.abs(F.col("c") - F.col("p") - F.col("u")) <= 0.5))
    return t.groupBy("l_orderkey").agg(F.max("c").alias("current"), F.max_by("u", F.struct("c", "u")).alias("consumed"))


@query("doc14", "orders", "lineitem", sql="""WITH c AS (SELECT l_orderkey, list(l_extendedprice * (1 - l_discount)) AS charges, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
SELECT o_orderkey, abs(list_sum(charges) - o_totalprice) <= 0.02 * o_totalprice AS reconciled, shipped >= o_orderdate AS dates_in_order, o_totalprice BETWEEN 1 AND 1e9 AS plausible FROM orders JOIN c ON o_orderkey = l_orderkey""")
def bill_checks(o: DataFrame, line: DataFrame) -> DataFrame:
    charges = line.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("charges"), F.min("l_shipdate").alias("shipped"))
    x = o.join(charges, o.o_orderkey == charges.l_orderkey)
    return x.select("o_orderkey", (F.abs(F.col("charges") - F.col("o_totalprice")) <= 0.02 * F.col("o_totalprice")).alias("reconciled"), (F.col("shipped") >= F.col("o_orderdate")).alias("dates_in_order"), F.col("o_totalprice").between(1, 1e9).alias("plausible"))


@query("doc16", "extraction_field", sql="WITH s AS (SELECT id, exp((ln(greatest(confidence, 1e-3)) + ln(greatest(least(value_num / 50, 1), 1e-3)) + ln(CASE WHEN value_text IS NULL THEN 0.9 ELSE 0.6 END) + ln(CASE status WHEN 'APPROVED' THEN 1.0 WHEN 'REJECTED' THEN 0.4 ELSE 0.8 END)) / 4) AS c FROM extraction_field) SELECT id, round(c, 6) AS composite, c < 0.85 AS review FROM s")
def composite_confidence(f: DataFrame) -> DataFrame:
    """A geometric mean of the parts of a field's confidence."""
    from .extraction import geometric_mean

    parts = [F.col("confidence"), F.least(F.col("value_num") / 50, F.lit(1.0)), F.when(F.col("value_text").isNull(), 0.9).otherwise(0.6), F.when(F.col("status") == "APPROVED", 1.0).when(F.col("status") == "REJECTED", 0.4).otherwise(0.8)]
    c = geometric_mean(parts)
    return f.select("id", F.round(c, 6).alias("composite"), (c < 0.85).alias("review"))


@query("doc18", "extraction_field", sql="SELECT id, round(confidence * CASE WHEN value_num BETWEEN lo AND hi THEN 1 ELSE 0.6 END, 6) AS confidence FROM extraction_field JOIN (SELECT canonical_key, avg(value_num) - stddev_samp(value_num) AS lo, avg(value_num) + stddev_samp(value_num) AS hi FROM extraction_field GROUP BY 1) USING (canonical_key)")
def range_bands(f: DataFrame) -> DataFrame:
    """Values outside their key's band lose confidence; there is a band for each key."""
    bands = f.groupBy("canonical_key").agg((F.avg("value_num") - F.stddev_samp("value_num")).alias("lo"), (F.avg("value_num") + F.stddev_samp("value_num")).alias("hi"))
    inside = F.col("value_num").between(F.col("lo"), F.col("hi"))
    return f.join(bands, "canonical_key").select("id", F.round(F.col("confidence") * F.when(inside, 1.0).otherwise(0.6), 6).alias("confidence"))
