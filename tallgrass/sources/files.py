"""Sources and sinks: scans, CSV with sniffed separators, JSON lines, partitioned and idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import FUELS, GRID_REGIONS, GRID_YEARS, GWP, PEERS, grid_rows
from ..plans.catalog import query
from .scratch import scratch_path

SEPARATORS = (",", ";", "\t", "|")


def read_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """A CSV file with a header, trimmed; the first separator that gives more than one column. More than ``max_rows`` rows is an error."""
    for sep in SEPARATORS:
        df = spark.read.options(header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
        if len(df.columns) > 1:
            break
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"{path} has more than {max_rows} rows")
    return df


@query("src1", "supplier", sql="SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000 AND s_nationkey < 10")
def scan(s: DataFrame) -> DataFrame:
    """Predicates and columns reach the Parquet scan."""
    return s.where((F.col("s_acctbal") > 5000) & (F.col("s_nationkey") < 10)).select("s_suppkey", "s_acctbal")


@query("src2", "customer", sql="SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def lookup(c: DataFrame) -> DataFrame:
    return c.where(F.col("c_custkey") == 42).limit(1).select("c_custkey", "c_name")


@query("src3", "nation", sql="SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def csv_round_trip(n: DataFrame) -> DataFrame:
    """Written as CSV and read back."""
    n.select("n_nationkey", "n_name").write.option("header", True).csv(path := scratch_path(n.sparkSession, "csv"))
    return read_csv(n.sparkSession, path, 10_000).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("src4", "nation", sql="SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def sniffed_csv(n: DataFrame) -> DataFrame:
    n.select("n_nationkey", "n_name").write.option("header", True).option("sep", ";").csv(path := scratch_path(n.sparkSession, "csv"))
    return read_csv(n.sparkSession, path).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, text`` of text files, lines numbered from 1 in each file whatever its parts."""
    # an id's upper bits are the task, its lower 33 the place; a task may read parts of several files
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    x.write.parquet(lines := scratch_path(spark, "lines"))
    x = spark.read.schema(x.schema).parquet(lines)
    parts = x.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "start", "first", before.alias("before"))
    return x.join(parts, ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), F.col("value").alias("text"))


def read_import(spark: SparkSession, path: str, required: tuple[str, ...], numbers: tuple[str, ...] = (), dates: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a header: rows as text columns with ``file`` and ``line``, rejects as ``file, line, reason, text``.

    A line with too few or too many cells or a quote that does not end is
    rejected, as are lines without a required cell and with a number or date
    that is none; nothing is dropped but empty lines, and the header, whose
    columns must hold all that are required in every file.  Cells may be quoted
    but not broken over lines.
    """
    lines = numbered_lines(spark, path)
    heads = [(r["file"], r["text"]) for r in lines.where(F.col("line") == 1).select("file", "text").distinct().limit(10_001).collect()]
    if len(heads) > 10_000:
        raise ValueError("more than 10,000 files")
    headers = {t for _, t in heads}
    if len(headers) > 1:
        raise ValueError(f"files differ in their header: {sorted(headers)[:2]}")
    if not headers:
        raise ValueError(f"{path} has no line")
    names = [c.strip().strip('"') for c in headers.pop().removeprefix("\ufeff").split(",")]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"Missing required column: {missing[0]}")
    cells = ", ".join(f"`{c}` string" for c in [*names, "_corrupt"])
    body = lines.where((F.col("line") > 1) & (F.trim("text") != ""))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    x = body.withColumn("_c", F.from_csv("text", cells, options)).select("file", "line", "text", "_c.*")
    told = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    problems = [F.when(F.col("_corrupt").isNotNull(), F.lit("cells do not fit the header"))]
    problems += [F.when(~told(c), F.lit(f"{c} is missing")) for c in required]
    problems += [F.when(told(c) & F.col(c).try_cast("double").isNull(), F.lit(f"{c} is no number")) for c in numbers]
    problems += [F.when(told(c) & F.col(c).try_cast("date").isNull(), F.lit(f"{c} is no date")) for c in dates]
    x = x.withColumn("reason", F.coalesce(*problems))
    x.write.parquet(parsed := scratch_path(spark, "import"))
    x = spark.read.schema(x.schema).parquet(parsed)
    return x.where(F.col("reason").isNull()).select("file", "line", *names), x.where(F.col("reason").isNotNull()).select("file", "line", "reason", "text")


@query("src5", "supplier", sql="""SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 13 = 0 THEN 'cells do not fit the header' WHEN s_suppkey % 7 = 0 THEN 'name is missing' WHEN s_suppkey % 11 = 0 THEN 'value is no number' WHEN s_suppkey % 17 = 0 THEN 'day is no date' END AS reason,
CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 17 <> 0 THEN s_name || CASE WHEN s_suppkey % 5 = 0 THEN ', Ltd' ELSE '' END END AS name FROM supplier""")
def imported(s: DataFrame) -> DataFrame:
    """Suppliers written as CSV with broken lines, read with its rejects: every line is a row or a reject."""
    k, spark = F.col("s_suppkey"), s.sparkSession
    name = F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat(F.lit('"'), "s_name", F.lit(', Ltd"'))).otherwise(F.col("s_name"))
    cells = [k.cast("string"), name, F.when(k % 11 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string")), F.when(k % 17 == 0, "31.02.2024").otherwise("2024-02-29")]
    line = F.when(k % 26 == 0, F.concat_ws(",", *cells, F.lit("more"))).when(k % 13 == 0, F.concat_ws(",", *cells[:2])).otherwise(F.concat_ws(",", *cells))
    # each line is one cell of a file of its own columns, so that it is written as it is
    s.select(line.alias("key,name,value,day")).write.options(header=True, sep="\x01", quote="", escape="").csv(path := scratch_path(spark, "import-csv"))
    rows, rejects = read_import(spark, path, ("key", "name", "value"), ("value",), ("day",))
    bad = rejects.select(F.element_at(F.split("text", ","), 1).alias("key"), "reason", F.lit(None).cast("string").alias("name"))
    return rows.select("key", F.lit(None).cast("string").alias("reason"), "name").union(bad)


#: Names that hold a list of entries, and names of an entry's number, in the order of preference.
LISTS, NUMBERS = ("events", "data"), ("value_num", "valueNum", "value", "valueCanonical")


def numeric_series(text: Column) -> Column:
    """The numbers of a JSON text of whatever shape: a list, or an object with one, of numbers or of objects with a number; none for other text.

    An empty list goes on to the next name; strings are no numbers, true is 1.
    """
    v = F.try_parse_json(text)
    array = lambda path: F.try_variant_get(v, path, "array<variant>")
    some = lambda a: F.when(F.size(a) > 0, a)
    items = F.coalesce(*[some(array(f"$.{c}")) for c in LISTS], array("$"), F.array().cast("array<variant>"))
    kind = r"^(BIGINT|DOUBLE|FLOAT|BOOLEAN|DECIMAL.*)$"
    number = lambda x, path: F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")).rlike(kind), F.try_variant_get(x, path, "double"))
    return F.filter(F.transform(items, lambda x: F.coalesce(*[number(x, p) for p in ("$", *(f"$.{c}" for c in NUMBERS))])), lambda x: x.isNotNull())


@query("src16", "events", sql="SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END::BIGINT AS n, round(CASE event_id % 4 WHEN 0 THEN 2 * value WHEN 1 THEN value WHEN 2 THEN 3.5 + event_id ELSE 0 END, 6)::DOUBLE AS total FROM events")
def tolerant_series(e: DataFrame) -> DataFrame:
    """Numbers out of several shapes of response."""
    entry = lambda name: F.struct(F.col("value").alias(name), F.lit("7").alias("valueCanonical"))
    k, key = F.col("event_id") % 4, F.col("event_id").cast("string")
    shapes = [F.to_json(F.struct(F.array(entry("valueNum"), entry("valueNum")).alias("events"))), F.to_json(F.struct(F.array().alias("events"), F.array(entry("value")).alias("data")))]
    text = F.when(k == 0, shapes[0]).when(k == 1, shapes[1]).when(k == 2, F.concat(F.lit("[1, 2.5, \"9\", {\"value\": "), key, F.lit("}, {\"other\": 1}, null]"))).otherwise(F.concat(F.lit("{\"events\": "), key))
    x = e.select("event_id", numeric_series(text).alias("numbers"))
    return x.select("event_id", F.size("numbers").cast("long").alias("n"), F.round(F.aggregate("numbers", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def reference_rows() -> list[tuple[str, str, str, float]]:
    """(table, name, detail, value) of all reference tables; bounds of the registry are those of ``flt13``."""
    rows = [("grid_state", s, r, k) for s, r, k in grid_rows()] + [("grid_region", r, "", k) for r, k in GRID_REGIONS.items()] + [("grid_year", str(y), "", k) for y, k in GRID_YEARS.items()]
    rows += [("fuel", f"{f} ({unit})", part, k) for f, (unit, *ks) in FUELS.items() for part, k in zip(("burnt", "upstream"), ks, strict=True)]
    rows += [("gwp", g, basis, k) for basis, gases in GWP.items() for g, k in gases.items()]
    rows += [("peer", f"{key} {sector}", part, float(k)) for (key, sector), ks in PEERS.items() for part, k in zip(("companies", "mean", "median", "sd", "p25", "p75"), ks, strict=True)]
    return rows


_REFERENCE_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{n}', '{d}', {k!r}::DOUBLE)" for t, n, d, k in reference_rows()) + ") t(name_of_table, name, detail, value))"


def reference_tables(spark: SparkSession) -> DataFrame:
    """All reference tables as one Parquet table, a folder for each, written and read."""
    rows = spark.createDataFrame(reference_rows(), "name_of_table string, name string, detail string, value double")
    rows.write.partitionBy("name_of_table").parquet(path := scratch_path(spark, "reference"))
    return spark.read.schema(rows.schema).parquet(path)


@query("src17", "lineitem", sql=f"WITH g AS (SELECT name, value FROM {_REFERENCE_SQL} WHERE name_of_table = 'grid_year'), x AS (SELECT year(l_shipdate) + 20 AS y, l_quantity FROM lineitem) SELECT y::BIGINT AS year, count(*)::BIGINT AS n, round(sum(l_quantity) * any_value(value), 4) AS emissions FROM x LEFT JOIN g ON y::VARCHAR = name GROUP BY 1")
def with_reference_table(line: DataFrame) -> DataFrame:
    """Quantities by year, 20 years on, by the grid factor of that year out of the reference tables; null for a year without one."""
    grid = reference_tables(line.sparkSession).where(F.col("name_of_table") == "grid_year").select("name", "value")
    by = line.groupBy((F.year("l_shipdate") + 20).cast("long").alias("year")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return by.join(F.broadcast(grid), F.col("year").cast("string") == F.col("name"), "left").select("year", "n", F.round(F.col("q") * F.col("value"), 4).alias("emissions"))


@query("snk4", "supplier", sql="SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 10")
def json_export(s: DataFrame) -> DataFrame:
    """Rows behind a cursor as JSON lines, and back."""
    s.where(F.col("s_suppkey") > 10).select("s_suppkey", "s_name").write.json(path := scratch_path(s.sparkSession, "jsonl"))
    return s.sparkSession.read.schema("s_suppkey long, s_name string").json(path)


@query("snk6", "part", sql="SELECT p_brand AS principle, count(*)::BIGINT AS n FROM part GROUP BY 1")
def partitioned_report(p: DataFrame) -> DataFrame:
    """One folder for each principle."""
    p.select(F.col("p_brand").alias("principle"), "p_partkey").repartition("principle").write.partitionBy("principle").parquet(path := scratch_path(p.sparkSession, "report"))
    return p.sparkSession.read.parquet(path).groupBy("principle").agg(F.count("*").alias("n"))


@query("snk2", "metric_event", sql="SELECT concat('run-', tenant_id) AS run_id, count(*)::BIGINT AS n_events, round(sum(value), 3) AS total FROM metric_event GROUP BY 1")
def run_summary(e: DataFrame) -> DataFrame:
    """A summary row per run, overwritten by run id: writing twice leaves one."""
    rows = e.groupBy(F.concat(F.lit("run-"), F.col("tenant_id").cast("string")).alias("run_id")).agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 3).alias("total"))
    path = scratch_path(e.sparkSession, "runs")
    for _ in range(2):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return e.sparkSession.read.schema(rows.schema).parquet(path).select("run_id", "n_events", "total")


@query("snk8", "nation", sql="SELECT concat('<report>', string_agg(concat('<row id=\"', n_nationkey, '\">', replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '</row>'), '' ORDER BY n_nationkey), '</report>') AS xml FROM nation")
def xml_report(n: DataFrame) -> DataFrame:
    """An envelope around escaped rows; of a table of bounded size."""
    row = F.concat(F.lit('<row id="'), F.col("n_nationkey").cast("string"), F.lit('">'), F.replace(F.replace("n_name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</row>"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("x")))), lambda s: s["x"])
    return n.agg(F.concat(F.lit("<report>"), F.array_join(parts, ""), F.lit("</report>")).alias("xml"))


@query("prj1", "orders", sql="SELECT o_orderkey, o_orderstatus FROM orders")
def projected(o: DataFrame) -> DataFrame:
    return o.select("o_orderkey", "o_orderstatus")


@query("flt2", "part", sql="SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
def in_list(p: DataFrame) -> DataFrame:
    return p.where(F.col("p_size").isin(1, 5, 9)).select("p_partkey")


@query("flt5", "audit_log", sql="SELECT id FROM audit_log WHERE actor_id IS NULL OR tenant_id = 2")
def global_or_tenant(log: DataFrame) -> DataFrame:
    return log.where(F.col("actor_id").isNull() | (F.col("tenant_id") == 2)).select("id")


@query("flt6", "orders", sql="SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_orderdate END IS NULL OR o_orderdate > TIMESTAMP '1996-01-01'")
def active_rows(o: DataFrame) -> DataFrame:
    until = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return o.where(until.isNull() | (until > F.lit("1996-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("flt7", "part", sql="SELECT p_partkey, list_contains([p_brand, p_type], 'Brand#12') AS has, list_has_any([p_brand, p_type], ['Brand#11', 'Brand#13']) AS has_some FROM part")
def array_filters(p: DataFrame) -> DataFrame:
    tags = F.array("p_brand", "p_type")
    return p.select("p_partkey", F.array_contains(tags, "Brand#12").alias("has"), F.arrays_overlap(tags, F.lit(["Brand#11", "Brand#13"])).alias("has_some"))


@query("flt11", "orders", sql="SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def not_equal(o: DataFrame) -> DataFrame:
    return o.where(F.col("o_orderstatus") != "F").select("o_orderkey")


@query("srt1", "nation", sql="SELECT n_name, n_regionkey, row_number() OVER (ORDER BY n_regionkey, n_name DESC)::INT AS place FROM nation")
def sorted_rows(n: DataFrame) -> DataFrame:
    return n.select("n_name", "n_regionkey", F.row_number().over(Window.orderBy("n_regionkey", F.col("n_name").desc())).alias("place"))


@query("wn9", "supplier", sql="SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)::INT AS rank FROM supplier")
def ranked(s: DataFrame) -> DataFrame:
    return s.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")).alias("rank"))


@query("set2", "customer", "supplier", sql="SELECT c_custkey AS key, 'rule' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey, 'other' FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = s_suppkey AND c_custkey % 3 = 0)")
def union_precedence(c: DataFrame, s: DataFrame) -> DataFrame:
    """The first source wins; the second fills in keys that it lacks."""
    rules = c.where(F.col("c_custkey") % 3 == 0).select(F.col("c_custkey").alias("key"), F.lit("rule").alias("origin"))
    others = s.select(F.col("s_suppkey").alias("key"), F.lit("other").alias("origin"))
    return rules.unionByName(others.join(rules.select("key"), "key", "left_anti"))


@query("set7", "customer", "supplier", sql="SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def concatenated(c: DataFrame, s: DataFrame) -> DataFrame:
    return c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))
