"""Units, gases and factors: small tables joined by broadcast, never per-row lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query

# Units by family, as multiples of the family's base unit.
UNITS = {
    "ENERGY": {"j": 1.0, "kj": 1e3, "mj": 1e6, "gj": 1e9, "tj": 1e12, "wh": 3600.0, "kwh": 3.6e6, "mwh": 3.6e9, "gwh": 3.6e12, "twh": 3.6e15, "cal": 4.184, "kcal": 4184.0, "btu": 1055.06, "therm": 1.05506e8},
    "MASS": {"kg": 1.0, "g": 1e-3, "mg": 1e-6, "t": 1e3, "lb": 0.45359237, "oz": 0.0283495231},
    "VOLUME": {"l": 1.0, "ml": 1e-3, "kl": 1e3, "m3": 1e3, "cm3": 1e-3, "gal_us": 3.78541, "gal_uk": 4.54609, "bbl": 158.987},
    "AREA": {"m2": 1.0, "cm2": 1e-4, "km2": 1e6, "ha": 1e4, "hectare": 1e4, "acre": 4046.8564224},
    "DISTANCE": {"m": 1.0, "km": 1e3, "cm": 1e-2, "mi": 1609.344, "ft": 0.3048},
    "TIME": {"s": 1.0, "min": 60.0, "h": 3600.0, "d": 86400.0},
    "POWER": {"w": 1.0, "kw": 1e3, "mw": 1e6, "gw": 1e9, "hp": 745.6999},
    "EMISSION": {"kgco2e": 1.0, "tco2e": 1e3, "gco2e": 1e-3, "mtco2e": 1e9},
    "MONEY": {"usd": 1.0},
}
# Spellings of units.
ALIASES = {"therms": "therm", "tonne": "t", "tonnes": "t", "tons": "t", "pounds": "lb", "lbs": "lb", "grams": "g", "kilogram": "kg", "litre": "l", "litres": "l", "m^3": "m3", "gallon": "gal_us", "barrel": "bbl", "sqm": "m2", "hectares": "ha", "acres": "acre", "miles": "mi", "feet": "ft", "hours": "h", "days": "d", "kilowatt": "kw", "t co2e": "tco2e", "kg co2e": "kgco2e"}
# Gases, and their warming potentials by assessment report and horizon in years.
GASES = "CO2 CH4 CH4_FOSSIL CH4_NON_FOSSIL N2O HFC-23 HFC-32 HFC-125 HFC-134a HFC-143a HFC-152a HFC-227ea HFC-236fa HFC-245fa R-404A R-407A R-407C R-410A R-507A SF6 NF3 PFC-14 PFC-116 PFC-218 PFC-318".split()
GWP = {
    "AR4": dict(zip(GASES, (1.0, 25.0, 25.0, 25.0, 298.0, 14800.0, 675.0, 3500.0, 1430.0, 4470.0, 124.0, 3220.0, 9810.0, 1030.0, 3922.0, 2107.0, 1774.0, 2088.0, 3985.0, 22800.0, 17200.0, 7390.0, 12200.0, 8830.0, 10300.0), strict=True)),
    "AR5": dict(zip(GASES, (1.0, 28.0, 30.0, 28.0, 265.0, 12400.0, 677.0, 3170.0, 1300.0, 4800.0, 138.0, 3350.0, 8060.0, 858.0, 3922.0, 2107.0, 1774.0, 2088.0, 3985.0, 23500.0, 16100.0, 6630.0, 11100.0, 8900.0, 9540.0), strict=True)),
    "AR6_100": dict(zip(GASES, (1.0, 27.9, 29.8, 27.0, 273.0, 14600.0, 771.0, 3740.0, 1530.0, 5810.0, 164.0, 3600.0, 8690.0, 962.0, 4728.0, 2262.0, 1908.0, 2256.0, 4282.0, 24300.0, 17400.0, 7380.0, 12400.0, 9290.0, 10000.0), strict=True)),
    "AR6_20": dict(zip(GASES, (1.0, 81.2, 82.5, 79.7, 273.0, 15300.0, 2690.0, 6740.0, 4140.0, 7840.0, 591.0, 5850.0, 8240.0, 3170.0, 6940.0, 4380.0, 4115.0, 4715.0, 7110.0, 18300.0, 13400.0, 5300.0, 8940.0, 6770.0, 7110.0), strict=True)),
}
# Kg of CO2 for a kWh from the grid, by region and state; by region; and for the whole country by year.
GRID = {
    "Northern": {"Punjab": 0.78, "Haryana": 0.81, "Delhi": 0.74, "Rajasthan": 0.79, "Uttar Pradesh": 0.83, "Uttarakhand": 0.50, "Himachal Pradesh": 0.30, "Jammu and Kashmir": 0.55, "Ladakh": 0.55, "Chandigarh": 0.78},
    "Western": {"Maharashtra": 0.85, "Gujarat": 0.82, "Madhya Pradesh": 0.91, "Chhattisgarh": 0.94, "Goa": 0.83, "Dadra and Nagar Haveli": 0.83, "Daman and Diu": 0.83},
    "Southern": {"Karnataka": 0.72, "Tamil Nadu": 0.65, "Kerala": 0.45, "Andhra Pradesh": 0.75, "Telangana": 0.78, "Puducherry": 0.65, "Lakshadweep": 0.85, "Andaman and Nicobar Islands": 0.85},
    "Eastern": {"West Bengal": 0.92, "Bihar": 0.95, "Jharkhand": 0.97, "Odisha": 0.93, "Sikkim": 0.25},
    "NorthEastern": {"Assam": 0.55, "Arunachal Pradesh": 0.30, "Manipur": 0.50, "Meghalaya": 0.30, "Mizoram": 0.40, "Nagaland": 0.55, "Tripura": 0.65},
}
GRID_REGIONS = {"Northern": 0.78, "Western": 0.85, "Southern": 0.65, "Eastern": 0.93, "NorthEastern": 0.50, "AllIndia": 0.716}
GRID_YEARS = {2018: 0.79, 2019: 0.77, 2020: 0.75, 2021: 0.73, 2022: 0.72, 2023: 0.718, 2024: 0.716}
# Fuels with their unit and kg of CO2e for one: burnt, and on the way to the tank.
FUELS = {
    "diesel": ("litre", 2.68, 0.61), "petrol": ("litre", 2.31, 0.61), "fuel_oil": ("litre", 3.16, 0.66), "kerosene": ("litre", 2.54, 0.55), "naphtha": ("litre", 2.12, 0.51),
    "lpg": ("kg", 1.51, 0.22), "lng": ("kg", 2.55, 0.71), "cng": ("kg", 2.55, 0.42), "natural_gas": ("kwh", 0.18, 0.029),
    "coal_industrial": ("tonne", 2403.0, 220.0), "coal_electricity_gen": ("tonne", 2252.0, 210.0), "coking_coal": ("tonne", 3160.0, 235.0), "lignite": ("tonne", 1281.0, 95.0), "petroleum_coke": ("tonne", 3386.0, 312.0),
    "aviation_spirit": ("litre", 2.33, 0.54), "aviation_turbine_fuel": ("litre", 2.55, 0.55), "marine_gas_oil": ("litre", 2.78, 0.62), "marine_fuel_oil": ("litre", 3.21, 0.67),
    "biodiesel": ("litre", 0.17, 0.55), "bioethanol": ("litre", 0.012, 0.41), "wood_pellets": ("tonne", 39.5, 92.0), "biomass_solid": ("tonne", 26.8, 67.0),
}
# Peers by (key, sector): companies, mean, median, standard deviation, quartiles.
PEERS = {
    ("ghg_intensity_per_revenue", "IT_SERVICES"): (38, 7.4, 6.2, 3.1, 4.8, 9.6),
    ("ghg_intensity_per_revenue", "MANUFACTURING"): (52, 84.0, 71.0, 41.0, 52.0, 110.0),
    ("ghg_intensity_per_revenue", "BANKING"): (27, 2.8, 2.4, 1.4, 1.7, 3.6),
    ("water_intensity_per_revenue", "IT_SERVICES"): (38, 21.0, 18.0, 9.0, 13.0, 27.0),
    ("water_intensity_per_revenue", "MANUFACTURING"): (52, 410.0, 305.0, 240.0, 195.0, 540.0),
    ("women_in_workforce_pct", "IT_SERVICES"): (38, 35.8, 35.0, 4.6, 32.5, 39.2),
    ("women_in_workforce_pct", "MANUFACTURING"): (52, 14.2, 12.8, 6.1, 9.0, 17.5),
    ("women_in_workforce_pct", "BANKING"): (27, 26.3, 25.7, 5.0, 22.0, 30.0),
    ("ltifr", "IT_SERVICES"): (38, 0.08, 0.05, 0.12, 0.0, 0.12),
    ("ltifr", "MANUFACTURING"): (52, 1.65, 1.4, 1.05, 0.8, 2.2),
}
# Units of the convert graph with their spellings, by dimension, and its edges: one of the first is so many of the second.
GRAPH_UNITS = {
    "energy": {"kWh": ("kilowatthour", "kwh", "kw h", "kilo watt hour"), "MWh": ("megawatthour", "mwh", "mw h"), "GWh": ("gigawatthour", "gwh"), "GJ": ("gigajoule", "gigajoules"), "MJ": ("megajoule",), "kJ": ("kilojoule",), "TJ": ("terajoule",), "kcal": ("kilocalorie", "kilo calorie")},
    "mass": {"kg": ("kilogram", "kilo", "kgs", "kilos", "kilograms"), "g": ("gram", "grams", "gm"), "tonnes": ("t", "ton", "tons", "metric ton", "metric tonne", "mt"), "lb": ("pound", "pounds", "lbs")},
    "volume": {"L": ("litre", "liter", "litres", "liters", "l"), "kL": ("kilolitre", "kiloliter", "kilolitres", "kl", "m3", "cubic metre", "cubic meter"), "mL": ("millilitre", "milliliter", "ml"), "ML": ("megalitre", "megaliter"), "scm": ("standard cubic metre", "nm3", "normal cubic metre")},
    "currency": {"INR": ("rs", "rupees", "rupee", "rs.", "inr", "₹"), "INR_lakh": ("lakh", "lakhs", "lac", "lacs"), "INR_crore": ("crore", "crores", "cr"), "USD": ("usd", "us$", "us dollar", "us dollars")},
    "emissions": {"tCO2e": ("t co2e", "metric tons co2e", "metric tonnes co2e", "tco2eq"), "kgCO2e": ("kg co2e", "kilograms co2e")},
    "dimensionless": {"pct": ("%", "percent", "percentage"), "count": ("nos", "number", "numbers", "headcount", "persons")},
    "time": {"hours": ("hr", "hrs", "hour"), "days": ("day",), "years": ("year", "yr", "yrs")},
}
GRAPH_EDGES = (
    ("kWh", "MWh", 0.001), ("MWh", "GWh", 0.001), ("kWh", "MJ", 3.6), ("MJ", "GJ", 0.001), ("GJ", "TJ", 0.001), ("kJ", "MJ", 0.001), ("kcal", "kJ", 4.184),
    ("kg", "g", 1000.0), ("kg", "tonnes", 0.001), ("lb", "kg", 0.45359237), ("L", "kL", 0.001), ("L", "mL", 1000.0), ("kL", "ML", 0.001),
    ("INR", "INR_lakh", 0.00001), ("INR_lakh", "INR_crore", 0.01), ("kgCO2e", "tCO2e", 0.001), ("hours", "days", 1 / 24), ("days", "years", 1 / 365.25),
)


def unit_rows(spark: SparkSession, more: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """(unit, family, k): every unit and alias; ``more`` registers further units as symbol: (family, k)."""
    rows = [(u, f, k) for f, us in UNITS.items() for u, k in us.items()]
    known = {u: (f, k) for u, f, k in rows}
    rows += [(a, *known[u]) for a, u in ALIASES.items()] + [(u.lower(), f, k) for u, (f, k) in (more or {}).items()]
    return spark.createDataFrame(rows, "unit string, family string, k double")


def converted(df: DataFrame, value: str, source: str, target: str, more: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """``df`` with ``converted`` (null if impossible) and ``problem``; two broadcast joins of fixed size."""
    units = unit_rows(df.sparkSession, more)
    key = lambda c: F.lower(F.trim(F.col(c)))
    a = units.select(F.col("unit").alias("_from"), F.col("family").alias("_ff"), F.col("k").alias("_fk"))
    b = units.select(F.col("unit").alias("_to"), F.col("family").alias("_tf"), F.col("k").alias("_tk"))
    x = df.join(F.broadcast(a), key(source) == F.col("_from"), "left").join(F.broadcast(b), key(target) == F.col("_to"), "left")
    problem = F.when(F.col("_ff").isNull() | F.col("_tf").isNull(), "unknown unit").when(F.col("_ff") != F.col("_tf"), "other family").when(F.col("_ff") == "MONEY", "money")
    return x.withColumn("problem", problem).withColumn("converted", F.when(problem.isNull(), F.col(value) * F.col("_fk") / F.col("_tk"))).drop("_from", "_to", "_ff", "_tf", "_fk", "_tk")


def _values(rows, names: str) -> str:
    lit = lambda x: f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names}))"


_KNOWN = {u: (f, k) for f, us in UNITS.items() for u, k in us.items()}
UNIT_SQL = _values([(u, f, k) for u, (f, k) in _KNOWN.items()] + [(a, *_KNOWN[u]) for a, u in ALIASES.items()], "unit, family, k")
_PAIRS = (("kWh", "MJ"), ("tonnes", "kg"), ("lbs", "kg"), ("gallon", "L"), ("kWh", "kg"), ("USD", "USD"), ("parsec", "m"), ("acres", "ha"))
_PAIR_SQL = f"{[p for p, _ in _PAIRS]!r}[(l_linenumber % 8 + 1)::INT]", f"{[p for _, p in _PAIRS]!r}[(l_linenumber % 8 + 1)::INT]"


def _pairs(line: DataFrame) -> DataFrame:
    at = (F.col("l_linenumber") % 8 + 1).cast("int")
    return line.select("l_orderkey", "l_linenumber", "l_quantity", F.element_at(F.lit([a for a, _ in _PAIRS]), at).alias("from_unit"), F.element_at(F.lit([b for _, b in _PAIRS]), at).alias("to_unit"))


@query("sc_m1", "lineitem", sql=f"""
WITH u AS {UNIT_SQL}, x AS (SELECT l_orderkey, l_linenumber, l_quantity, {_PAIR_SQL[0]} AS from_unit, {_PAIR_SQL[1]} AS to_unit FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a.family IS NULL OR b.family IS NULL THEN 'unknown unit' WHEN a.family <> b.family THEN 'other family' WHEN a.family = 'MONEY' THEN 'money' END AS problem,
 CASE WHEN a.family = b.family AND a.family <> 'MONEY' THEN round(l_quantity * a.k / b.k, 6) END AS converted FROM x LEFT JOIN u a ON lower(trim(from_unit)) = a.unit LEFT JOIN u b ON lower(trim(to_unit)) = b.unit""")
def convert(line: DataFrame) -> DataFrame:
    return converted(_pairs(line), "l_quantity", "from_unit", "to_unit").select("l_orderkey", "l_linenumber", "problem", F.round("converted", 6).alias("converted"))


@query("sc_m2", "lineitem", sql=f"""WITH u AS {UNIT_SQL}, x AS (SELECT {_PAIR_SQL[0]} AS from_unit, {_PAIR_SQL[1]} AS to_unit, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT family, count(*)::BIGINT AS in_family, string_agg(unit, ',' ORDER BY unit) AS units FROM u GROUP BY 1)
SELECT from_unit, to_unit, n, a.family, in_family, units, coalesce(a.family = b.family AND a.family <> 'MONEY', false) AS can_convert FROM x LEFT JOIN u a ON lower(from_unit) = a.unit LEFT JOIN u b ON lower(to_unit) = b.unit LEFT JOIN f ON f.family = a.family""")
def families_of_units(line: DataFrame) -> DataFrame:
    """The family of each pair of units, all units of that family, and whether the pair converts."""
    units = unit_rows(line.sparkSession)
    families = units.groupBy("family").agg(F.count("*").alias("in_family"), F.concat_ws(",", F.sort_array(F.collect_list("unit"))).alias("units"))
    x = _pairs(line).groupBy("from_unit", "to_unit").agg(F.count("*").alias("n"))
    x = converted(x.withColumn("one", F.lit(1.0)), "one", "from_unit", "to_unit").withColumn("can_convert", F.col("problem").isNull())
    of = units.join(families, "family").select(F.col("unit").alias("_unit"), "family", "in_family", "units")
    return x.join(F.broadcast(of), F.lower("from_unit") == F.col("_unit"), "left").select("from_unit", "to_unit", "n", "family", "in_family", "units", "can_convert")


@query("sc_m3", "lineitem", sql=f"WITH a AS {_values(list(ALIASES.items()), 'alias, unit')} SELECT l_orderkey, l_linenumber, coalesce(unit, lower(trim(f))) AS unit FROM (SELECT l_orderkey, l_linenumber, {_PAIR_SQL[0]} AS f FROM lineitem) LEFT JOIN a ON lower(trim(f)) = alias")
def normal_units(line: DataFrame) -> DataFrame:
    """The unit that each line's spelling stands for; an unknown spelling stays, trimmed and in lower case."""
    rows = line.sparkSession.createDataFrame(list(ALIASES.items()), "alias string, unit string")
    low = F.lower(F.trim("from_unit"))
    return _pairs(line).join(F.broadcast(rows), low == F.col("alias"), "left").select("l_orderkey", "l_linenumber", F.coalesce("unit", low).alias("unit"))


def spelled(text: Column) -> Column:
    """A unit's name without spaces, dashes, slashes, dots and underlines, in lower case."""
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s\-_/.]+", "")


def graph_rows() -> list[tuple[str, str, str, float]]:
    """(spelling, unit, part, k): a unit reaches those of its part of the graph, with k of them to the part's first unit; of units with one spelling the last holds it."""
    reach: dict[str, tuple[str, float]] = {}
    for units in GRAPH_UNITS.values():
        for start in units:
            if start in reach:
                continue
            reach[start], waiting = (start, 1.0), [start]
            for u in waiting:
                for a, b, k in GRAPH_EDGES:
                    for here, there, factor in ((a, b, 1 / k), (b, a, k)):
                        if here == u and there not in reach:
                            reach[there] = (start, reach[u][1] * factor)
                            waiting.append(there)
    names = {re.sub(r"[\s\-_/.]+", "", n.lower()): u for units in GRAPH_UNITS.values() for u, more in units.items() for n in (u, *more)}
    return [(n, u, *reach[u]) for n, u in names.items()]


def graph_converted(df: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """``df`` with ``converted``: null for unknown units and where no edges lead from one to the other."""
    rows = df.sparkSession.createDataFrame(graph_rows(), "name string, unit string, part string, k double")
    a, b = (rows.select(*(F.col(c).alias(f"_{side}_{c}") for c in rows.columns)) for side in "ab")
    x = df.join(F.broadcast(a), spelled(F.col(source)) == F.col("_a_name"), "left").join(F.broadcast(b), spelled(F.col(target)) == F.col("_b_name"), "left")
    same = F.when(F.col("_a_part") == F.col("_b_part"), F.col(value) * F.col("_a_k") / F.col("_b_k"))
    return x.withColumn("converted", same).select(*df.columns, "converted")


_GRAPH_PAIRS = (("lakh", "crore"), ("Rs.", "lacs"), ("scm", "L"), ("%", "percent"), ("kilo watt hour", "GJ"), ("k-cal", "MJ"), ("US$", "INR"), ("headcount", "pct"), ("parsec", "kg"), ("M3", "litres"), ("hrs", "yr"), ("lbs", "metric_ton"))
_GRAPH_SQL = f"WITH g AS {_values(graph_rows(), 'name, unit, part, k')}, x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {[a for a, _ in _GRAPH_PAIRS]!r}[(l_partkey % 12 + 1)::INT] AS a, {[b for _, b in _GRAPH_PAIRS]!r}[(l_partkey % 12 + 1)::INT] AS b FROM lineitem)"


@query("sc_m4", "lineitem", sql=_GRAPH_SQL + r"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN ga.part = gb.part THEN round(l_quantity * ga.k / gb.k, 9) END AS converted FROM x
LEFT JOIN g ga ON ga.name = regexp_replace(lower(trim(a)), '[\s\-_/.]+', '', 'g') LEFT JOIN g gb ON gb.name = regexp_replace(lower(trim(b)), '[\s\-_/.]+', '', 'g')""")
def convert_by_graph(line: DataFrame) -> DataFrame:
    at = (F.col("l_partkey") % 12 + 1).cast("int")
    x = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.element_at(F.lit([a for a, _ in _GRAPH_PAIRS]), at).alias("a"), F.element_at(F.lit([b for _, b in _GRAPH_PAIRS]), at).alias("b"))
    return graph_converted(x, "l_quantity", "a", "b").select("l_orderkey", "l_linenumber", "l_partkey", F.round("converted", 9).alias("converted"))


@query("sc_m5", "lineitem", sql="SELECT l_orderkey, l_linenumber, try_cast(regexp_replace(concat('INR ', l_quantity::BIGINT, ',000.', l_linenumber, ' /-'), '[^0-9.eE]', '', 'g') AS DOUBLE) AS number FROM lineitem")
def parse_numbers(line: DataFrame) -> DataFrame:
    text = F.concat(F.lit("INR "), F.col("l_quantity").cast("long").cast("string"), F.lit(",000."), F.col("l_linenumber").cast("string"), F.lit(" /-"))
    return line.select("l_orderkey", "l_linenumber", F.regexp_replace(text, "[^0-9.eE]", "").try_cast("double").alias("number"))


_GAS = f"{GASES!r}[(l_partkey % {len(GASES)} + 1)::INT]"


def _gas() -> Column:
    return F.element_at(F.lit(GASES), (F.col("l_partkey") % len(GASES) + 1).cast("int"))


def gwp_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, g, k) for b, gs in GWP.items() for g, k in gs.items()], "basis string, gas string, gwp double")


GWP_SQL = _values([(b, g, k) for b, gs in GWP.items() for g, k in gs.items()], "basis, gas, gwp")


@query("ag32", "lineitem", sql=f"WITH g AS {GWP_SQL}, x AS (SELECT l_suppkey, l_quantity, {_GAS} AS gas FROM lineitem) SELECT l_suppkey, basis, round(sum(l_quantity * gwp), 4) AS co2e FROM x JOIN g USING (gas) GROUP BY ALL")
def co2e(line: DataFrame) -> DataFrame:
    rows = line.select("l_suppkey", "l_quantity", _gas().alias("gas")).join(F.broadcast(gwp_rows(line.sparkSession)), "gas")
    return rows.groupBy("l_suppkey", "basis").agg(F.round(F.sum(F.col("l_quantity") * F.col("gwp")), 4).alias("co2e"))


@query("jn20", "lineitem", sql=f"WITH g AS {GWP_SQL}, x AS (SELECT l_orderkey, l_linenumber, l_quantity, {_GAS} AS gas FROM lineitem) SELECT l_orderkey, l_linenumber, gas, round(l_quantity * gwp, 4) AS co2e FROM x JOIN g USING (gas) WHERE basis = 'AR6_100'")
def strict_gwp(line: DataFrame) -> DataFrame:
    """A gas that is not in the table stops the job."""
    table = gwp_rows(line.sparkSession).where(F.col("basis") == "AR6_100")
    x = line.select("l_orderkey", "l_linenumber", "l_quantity", _gas().alias("gas")).join(F.broadcast(table), "gas", "left")
    factor = F.coalesce(F.col("gwp"), F.raise_error(F.concat(F.lit("no potential for "), F.col("gas"))).cast("double"))
    return x.select("l_orderkey", "l_linenumber", "gas", F.round(F.col("l_quantity") * factor, 4).alias("co2e"))


def grid_rows() -> list[tuple[str, str, float]]:
    """(state, region, factor)."""
    return [(state, region, k) for region, states in GRID.items() for state, k in states.items()]


#: Names as they come in reports: all states, some with spaces or capitals, and one that is none.
_STATES = [s.upper() if i % 5 == 0 else f" {s} " if i % 5 == 1 else s for i, (s, _, _) in enumerate(grid_rows())] + ["Atlantis"]
_STATE = f"{_STATES!r}[(o_custkey % {len(_STATES)} + 1)::INT]"


@query("jn18", "orders", sql=f"""WITH s AS {_values([(k.lower(), r, GRID_REGIONS[r], v) for k, r, v in grid_rows()], 'state, region, by_region, f')}, y AS {_values(list(GRID_YEARS.items()), 'year, f')}, x AS (SELECT o_orderkey, lower(trim({_STATE})) AS state, 2016 + o_orderkey % 10 AS year FROM orders)
SELECT o_orderkey, coalesce(s.f, y.f, 0.716)::DOUBLE AS factor, coalesce(region, 'AllIndia') AS region, coalesce(by_region, 0.716)::DOUBLE AS by_region FROM x LEFT JOIN s USING (state) LEFT JOIN y ON x.year = y.year""")
def grid_factor(o: DataFrame) -> DataFrame:
    """The state's factor, else the country's for the year, else the country's newest; beside it the factor of the region."""
    spark = o.sparkSession
    states = spark.createDataFrame([(k.lower(), r, GRID_REGIONS[r], v) for k, r, v in grid_rows()], "state string, region string, by_region double, by_state double")
    years = spark.createDataFrame(list(GRID_YEARS.items()), "year long, by_year double")
    state = F.element_at(F.lit(_STATES), (F.col("o_custkey") % len(_STATES) + 1).cast("int"))
    x = o.select("o_orderkey", F.lower(F.trim(state)).alias("state"), (F.col("o_orderkey") % 10 + 2016).alias("year"))
    x = x.join(F.broadcast(states), "state", "left").join(F.broadcast(years), "year", "left")
    whole = F.lit(GRID_REGIONS["AllIndia"])
    return x.select("o_orderkey", F.coalesce("by_state", "by_year", whole).alias("factor"), F.coalesce("region", F.lit("AllIndia")).alias("region"), F.coalesce("by_region", whole).alias("by_region"))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


_PEER_SQL = _values([(k, s, *v) for (k, s), v in PEERS.items()], "key, sector, companies, mean, median, sd, p25, p75")
_ERF = "sign(x) * (1 - (t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-x * x))"


def peer_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, s, *v) for (k, s), v in PEERS.items()], "key string, sector string, companies int, mean double, median double, sd double, p25 double, p75 double")


_ASKED = [*PEERS, ("unheard", "IT_SERVICES")]


def _measured(c: DataFrame) -> DataFrame:
    k = (F.col("c_custkey") % len(_ASKED) + 1).cast("int")
    return c.select("c_custkey", F.element_at(F.lit([x for x, _ in _ASKED]), k).alias("key"), F.element_at(F.lit([x for _, x in _ASKED]), k).alias("sector"), (F.col("c_custkey") % 120).cast("double").alias("value"))


_MEASURED = f"m AS (SELECT c_custkey, {[x for x, _ in _ASKED]!r}[(c_custkey % {len(_ASKED)} + 1)::INT] AS key, {[x for _, x in _ASKED]!r}[(c_custkey % {len(_ASKED)} + 1)::INT] AS sector, (c_custkey % 120)::DOUBLE AS value FROM customer)"


@query("jn21", "customer", sql=f"WITH p AS {_PEER_SQL}, {_MEASURED} SELECT c_custkey, value, mean FROM m LEFT JOIN p USING (key, sector)")
def peer_join(c: DataFrame) -> DataFrame:
    return _measured(c).join(F.broadcast(peer_rows(c.sparkSession)), ["key", "sector"], "left").select("c_custkey", "value", "mean")


@query("sc_m8", "customer", sql=f"""WITH p AS {_PEER_SQL}, {_MEASURED}, z AS (SELECT *, (value - mean) / sd AS z, (value - mean) / sd / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs((value - mean) / sd / sqrt(2))) AS t FROM m JOIN p USING (key, sector))
SELECT c_custkey, round(z, 3) AS z_score, round(0.5 * (1 + {_ERF}) * 100, 1) AS percentile, CASE WHEN value < p25 THEN 'bottom_quartile' WHEN value < median THEN 'second_quartile' WHEN value < p75 THEN 'third_quartile' ELSE 'top_quartile' END AS bucket FROM z""")
def peer_position(c: DataFrame) -> DataFrame:
    x = _measured(c).join(F.broadcast(peer_rows(c.sparkSession)), ["key", "sector"])
    z, v = (F.col("value") - F.col("mean")) / F.col("sd"), F.col("value")
    bucket = F.when(v < F.col("p25"), "bottom_quartile").when(v < F.col("median"), "second_quartile").when(v < F.col("p75"), "third_quartile").otherwise("top_quartile")
    return x.select("c_custkey", F.round(z, 3).alias("z_score"), F.round(0.5 * (1 + erf(z / F.sqrt(F.lit(2.0)))) * 100, 1).alias("percentile"), bucket.alias("bucket"))
