"""Formula runs: authored expressions over summed inputs, as columns in dependency order.

Formulas are Spark SQL expressions, so Spark parses them.  Every key has one
unit in a run (a mixed one stops it), so units are settled before any row is
read.  A formula that divides by zero or lacks an input gives null; a cycle
stops the run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from .emissions import USABLE_SQL, usable


@dataclass(frozen=True)
class Formula:
    output: str
    expression: str
    unit: str
    inputs: tuple[str, ...]


#: The built-in formula, used only where no other gives its output; then formulas of our own for each kind of expression.
BUILT_IN = Formula("scope2_from_grid", "purchased_electricity_kwh * 0.000716", "tCO2e", ("purchased_electricity_kwh",))
FORMULAS = (
    Formula("scope12", "ghg_scope1_total + coalesce(scope2_from_grid, ghg_scope2_location)", "tCO2e", ("ghg_scope1_total", "scope2_from_grid", "ghg_scope2_location")),
    Formula("intensity", "try_divide(scope12, purchased_electricity_kwh)", "tCO2e/kWh", ("scope12", "purchased_electricity_kwh")),
    Formula("worst", "greatest(ghg_scope2_location, ghg_scope2_market)", "tCO2e", ("ghg_scope2_location", "ghg_scope2_market")),
    Formula("flag", "if(ghg_scope1_total > ghg_scope2_market AND NOT scope12 <= 0, 1, 0)", "", ("ghg_scope1_total", "ghg_scope2_market", "scope12")),
    Formula("rest", "round(abs(ghg_scope2_market - ghg_scope2_location) % 7, 2)", "tCO2e", ("ghg_scope2_market", "ghg_scope2_location")),
    Formula("mean_scope2", "(ghg_scope2_location + ghg_scope2_market) / 2", "tCO2e", ("ghg_scope2_location", "ghg_scope2_market")),
    Formula("hopeless", "try_divide(ghg_scope1_total, 0)", "", ("ghg_scope1_total",)),
)


def ordered(formulas: tuple[Formula, ...]) -> list[Formula]:
    """Dependencies first; ``ValueError`` for a cycle or an output that is given twice."""
    by = {f.output: f for f in formulas}
    if len(by) < len(formulas):
        raise ValueError("an output has two formulas")
    if BUILT_IN.output not in by:
        by[BUILT_IN.output] = BUILT_IN
    try:
        order = list(TopologicalSorter({k: [i for i in f.inputs if i in by] for k, f in by.items()}).static_order())
    except CycleError as e:
        raise ValueError(f"formulas depend on each other: {e.args[1]}") from e
    return [by[k] for k in order]


def check_units(formulas: list[Formula], units: dict[str, str]) -> None:
    """Sums and differences of unlike units are refused; a factor has none.

    Beside operands that stand next to each other, inputs of unlike units may
    not be in one formula with a sum, a difference, a comparison or a choice
    among values: only products and quotients are safe then.
    """
    known = dict(units) | {f.output: f.unit for f in formulas}
    for f in formulas:
        met = sorted({known[i] for i in f.inputs if known.get(i)})
        plain = re.sub(r"\b\d[\d.]*(e[+-]?\d+)?", "", f.expression, flags=re.IGNORECASE)
        if len(met) > 1 and re.search(r"[+<>=-]|\b(greatest|least|coalesce|nvl|ifnull|between|in)\b", plain, re.IGNORECASE):
            raise ValueError(f"{f.output}: an input is in {met[0]}, another in {met[1]}")
        for a, b in re.findall(r"\b(\w+)\b\s*[+-]\s*(?=(\w+))", f.expression):
            if known.get(a) and known.get(b) and known[a] != known[b]:
                raise ValueError(f"{f.output}: {a} is in {known[a]}, {b} in {known[b]}")


def run_formulas(e: DataFrame, by: list[str], formulas: tuple[Formula, ...] = FORMULAS) -> DataFrame:
    """(by, output, value, unit) of every formula for each group; only the keys that formulas read are scanned."""
    order = ordered(formulas)
    outputs = {f.output for f in order}
    keys = sorted({i for f in order for i in f.inputs if i not in outputs})
    rows = usable(e).where(F.col("canonical_key").isin(*keys))
    seen = rows.groupBy("canonical_key").agg(F.min("unit").alias("unit"), F.max("unit").alias("other"), F.count_if(F.col("unit").isNull()).alias("without")).collect()
    for r in seen:
        if r["unit"] != r["other"] or (r["unit"] is not None and r["without"]):
            raise ValueError(f"mixed units for {r['canonical_key']}: {r['unit']} and {r['other'] if r['unit'] != r['other'] else None}")
    check_units(order, {r["canonical_key"]: r["unit"] for r in seen})
    wide = rows.groupBy(*by).pivot("canonical_key", keys).agg(F.sum("value"))
    for f in order:
        wide = wide.withColumn(f.output, F.expr(f.expression).cast("double"))
    unit = F.create_map(*(F.lit(x) for f in order for x in (f.output, f.unit)))
    long = wide.unpivot(by, [f.output for f in order], "output", "value")
    return long.withColumn("unit", unit[F.col("output")])


_WIDE = f"""w AS (SELECT tenant_id, sum(value) FILTER (canonical_key = 'ghg_scope1_total') AS s1, sum(value) FILTER (canonical_key = 'ghg_scope2_location') AS l, sum(value) FILTER (canonical_key = 'ghg_scope2_market') AS m,
 sum(value) FILTER (canonical_key = 'purchased_electricity_kwh') AS kwh FROM metric_event WHERE {USABLE_SQL} GROUP BY 1),
o AS (SELECT tenant_id, unnest(['scope2_from_grid', 'scope12', 'intensity', 'worst', 'flag', 'rest', 'mean_scope2', 'hopeless']) AS output,
 unnest([kwh * 0.000716, s1 + coalesce(kwh * 0.000716, l), (s1 + coalesce(kwh * 0.000716, l)) / nullif(kwh, 0), greatest(l, m), CASE WHEN s1 > m AND NOT s1 + coalesce(kwh * 0.000716, l) <= 0 THEN 1 ELSE 0 END, round(abs(m - l) % 7, 2), (l + m) / 2, NULL]::DOUBLE[]) AS value FROM w)"""


@query("sc_c18", "metric_event", sql=f"WITH {_WIDE} SELECT tenant_id, output, round(value, 6) AS value FROM o")
def formula_run(e: DataFrame) -> DataFrame:
    return run_formulas(e, ["tenant_id"]).select("tenant_id", "output", F.round("value", 6).alias("value"))


@query("snk1", "metric_event", sql=f"WITH {_WIDE} SELECT concat(tenant_id, '-', output) AS id, 'DRAFT' AS status, round(value, 6) AS value FROM o WHERE value IS NOT NULL")
def derived_events(e: DataFrame) -> DataFrame:
    """Derived events of a run: one for each formula that gave a value."""
    rows = run_formulas(e, ["tenant_id"]).where(F.col("value").isNotNull())
    return rows.select(F.concat_ws("-", F.col("tenant_id").cast("string"), "output").alias("id"), F.lit("DRAFT").alias("status"), F.round("value", 6).alias("value"))
