"""Lines of documents: labels, meters, periods, kinds and headers, on hand-made texts."""

import pytest
from pyspark.sql import functions as F

from tallgrass.functions.text import INTENTS, intent
from tallgrass.operators import layout


def aliases(spark):
    return spark.createDataFrame([("payable amount", "bill_amount", 0), ("rebate", "rebate", 1), ("units consumed", "kwh", 2), ("power factor", "pf", 3)], "alias string, key string, place int")


TEXT = "# a comment: 1\r\nPayable Amount  72,200\n\nRebate: ★ Rs 50\nrebate: 70\nPower Factor\t0.95\nTotal units consumed 1,234.50\nnothing here 5\nKWH 5200 5,000 200\nKVAH 7\nPAN: ABCDE  second cell\nlabel only:\n: value only\nDue 31-01-2024: x"


def test_labels_with_values(spark):
    out = layout.harvest(spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "id long, text string"), aliases(spark)).collect()
    got = {(r["line"], r["way"], r["key"], r["value"]) for r in out}
    assert got == {
        (3, 1, "Rebate", "★ Rs 50"), (4, 1, "rebate", "70"), (10, 1, "PAN", "ABCDE"), (13, 1, "Due 31-01-2024", "x"),
        (1, 2, "Payable Amount", "72,200"), (5, 2, "Power Factor", "0.95"),
        (1, 3, "Payable Amount", "72,200"), (3, 3, "Rebate: ★ Rs", "50"), (4, 3, "rebate:", "70"), (5, 3, "Power Factor", "0.95"), (6, 3, "Total units consumed", "1,234.50"),
    }
    rows = layout.meter_rows(layout.text_lines(spark.createDataFrame([(1, TEXT)], "id long, text string"))).collect()
    assert [(r["line"], r["energy"], r["numbers"]) for r in rows] == [(8, "KWH", [5200.0, 5000.0, 200.0])]


def test_first_values_of_canonical_labels(spark):
    out = layout.mapped(spark.createDataFrame([(1, TEXT)], "id long, text string"), aliases(spark)).collect()
    got = {r["canonical"]: (r["raw"], r["value"], r["unit"], r["sign"], r["confidence"]) for r in out}
    assert got == {"rebate": ("Rs 50", None, "rs", -1, 1.0), "bill_amount": ("72,200", 72200.0, None, 1, 1.0), "pf": ("0.95", 0.95, None, 1, 1.0), "kwh": ("1,234.50", 1234.5, None, 1, 0.955)}


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("Billing Period: 01-Apr-2024 to 30/June/24", "2024-04-01", "2024-06-30"), ("from 5 sept 23", "2023-09-05", "2023-09-05"), ("month February 2024", "2024-02-01", "2024-02-29"), ("Period: Jan 2023 to Mar 2023", "2023-01-01", "2023-03-31"),
        ("accounts of FY 2023-24", "2023-04-01", "2024-03-31"), ("period 31 Feb 2024, FY 21/22", "2021-04-01", "2022-03-31"), ("period 5 Smarch 2024", "2024-01-05", "2024-01-05"), ("nothing", None, None), ("", None, None), (None, None, None),
    ],
)
def test_periods(spark, text, start, end):
    a, b = layout.bill_period(F.lit(text).cast("string"))
    row = spark.range(1).select(a.cast("string").alias("a"), b.cast("string").alias("b")).first()
    assert (row["a"], row["b"]) == (start, end)


def test_kinds(spark):
    rows = [("Water bill, 5 kilolitres of diesel", None), ("Diesel and hsd by HPCL", None), ("electricity bill, tariff, TATA  POWER", None), ("", "waste_manifest"), ("headcount", "nonsense"), (None, None)]
    kind, confidence = layout.document_type(F.col("text"), F.col("hint"))
    out = spark.createDataFrame(rows, "text string, hint string").select(kind.alias("k"), confidence.alias("c")).collect()
    assert [(r["k"], r["c"]) for r in out[:5]] == [("WATER_BILL", 0.76), ("FUEL_INVOICE", 0.76), ("UTILITY_BILL", 0.94), ("WASTE_MANIFEST", 0.99), ("HR_HEADCOUNT_SHEET", 0.58)]
    heads = [("Period | From | To | Units", "BILLING_TABLE"), ("Emp ID | Gender | DOJ", "HR_TABLE"), ("topic hours", "TRAINING_TABLE"), ("kl source", "WATER_TABLE"), ("summary", "CONSUMPTION_SUMMARY"), ("?", "GENERIC_TABLE"), ("disposal kl", "WASTE_TABLE")]
    got = spark.createDataFrame(heads, "h string, want string").select("want", layout.table_label(F.col("h")).alias("l")).collect()
    assert [r["l"] for r in got] == [r["want"] for r in got]


def test_headers_of_two_rows(spark):
    rows = [(["Energy", "Used"], ["(kWh)", "", "note"]), (["a", "b"], ["1", "x"]), (["a"], ["", " "]), (["a", "b"], None), (["a"] * 6, ["x", "x", "x", "x", "x", "7"])]
    out = spark.createDataFrame(rows, "h array<string>, f array<string>").select(layout.merged_header(F.col("h"), F.col("f")).alias("m")).collect()
    assert [r["m"] for r in out] == [["Energy (kWh)", "Used", "note"], ["a", "b"], ["a"], ["a", "b"], ["a x"] * 5 + ["a 7"]]


def test_fields_in_the_units_of_their_keys(spark):
    rows = [
        (1, "e", "2024", "a", 2.0, "MWh", 0.9, False), (1, "e", "2024", "b", 7.0, "", 0.9, False), (1, "e", "2024", "c", 1.0, "kWh", 0.5, False), (1, "e", "2024", "t", 5.0, "kWh", 0.9, True),
        (2, "e", "2024", "d", 3.0, "kg", 0.9, False), (3, "e", "2024", "f", 99.0, "GWh", 0.9, False), (4, "x", "2024", "g", 3.0, " KG ", 0.9, False), (5, "e", "2024", "h", None, "kWh", 0.9, False), (6, "e", "2024", "i", 4.0, "parsec", 0.2, False),
    ]
    fields = spark.createDataFrame(rows, "document_id long, key string, period string, id string, value double, unit string, confidence double, total boolean")
    targets = spark.createDataFrame([("e", "kwh", 0.0, 1e6)], "key string, target string, low double, high double")
    got = sorted((r["document_id"], r["period"], r["id"], r["value"], r["unit"]) for r in layout.normalised(fields, targets).collect())
    assert got == [(1, "2024", "a", pytest.approx(2000.0), "kwh"), (1, "_TOTAL", "t", 5.0, "kwh"), (2, "2024", "d", 3.0, "kg"), (4, "2024", "g", 3.0, "kg"), (6, "2024", "i", 4.0, "kwh")]


def test_every_intent(spark):
    for name, first, lists in INTENTS:
        text = ("" if first else "please ") + " ".join(ps[-1] for ps in lists).upper() + " ..."
        assert spark.range(1).select(intent(F.lit(f"  {text}")).alias("i")).first()["i"] == name
    assert spark.range(1).select(intent(F.lit("so what is it")).alias("i")).first()["i"] == "GENERAL"
