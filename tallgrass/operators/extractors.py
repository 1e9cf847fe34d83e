"""Bills as text and what extractors make of them: a table function by the extractor's name, types by weighted signals, labels by aliases.

An extractor is data: signatures that tell its kind of document, ladders of
patterns for its fields, and numbers for its confidence.  The table function
``extracted`` runs one over every document of a partition.
"""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.matching import DOC_TYPES, FULL, HINTED, LEAST, MOST, UNKNOWN, document_types, longest_alias
from ..plans.catalog import query


@dataclass(frozen=True)
class Field:
    """A field with its ladder: the first pattern that is found gives the value, if it is within ``low`` and ``high``."""

    key: str
    unit: str | None
    confidence: float
    ladder: tuple[str, ...]
    low: float = 0.0
    high: float = float("inf")
    #: Whether ``low`` itself is a value, and whether a value out of bounds lets the next pattern try.
    with_low: bool = False
    goes_on: bool = False


@dataclass(frozen=True)
class Extractor:
    """Signatures by name, the first that is found wins; confidence is ``base + step * fields + dated``, capped."""

    signatures: tuple[tuple[str, str], ...]
    fields: tuple[Field, ...]
    base: float
    step: float
    dated: float
    #: Names of signatures with a base of their own, characters that a text must have, and fields that take the first field's value where a line names them.
    bases: dict[str, float] = field(default_factory=dict)
    least: int = 1
    tags: tuple[tuple[str, str], ...] = ()
    years: bool = False
    #: Rows of numbers by signature, which are looked for before the first field's ladder: the last number counts, 0 is one that is less sure.
    rows: dict[str, tuple[str, ...]] = field(default_factory=dict)


CAP = 0.96
_N, _NK = r"([\d,]+(?:\.\d+)?)", r"\s*[:\-]\s*([\d,]+(?:\.\d+)?)\s*kg"
_M = r"([\d,]+(?:\.\d{1,2})?)"

# Signatures, ladders, bounds and confidences of the extractors.
ELECTRICITY = Extractor(
    (
        ("ADANI", r"\bADANI\s+ELECTRICITY\b"), ("MGVCL", r"\b(MGVCL|MADHYA\s+GUJARAT\s+VIJ)\b"), ("PGVCL", r"\b(PGVCL|PASCHIM\s+GUJARAT\s+VIJ)\b"), ("UGVCL", r"\b(UGVCL|UTTAR\s+GUJARAT\s+VIJ)\b"), ("DGVCL", r"\b(DGVCL|DAKSHIN\s+GUJARAT\s+VIJ)\b"),
        ("TORRENT", r"\bTORRENT\s+POWER\b"), ("MSEDCL", r"(\bMSEDCL\b|\bMahavitaran\b|महावितरण|महाराष्ट्र\s+स्टेट\s+इलेक्ट्रिसिटी)"), ("TATA_POWER", r"\bTATA\s+POWER\b"), ("BEST", r"\bBEST\s+(?:UNDERTAKING|MUMBAI)\b"),
        ("RELIANCE", r"\b(RELIANCE\s+ENERGY|RELIANCE\s+INFRASTRUCTURE)\b"), ("BSES_RAJ", r"\bBSES\s+RAJDHANI\b"), ("BSES_YAM", r"\bBSES\s+YAMUNA\b"), ("TPDDL", r"\b(TPDDL|TATA\s+POWER\s+DELHI)\b"),
        ("BESCOM", r"\bBESCOM\b|\bBANGALORE\s+ELECTRICITY\b"), ("MESCOM", r"\bMESCOM\b|\bMANGALORE\s+ELECTRICITY\b"), ("HESCOM", r"\bHESCOM\b|\bHUBLI\s+ELECTRICITY\b"), ("GESCOM", r"\bGESCOM\b|\bGULBARGA\s+ELECTRICITY\b"),
        ("TANGEDCO", r"\b(TANGEDCO|TNEB|TAMIL\s+NADU\s+ELECTRICITY)\b"), ("APSPDCL", r"\bAPSPDCL\b|\bAP\s+SOUTHERN\s+POWER\b"), ("APEPDCL", r"\bAPEPDCL\b|\bAP\s+EASTERN\s+POWER\b"), ("APCPDCL", r"\bAPCPDCL\b|\bAP\s+CENTRAL\s+POWER\b"),
        ("TSSPDCL", r"\bTSSPDCL\b|\bTELANGANA\s+SOUTHERN\b"), ("TSNPDCL", r"\bTSNPDCL\b|\bTELANGANA\s+NORTHERN\b"), ("KSEB", r"\b(KSEB|KERALA\s+STATE\s+ELECTRICITY)\b"), ("WBSEDCL", r"\b(WBSEDCL|WEST\s+BENGAL\s+STATE\s+ELECTRICITY)\b"),
        ("CESC", r"\bCESC(\s+LIMITED)?\b"), ("PSPCL", r"\b(PSPCL|PUNJAB\s+STATE\s+POWER)\b"), ("UHBVN", r"\b(UHBVN|UTTAR\s+HARYANA\s+BIJLI)\b"), ("DHBVN", r"\b(DHBVN|DAKSHIN\s+HARYANA\s+BIJLI)\b"),
        ("JVVNL", r"\b(JVVNL|JAIPUR\s+VIDYUT)\b"), ("AVVNL", r"\b(AVVNL|AJMER\s+VIDYUT)\b"), ("JDVVNL", r"\b(JDVVNL|JODHPUR\s+VIDYUT)\b"), ("UPPCL", r"\b(UPPCL|UTTAR\s+PRADESH\s+POWER)\b"),
        ("MPPKVVCL", r"\b(MPPKVVCL|MADHYA\s+PRADESH\s+PASCHIM)\b"), ("MPMKVVCL", r"\b(MPMKVVCL|MADHYA\s+PRADESH\s+MADHYA)\b"), ("SBPDCL", r"\b(SBPDCL|SOUTH\s+BIHAR\s+POWER)\b"), ("NBPDCL", r"\b(NBPDCL|NORTH\s+BIHAR\s+POWER)\b"),
        ("JBVNL", r"\b(JBVNL|JHARKHAND\s+BIJLI)\b"), ("CSPDCL", r"\b(CSPDCL|CHHATTISGARH\s+STATE\s+POWER)\b"), ("UPCL", r"\b(UPCL|UTTARAKHAND\s+POWER)\b"), ("TPODL", r"\bTP[CNWS]ODL\b|\bTATA\s+POWER\s+ODISHA\b"),
        ("GENERIC", r"(\bELECTRICITY\s+BILL\b|\bTARIFF\s+CALCULATION\b|\bUTILITY\s+BILL\b|\bLT\s+E-?Bill\b|\bHT\s+E-?Bill\b|\bENERGY\s+CHARGES\b|वीज\s+पुरवठा|बिजली\s+बिल|विद्युत\s+देयक|வைய\s+ஆற்றல்)"),
    ),
    (
        Field("purchased_electricity_kwh", "kWh", 0.95, (
            rf"Total\s+Units\s+Consumed\s*[:\-]\s*{_N}\s*kWh", rf"Units\s+Consumed\s*[:\-]\s*{_N}\s*kWh", rf"Energy\s+Consumed\s*\(?\s*kWh\s*\)?\s*[:\-]\s*{_N}", rf"Net\s+(?:Energy|Units)\s+Consumed\s*[:\-]\s*{_N}\s*(?:kWh)?",
            rf"\bUnits\s*(?:billed|charged)\s*[:\-]\s*{_N}", rf"(?m)^[\s\-]*Units?\s*[:\-]\s*{_N}\s*kWh\s*$", rf"कुल\s+(?:यू|यु|यू)निट\s*[:\-]?\s*{_N}", rf"மொத்த\s+அலகுகள்\s*[:\-]?\s*{_N}", rf"एकूण\s*[:\-]?\s*{_N}\b(?!\s*\d)",
        ), high=1e9),
        Field("sanctioned_load_kw", "kW", 0.92, (
            rf"Sanctioned\s+Load\s*[:\-]\s*{_N}\s*k?W?", rf"Connected\s+Load\s*[:\-]\s*{_N}\s*k?W?", rf"Sanctioned\s+Demand\s*[:\-]\s*{_N}", rf"मंजूर\s+भार\s*[:\-]?\s*{_N}\s*(?:k?W|किलोवॅट)?", rf"स्वीकृत\s+भार\s*[:\-]?\s*{_N}\s*(?:k?W)?",
        ), high=1e6),
        Field("maximum_demand_kva", "kVA", 0.90, (
            rf"Maximum\s+Demand\s+Recorded\s*[:\-]\s*{_N}", rf"Maximum\s+Demand\s*[:\-]\s*{_N}", rf"Recorded\s+Demand\s*[:\-]\s*{_N}", rf"\bDemand\s*\(?\s*kVA\s*\)?\s*[:\-]\s*{_N}",
        ), high=1e6),
        Field("power_factor", None, 0.95, (r"(?:Avg\.?\s*)?Power\s+Factor\s*[:\-]\s*([01]?\.\d{1,3})",), high=1.0000001),
        Field("bill_amount_inr", "INR", 0.92, (
            rf"Total\s+Amount\s+(?:Due|Payable)\s*[:\-]\s*(?:Rs\.?|INR|₹)\s*{_M}", rf"Total\s+Payable\s*[:\-]\s*(?:Rs\.?|INR|₹)\s*{_M}", rf"Net\s+Amount\s+Payable\s*\(?\s*(?:Rs|INR|₹)?\s*\)?\s*[:\-]\s*{_M}", rf"Bill\s+Amount\s*\(?\s*(?:INR|Rs|₹)?\s*\)?\s*[:\-]\s*{_M}",
            rf"Pay\s+Rs\.\s*{_M}", rf"देयक\s+रक्कम\s*(?:रु\.?|₹)?\s*[:\-]?\s*{_M}", rf"पूर्णांक\s+देयक\s*\(?\s*(?:रु\.?|₹)?\s*\)?\s*[:\-]?\s*{_M}", rf"(?:कुल\s+)?देय\s+राशि\s*[:\-]?\s*(?:रु\.?|₹)?\s*{_M}", rf"बिल\s+राशि\s*[:\-]?\s*(?:रु\.?|₹)?\s*{_M}",
        )),
    ),
    base=0.62, step=0.12, dated=0.08, bases={"GENERIC": 0.40}, least=40,
    rows={"MSEDCL": tuple(r"(?m)एकूण[\s\S]{0,400}?(?:^|\n)\s*" + r"\s+".join([r"(\d+(?:\.\d+)?)"] * n) + r"\b" for n in (6, 5, 4))},
)
_KL = r"[^\n:]*[:\-]\s*([\d,]+(?:\.\d+)?)\s*kL"
WATER = Extractor(
    (("WATER", r"\bMUNICIPAL\s+WATER\b|\bWATER\s+SUPPLY\b|\bWATER\s+BILL\b|\bwater\s+withdrawn\b|\bborewell\b|\bgroundwater\b"),),
    (
        Field("water_withdrawn_total_kl", "kL", 0.95, (rf"Total\s+water\s+withdrawn\s*[:\-]\s*{_N}\s*kL", rf"Total\s+water\s+(?:consumption|consumed)\s*[:\-]\s*{_N}\s*kL", rf"Net\s+water\s+(?:withdrawn|consumed)\s*[:\-]\s*{_N}\s*kL"), goes_on=True),
        Field("water_withdrawn_groundwater_kl", "kL", 0.93, ("Groundwater" + _KL, "Borewell" + _KL), goes_on=True),
        Field("water_withdrawn_surface_kl", "kL", 0.93, (r"Surface\s+water" + _KL,)),
        Field("water_withdrawn_third_party_kl", "kL", 0.93, (r"Third[\s\-]Party" + _KL, r"Municipal\s+Supply" + _KL), goes_on=True),
        Field("water_withdrawn_seawater_kl", "kL", 0.93, ("Seawater" + _KL,)),
        Field("water_recycled_kl", "kL", 0.93, (r"(?:Recycled|Re-?used)\s+water" + _KL,)),
    ),
    base=0.60, step=0.12, dated=0.08,
    tags=(
        ("water_withdrawn_groundwater_kl", r"Source\s*[:\-][^\n]*\b(?:groundwater|borewell)\b"), ("water_withdrawn_surface_kl", r"Source\s*[:\-][^\n]*\bsurface\s+water\b"),
        ("water_withdrawn_third_party_kl", r"Source\s*[:\-][^\n]*\b(?:third[\s\-]party|municipal)\b"), ("water_withdrawn_seawater_kl", r"Source\s*[:\-][^\n]*\bseawater\b"),
    ),
)
WASTE = Extractor(
    (("WASTE", r"\bWASTE\s+MANIFEST\b|\bHAZARDOUS\s+WASTE\b|\bForm\s*[\-\s]*10\b|\bWaste\s+(?:Category|Generator)\b|\bdisposal\s+method\b"),),
    tuple(
        Field(key, "kg", 0.94, ladder, goes_on=True)
        for key, ladder in (
            ("waste_hazardous_kg", (r"Total\s+Hazardous\s+waste" + _NK, rf"(?m)^\s*Hazardous\s+waste\s*[,\-:]\s*{_N}\b")),
            ("waste_non_hazardous_kg", (r"Total\s+Non[\-\s]hazardous\s+waste" + _NK, rf"(?m)^\s*Non[\-\s]hazardous\s+waste\s*[,\-:]\s*{_N}\b")),
            ("waste_recycled_kg", (r"Waste\s+recycled" + _NK, r"(?:Total\s+)?Recycled\s+waste" + _NK)),
            ("waste_to_landfill_kg", (r"Waste\s+sent\s+to\s+landfill" + _NK, "Landfilled" + _NK)),
            ("waste_to_incineration_kg", (r"Waste\s+sent\s+to\s+incineration" + _NK, "Incinerated" + _NK)),
            ("e_waste_kg", (rf"(?m)^\s*E[\-\s]?waste\s*[,\-:]\s*{_N}\b", r"Total\s+E[\-\s]?waste" + _NK)),
            ("plastic_waste_kg", (rf"(?m)^\s*Plastic\s+waste\s*[,\-:]\s*{_N}\b", r"Total\s+Plastic\s+waste" + _NK)),
            ("battery_waste_kg", (rf"(?m)^\s*Battery\s+waste\s*[,\-:]\s*{_N}\b", r"Total\s+Battery\s+waste" + _NK)),
        )
    ),
    base=0.50, step=0.06, dated=0.05,
)
HEADCOUNT = Extractor(
    (("HEADCOUNT", r"\bEMPLOYEE\s+MASTER\b|\bHEADCOUNT\b|\bPAYROLL\b|\bHR\s+(?:Master|Report|Register)\b|\bTotal\s+Employees?\b"),),
    tuple(
        Field(key, "count", 0.94, tuple(p + r"\s*[:\-]\s*([\d,]+)" for p in ladder), high=1e7 + 1, with_low=True, goes_on=True)
        for key, ladder in (
            ("employee_count_total", (r"Total\s+(?:number\s+of\s+)?Employees?", r"Total\s+Headcount")),
            ("employee_count_male", (r"Male\s+Employees?", r"(?:Total\s+)?Male\s+Headcount")),
            ("employee_count_female", (r"Female\s+Employees?", r"(?:Total\s+)?Female\s+Headcount", r"Women\s+Employees?")),
            ("employee_count_permanent", (r"Permanent\s+Employees?", r"Full[\-\s]Time\s+Employees?")),
            ("contract_workers_count", (r"Contract\s+Workers?", r"Contractual\s+Employees?")),
            ("trainees_count", (r"Trainees?", r"Apprentices?")),
            ("employee_count_pwd", (r"Persons?\s+with\s+Disabilit(?:ies|y)", "PwD")),
        )
    ),
    base=0.50, step=0.07, dated=0.05, years=True,
)
EXTRACTORS = {"electricity": ELECTRICITY, "water": WATER, "waste": WASTE, "headcount": HEADCOUNT}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAMED = re.compile(r"(?:Billing\s+Period|Reading\s+Period|Period)\s*[:\-]\s*(\d{1,2})\s*[\-/\s]+\s*([A-Za-z]+)\s*[\-/\s]+\s*(\d{2,4})\s*(?:to|-)\s*(\d{1,2})\s*[\-/\s]+\s*([A-Za-z]+)\s*[\-/\s]+\s*(\d{2,4})", re.I)
_ISO = re.compile(r"(?:Billing\s+Period|Reading\s+Period|Manifest\s+Period|Reporting\s+Period|Period)\s*[:\-]\s*(\d{4})-(\d{2})-(\d{2})\s*(?:to|-)\s*(\d{4})-(\d{2})-(\d{2})", re.I)
_MONTH = re.compile(r"(?:Billing\s+Month\s*[:\-]\s*|वीज\s+पुरवठा\s+देयक\s+माहे\s*[:\-]?\s*)([A-Za-z]+)[\s-]+(\d{4})", re.I)
_FISCAL = re.compile(r"FY\s*(\d{2,4})\s*[-/]\s*(\d{2,4})", re.I)
_SNAPSHOT = re.compile(r"(?:(?:Reporting|Snapshot)\s+Date|Generated)\s*[:\-]\s*(\d{4})-(\d{2})-(\d{2})", re.I)


def number(text: str) -> float | None:
    cleaned = re.sub(r"[^\d.\-]", "", text)
    try:
        return float(cleaned)
    except ValueError:
        return None


def month(name: str) -> int:
    """A month's number by its name or the first three or four letters of it; of no month a ValueError."""
    low = name.lower()
    k = MONTHS.index(low[:3]) + 1
    if not date(2000, k, 1).strftime("%B").lower().startswith(low) and low != "sept":
        raise ValueError(name)
    return k


def year(digits: str) -> int:
    return int(digits) + 2000 * (int(digits) < 100)


def period(text: str, years: bool = False) -> tuple[date, date] | None:
    """The first period that is found and is one: from day to day, a month, or a fiscal year from April on."""
    ways = [
        (_ISO, lambda g: (date(*map(int, g[:3])), date(*map(int, g[3:])))),
        (_NAMED, lambda g: (date(year(g[2]), month(g[1]), int(g[0])), date(year(g[5]), month(g[4]), int(g[3])))),
        (_MONTH, lambda g: (date(int(g[1]), month(g[0]), 1), date(int(g[1]), month(g[0]), monthrange(int(g[1]), month(g[0]))[1]))),
    ]
    if years:
        start = lambda g: int(g[0]) - (date(*map(int, g)).month < 4)
        ways = [(_FISCAL, lambda g: (date(year(g[0]), 4, 1), date(year(g[1]), 3, 31))), (_SNAPSHOT, lambda g: (date(start(g), 4, 1), date(start(g) + 1, 3, 31)))]
    for pattern, made in ways:
        if m := pattern.search(text):
            try:
                return made(m.groups())
            except ValueError:
                continue
    return None


def value_of(f: Field, text: str) -> float | None:
    for p in f.ladder:
        if m := re.search(p, text, re.I):
            v = number(m[1])
            if v is not None and (f.low <= v if f.with_low else f.low < v) and v < f.high:
                return v
            if not f.goes_on:
                return None
    return None


def row_value(patterns: tuple[str, ...], text: str) -> float | None:
    """The last number of the first row of numbers that is found."""
    for p in patterns:
        if (m := re.search(p, text)) and (v := number(m.groups()[-1])) is not None and v < 1e8:
            return v
    return None


def extract(text: str | None, by: Extractor) -> tuple[str, tuple[date, date] | None, list[tuple[str, float, str | None, float]], float] | None:
    """(signature, period, fields as (key, value, unit, confidence), confidence of all), or None for another kind of document or one without a field."""
    if not text or len(text) < by.least:
        return None
    name = next((n for n, p in by.signatures if re.search(p, text, re.I)), None)
    if name is None:
        return None
    first, told = by.fields[0], row_value(by.rows.get(name, ()), text)
    found = [] if told is None else [(first.key, told, first.unit, first.confidence if told > 0 else 0.85)]
    found += [(f.key, v, f.unit, f.confidence) for f in by.fields[len(found) :] if (v := value_of(f, text)) is not None]
    if by.tags and found and found[0][0] == by.fields[0].key:
        for key, p in by.tags:
            if key not in {k for k, *_ in found} and re.search(p, text, re.I):
                found.append((key, found[0][1], found[0][2], 0.90))
    if not found:
        return None
    days = period(text, by.years)
    return name, days, found, min(CAP, by.bases.get(name, by.base) + by.step * len(found) + (by.dated if days else 0))


FIELDS = StructType()
for _name, _type in (("id", "long"), ("signature", "string"), ("key", "string"), ("value", "double"), ("unit", "string"), ("confidence", "double"), ("period_start", "date"), ("period_end", "date"), ("overall", "double")):
    FIELDS.add(_name, _type)


@dataclass
class Chosen(AnalyzeResult):
    """What the analysis of a call hands to the workers."""

    extractor: str = ""


class Extracted:
    """Table function: the fields of every document (id, text) of a table by the extractor named."""

    def __init__(self, analyzed: Chosen):
        self.by = EXTRACTORS[analyzed.extractor]

    @staticmethod
    def analyze(rows: AnalyzeArgument, extractor: AnalyzeArgument) -> Chosen:
        if not rows.isTable or not {"id", "text"} <= set(rows.dataType.names):
            raise ValueError("the first argument is a table with id and text")
        if not extractor.isConstantExpression or extractor.value not in EXTRACTORS:
            raise ValueError(f"the extractor is one of {', '.join(EXTRACTORS)}")
        return Chosen(schema=FIELDS, extractor=extractor.value)

    def eval(self, row, extractor) -> Iterator[tuple]:
        if made := extract(row["text"], self.by):
            name, days, fields, overall = made
            for key, v, unit, confidence in fields:
                yield row["id"], name, key, v, unit, confidence, *(days or (None, None)), round(overall, 4)


def extracted(bills: DataFrame, extractor: str) -> DataFrame:
    """``FIELDS`` of (id, text) by the table function; rows stay in their partitions."""
    from pyspark.sql.functions import udtf

    return udtf(Extracted)(bills.select(F.col("id").cast("long").alias("id"), "text").asTable(), F.lit(extractor))


# --- queries: a bill for every order ------------------------------------------------------------------------------------

KINDS = ("electricity", "water", "waste", "headcount")


def bills(o: DataFrame) -> DataFrame:
    """(id, kind, text): a document of one of four kinds for each order, by its customer, price and date."""
    whole = F.floor(F.col("o_totalprice")).cast("long")
    thousands = F.format_number(whole, 0)
    day = F.to_date("o_orderdate")
    iso = F.concat(F.lit("Period: "), F.date_format(day, "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.date_add(day, 29), "yyyy-MM-dd"), F.lit("\n"))
    named = F.concat(F.lit("Period: "), F.date_format(day, "dd MMMM yyyy"), F.lit(" to "), F.date_format(F.date_add(day, 29), "dd MMMM yyyy"), F.lit("\n"))
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.col("o_custkey") % len(xs) + 1).cast("int"))
    power = F.concat(
        pick("ADANI ELECTRICITY MUMBAI\n", "Electricity Bill of the town\n", "Tata Power\n", "BESCOM\n", "Invoice\n"), pick("Total Units Consumed: ", "Units billed: ", "Energy Consumed (kWh): "), thousands, F.lit(" kWh\n"),
        F.lit("Billing Month: "), F.date_format(day, "MMMM yyyy"), F.lit("\n"), pick("", "Sanctioned Load: 45 kW\n"), pick("Power Factor: 0.95\n", "Power Factor: 1.500\n"), F.lit("Bill Amount (INR): "), whole.cast("string"), F.lit(".50\nKWH 5200 5,000 200\n"),
    )
    water = F.concat(pick("Municipal water\n", "WATER BILL\n", "Tankers\n"), F.lit("Total water withdrawn: "), thousands, F.lit(" kL\n"), pick("Source: borewell\n", "Third Party: 12.5 kL\n"), pick(named, iso))
    waste = F.concat(F.lit("WASTE MANIFEST\n"), pick("Total Hazardous waste: ", "Hazardous waste, ", "Landfilled: "), thousands, F.lit(" kg\n"), pick("Plastic waste: 7\n", ""), iso)
    staff = F.concat(pick("HR Report\n", "Payroll\n"), F.lit("Total Employees: "), thousands, F.lit("\nWomen Employees: "), (whole % 100).cast("string"), F.lit("\nPwD: 0\nFY "), F.year(day).cast("string"), F.lit("-"), (F.year(day) + 1).cast("string"), F.lit("\nContract workers   12"))
    kind = (F.col("o_orderkey") % 4).cast("int")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), F.element_at(F.lit(list(KINDS)), kind + 1).alias("kind"), F.element_at(F.array(power, water, waste, staff), kind + 1).alias("text"))


_BILLS = """b AS (SELECT o_orderkey::BIGINT AS id, o_custkey AS c, floor(o_totalprice)::BIGINT AS w, o_orderdate::DATE AS day FROM orders)"""
_DAYS = "day AS period_start, day + 29 AS period_end"
_ROWS = "SELECT id, signature, f.key AS key, f.value::DOUBLE AS value, f.unit AS unit, f.confidence::DOUBLE AS confidence, strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end, round(least(0.96, base + step * count(*) OVER (PARTITION BY id) + dated), 4)::DOUBLE AS overall FROM (SELECT *, unnest(list_filter(fields, lambda f: f.value IS NOT NULL)) AS f FROM x)"


def _field(key: str, value: str, unit: str, confidence: float) -> str:
    return f"{{'key': '{key}', 'value': ({value})::DOUBLE, 'unit': {unit}, 'confidence': {confidence}::DOUBLE}}"


def told(x: DataFrame) -> DataFrame:
    return x.withColumns({c: F.col(c).cast("string") for c in ("period_start", "period_end")})


@query("doc9", "orders", sql=f"""WITH {_BILLS}, x AS (SELECT id, ['ADANI', 'GENERIC', 'TATA_POWER', 'BESCOM', NULL][(c % 5 + 1)::INT] AS signature, CASE c % 5 WHEN 1 THEN 0.40 ELSE 0.62 END AS base, 0.12 AS step, 0.08 AS dated,
date_trunc('month', day)::DATE AS period_start, last_day(day) AS period_end, [{_field('purchased_electricity_kwh', 'CASE WHEN w > 0 THEN w END', "'kWh'", 0.95)}, {_field('sanctioned_load_kw', 'CASE WHEN c % 2 = 1 THEN 45 END', "'kW'", 0.92)},
{_field('power_factor', 'CASE WHEN c % 2 = 0 THEN 0.95 END', 'NULL', 0.95)}, {_field('bill_amount_inr', 'w + 0.5', "'INR'", 0.92)}] AS fields FROM b WHERE id % 4 = 0 AND c % 5 <> 4) {_ROWS}""")
def electricity_rules(o: DataFrame) -> DataFrame:
    """Fields of electricity bills; an unknown utility gives none, a factor above 1 is no value."""
    return told(extracted(bills(o).where(F.col("kind") == "electricity"), "electricity"))


@query("doc10", "orders", sql=f"""WITH {_BILLS}, x AS (
SELECT id, 'WATER' AS signature, 0.60 AS base, 0.12 AS step, 0.08 AS dated, {_DAYS}, [{_field('water_withdrawn_total_kl', 'CASE WHEN w > 0 THEN w END', "'kL'", 0.95)}, {_field('water_withdrawn_groundwater_kl', 'CASE WHEN c % 2 = 0 AND w > 0 THEN w END', "'kL'", 0.90)}, {_field('water_withdrawn_third_party_kl', 'CASE WHEN c % 2 = 1 THEN 12.5 END', "'kL'", 0.93)}] AS fields FROM b WHERE id % 4 = 1
UNION ALL SELECT id, 'WASTE', 0.50, 0.06, 0.05, {_DAYS}, [{_field('waste_hazardous_kg', 'CASE WHEN c % 3 < 2 AND w > 0 THEN w END', "'kg'", 0.94)}, {_field('waste_to_landfill_kg', 'CASE WHEN c % 3 = 2 AND w > 0 THEN w END', "'kg'", 0.94)}, {_field('plastic_waste_kg', 'CASE WHEN c % 2 = 0 THEN 7 END', "'kg'", 0.94)}] FROM b WHERE id % 4 = 2
UNION ALL SELECT id, 'HEADCOUNT', 0.50, 0.07, 0.05, make_date(year(day), 4, 1), make_date(year(day) + 1, 3, 31), [{_field('employee_count_total', 'w', "'count'", 0.94)}, {_field('employee_count_female', 'w % 100', "'count'", 0.94)}, {_field('employee_count_pwd', '0', "'count'", 0.94)}] FROM b WHERE id % 4 = 3) {_ROWS}""")
def water_waste_and_staff(o: DataFrame) -> DataFrame:
    """Fields of water bills, waste manifests and headcount reports, each by its own extractor."""
    x = bills(o)
    return told(extracted(x.where(F.col("kind") == "water"), "water").union(extracted(x.where(F.col("kind") == "waste"), "waste")).union(extracted(x.where(F.col("kind") == "headcount"), "headcount")))


_TEXT_SQL = """t AS (SELECT id, c, CASE id % 4
WHEN 0 THEN concat(['ADANI ELECTRICITY MUMBAI\n', 'Electricity Bill of the town\n', 'Tata Power\n', 'BESCOM\n', 'Invoice\n'][(c % 5 + 1)::INT], ['Total Units Consumed: ', 'Units billed: ', 'Energy Consumed (kWh): '][(c % 3 + 1)::INT], format('{:,}', w), ' kWh\nBilling Month: ', strftime(day, '%B %Y'), '\n', ['', 'Sanctioned Load: 45 kW\n'][(c % 2 + 1)::INT], ['Power Factor: 0.95\n', 'Power Factor: 1.500\n'][(c % 2 + 1)::INT], 'Bill Amount (INR): ', w, '.50\nKWH 5200 5,000 200\n')
WHEN 1 THEN concat(['Municipal water\n', 'WATER BILL\n', 'Tankers\n'][(c % 3 + 1)::INT], 'Total water withdrawn: ', format('{:,}', w), ' kL\n', ['Source: borewell\n', 'Third Party: 12.5 kL\n'][(c % 2 + 1)::INT], 'Period: ', [strftime(day, '%d %B %Y'), strftime(day, '%Y-%m-%d')][(c % 2 + 1)::INT], ' to ', [strftime(day + 29, '%d %B %Y'), strftime(day + 29, '%Y-%m-%d')][(c % 2 + 1)::INT], '\n')
WHEN 2 THEN concat('WASTE MANIFEST\n', ['Total Hazardous waste: ', 'Hazardous waste, ', 'Landfilled: '][(c % 3 + 1)::INT], format('{:,}', w), ' kg\n', ['Plastic waste: 7\n', ''][(c % 2 + 1)::INT], 'Period: ', strftime(day, '%Y-%m-%d'), ' to ', strftime(day + 29, '%Y-%m-%d'), '\n')
ELSE concat(['HR Report\n', 'Payroll\n'][(c % 2 + 1)::INT], 'Total Employees: ', format('{:,}', w), '\nWomen Employees: ', w % 100, '\nPwD: 0\nFY ', year(day), '-', year(day) + 1, '\\nContract workers   12') END AS text FROM b)""".replace("\\n'", "' || chr(10)").replace("\\n", "' || chr(10) || '")
_TYPE_SCORES = ", ".join("least(1.0, (" + " + ".join(f"{round(w * 1000)} * contains(low, '{s}')::INT" for s, w in signals) + f") / {1000 * FULL}) AS {t}" for t, signals in DOC_TYPES.items())
_BEST = f"greatest({', '.join(DOC_TYPES)})"


@query("doc5", "orders", sql=f"""WITH {_BILLS}, {_TEXT_SQL}, s AS (SELECT id, CASE WHEN id % 25 = 1 THEN 'WATER_BILL' WHEN id % 25 = 2 THEN 'NO_TYPE' END AS hint, {_TYPE_SCORES} FROM (SELECT id, lower(text) AS low FROM t))
SELECT id, CASE WHEN hint = 'WATER_BILL' THEN hint {' '.join(f"WHEN {_BEST} >= {LEAST} AND {t} = {_BEST} THEN '{t}'" for t in DOC_TYPES)} ELSE 'UNKNOWN' END AS type,
(CASE WHEN hint = 'WATER_BILL' THEN greatest(WATER_BILL, {HINTED}) WHEN {_BEST} >= {LEAST} THEN round(least({MOST}, {_BEST}), 3) ELSE {UNKNOWN} END)::DOUBLE AS score FROM s""")
def types_of_bills(o: DataFrame) -> DataFrame:
    """The type of each order's document by weighted signals; some come with a hint, which wins where it names a type."""
    hint = F.when(F.col("id") % 25 == 1, "water_bill").when(F.col("id") % 25 == 2, "no_type")
    return document_types(bills(o).select("id", "text", hint.alias("hint")))


#: Aliases of the labels on bills, in the order that ties go by.
ALIASES = (("units consumed", "purchased_electricity_kwh"), ("units billed", "purchased_electricity_kwh"), ("energy consumed", "purchased_electricity_kwh"), ("bill amount", "bill_amount_inr"), ("sanctioned load", "sanctioned_load_kw"), ("power factor", "power_factor"), ("water withdrawn", "water_withdrawn_total_kl"), ("third party", "water_withdrawn_third_party_kl"), ("waste", "waste_total_kg"), ("hazardous waste", "waste_hazardous_kg"), ("employees", "employee_count_total"), ("women employees", "employee_count_female"))
LINE = r"^([A-Za-z0-9 \-\(\)/&\.,]+?)\s*[:=\-]\s*([\d,\.]+)\s*([A-Za-z%₹]+)?\s*$"


def label_lines(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, line, key, value, unit, confidence`` of lines that are a label, a value and perhaps a unit, where an alias names the label."""
    x = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    x = x.select("id", "line", *(F.regexp_extract("t", LINE, k).alias(c) for k, c in ((1, "label"), (2, "number"), (3, "unit"))))
    x = x.where(F.col("label") != "").withColumn("value", F.replace("number", F.lit(",")).try_cast("double")).where(F.col("value").isNotNull())
    found = x.join(longest_alias(x.select("label").distinct(), aliases), "label")
    unit = F.nullif(F.col("unit"), F.lit(""))
    return found.select("id", "line", "key", "value", unit.alias("unit"), F.when(unit.isNotNull(), 0.86).otherwise(0.76).alias("confidence"))


@query("doc8", "orders", sql=f"""WITH {_BILLS}, {_TEXT_SQL}, a AS (SELECT * FROM (VALUES {', '.join(f"({k}, {a!r}, {key!r})" for k, (a, key) in enumerate(ALIASES))}) t(place, alias, key)),
l AS (SELECT id, unnest(range(len(string_split(text, chr(10)))))::INT AS line, unnest(string_split(text, chr(10))) AS t FROM t), g AS (SELECT id, line, regexp_extract(t, '{LINE}', ['label', 'number', 'unit']) AS g FROM l),
x AS (SELECT id, line, g.label AS label, try_cast(replace(g.number, ',', '') AS DOUBLE) AS value, nullif(g.unit, '') AS unit FROM g WHERE g.label <> ''),
k AS (SELECT label, arg_max(key, (length(alias), -place)) AS key FROM (SELECT DISTINCT label FROM x) JOIN a ON contains(lower(trim(label)), alias) GROUP BY 1)
SELECT id, line, key, value, unit, CASE WHEN unit IS NULL THEN 0.76 ELSE 0.86 END::DOUBLE AS confidence FROM x JOIN k USING (label) WHERE value IS NOT NULL""")
def labelled_lines(o: DataFrame) -> DataFrame:
    rows = o.sparkSession.createDataFrame([(k, a, key) for k, (a, key) in enumerate(ALIASES)], "place int, alias string, key string")
    return label_lines(bills(o).select("id", "text"), rows)
