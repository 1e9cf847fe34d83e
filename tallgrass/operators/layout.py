"""What a document's lines tell: kinds of tables and documents, labels with values, meters, periods, headers of two rows, merged fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import scored_alias, written
from ..functions.units import UNIT_SQL, converted
from ..plans.catalog import query
from .extractors import _BILLS, _TEXT_SQL, ALIASES, bills

# Words of header rows by the table that they tell; tables in the order that ties go by.
TABLE_WORDS = {
    "BILLING_TABLE": ("period", "from", "to", "units", "amount", "tariff", "consumption"),
    "HR_TABLE": ("employee", "emp id", "name", "gender", "designation", "doj"),
    "TRAINING_TABLE": ("training", "hours", "topic", "trainees", "program"),
    "WASTE_TABLE": ("waste", "category", "quantity", "manifest", "disposal", "tsdf"),
    "FUEL_TABLE": ("fuel", "diesel", "petrol", "litres", "qty", "rate"),
    "WATER_TABLE": ("water", "source", "withdrawal", "kl", "consumption"),
    "CONSUMPTION_SUMMARY": ("total", "summary", "units consumed", "consumed"),
}
# Patterns of document types, in the order that ties go by, and all types that a hint may name.
TYPE_PATTERNS = {
    "UTILITY_BILL": (r"\b(units?\s+consumed|kwh\s+consumed|tariff|sanctioned\s+load|fixed\s+charge)\b", r"\b(electricity\s+bill|energy\s+bill|power\s+bill)\b", r"\b(tata\s+power|adani\s+electricity|mgvcl|torrent\s+power|bses|cesc)\b"),
    "FUEL_INVOICE": (r"\b(diesel|hsd|petrol|gasoline|fuel\s+invoice|nozzle|dispensing\s+unit)\b", r"\b(indian\s+oil|hpcl|bpcl|reliance\s+petroleum)\b"),
    "WATER_BILL": (r"\b(water\s+bill|water\s+supply|water\s+consumption|borewell|municipal\s+water)\b", r"\b(kilolit(?:re|er)s?|kl\s+consumed|cubic\s+met(?:re|er)s?)\b"),
    "HR_HEADCOUNT_SHEET": (r"\bemployee\s+(?:id|code|name|master)\b", r"\b(?:headcount|workforce|gender|date\s+of\s+joining)\b", r"\b(?:training\s+report|training\s+hours)\b"),
    "WASTE_MANIFEST": (r"\b(hazardous\s+waste|waste\s+manifest|form\s+10|tsdf|cpcb)\b", r"\b(co[\-\s]processing|landfill|incineration|e[\-\s]waste)\b"),
}
DOCUMENT_TYPES = (*TYPE_PATTERNS, "HR_PAYROLL", "EHS_INCIDENT_REPORT", "AUDITED_FINANCIALS", "BOARD_MINUTES", "CSR_SPEND_REPORT", "ENERGY_AUDIT", "RENEWABLE_PPA", "FUGITIVE_LOG", "SUPPLIER_SAQ", "GENERIC", "UNKNOWN")
# Energies of metered lines in the order that they are looked for, units of values, codes that reduce a bill.
ENERGIES = ("KVAH", "KWH", "KVA", "KW", "SCM", "MMBTU", "LITRE", "LTR", "M3", "KL")
VALUE_UNITS = ("kvah", "kwh", "kva", "kw", "scm", "mmbtu", "litre", "ltr", "kl", "m3", "m³", "units", "rs", "₹")
NEGATIVE = ("rebate", "subsidy")
NUMBER, DAY = r"-?\d[\d,]*\.?\d*", r"\d{1,2}[-/.][A-Za-z0-9]{2,9}[-/.]\d{2,4}|\d{4}-\d{2}-\d{2}"


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def most_hits(hits: dict[str, Column], otherwise: str) -> tuple[Column, Column]:
    """The name with the most hits, the first among equals, and how many these are."""
    best = F.greatest(*hits.values())
    kind = F.when(best == 0, otherwise)
    for name, n in hits.items():
        kind = kind.when(n == best, name)
    return kind, best


def table_label(header: Column) -> Column:
    """The table that a header row, as one text, tells by the most of its words."""
    low = F.lower(header)
    return most_hits({t: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)) for t, ws in TABLE_WORDS.items()}, "GENERIC_TABLE")[0]


def document_type(text: Column, hint: Column) -> tuple[Column, Column]:
    """(type, confidence): a hint that names a type, else the type with the most patterns in the whole text."""
    n = {t: sum((text.rlike(f"(?i){p}").cast("int") for p in ps), F.lit(0)) for t, ps in TYPE_PATTERNS.items()}
    kind, most = most_hits(n, "UNKNOWN")
    told = F.upper(hint).isin(*DOCUMENT_TYPES)
    return F.when(told, F.upper(hint)).otherwise(kind), F.when(told, 0.99).when(most == 0, 0.0).otherwise(F.round(F.least(F.lit(0.95), 0.40 + 0.18 * most), 4))


_HEADER = "lower(array_to_string(string_split(text, chr(10)), ' '))"
_WORD_HITS = ", ".join("(" + " + ".join(f"contains({_HEADER}, '{w}')::INT" for w in ws) + f") AS {t}" for t, ws in TABLE_WORDS.items())
_PATTERN_HITS = ", ".join("(" + " + ".join(f"regexp_matches(text, '(?i){p}')::INT" for p in ps) + f") AS {t}" for t, ps in TYPE_PATTERNS.items())


def _first(names: dict, otherwise: str) -> str:
    best = f"greatest({', '.join(names)})"
    return f"CASE WHEN {best} = 0 THEN '{otherwise}' {' '.join(f'WHEN {t} = {best} THEN {t!r}' for t in names)} END"


@query("doc3", "orders", sql=f"WITH {_BILLS}, {_TEXT_SQL}, h AS (SELECT id, {_WORD_HITS} FROM t) SELECT id, {_first(TABLE_WORDS, 'GENERIC_TABLE')} AS label FROM h")
def table_labels(o: DataFrame) -> DataFrame:
    """The label of each order's document, its lines taken as a header row."""
    return bills(o).select("id", table_label(F.replace("text", F.lit("\n"), F.lit(" "))).alias("label"))


@query("doc4", "orders", sql=f"""WITH {_BILLS}, {_TEXT_SQL}, h AS (SELECT id, CASE WHEN id % 30 = 0 THEN 'ENERGY_AUDIT' WHEN id % 30 = 1 THEN 'ODD' END AS hint, {_PATTERN_HITS} FROM t)
SELECT id, CASE WHEN hint = 'ENERGY_AUDIT' THEN hint ELSE {_first(TYPE_PATTERNS, 'UNKNOWN')} END AS type,
(CASE WHEN hint = 'ENERGY_AUDIT' THEN 0.99 WHEN greatest({', '.join(TYPE_PATTERNS)}) = 0 THEN 0 ELSE round(least(0.95, 0.40 + 0.18 * greatest({', '.join(TYPE_PATTERNS)})), 4) END)::DOUBLE AS confidence FROM h""")
def heuristic_type(o: DataFrame) -> DataFrame:
    """The type of each order's document by patterns; some come with the hint of who has sent it."""
    hint = F.when(F.col("id") % 30 == 0, "energy_audit").when(F.col("id") % 30 == 1, "odd")
    kind, confidence = document_type(F.col("text"), hint)
    return bills(o).select("id", kind.alias("type"), confidence.alias("confidence"))


# --- labels with values ------------------------------------------------------------------------------------------------


def energy_of(line: Column) -> Column:
    """The first energy that a line names as a word of its own."""
    up, kind = F.upper(line), None
    for e in ENERGIES:
        kind = (F if kind is None else kind).when(up.rlike(rf"\b{e}\b"), e)
    return kind


def metered(line: Column, least: int) -> Column:
    """Whether a line names an energy, by one pattern for all, and has so many numbers."""
    return F.upper(line).rlike(rf"\b(?:{'|'.join(ENERGIES)})\b") & (F.regexp_count(line, F.lit(NUMBER)) >= least)


def meter_rows(lines: DataFrame) -> DataFrame:
    """``id, line, energy, numbers`` of (id, line, text): lines that name an energy and have two numbers and more."""
    numbers = F.transform(F.regexp_extract_all("text", F.lit(NUMBER), F.lit(0)), lambda s: F.replace(s, F.lit(",")).cast("double"))
    return lines.where(metered(F.col("text"), 2)).select("id", "line", energy_of(F.col("text")).alias("energy"), numbers.alias("numbers"))


def cells(text: Column) -> Column:
    """What two spaces and more, or tabs, part."""
    return F.filter(F.transform(F.split(stripped(text), r"\s{2,}|\t"), lambda c: stripped(c)), lambda c: c != "")


def like_value(c: Column) -> Column:
    return c.rlike(DAY) | F.replace(c, F.lit(" ")).rlike(f"^(?:{NUMBER})$") | ((F.length(c) <= 30) & c.rlike(r"\d") & ~c.rlike(r"\s{2,}"))


def text_lines(texts: DataFrame) -> DataFrame:
    """``id, line, text`` of (id, text): trimmed lines that are not empty and no comment, from 0."""
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    # trimmed before they are parted, or each later use of a line would trim it again
    x = texts.select("id", F.posexplode(F.transform(lines, stripped)).alias("line", "text"))
    return x.where((F.col("text") != "") & ~F.startswith("text", F.lit("#")))


def labels_with_values(texts: DataFrame) -> DataFrame:
    """``id, line, way, key, value`` of (id, text), the rows of ``harvest`` before aliases are asked. Lines are looked at once, by plain patterns before others, and written."""
    text, apart, tail = F.col("text"), r"\s{2}|\t", r"^(.*?)(-?\d[\d,]*\.?\d*)\s*$"
    x = text_lines(texts).where(~metered(text, 3))
    at = F.locate(":", text)
    rest = stripped(F.substring(text, at + 1, F.length(text)))
    x = x.select(
        "id", "line", F.when(at > 0, stripped(F.substring(text, F.lit(1), at - 1))).alias("k1"), F.when(at > 0, F.when(rest.rlike(apart), F.get(cells(rest), F.lit(0))).otherwise(rest)).alias("v1"),
        F.when(text.rlike(apart), cells(text)).alias("c"), *(F.when(text.rlike(r"[\d,.]\s*$"), F.regexp_extract(text, tail, k)).alias(c) for k, c in ((1, "k3"), (2, "v3"))),
    )
    x = written(x, "lines")
    one = x.where((F.col("k1") != "") & (F.col("v1") != "")).select("id", "line", F.lit(1).alias("way"), F.col("k1").alias("key"), F.col("v1").alias("value"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.struct(F.get("c", i).alias("key"), F.get("c", i + 1).alias("value")))
    two = x.where(F.size("c") > 1).select("id", "line", F.lit(2).alias("way"), F.inline(pairs)).where(like_value(F.col("value")))
    three = x.where(F.col("v3") != "").select("id", "line", F.lit(3).alias("way"), stripped(F.col("k3")).alias("key"), F.col("v3").alias("value"))
    return one.union(two).union(three)


def harvest(texts: DataFrame, aliases: DataFrame, least: float = 0.6) -> DataFrame:
    """``id, line, way, key, value`` of (id, text): what a colon parts, cells beside a cell that an alias names, and a number behind a label that one names.

    ``way`` is 1, 2 or 3; lines of meters give none of them.
    """
    found = labels_with_values(texts)
    asked = found.where(F.col("way") > 1)
    known = scored_alias(asked.select(F.col("key").alias("label")).distinct(), aliases).where(F.col("score") >= least).select(F.col("label").alias("key"))
    return found.where(F.col("way") == 1).union(asked.join(known, "key", "left_semi").select("id", "line", "way", "key", "value"))


def alias_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, a, key) for k, (a, key) in enumerate(ALIASES)], "place int, alias string, key string")


_ALIAS_SQL = "a AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a!r}, {key!r})" for k, (a, key) in enumerate(ALIASES)) + ") t(place, alias, key))"
_LINES = "l AS (SELECT id, line, trim(t) AS text FROM (SELECT id, unnest(range(len(string_split(text, chr(10)))))::INT AS line, unnest(string_split(text, chr(10))) AS t FROM t) WHERE trim(t) <> '')"
_ENERGY = "CASE " + " ".join(f"WHEN regexp_matches(upper(text), '\\b{e}\\b') THEN '{e}'" for e in ENERGIES) + " END"
_HARVEST = f"""{_BILLS}, {_TEXT_SQL}, {_ALIAS_SQL}, {_LINES}, m AS (SELECT * FROM l WHERE NOT coalesce({_ENERGY} IS NOT NULL AND len(regexp_extract_all(text, '{NUMBER}')) >= 3, false)),
one AS (SELECT id, line, 1 AS way, trim(split_part(text, ':', 1)) AS key, trim(regexp_split_to_array(trim(substr(text, strpos(text, ':') + 1)), '\\s{{2,}}|\\t')[1]) AS value FROM m WHERE contains(text, ':')),
c AS (SELECT id, line, list_filter(regexp_split_to_array(text, '\\s{{2,}}|\\t'), lambda x: trim(x) <> '') AS c FROM m),
two AS (SELECT id, line, 2 AS way, trim(c[i]) AS key, trim(c[i + 1]) AS value FROM (SELECT id, line, c, unnest(range(1, len(c))) AS i FROM c WHERE len(c) > 1) WHERE regexp_matches(c[i + 1], '\\d') AND length(trim(c[i + 1])) <= 30),
three AS (SELECT id, line, 3 AS way, trim(regexp_extract(text, '^(.*?)(-?\\d[\\d,]*\\.?\\d*)\\s*$', 1)) AS key, regexp_extract(text, '^(.*?)(-?\\d[\\d,]*\\.?\\d*)\\s*$', 2) AS value FROM m WHERE regexp_matches(text, '^(.*?)(-?\\d[\\d,]*\\.?\\d*)\\s*$')),
asked AS (SELECT * FROM two UNION ALL SELECT * FROM three), k AS (SELECT DISTINCT lower(trim(x.key)) AS low FROM (SELECT key FROM asked UNION SELECT key FROM one) x WHERE trim(x.key) <> ''),
r AS (SELECT low, arg_max(key, (low = alias, length(alias), -place)) AS canonical, CASE WHEN bool_or(low = alias) THEN 1.0 ELSE 0.85 END AS score FROM k JOIN a ON low = alias OR (length(alias) >= 4 AND (contains(low, alias) OR contains(alias, low))) GROUP BY 1),
kv AS (SELECT * FROM one WHERE key <> '' AND value <> '' UNION ALL SELECT asked.* FROM asked SEMI JOIN r ON lower(trim(asked.key)) = low)"""


@query("doc11", "orders", sql=f"WITH {_HARVEST} SELECT id, line, way, key, value FROM kv UNION ALL SELECT id, line, 0, {_ENERGY}, array_to_string(list_transform(regexp_extract_all(text, '{NUMBER}'), lambda n: replace(n, ',', '')::DOUBLE::BIGINT::VARCHAR), ' ') FROM l WHERE {_ENERGY} IS NOT NULL AND len(regexp_extract_all(text, '{NUMBER}')) >= 2")
def key_values(o: DataFrame) -> DataFrame:
    """Labels with values of each order's document, and its metered lines (way 0)."""
    texts = bills(o).select("id", "text")
    meters = meter_rows(text_lines(texts)).select("id", "line", F.lit(0).alias("way"), F.col("energy").alias("key"), F.array_join(F.transform("numbers", lambda n: n.cast("long").cast("string")), " ").alias("value"))
    return harvest(texts, alias_frame(o)).union(meters)


def parsed_value(raw: Column) -> tuple[Column, Column]:
    """(number, unit) of a value; the number is null unless it makes up the cell."""
    low = F.lower(raw)
    unit = None
    for u in VALUE_UNITS:
        unit = (F if unit is None else unit).when(F.contains(low, F.lit(u)), u.replace("m³", "m3"))
    plain = F.replace(low, F.lit(","))
    return F.when(plain.rlike(r"^-?\d[\d,]*\.?\d*\s*[a-z₹/]*$"), F.regexp_extract(plain, NUMBER, 0).try_cast("double")), unit


def mapped(texts: DataFrame, aliases: DataFrame, least: float = 0.6) -> DataFrame:
    """``id, canonical, value, unit, sign, confidence`` of (id, text): of each label's canonical name the first value that ``harvest`` finds in a document; codes that reduce a bill have a negative sign."""
    found = labels_with_values(texts)
    known = scored_alias(found.select(F.col("key").alias("label")).distinct(), aliases).select("label", F.col("key").alias("canonical"), "score")
    x = found.join(known, F.col("key") == F.col("label")).where((F.col("way") == 1) | (F.col("score") >= least))
    first = x.groupBy("id", "canonical").agg(F.min_by(F.struct("value", "score"), F.struct("line", "way")).alias("f"))
    first = first.select("id", "canonical", stripped(F.regexp_replace(F.regexp_replace("f.value", r"^[\s:;|*★·.\-]+", ""), r"\s+", " ")).alias("raw"), "f.score")
    number, unit = parsed_value(F.col("raw"))
    sign = F.when(F.col("canonical").isin(*NEGATIVE), -1).otherwise(1)
    return first.select("id", "canonical", "raw", number.alias("value"), unit.alias("unit"), sign.alias("sign"), F.round(0.7 + 0.3 * F.col("score"), 3).alias("confidence"))


_UNIT_OF = "CASE " + " ".join(f"WHEN contains(lower(v), '{u}') THEN '{u.replace('m³', 'm3')}'" for u in VALUE_UNITS) + " END"


@query("doc13", "orders", sql=f"""WITH {_HARVEST}, f AS (SELECT id, canonical, arg_min(value, (line, way)) AS v, arg_min(score, (line, way)) AS score FROM kv JOIN r ON lower(trim(kv.key)) = low GROUP BY 1, 2)
SELECT id, canonical, v AS raw, CASE WHEN regexp_matches(replace(lower(v), ',', ''), '^-?\\d[\\d,]*\\.?\\d*\\s*[a-z₹/]*$') THEN try_cast(regexp_extract(replace(v, ',', ''), '{NUMBER}') AS DOUBLE) END AS value, {_UNIT_OF} AS unit, 1 AS sign, round(0.7 + 0.3 * score, 3)::DOUBLE AS confidence FROM f""")
def universal_document(o: DataFrame) -> DataFrame:
    """The first value of each canonical label on each order's document."""
    return mapped(bills(o).select("id", "text"), alias_frame(o))


# --- periods -----------------------------------------------------------------------------------------------------------


def bill_period(text: Column) -> tuple[Column, Column]:
    """(start, end): days by their months' names, then months, then a fiscal year from April on; the first that is found and is one.

    Without a second day or month the period ends with the first; a name that is
    no month's stands for January.
    """
    lead = r"(?i)\b(?:period|billing period|month|from)\s*[:\-]?\s*"
    day, month = r"(\d{1,2})\s*[\-/\s]\s*([A-Za-z]+)\s*[\-/\s]\s*(\d{2,4})", r"([A-Za-z]+)\s+(\d{4})"
    p1, p2, p3 = lead + day + rf"(?:\s*(?:to|-)\s*{day})?", lead + month + rf"(?:\s*(?:to|-)\s*{month})?", r"(?i)\bFY\s*(\d{2,4})\s*[-/]\s*(\d{2,4})\b"
    g = lambda p, k: F.regexp_extract(text, p, k)
    year = lambda c: F.when(F.length(c) <= 2, c.try_cast("int") + 2000).otherwise(c.try_cast("int"))
    names = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
    number = lambda c: F.greatest(F.array_position(F.lit(list(names)), F.substring(F.lower(c), 1, 3)), F.lit(1)).cast("int")
    date = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    day1 = date(year(g(p1, 3)), number(g(p1, 2)), g(p1, 1).try_cast("int"))
    day2 = F.when(g(p1, 4) != "", date(year(g(p1, 6)), number(g(p1, 5)), g(p1, 4).try_cast("int"))).otherwise(day1)
    month1 = date(year(g(p2, 2)), number(g(p2, 1)), F.lit(1))
    month2 = F.last_day(F.when(g(p2, 3) != "", date(year(g(p2, 4)), number(g(p2, 3)), F.lit(1))).otherwise(month1))
    fy1, fy2 = date(year(g(p3, 1)), F.lit(4), F.lit(1)), date(year(g(p3, 2)), F.lit(3), F.lit(31))
    both = F.coalesce(*[F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b"))) for a, b in ((day1, day2), (month1, month2), (fy1, fy2))])
    return both["a"], both["b"]


@query("sc_d11", "orders", sql=f"""WITH {_BILLS} SELECT id, CASE WHEN id % 4 = 0 THEN strftime(date_trunc('month', day), '%Y-%m-%d') WHEN id % 4 = 1 AND c % 2 = 0 THEN strftime(day, '%Y-%m-%d') WHEN id % 4 = 3 THEN strftime(make_date(year(day), 4, 1), '%Y-%m-%d') END AS start,
CASE WHEN id % 4 = 0 THEN strftime(last_day(day), '%Y-%m-%d') WHEN id % 4 = 1 AND c % 2 = 0 THEN strftime(day + 29, '%Y-%m-%d') WHEN id % 4 = 3 THEN strftime(make_date(year(day) + 1, 3, 31), '%Y-%m-%d') END AS "end" FROM b""")
def bill_periods(o: DataFrame) -> DataFrame:
    """The period of each order's document."""
    start, end = bill_period(F.col("text"))
    return bills(o).select("id", start.cast("string").alias("start"), end.cast("string").alias("end"))


# --- headers of two rows -----------------------------------------------------------------------------------------------


def like_header(row: Column) -> Column:
    """A row of which something is told and fewer than a fifth of that holds a number."""
    some = F.filter(row, lambda c: F.trim(c) != "")
    return (F.size(some) > 0) & (F.size(F.filter(some, lambda c: c.rlike(r"\d"))) < 0.2 * F.size(some))


def merged_header(header: Column, first: Column) -> Column:
    """A header with the row below it, cell by cell, where that is a header too."""
    both = F.zip_with(header, first, lambda a, b: F.trim(F.concat_ws(" ", a, b)))
    return F.when(F.coalesce(like_header(first), F.lit(False)), both).otherwise(header)


_ROW = "list_filter(string_split(string_split(text, chr(10))[{}], ' '), lambda x: true)"


@query("wn11", "documents", sql=f"""WITH r AS (SELECT doc_id, {_ROW.format(1)} AS h, {_ROW.format(2)} AS f FROM documents WHERE contains(text, chr(10))), x AS (SELECT *, list_filter(f, lambda c: trim(c) <> '') AS told FROM r),
y AS (SELECT *, len(told) > 0 AND len(list_filter(told, lambda c: regexp_matches(c, '\\d'))) < 0.2 * len(told) AS continues FROM x)
SELECT doc_id, continues, md5(array_to_string(CASE WHEN continues THEN list_transform(range(1, greatest(len(h), len(f)) + 1), lambda i: trim(concat_ws(' ', h[i], f[i]))) ELSE h END, '|')) AS header FROM y""")
def headers_of_two_rows(d: DataFrame) -> DataFrame:
    """The words of a document's first line as a header, with those of the second where it goes on."""
    row = lambda k: F.split(F.get(F.split("text", "\n"), F.lit(k)), " ")
    x = d.where(F.contains("text", F.lit("\n"))).select("doc_id", row(0).alias("h"), row(1).alias("f"))
    return x.select("doc_id", like_header(F.col("f")).alias("continues"), F.md5(F.array_join(merged_header(F.col("h"), F.col("f")), "|")).alias("header"))


# --- fields in the units of their keys, the surest of each ---------------------------------------------------------------

#: Units of keys and bounds of their values.
TARGETS = (("electricity_kwh", "kwh", 0.0, 40_000.0), ("diesel_l", "l", 0.0, 1e9), ("water_kl", "m3", 0.01, 45.0), ("waste_t", "t", 0.0, 1e9))
SOURCES = ("kwh", "mwh", "", "kg", "t", "l", "parsec", "gj")


def normalised(fields: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each document, key and period (id, value, unit): values in the unit of their key, inside its bounds, the surest, then one that came with a unit, then the first.

    ``fields`` is (document_id, key, period, id, value, unit, confidence, total),
    ``targets`` (key, target, low, high).  A unit that is missing or unknown is
    taken for the key's own; a unit of another family keeps value and unit; a key
    without a target keeps both.  Totals are told apart, keys without a value go.
    """
    x = fields.where(F.col("value").isNotNull()).join(F.broadcast(targets), "key", "left")
    x = converted(x, "value", "unit", "target")
    own = F.coalesce(F.trim("unit"), F.lit("")) != ""
    foreign = F.col("problem") == "other family"
    x = x.withColumns({"v": F.when(F.col("target").isNull() | F.col("problem").isNotNull(), F.col("value")).otherwise(F.col("converted")), "u": F.when(F.col("target").isNull() | foreign, F.when(own, F.lower(F.trim("unit")))).otherwise(F.col("target"))})
    x = x.where((F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high"))))
    by = ["document_id", "key", F.when(F.col("total"), "_TOTAL").otherwise(F.col("period")).alias("period")]
    best = x.groupBy(*by).agg(F.min_by(F.struct("id", "v", "u"), F.struct((-F.col("confidence")).alias("c"), F.col("u").isNull().alias("n"), "id")).alias("b"))
    return best.select("document_id", "key", "period", "b.id", F.col("b.v").alias("value"), F.col("b.u").alias("unit"))


@query("doc15", "extraction_field", sql=f"""WITH t AS (SELECT * FROM (VALUES {', '.join(f"({k!r}, {u!r}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, u, a, b in TARGETS)}) t(key, target, low, high)), u AS {UNIT_SQL},
x AS (SELECT document_id, canonical_key AS key, year(created_at)::VARCHAR AS period, id, value_num AS value, {list(SOURCES)!r}[(value_num::BIGINT % {len(SOURCES)} + 1)::INT] AS unit, confidence, value_text = 'R' AS total FROM extraction_field),
y AS (SELECT x.*, target, low, high, a.family AS fa, b.family AS fb, a.k AS ka, b.k AS kb FROM x LEFT JOIN t USING (key) LEFT JOIN u a ON x.unit = a.unit LEFT JOIN u b ON t.target = b.unit),
z AS (SELECT *, CASE WHEN target IS NOT NULL AND fa = fb THEN value * ka / kb ELSE value END AS v, CASE WHEN target IS NULL OR fa <> fb THEN nullif(unit, '') ELSE target END AS un FROM y)
SELECT document_id, key, CASE WHEN coalesce(total, false) THEN '_TOTAL' ELSE period END AS period, arg_min(id, (-confidence, un IS NULL, id)) AS id, round(arg_min(v, (-confidence, un IS NULL, id)), 6) AS value, arg_min(coalesce(un, ''), (-confidence, un IS NULL, id)) AS unit
FROM z WHERE (low IS NULL OR v >= low) AND (high IS NULL OR v <= high) GROUP BY 1, 2, 3""")
def merged_fields(f: DataFrame) -> DataFrame:
    """Extracted fields, with units by their values, in the units of their keys."""
    unit = F.element_at(F.lit(list(SOURCES)), (F.col("value_num").cast("long") % len(SOURCES) + 1).cast("int"))
    rows = f.select("document_id", F.col("canonical_key").alias("key"), F.year("created_at").cast("string").alias("period"), "id", F.col("value_num").alias("value"), unit.alias("unit"), "confidence", F.coalesce(F.col("value_text") == "R", F.lit(False)).alias("total"))
    targets = f.sparkSession.createDataFrame(list(TARGETS), "key string, target string, low double, high double")
    return normalised(rows, targets).withColumns({"value": F.round("value", 6), "unit": F.coalesce("unit", F.lit(""))})
