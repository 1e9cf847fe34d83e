"""Many patterns in one pass: labels and whole texts against tables of aliases and keywords by an Aho-Corasick automaton.

A table of patterns is cut into slices of bounded size; each is sent to the
executors once, where a worker builds the automaton and reads every text in one
go, whatever the number of patterns.  Labels are made distinct first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.scratch import scratch_path

#: Patterns that one broadcast holds at most; longer tables are read in several passes.
SLICE = 200_000


@lru_cache(maxsize=4)
def automaton(words: tuple[str, ...]):
    """The automaton of different words; a match tells the word's place in the list."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, w in enumerate(words):
        found.add_word(w, k)
    found.make_automaton()
    return found


def slices(patterns: DataFrame, column: str, most: int = SLICE) -> Iterator[list[str]]:
    """The different patterns that are not empty, so many at a time at most."""
    words = patterns.select(F.col(column).alias("w")).where(F.length("w") > 0).distinct()
    n = words.count()
    parts = max(1, -(-2 * n // most)) if n > most else 1  # hashed slices differ a little in size
    for k in range(parts):
        yield sorted(r["w"] for r in words.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == k).collect())


def occurrences(texts: DataFrame, id_column: str, text: str, patterns: DataFrame, column: str, most: int = SLICE) -> DataFrame:
    """``id, pattern, n``: how often each pattern is inside each text, overlaps included; both as they are written.

    A null text holds nothing, an empty pattern is none.  Texts are never cut.
    """
    spark, found = texts.sparkSession, None
    kind = texts.select(F.col(id_column).alias("id")).schema["id"]
    for words in slices(patterns, column, most):
        if not words:
            continue
        sent = spark.sparkContext.broadcast(tuple(words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            a = automaton(sent.value)
            for b in batches:
                at, which, n = [], [], []
                for i, t in enumerate(b["text"]):
                    hits: dict[int, int] = {}
                    for _, k in a.iter(t.as_py()) if t.is_valid else ():
                        hits[k] = hits.get(k, 0) + 1
                    at += [i] * len(hits)
                    which += [sent.value[k] for k in hits]
                    n += hits.values()
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at, pa.int64())), pa.array(which, pa.string()), pa.array(n, pa.int64())], ["id", "pattern", "n"])

        x = texts.select(F.col(id_column).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind.dataType.simpleString()}, pattern string, n long")
        found = x if found is None else found.union(x)
    return found if found is not None else spark.createDataFrame([], f"id {kind.dataType.simpleString()}, pattern string, n long")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written: a table whose size is known, so that Spark sends one that is small to the rows that join it.

    Otherwise rows would be sorted by their label, and a common label's rows all lie in one task.
    """
    df.write.parquet(path := scratch_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alias_table(aliases: DataFrame) -> DataFrame:
    """``alias, key, place`` of (alias, key, place): a repeated alias keeps its first place and takes its last key."""
    low = aliases.select(F.lower(F.trim("alias")).alias("alias"), "key", "place").where(F.length("alias") > 0)
    return low.groupBy("alias").agg(F.max_by("key", F.struct("place", "key")).alias("key"), F.min("place").alias("place"))


def longest_alias(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """``label, alias, key`` of the labels that are an alias, or hold one: the longest, of equally long ones the first (at one place: the last by name).

    ``labels`` has different labels, ``aliases`` (alias, key, place).  An exact
    alias is the longest inside its label, so one rule tells both.
    """
    table = written(alias_table(aliases), "aliases")
    low = written(labels.select("label", F.lower(F.trim("label")).alias("low")), "labels")  # read for the texts and for the rows
    texts = low.select("low").distinct()
    hits = occurrences(texts, "low", "low", table, "alias").join(table, F.col("pattern") == F.col("alias"))
    best = hits.groupBy("id").agg(F.max_by(F.struct("alias", "key"), F.struct(F.length("alias"), -F.col("place"), "alias")).alias("best"))
    return written(low.join(best, F.col("low") == F.col("id")).select("label", "best.alias", "best.key"), "labels-with-aliases")


def substrings(c: Column, least: int = 1) -> Column:
    """All different parts of a string, of so many characters at least."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: F.substring(c, i, n))))
    return F.array_distinct(F.filter(parts, lambda s: F.length(s) >= least))


def scored_alias(labels: DataFrame, aliases: DataFrame, least: int = 4, held: float = 0.85) -> DataFrame:
    """``label, alias, key, score``: 1 for an exact alias, else ``held`` for the longest alias that holds the label or that the label holds.

    Aliases inside labels come from the automaton, labels inside aliases from an
    equi-join with the aliases' parts, so neither way compares all with all.
    Exact aliases may be short, others have ``least`` characters; of equally long
    ones the first counts.
    """
    table = written(alias_table(aliases), "aliases")
    # written, as both ways read them
    low = written(labels.select("label", F.lower(F.trim("label")).alias("low")).where(F.length("low") > 0), "labels")
    some = low.select("low").distinct()
    inside = occurrences(some, "low", "low", table, "alias").select(F.col("id").alias("low"), F.col("pattern").alias("alias"))
    parts = table.where(F.length("alias") >= least).select("alias", F.explode(substrings(F.col("alias"))).alias("part"))
    around = parts.join(some, F.col("part") == F.col("low")).select("low", "alias")
    hits = inside.union(around).join(table, "alias")
    exact = F.col("low") == F.col("alias")
    best = hits.where(exact | (F.length("alias") >= least)).groupBy("low").agg(F.max_by(F.struct("alias", "key", exact.alias("exact")), F.struct(exact, F.length("alias"), -F.col("place"), "alias")).alias("b"))
    return written(low.join(best, "low").select("label", "b.alias", "b.key", F.when(F.col("b.exact"), 1.0).otherwise(held).alias("score")), "scored-labels")


# --- queries: aliases out of the benchmark's passages, labels and texts out of the documents ------------------------


def passages(b: DataFrame) -> DataFrame:
    """Aliases (alias, key, place): words and pairs of words of every passage, whose key they stand for."""
    w = F.filter(F.split(F.lower("text"), r"[^\pL\pN]+"), lambda x: F.length(x) > 0)
    x = b.select("item_id", w.alias("w"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    both = F.array_distinct(F.concat(F.filter("w", lambda s: F.length(s) >= 7), pairs))
    return x.select(both.alias("alias"), F.concat(F.lit("m"), "item_id").alias("key"), F.col("item_id").alias("place")).select(F.explode("alias").alias("alias"), "key", "place")


_PASSAGES = r"""w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: length(x) > 0) AS w FROM benchmark),
u AS (SELECT DISTINCT item_id, unnest(list_concat(list_filter(w, lambda s: length(s) >= 7), list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: concat_ws(' ', w[i], w[i + 1])))) AS alias FROM w),
a AS (SELECT alias, arg_max(concat('m', item_id), (item_id, concat('m', item_id))) AS key, min(item_id) AS place FROM u GROUP BY 1)"""


def headings(d: DataFrame) -> DataFrame:
    """The words of a document's last line as a label, and for every third document a pair of them."""
    words = F.split(F.lower(F.trim(F.element_at(F.split("text", "\n"), -1))), r"[^\pL\pN]+")
    some = F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(2)))).otherwise(F.concat_ws(" ", words))
    return d.select("doc_id", some.alias("label"))


_HEADINGS = r"""h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', l[2], l[3]) ELSE array_to_string(l, ' ') END AS label
FROM (SELECT doc_id, regexp_split_to_array(lower(trim(string_split(text, chr(10))[-1])), '[^\pL\pN]+') AS l FROM documents))"""


@query("jn16", "documents", "benchmark", sql=f"WITH {_PASSAGES}, {_HEADINGS}, d AS (SELECT DISTINCT label, trim(label) AS low FROM h), b AS (SELECT label, arg_max(key, (length(alias), -place, alias)) AS key FROM d JOIN a ON contains(low, alias) GROUP BY 1) SELECT doc_id, key FROM h LEFT JOIN b USING (label)")
def label_keys(d: DataFrame, b: DataFrame) -> DataFrame:
    """The key of the longest alias in a document's heading."""
    rows = headings(d)
    return rows.join(longest_alias(rows.select("label").distinct(), passages(b)), "label", "left").select("doc_id", "key")


@query("jn17", "documents", "benchmark", sql=f"""WITH {_PASSAGES}, {_HEADINGS}, d AS (SELECT DISTINCT label, trim(label) AS low FROM h WHERE trim(label) <> ''),
x AS (SELECT label, key, low = alias AS exact, length(alias) AS n, place, alias FROM d JOIN a ON low = alias OR (length(alias) >= 4 AND (contains(low, alias) OR contains(alias, low))))
SELECT label, arg_max(key, (exact, n, -place, alias)) AS key, CASE WHEN bool_or(exact) THEN 1.0 ELSE 0.85 END::DOUBLE AS score FROM x GROUP BY 1""")
def label_scores(d: DataFrame, b: DataFrame) -> DataFrame:
    """1 for an exact label, 0.85 where one holds the other."""
    return scored_alias(headings(d).select("label").distinct(), passages(b)).select("label", "key", "score")


# Signals of document types with their weights; types in the order that ties go by.
DOC_TYPES: dict[str, tuple[tuple[str, float], ...]] = {
    "ELECTRICITY_BILL": (
        ("electricity bill", 1.0), ("energy bill", 0.8), ("िवदुत बीजक", 1.0), ("vidyut vitran", 0.8), ("units consumed", 0.6), ("kwh", 0.4), ("kvah", 0.5), ("net billed unit", 0.7), ("sanction load", 0.5),
        ("tariff", 0.3), ("discom", 0.4), ("energy charges", 0.5), ("energy charge", 0.5), ("electricity distribution", 0.7), ("distribution company", 0.5), ("connected load", 0.4), ("consumerid", 0.5),
        ("billed demand", 0.4), ("electricity duty", 0.5), ("वीज आकार", 0.6), ("ग्राहक क्रमांक", 0.5), ("देयक रक्कम", 0.5), ("रिडिंग", 0.4), ("मंजुर भार", 0.4), ("महावितरण", 0.7),
    ),
    "SOLAR_NET_METERING": (("net metering", 1.0), ("grid export", 0.8), ("export units", 0.7), ("surplus solar units", 0.9), ("solar pv capacity", 0.6), ("banked units", 0.7), ("net meter", 0.8)),
    "SOLAR_GROSS_METERING": (("gross metering", 1.0), ("gross meter", 0.9), ("generation meter", 0.7), ("solar generated", 0.7), ("feed-in tariff", 0.8)),
    "WIND_ENERGY": (("wind energy", 1.0), ("wind generation", 0.9), ("wtg", 0.6), ("wind statement", 0.9), ("wind mill", 0.7)),
    "OPEN_ACCESS": (("open access", 1.0), ("oa charges", 0.7), ("wheeling charges", 0.6), ("cross subsidy surcharge", 0.7), ("scheduled energy", 0.6), ("drawl", 0.5), ("injection", 0.5)),
    "GROUP_CAPTIVE": (("group captive", 1.0), ("captive consumer", 0.8), ("captive generating", 0.8), ("26% equity", 0.6)),
    "REC_CERTIFICATE": (("renewable energy certificate", 1.0), ("rec", 0.5), ("redemption", 0.5), ("issuance", 0.4), ("vintage", 0.5)),
    "DIESEL_BILL": (("high speed diesel", 1.0), ("hsd", 0.7), ("diesel", 0.8), ("furnace oil", 0.7), ("bpcl", 0.5), ("hpcl", 0.5), ("iocl", 0.5), ("litres", 0.4)),
    "PNG_BILL": (("natural gas", 0.9), ("png", 0.8), ("scm", 0.6), ("mahanagar gas", 0.7), ("indraprastha gas", 0.7), ("gail", 0.6)),
    "WATER_BILL": (("water bill", 1.0), ("water charges", 0.7), ("cubic metre", 0.6), ("kilolitre", 0.6), ("jal board", 0.7), ("water supply", 0.6)),
}
#: A type that is known has this score at least; what is full, what is known, what is unknown.
FULL, LEAST, UNKNOWN, HINTED, MOST = 2.5, 0.4, 0.2, 0.6, 0.99


def signal_rows(spark: SparkSession, types: dict = DOC_TYPES) -> DataFrame:
    rows = [(t, k, s, w) for k, (t, signals) in enumerate(types.items()) for s, w in signals]
    return spark.createDataFrame(rows, "type string, place int, signal string, weight double")


def document_types(texts: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """``id, type, score`` of (id, text) or (id, text, hint): the type whose signals weigh most, the first among equals, ``UNKNOWN`` below the threshold.

    A ``hint`` that names a type wins and is scored at least ``HINTED``.  All
    signals of all types are looked for in one pass over each text.
    """
    signals = signals if signals is not None else signal_rows(texts.sparkSession)
    hinted = F.upper("hint") if "hint" in texts.columns else F.lit(None).cast("string")
    low = texts.select("id", F.lower("text").alias("text"), hinted.alias("hint"))
    hits = occurrences(low, "id", "text", signals, "signal").join(F.broadcast(signals), F.col("pattern") == F.col("signal"))
    # sums of tenths are kept whole, so that their order does not tell
    scores = hits.groupBy("id", "type", "place").agg(F.least(F.lit(1.0), F.sum(F.round(F.col("weight") * 1000).cast("long")) / (1000 * FULL)).alias("score"))
    best = scores.groupBy("id").agg(F.max_by(F.struct("type", "score"), F.struct("score", -F.col("place"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("type", "score"))).alias("scores"))
    x = low.select("id", "hint").join(best, "id", "left").join(F.broadcast(signals.select(F.col("type").alias("hint"), F.lit(True).alias("told")).distinct()), "hint", "left")
    own = F.greatest(F.coalesce(F.try_element_at("scores", F.col("hint")), F.lit(0.0)), F.lit(HINTED))
    known = F.col("best.score") >= LEAST
    kind = F.when(F.col("told"), F.col("hint")).when(known, F.col("best.type")).otherwise("UNKNOWN")
    return x.select("id", kind.alias("type"), F.when(F.col("told"), own).when(known, F.round(F.least(F.lit(MOST), F.col("best.score")), 3)).otherwise(UNKNOWN).alias("score"))
