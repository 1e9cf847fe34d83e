"""Operator 11: fill-in-middle arrangements of whole texts, in Spark SQL functions only.

``regexp_extract_all`` gives the array of a text's units, two numbers out of
the digest of its id cut it, ``slice`` and ``array_join`` build the three parts,
and the order of the sentinels tells how to put a text together again.  There
is no shuffle and no Python: a row needs nothing but itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A unit is a code point.
UNIT = "(?s)."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents as many are arranged, and of a hundred arranged ones as many begin with the suffix.
ARRANGED, SUFFIX_FIRST = 90, 20
SEED = "1:"


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 out of the digest of ``seed`` and the id; a null id has an empty name."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def has_sentinel(text: Column) -> Column:
    return F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))


def arranged(docs: DataFrame, unit: str = UNIT, percent: int = ARRANGED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """``doc_id, text, n, form, prefix_units, middle_units, output`` of every row.

    ``form`` is ``psm``, ``spm`` or ``plain``; plain are empty texts, texts that
    hold a sentinel, and those that the draw leaves as they are (``output`` is
    the text, both lengths are null).  ``unit`` is a pattern whose matches, one
    after the other, are the whole text.  A null text is empty; repeated rows
    return as they are, each arranged alike; rows with a null id are arranged by
    the draw of an empty name; an empty table gives an empty one; other columns
    are dropped, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    x = x.withColumns({f"h{k + 1}": h for k, h in enumerate(draws(F.col("doc_id"), seed))})
    plain = (F.col("text") == "") | has_sentinel(F.col("text")) | (F.col("h3") % 100 >= percent)
    x = x.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"))
    x = x.withColumn("units", F.regexp_extract_all("text", F.lit(unit), F.lit(0)))
    x = x.withColumn("n", F.size("units"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    x = x.withColumns({"first": F.least(*cuts).cast("int"), "last": F.greatest(*cuts).cast("int")})
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    one = F.lit(1)
    x = x.withColumns({"prefix": part(one, F.col("first")), "middle": part(F.col("first") + 1, F.col("last") - F.col("first")), "suffix": part(F.col("last") + 1, F.col("n") - F.col("last"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    told = lambda c: F.when(F.col("form") != "plain", c).cast("long")
    return x.select("doc_id", "text", F.col("n").cast("long").alias("n"), "form", told(F.col("first")).alias("prefix_units"), told(F.col("last") - F.col("first")).alias("middle_units"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: what lies between the sentinels in the order that the form tells; null where they are not there in that order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda k: F.get(parts, F.lit(k))
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    sound = F.startswith(output, first) & (F.size(parts) == 4) & (output == F.concat(first, at(1), second, at(2), F.lit(MIDDLE), at(3)))
    text = F.when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
    return F.when(form == "plain", output).when(sound, text)


def fill_in_middle(docs: DataFrame, unit: str = UNIT, percent: int = ARRANGED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """``arranged`` with ``restored``, the text as sentinel parsing gives it back from ``output`` and ``form``."""
    x = arranged(docs, unit, percent, suffix_first, seed)
    return x.withColumn("restored", restored(F.col("output"), F.col("form")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fill_in_middle(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256(concat('1:', doc_id)) AS h FROM documents
), c AS (
  SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT % (length(text) + 1) AS a, ('0x' || h[9:16])::BIGINT % (length(text) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, least(a, b) AS i, greatest(a, b) - least(a, b) AS m, substr(text, 1, least(a, b)) AS prefix,
         substr(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substr(text, greatest(a, b) + 1) AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN m END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
