"""Operator 10: quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a column that is true where a document fails.  Cost and
selectivity of every rule are measured on a bounded sample; the cascade asks
the rules in the order of rejections per cost, and a document that fails one is
not asked further: features that later rules need are not worked out for it.
Counts that are returned for every document are there anyway, so rules over
them cost next to nothing.  The order changes the work, never the verdict.

Repeated 3-word windows are found inside a row: 64-bit hashes of the windows
are sorted, only windows with an equal neighbour are compared as text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
LETTER, BULLET, ELLIPSIS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]", r"^[\x20\x09-\x0D]*[-*•]", r"([.][.][.]|…)[\x20\x09-\x0D]*\z"
#: Rows that costs and selectivities are estimated on, and how often a cost is paid to be told from that of starting a job.
SAMPLE_ROWS, TIMES = 1_000, 4
#: Lines that a text must have for rules over shares of its lines.
LEAST_LINES = 3
#: Up to so many distinct repeated hashes, windows are looked up in their list; beyond, all windows are sorted. Both are exact.
FEW = 48


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_chars(text: Column, words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column, words: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")


def n_shouts(text: Column, words: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long")


def n_dup_lines(text: Column, words: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_letter_words(text: Column, words: Column) -> Column:
    """Words with a character that is no ASCII mark, digit or control character."""
    return F.size(F.filter(words, lambda x: x.rlike(LETTER))).cast("long")


def percent_of_lines(text: Column, pattern: str) -> Column:
    """Of the lines with a word, those that match; 0 for fewer lines than tell."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.when(F.size(x) < LEAST_LINES, 0).otherwise(F.floor(100 * F.size(F.filter(x, lambda y: y.rlike(pattern))) / F.size(x)))).cast("long")


def bullet_percent(text: Column, words: Column) -> Column:
    """Of the lines with a word, those that start with a bullet."""
    return percent_of_lines(text, BULLET)


def ellipsis_percent(text: Column, words: Column) -> Column:
    """Of the lines with a word, those that end with an ellipsis."""
    return percent_of_lines(text, ELLIPSIS)


def n_repeat_words(text: Column, words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the text, the first included."""
    places = F.sequence(F.lit(0), F.size(words) - 3)

    def window(i: Column, as_one: Callable[..., Column]) -> Column:
        return as_one(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))

    def covered(starts: Column) -> Column:
        widths = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    def exact(some: Column) -> Column:
        pairs = F.sort_array(F.transform(some, lambda i: F.struct(window(i, lambda *w: F.concat_ws(" ", *w)).alias("g"), i.alias("p"))))
        twice = let(pairs, lambda t: F.filter(t, lambda x, k: (x["g"] == F.get(t, k - 1)["g"]) | (x["g"] == F.get(t, k + 1)["g"])))
        return let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

    def found(hashes: Column) -> Column:
        repeated = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1))))
        some = lambda d: F.when(F.size(d) <= FEW, F.filter(places, lambda i: F.array_contains(d, F.get(hashes, i)))).otherwise(places)
        return let(repeated, lambda d: F.when(F.size(d) == 0, 0).otherwise(let(some(d), exact)))

    return F.when(F.size(words) < 4, 0).otherwise(let(F.transform(places, lambda i: window(i, F.xxhash64)), found)).cast("long")


#: What every document is told, and what only some rules ask for.
COUNTS = {"word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
FEATURES = {**COUNTS, "n_shouts": n_shouts, "n_letter_words": n_letter_words, "bullet_percent": bullet_percent, "ellipsis_percent": ellipsis_percent}


@dataclass(frozen=True)
class Rule:
    """``fails(n_words, feature)`` is true for a document to reject; ``base`` marks the contract's own rules."""

    name: str
    feature: str | None
    fails: Callable[[Column, Column | None], Column]
    base: bool = False


RULES = (
    Rule("few_words", None, lambda n, _: n < 50, True),
    Rule("repeated_words", "n_repeat_words", lambda n, x: 100 * x > 50 * n, True),
    Rule("symbols", "n_symbols", lambda n, x: 100 * x > 25 * n),
    Rule("shouting", "n_shouts", lambda n, x: 100 * x > 25 * n),
    Rule("short_words", "word_chars", lambda n, x: x < 2 * n),
    Rule("long_words", "word_chars", lambda n, x: x > 16 * n),
    Rule("few_letters", "n_letter_words", lambda n, x: 100 * x < 50 * n),
    Rule("bullets", "bullet_percent", lambda n, x: x > 90),
    Rule("ellipses", "ellipsis_percent", lambda n, x: x > 30),
    Rule("repeated_lines", "n_dup_lines", lambda n, x: (x >= 3) & (100 * x > 5 * n)),
)


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = (), rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a row) by falling rejections per second, measured on at most ``rows`` rows.

    Rows are drawn by a hash from the whole table.  A rule's cost is that of its
    feature beyond that of a job without one; features that are ``known``, and
    no feature, cost nothing.
    """
    n = docs.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select(text.alias("text"), F.xxhash64(*(["doc_id"] if "doc_id" in docs.columns else []), text).alias("h"))
    drawn = hashed.where(F.pmod("h", F.lit(1 << 20)) < (1 << 20) * min(1.0, 4 * rows / n)).orderBy("h").limit(rows)
    sample = drawn.select("text", words_of(F.col("text")).alias("words")).repartition(2).cache()
    n_words = F.size("words")
    feature = lambda name: FEATURES[name](F.col("text"), F.col("words"))
    many = sample.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def seconds(value: Column) -> float:
        began = time.perf_counter()
        many.agg(F.sum(value)).first()
        return time.perf_counter() - began

    try:
        hits = [F.count_if(r.fails(n_words, feature(r.feature) if r.feature else None)) for r in rules]
        seen, *hits = sample.agg(F.count("*"), *(h.alias(f"h{i}") for i, h in enumerate(hits))).first()
        start = seconds(n_words)
        cost = {name: max(0.0, seconds(feature(name)) - start) / max(seen * TIMES, 1) for name in dict.fromkeys(r.feature for r in rules) if name and name not in known}
    finally:
        sample.unpersist()
    found = [(r, h / max(seen, 1), cost.get(r.feature, 0.0)) for r, h in zip(rules, hits, strict=True)]
    return sorted(found, key=lambda x: (-x[1] / max(x[2], 1e-9), x[0].name))


def cascade(rules: list[Rule], n_words: Column, feature: Callable[[str], Column]) -> Column:
    """False at the first rule that fails, else true."""
    verdict = None
    for rule in rules:
        fails = rule.fails(n_words, feature(rule.feature) if rule.feature else None)
        verdict = (F if verdict is None else verdict).when(fails, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All counts and the verdict of each document, from whole texts.

    A null or empty text has no words: all counts 0, it fails.  Repeated rows
    and null ids return as they are, an empty table gives an empty one, other
    columns are dropped.
    """
    order = [r for r, _, _ in rule_order(docs, rules, tuple(COUNTS))]
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def told(words: Column) -> Column:
        counts = F.struct(F.size(words).cast("long").alias("n_words"), *(f(text, words).alias(k) for k, f in COUNTS.items()))
        return let(counts, lambda c: F.struct(c.alias("counts"), cascade(order, c["n_words"], lambda name: c[name] if name in COUNTS else FEATURES[name](text, words)).alias("kept")))

    out = rows.select("doc_id", let(words_of(text), told).alias("s")).select("doc_id", "s.counts.*", "s.kept")
    base = F.lit(False)
    for rule in rules:
        if rule.base:
            base = base | rule.fails(F.col("n_words"), F.col(rule.feature) if rule.feature else None)
    return out.withColumn("base_failed", base)


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes every rule, all columns as they are; a feature is worked out only where the cascade comes to it.

    A null or empty text has no words and fails.  Repeated rows are kept or
    rejected together, a null id does not matter, an empty table gives an empty one.
    """
    order = [r for r, _, _ in rule_order(docs, rules)]
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(let(words_of(text), lambda w: cascade(order, F.size(w), lambda name: FEATURES[name](text, w))))


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT doc_id, i, unnest([i, i + 1, i + 2]) AS place
  FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
    FROM (
      SELECT doc_id, i, list_aggregate(words[i:i + 2], 'string_agg', ' ') AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
    )
  ) WHERE n >= 2
), r AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM g GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
         CASE WHEN count(*) < 3 THEN 0 ELSE 100 * count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) // count(*) END AS bullets,
         CASE WHEN count(*) < 3 THEN 0 ELSE 100 * count(*) FILTER (regexp_matches(line, '([.][.][.]|…)[\x20\x09-\x0D]*\z')) // count(*) END AS ellipses
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         coalesce(length(list_aggregate(words, 'string_agg', '')), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS n_shouts,
         len(list_filter(words, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_letter_words,
         coalesce(bullets, 0) AS bullets, coalesce(ellipses, 0) AS ellipses
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 25 * n_words
            OR 100 * n_shouts > 25 * n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words
            OR 100 * n_letter_words < 50 * n_words OR bullets > 90 OR ellipses > 30
            OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 5 * n_words)) AS kept
FROM f
"""
