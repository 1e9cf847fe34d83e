"""Text operators as column expressions: redaction, chunks, tokens, claims, citations, routing."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.scratch import scratch_path

# Patterns of personal data in the order of redaction, with what replaces them.
PII = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("phone", r"(?<!\d)(?:\+?91[\s-]?)?[6-9]\d{9}(?!\d)|(?<!\d)\+?\d{1,3}[\s-]?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4}(?!\d)", "[REDACTED_PHONE]"),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", "[REDACTED_PAN]"),
    ("aadhaar", r"\b\d{4}\s?\d{4}\s?\d{4}\b", "[REDACTED_AADHAAR]"),
    ("salary_line", r"(?im)^.*\b(salary|ctc|wages?|gross\s+pay|remuneration)\b.*?(?:INR|Rs\.?|₹)\s*[\d,]+(?:\.\d+)?.*$", "[REDACTED_SALARY_LINE]"),
    ("named_person", r"\b(Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Shri|Smt\.?)\s+([A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+){0,2})", "$1 [REDACTED_NAME]"),
)


# What logs must not show, in the order of redaction.
LOG_PII = (
    ("api_key", r"sk-[A-Za-z0-9]{20,}", "[REDACTED_API_KEY]"),
    ("bearer", r"(?i)Bearer\s+[A-Za-z0-9._\-]+", "Bearer [REDACTED]"),
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    ("aadhaar", r"\b\d{4}[\-\s]?\d{4}[\-\s]?\d{4}\b", "[REDACTED_AADHAAR]"),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b", "[REDACTED_PAN]"),
    ("card", r"\b(?:\d[ \-]?){13,19}\b", "[REDACTED_CARD]"),
    ("phone", r"(?:(?:\+?91[\-\s]?)|0)?[6-9]\d{9}", "[REDACTED_PHONE]"),
)


# What a text must hold for a pattern to find anything; it is cheaper to ask for.
HINTS = {"email": "@", "phone": r"\d{3}[\s-]?\d{3}", "aadhaar": r"\d{4}\s?\d{4}", "salary_line": r"(?i)salary|ctc|wage|gross\s+pay|remuneration", "named_person": r"\b(?:Mr|Mrs|Ms|Dr|Shri|Smt)\b"}


def redact(df: DataFrame, text: str, kinds: tuple = PII) -> DataFrame:
    """``df`` with ``text`` redacted step by step and a count of each kind, taken before its step.

    A pattern is looked for only in texts that hold its hint, and replaced only where it is found.
    """
    for kind, pattern, instead in kinds:
        count = F.regexp_count(text, F.lit(pattern))
        if hint := HINTS.get(kind):
            count = F.when(F.col(text).rlike(hint), count).when(F.col(text).isNotNull(), 0)
        df = df.withColumn(kind, count.cast("long"))
        df = df.withColumn(text, F.when(F.col(kind) > 0, F.regexp_replace(text, pattern, instead)).otherwise(F.col(text)))
    return df


@query("sc_s7", "documents")
def redacted_documents(d: DataFrame) -> DataFrame:
    return redact(d.select("doc_id", "text"), "text").select("doc_id", *(k for k, _, _ in PII), F.md5("text").alias("text_md5"))


_LOGGED = "concat(coalesce(text, ''), ' by Bearer abc.', user_no, '-x key sk-', repeat('a1B2', 6), ' card 4111 1111 1111 ', 1000 + user_no, ' of ABCDE1234F')"


@query("sc_s7_log", "conversations", sql=rf"""WITH t0 AS (SELECT conv_id, turn, {_LOGGED} AS t FROM (SELECT *, conv_id % 9000 AS user_no FROM conversations)),
{", ".join(f"t{k + 1} AS (SELECT conv_id, turn, regexp_replace(t, '{p}', '{r}', 'g') AS t FROM t{k})" for k, (_, p, r) in enumerate(LOG_PII))}
SELECT conv_id, turn, md5(t) AS text_md5, contains(t, 'sk-a1B2') AS key_left FROM t{len(LOG_PII)}""")
def redacted_log(c: DataFrame) -> DataFrame:
    """Turns as log lines with a bearer token, a key, a card and a tax number, none of which stays."""
    no = (F.col("conv_id") % 9000).cast("string")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" by Bearer abc."), no, F.lit("-x key sk-" + "a1B2" * 6 + " card 4111 1111 1111 "), (F.col("conv_id") % 9000 + 1000).cast("string"), F.lit(" of ABCDE1234F"))
    x = redact(c.select("conv_id", "turn", text.alias("text")), "text", LOG_PII)
    return x.select("conv_id", "turn", F.md5("text").alias("text_md5"), F.contains("text", F.lit("sk-a1B2")).alias("key_left"))


@query("sc_s7_email", "documents", sql=r"SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'))::BIGINT AS email, md5(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED_EMAIL]', 'g')) AS text_md5 FROM documents")
def redacted_emails(d: DataFrame) -> DataFrame:
    return redact(d.select("doc_id", "text"), "text", PII[:1]).select("doc_id", "email", F.md5("text").alias("text_md5"))


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space that are letters and digits only."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<!\S)[\p{L}\p{N}]+(?!\S)"), F.lit(0))


@query("sc_s15", "documents", sql=r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: regexp_matches(t, '^[\pL\pN]+$')))::BIGINT AS n FROM documents")
def token_counts(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query("sc_s14", "documents", sql=r"SELECT doc_id, greatest(1, floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) * 1.3))::BIGINT AS n FROM documents")
def token_estimate(d: DataFrame) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    return d.select("doc_id", F.greatest(F.lit(1), F.floor(F.size(words) * 1.3)).cast("long").alias("n"))


@query("sc_s13", "pages", sql="SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped FROM pages")
def escaped_html(p: DataFrame) -> DataFrame:
    out = F.col("html")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return p.select("page_id", F.md5(out).alias("escaped"))


@query("sc_s9", "documents", sql=r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: regexp_matches(s, '[^ \t\n\r]')))::BIGINT AS sentences, len(list_filter(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda n: NOT regexp_matches(n, '^(19|20)\d\d$')))::BIGINT AS numbers FROM documents")
def sentences_and_numbers(d: DataFrame) -> DataFrame:
    """Sentences, and numbers that are not bare years."""
    sentences = F.filter(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]?"), F.lit(0)), lambda s: s.rlike(r"[^ \t\n\r]"))
    numbers = F.filter(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: ~n.rlike(r"^(19|20)\d\d$"))
    return d.select("doc_id", F.size(sentences).cast("long").alias("sentences"), F.size(numbers).cast("long").alias("numbers"))


@query("sc_s6", "documents", sql=r"WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\d[\d,]*(?:\.\d+)?)\s*(kWh|MWh|km|kg|t|L|%)', 1)) AS n FROM documents) SELECT doc_id, count(*)::BIGINT AS n, round(sum(try_cast(replace(n, ',', '') AS DOUBLE)), 3) AS total FROM x GROUP BY 1")
def numbers_with_units(d: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"(\d[\d,]*(?:\.\d+)?)\s*(kWh|MWh|km|kg|t|L|%)"), F.lit(1))
    rows = d.select("doc_id", F.explode(found).alias("n"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum(F.replace("n", F.lit(","), F.lit("")).try_cast("double")), 3).alias("total"))


@query("sc_s3", "customer", sql="SELECT c_custkey, regexp_matches(concat('ABCDE', lpad((c_custkey % 10000)::VARCHAR, 4, '0'), CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE 'K' END), '^[A-Z]{5}[0-9]{4}[A-Z]$') AS valid FROM customer")
def tax_ids(c: DataFrame) -> DataFrame:
    text = F.concat(F.lit("ABCDE"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.when(F.col("c_custkey") % 3 == 0, "1").otherwise("K"))
    return c.select("c_custkey", text.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$").alias("valid"))


#: A string of JSON, or a whole number with a fraction of zero.
_WHOLE = r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0(?=[,\]}]|$)'


def stable_json(text: Column) -> Column:
    """JSON of any shape with its keys sorted at every depth and no space; lists keep their order. Null for text that is none, or that names a key twice.

    Numbers of 1e21 and more, and below 1e-6, are written with ``E``.
    """
    return F.regexp_replace(F.to_json(F.try_parse_json(text)), _WHOLE, "$1$2")


def json_hash(text: Column) -> Column:
    return F.sha2(stable_json(text), 256)


@query("sc_m13", "events", sql="""SELECT event_id, sha256(concat('{"a":{"c":"', event_type, '","d":', event_id, '},"b":[{"x":null,"y":', user_id, '},2.5,"q\\"e"],"p":', replace(props, ' ', ''), '}')) AS object_hash FROM events""")
def object_hash(e: DataFrame) -> DataFrame:
    """A hash of nested JSON, whose keys come in one order or another."""
    a = F.concat(F.lit('"a": {"d": '), F.col("event_id").cast("string"), F.lit(', "c": "'), "event_type", F.lit('"}'))
    a2 = F.concat(F.lit('"a":{"c":"'), "event_type", F.lit('","d":'), F.col("event_id").cast("string"), F.lit(".0}"))
    b = F.concat(F.lit('"b": [{"y": '), F.col("user_id").cast("string"), F.lit(', "x": null}, 2.50, "q\\"e"]'))
    p = F.concat(F.lit('"p": '), "props")
    text = lambda *xs: F.concat(F.lit("{"), F.concat_ws(", ", *xs), F.lit("}"))
    return e.select("event_id", json_hash(F.when(F.col("event_id") % 2 == 0, text(a, b, p)).otherwise(text(p, b, a2))).alias("object_hash"))


@query("sc_m14", "customer", sql="SELECT c_custkey, (('0x' || substr(sha256(c_name), 1, 16))::UBIGINT)::VARCHAR AS stable_id FROM customer")
def stable_id(c: DataFrame) -> DataFrame:
    return c.select("c_custkey", F.conv(F.substring(F.sha2("c_name", 256), 1, 16), 16, 10).alias("stable_id"))


@query("sc_m15", "audit_log", sql="SELECT id, CASE WHEN actor_id IS NULL THEN '' ELSE substr(sha256(actor_id), 1, 16) END AS actor, substr(sha256(tenant_id::VARCHAR), 1, 16) AS tenant FROM audit_log")
def tenant_hash(log: DataFrame) -> DataFrame:
    """The first 16 digits of a name's digest for logs; of no name nothing."""
    return log.select("id", short_hash(F.col("actor_id")).alias("actor"), short_hash(F.col("tenant_id").cast("string")).alias("tenant"))


def short_hash(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(F.substring(F.sha2(name, 256), 1, 16))


@query("sc_j2", "documents", sql=r"WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars::VARCHAR ELSE source END AS raw FROM documents) SELECT doc_id, CASE WHEN regexp_matches(raw, '^-?\d+(\.\d+)?$') THEN raw::DOUBLE END AS value_num, CASE WHEN NOT regexp_matches(raw, '^-?\d+(\.\d+)?$') THEN raw END AS value_text FROM x")
def number_or_text(d: DataFrame) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).otherwise(F.col("source"))
    number = raw.rlike(r"^-?\d+(\.\d+)?$")
    return d.select("doc_id", F.when(number, raw.try_cast("double")).alias("value_num"), F.when(~number, raw).alias("value_text"))


@query("sc_j3", "customer", sql="SELECT c_custkey, k AS label, v AS value FROM (SELECT c_custkey, unnest(['name', 'segment', 'meter']) AS k, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS v FROM customer)")
def flattened(c: DataFrame) -> DataFrame:
    """Entries of a map and elements of an array as rows."""
    nested = c.select("c_custkey", F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("section"), F.array(F.struct(F.lit("meter").alias("label"), F.col("c_nationkey").cast("string").alias("value"))).alias("meters"))
    both = F.concat(F.transform(F.map_entries("section"), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value"))), F.col("meters"))
    return nested.select("c_custkey", F.explode(both).alias("e")).select("c_custkey", "e.label", "e.value")


# Punctuation that stands for a space in labels.
PUNCTUATION = r"[()\[\]/:.,\-–—\s]+"


def plain_label(text: str) -> str:
    """Compatibility forms as their plain characters, lower case, punctuation as a space; other scripts stay."""
    return re.sub(PUNCTUATION, " ", unicodedata.normalize("NFKC", text).lower()).strip()


def with_plain_label(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``plain`` of a label (null: empty); each different label is worked out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["_label"], pa.array([plain_label(t.as_py()) for t in b["_label"]], pa.string())], ["_label", "plain"])

    some = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_label")).distinct()
    found = some.mapInArrow(run, "_label string, plain string")
    return df.join(found, F.col(label) == F.col("_label"), "left").drop("_label").withColumn("plain", F.coalesce("plain", F.lit("")))


@query("sc_s11", "part", sql=r"""SELECT p_partkey, trim(regexp_replace(lower(translate(concat('Ｔｏtal ', p_brand, ' (Ｍ²/day)— ', p_size, ', FY:', p_partkey % 7), 'ＴｏＭ²', 'ToM2')), '[()\[\]/:.,\-–—\s]+', ' ', 'g')) AS plain FROM part""")
def plain_labels(p: DataFrame) -> DataFrame:
    label = F.concat(F.lit("Ｔｏtal "), "p_brand", F.lit(" (Ｍ²/day)— "), F.col("p_size").cast("string"), F.lit(", FY:"), (F.col("p_partkey") % 7).cast("string"))
    return with_plain_label(p.select("p_partkey", label.alias("label")), "label").select("p_partkey", "plain")


@query("sc_s10", "events", sql="SELECT event_id, CASE WHEN event_type = 'purchase' THEN '***' ELSE event_type END AS token, event_type AS kind FROM events")
def masked_map(e: DataFrame) -> DataFrame:
    """Values of sensitive keys are masked in a map."""
    m = F.create_map(F.lit("token"), "event_type", F.lit("kind"), "event_type")
    masked = F.transform_values(m, lambda k, v: F.when((k == "token") & (v == "purchase"), "***").otherwise(v))
    return e.select("event_id", masked.alias("m")).select("event_id", F.col("m")["token"].alias("token"), F.col("m")["kind"].alias("kind"))


@query("ret1", "documents", sql="SELECT doc_id, (i // 1800)::BIGINT AS chunk, md5(substr(text, i + 1, 2000)) AS md5 FROM (SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS i FROM documents WHERE length(text) > 0)")
def character_chunks(d: DataFrame, size: int = 2000, step: int = 1800) -> DataFrame:
    """Overlapping chunks of characters."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))
    rows = d.where(F.length("text") > 0).select("doc_id", "text", F.explode(starts).alias("i"))
    return rows.select("doc_id", F.floor(F.col("i") / step).cast("long").alias("chunk"), F.md5(F.substring("text", F.col("i") + 1, F.lit(size))).alias("md5"))


def estimated_tokens(text: str) -> int:
    words = len(text.split())
    return max(1, int(words * 1.3)) if text else 0


def packed(parts: list[str], budget: int, glue: str) -> list[str]:
    """Neighbours joined as long as their estimates stay within the budget; a part above it stands alone."""
    out, held, size = [], [], 0
    for part in parts:
        n = estimated_tokens(part)
        if held and size + n > budget:
            out.append(glue.join(held))
            held, size = [], 0
        held.append(part)
        size += n
    return [*out, glue.join(held)] if held else out


def paragraph_chunks(text: str, budget: int, overlap: int) -> list[str]:
    """Paragraphs packed whole; one above the budget by its sentences. A chunk starts with the last words of the one before."""
    chunks, run = [], []
    for para in filter(None, (p.strip() for p in re.split(r"\n\s*\n+", text))):
        if estimated_tokens(para) <= budget:
            run.append(para)
        else:
            sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", para) if s.strip()]
            chunks += packed(run, budget, "\n\n") + packed(sentences, budget, " ")
            run = []
    chunks += packed(run, budget, "\n\n")
    tails = ["", *(" ".join(c.split()[-overlap:]) for c in chunks)] if overlap else [""] * len(chunks)
    return [c if not tail or c.startswith(tail) else f"{tail} {c}" for tail, c in zip(tails, chunks, strict=False)]


@query("ret2", "documents")
def text_chunks(d: DataFrame, budget: int = 400, overlap: int = 50) -> DataFrame:
    """A sequential fold within each text, so in Python; the rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256).to_pylist()
                rows = [(r["doc_id"], k, c) for r in part for k, c in enumerate(paragraph_chunks(r["text"] or "", budget, overlap))]
                ids, places, texts = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "chunk", "text"])

    return d.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk long, text string")


# Intents in the order that they are asked for; of each phrase list one must be there, at the start or anywhere.
INTENTS: tuple[tuple[str, bool, tuple[tuple[str, ...], ...]], ...] = (
    ("DEFINITION", True, (("what is", "define", "explain the term"),)),
    ("ANALYTICAL", True, (("why is", "why did", "what changed", "compare to"),)),
    ("WRITER", False, (("generate",), ("narrative", "paragraph", "section"))),
    ("COMPLETENESS", False, (("missing", "completeness", "what's left"),)),
    ("BENCHMARKING", False, (("peers", "benchmark", "industry average"),)),
    ("PROVENANCE", False, (("how was",), ("calculated",))),
    ("PROVENANCE", False, (("show me how",), ("computed", "calculated"))),
)


def intent(text: Column) -> Column:
    """The first of ``INTENTS`` whose phrases are there, else ``GENERAL``."""
    q, found = F.lower(F.trim(text)), None
    for name, first, lists in INTENTS:
        there = F.startswith if first else F.contains
        holds = reduce(and_, (reduce(or_, (there(q, F.lit(p)) for p in phrases)) for phrases in lists))
        found = (F if found is None else found).when(holds, name)
    return found.otherwise("GENERAL")


def _intent_sql(q: str) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    cases = (" AND ".join("(" + " OR ".join(f"{'starts_with' if first else 'contains'}({q}, {quoted(p)})" for p in ps) + ")" for ps in lists) for _, first, lists in INTENTS)
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, (n, _, _) in zip(cases, INTENTS, strict=True)) + " ELSE 'GENERAL' END"


_ASKED = "['What is scope 3? ', 'why did it rise ', 'Generate a section on ', 'completeness of ', 'our peers and ', 'show me how it is computed ', ''][(conv_id % 7 + 1)::INT]"


@query("ret7", "conversations", sql=f"SELECT conv_id, turn, {_intent_sql('q')} AS intent FROM (SELECT conv_id, turn, lower(trim(concat({_ASKED}, text))) AS q FROM conversations)")
def intents(c: DataFrame) -> DataFrame:
    asked = F.element_at(F.lit(["What is scope 3? ", "why did it rise ", "Generate a section on ", "completeness of ", "our peers and ", "show me how it is computed ", ""]), (F.col("conv_id") % 7 + 1).cast("int"))
    return c.select("conv_id", "turn", intent(F.concat(asked, F.coalesce("text", F.lit("")))).alias("intent"))


CITE = r'<cite ([^>]*)/>'


def _cited(c: DataFrame) -> DataFrame:
    tag = F.concat(F.lit('Total was 42 t. Energy fell <cite metric="m'), (F.col("conv_id") % 5).cast("string"), F.lit('"/>. See <cite doc="d'), F.col("turn").cast("string"), F.lit('"/>.'))
    return c.select("conv_id", "turn", tag.alias("text"))


@query("sc_s8", "conversations", sql="SELECT conv_id, turn, kind, key FROM (SELECT conv_id, turn, unnest(['metric', 'doc']) AS kind, unnest([concat('m', conv_id % 5), concat('d', turn)]) AS key FROM conversations)")
def citation_tags(c: DataFrame) -> DataFrame:
    """Attributes of citation tags, with the kind that they name."""
    tags = _cited(c).select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(CITE), F.lit(1))).alias("a"))
    return tags.select("conv_id", "turn", F.regexp_extract("a", r'^(\w+)="', 1).alias("kind"), F.regexp_extract("a", r'="([^"]*)"', 1).alias("key"))


@query("jn25", "conversations", sql="WITH t AS (SELECT conv_id, turn, unnest(['metric', 'doc']) AS kind, unnest([concat('m', conv_id % 5), concat('d', turn)]) AS key FROM conversations) SELECT conv_id, turn, kind, key, key IN ('m1', 'm2', 'd0', 'd1') AS verified FROM t")
def verified_citations(c: DataFrame) -> DataFrame:
    known = c.sparkSession.createDataFrame([("m1",), ("m2",), ("d0",), ("d1",)], "known string")
    x = citation_tags(c).join(F.broadcast(known), F.col("key") == F.col("known"), "left")
    return x.select("conv_id", "turn", "kind", "key", F.col("known").isNotNull().alias("verified"))


@query("ret8", "conversations", sql="WITH t AS (SELECT conv_id, turn, unnest(['missing', CASE WHEN conv_id % 5 IN (1, 2) THEN 'valid' ELSE 'unverified' END, CASE WHEN turn IN (0, 1) THEN 'valid' ELSE 'unverified' END]) AS type FROM conversations) SELECT conv_id, type, count(*)::BIGINT AS n FROM t GROUP BY ALL")
def enforced(c: DataFrame) -> DataFrame:
    """Findings by conversation: citations that hold or do not, and sentences with numbers but no citation."""
    sentence = F.explode(F.regexp_extract_all("text", F.lit(r"(?:<cite [^>]*/>|[^.!?<])+[.!?]?"), F.lit(0)))
    bare = _cited(c).select("conv_id", sentence.alias("s")).where(F.col("s").rlike(r"(?<![A-Za-z_\"\d])\d") & ~F.col("s").rlike("<cite "))
    found = verified_citations(c).select("conv_id", F.when(F.col("verified"), "valid").otherwise("unverified").alias("type"))
    return found.union(bare.select("conv_id", F.lit("missing"))).groupBy("conv_id", "type").agg(F.count("*").alias("n"))


@query("ret9", "conversations", "orders", sql="""WITH k AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY 1), x AS (SELECT conv_id, (100 + turn)::DOUBLE AS claimed, CASE WHEN conv_id % 3 > 0 THEN 100.0 + conv_id % 4 END::DOUBLE AS actual FROM k)
SELECT conv_id, claimed, actual, CASE WHEN actual IS NOT NULL THEN round(abs(claimed - actual) / greatest(abs(actual), 1e-9) * 100, 3) END AS delta_pct FROM x WHERE actual IS NULL OR abs(claimed - actual) / greatest(abs(actual), 1e-9) > 0.01""")
def checked_claims(c: DataFrame, o: DataFrame) -> DataFrame:
    """The first claim of each conversation against what is stored; more than 1 per cent away, or nothing stored."""
    text = F.concat(F.lit("scope1 was "), (F.col("turn") + 100).cast("string"), F.lit(" in FY2024-25"))
    first = c.groupBy("conv_id").agg(F.min_by(text, "turn").alias("text"))
    claims = first.select("conv_id", F.regexp_extract("text", r"scope1 was (\d+(?:\.\d+)?)", 1).try_cast("double").alias("claimed"))
    stored = first.where(F.col("conv_id") % 3 > 0).select("conv_id", (F.col("conv_id") % 4 + 100.0).alias("actual"))
    x = claims.join(stored, "conv_id", "left")
    delta = F.abs(F.col("claimed") - F.col("actual")) / F.greatest(F.abs("actual"), F.lit(1e-9))
    return x.where(F.col("actual").isNull() | (delta > 0.01)).select("conv_id", "claimed", "actual", F.round(delta * 100, 3).alias("delta_pct"))


@query("jn26", "conversations", sql="SELECT conv_id, turn, (turn * 10)::DOUBLE AS claimed, CASE WHEN turn < 3 THEN turn * 10.0 + 1 END::DOUBLE AS actual FROM conversations")
def claim_actuals(c: DataFrame) -> DataFrame:
    actual = F.broadcast(c.sparkSession.createDataFrame([(t, t * 10.0 + 1) for t in range(3)], "turn long, actual double"))
    return c.select("conv_id", "turn", (F.col("turn") * 10).cast("double").alias("claimed")).join(actual, "turn", "left").select("conv_id", "turn", "claimed", "actual")


# --- document dataflow --------------------------------------------------------------------------------------------------


def lines(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query("doc1", "documents", sql="""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (contains(line, ' | '))::BIGINT AS tabular, count(*) FILTER (regexp_matches(line, '^[A-Z][^:]{0,40}: '))::BIGINT AS labels, count(*) FILTER (line = upper(line) AND regexp_matches(line, '[A-Z]'))::BIGINT AS headers, count(*)::BIGINT AS lines FROM l GROUP BY 1""")
def layout(d: DataFrame) -> DataFrame:
    """Lines by what they look like."""
    x = F.col("line")
    return lines(d).groupBy("doc_id").agg(F.count_if(F.contains(x, F.lit(" | "))).alias("tabular"), F.count_if(x.rlike("^[A-Z][^:]{0,40}: ")).alias("labels"), F.count_if((x == F.upper(x)) & x.rlike("[A-Z]")).alias("headers"), F.count("*").alias("lines"))


@query("wn12", "documents", sql="""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l WHERE contains(line, ' | '))
SELECT doc_id, min(n)::INT AS first_line, count(*)::BIGINT AS n_lines FROM t GROUP BY doc_id, island HAVING count(*) >= 2""")
def table_regions(d: DataFrame) -> DataFrame:
    """Runs of two and more tabular lines."""
    t = lines(d).where(F.contains("line", F.lit(" | ")))
    island = F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    return t.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("n").alias("first_line"), F.count("*").alias("n_lines")).where(F.col("n_lines") >= 2).drop("island")


@query("wn10", "events", sql="SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carried_down(e: DataFrame) -> DataFrame:
    """A blank cell takes the last one of its column that is not."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", F.last(F.when(F.col("event_type") != "click", F.col("event_type")), ignorenulls=True).over(w).alias("carried"))


@query("doc19", "documents", sql="SELECT sha256(text) AS sha256, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def file_dedupe(d: DataFrame) -> DataFrame:
    """The earliest file of each (source, digest)."""
    return d.groupBy(F.sha2("text", 256).alias("sha256"), "source").agg(F.min("doc_id").alias("doc_id"))


@query("src7", "documents", sql="SELECT doc_id, length(text)::BIGINT AS n_chars, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM documents")
def plain_text(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


# First bytes of files by kind.
MAGIC = (("pdf", "25504446"), ("zip", "504B0304"), ("html", "3C"), ("png", "89504E47"))


@query("src11", "pages", sql="SELECT page_id, CASE WHEN starts_with(hex(encode(html)), '25504446') THEN 'pdf' WHEN starts_with(hex(encode(html)), '504B0304') THEN 'zip' WHEN starts_with(hex(encode(html)), '3C') THEN 'html' WHEN starts_with(hex(encode(html)), '89504E47') THEN 'png' ELSE 'text' END AS kind FROM pages")
def file_kind(p: DataFrame) -> DataFrame:
    head = F.hex(F.substring(F.col("html").cast("binary"), 1, 8))
    kind = F.when(F.startswith(head, F.lit(MAGIC[0][1])), MAGIC[0][0])
    for name, magic in MAGIC[1:]:
        kind = kind.when(F.startswith(head, F.lit(magic)), name)
    return p.select("page_id", kind.otherwise("text").alias("kind"))
