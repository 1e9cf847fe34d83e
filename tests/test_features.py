"""Matching, indexes, extractors, orders, upserts, imports and JSON against plain Python on hand-made rows."""

import hashlib
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import inverted_index, matching, vector_index
from tallgrass.functions.text import LOG_PII, json_hash, redact, short_hash, stable_json
from tallgrass.operators import extraction, extractors, hierarchy
from tallgrass.operators.assurance import merkle
from tallgrass.sources import upsert
from tallgrass.sources.files import numeric_series, read_import
from tallgrass.sources.numbered import numbered

# --- many patterns -------------------------------------------------------------------------------------------------------


def alias_index(rows):
    index = {}
    for alias, key, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if alias.lower().strip():
            index[alias.lower().strip()] = key
    return index


def by_alias(text, index):
    t = text.lower().strip()
    return index.get(t) or next((index[a] for a in sorted(index, key=len, reverse=True) if a in t), None)


def test_ten_thousand_aliases(spark, sf_dir, monkeypatch):
    r = random.Random(1)
    texts = [x["text"] or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    words = sorted({w for t in texts for w in t.split()})
    rows = [(f" {r.choice(words)} {r.choice(words)}" if i % 2 else r.choice(words).upper(), f"k{i}", i) for i in range(10_000)]
    rows += [("", "none", 10_000), (rows[3][0], "again", 10_001)]
    labels = sorted({t.split("\n")[0][:300] for t in texts} | {rows[1][0], rows[2][0].lower(), "no such label 0", ""})
    index = alias_index(rows)
    frame, aliases = spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame(rows, "alias string, key string, place int")
    want = {x: k for x in labels if (k := by_alias(x, index))}
    assert {x["label"]: x["key"] for x in matching.longest_alias(frame, aliases).collect()} == want and len(want) > 50
    # whole texts, in several passes
    monkeypatch.setattr(matching.slices, "__defaults__", (500,))
    some = sorted({a for a, _, _ in rows if a.strip()})[:1200]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])] + [(99, None)], "id long, text string")
    found = matching.occurrences(docs, "id", "text", spark.createDataFrame([(a,) for a in some], "a string"), "a", 500)
    count = lambda t, a: sum(t.startswith(a, i) for i in range(len(t)))
    assert {(x["id"], x["pattern"]): x["n"] for x in found.collect()} == {(i, a): n for i, t in enumerate(texts[:40]) for a in some if a in t and (n := count(t, a))}


def test_aliases_on_either_side(spark):
    rows = [("energy", "e", 0), ("total energy used", "t", 1), ("kwh", "k", 2), ("used", "u", 3), ("user", "v", 4)]
    labels = ["Energy", "energy used", "kwh", "kw", "the energy of it", "nothing", " ", "us"]
    out = matching.scored_alias(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame(rows, "alias string, key string, place int"))
    got = {x["label"]: (x["key"], x["score"]) for x in out.collect()}
    # "us" is inside three aliases: the longest counts; "kw" is only inside a short one
    assert got == {"Energy": ("e", 1.0), "energy used": ("t", 0.85), "kwh": ("k", 1.0), "the energy of it": ("e", 0.85), "us": ("t", 0.85)}


def test_document_types(spark):
    rows = [(1, "ELECTRICITY BILL kWh units consumed", None), (2, "png", None), (3, "natural gas png scm", None), (4, "", "water_bill"), (5, None, None), (6, "water bill, water charges, jal board", "nonsense"), (7, "open access electricity bill", None), (8, "x" * 50 + "diesel hsd", "DIESEL_BILL")]
    out = {x["id"]: (x["type"], x["score"]) for x in matching.document_types(spark.createDataFrame(rows, "id long, text string, hint string")).collect()}
    assert out == {1: ("ELECTRICITY_BILL", 0.8), 2: ("UNKNOWN", 0.2), 3: ("PNG_BILL", 0.92), 4: ("WATER_BILL", 0.6), 5: ("UNKNOWN", 0.2), 6: ("WATER_BILL", 0.96), 7: ("ELECTRICITY_BILL", 0.4), 8: ("DIESEL_BILL", 0.6)}


# --- indexes -------------------------------------------------------------------------------------------------------------


def okapi(corpus, asked):
    """Scores of one query, as the usual small library works them out."""
    tokens = lambda t: [w for w in t.lower().split() if w.isalnum()]
    docs = [tokens(t) for t in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in tokens(asked)) for d in docs]


@pytest.mark.parametrize(("documents", "queries"), [(8192, 2048), (50, 2)])
def test_search_against_all_scores(spark, tmp_path, monkeypatch, documents, queries):
    monkeypatch.setattr(inverted_index, "DOCUMENTS", documents)
    monkeypatch.setattr(inverted_index, "QUERIES", queries)
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(20_000)]
    corpus = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(400)] + ["", "!!! ???"]
    index = inverted_index.build(spark.createDataFrame(list(enumerate(corpus)) + [(9999, None)], "id long, text string"), str(tmp_path / "index"))
    queries = [" ".join(r.choice(words) for _ in range(k)) for k in (1, 3, 8, 20)] + ["w1 w1 w2 unknownword", "nothingatall", ""]
    found = inverted_index.search(index, spark.createDataFrame(list(enumerate(queries)), "query long, text string"), 7).collect()
    for q, text in enumerate(queries):
        scores = okapi([*corpus, ""], text)
        held = {w for w in text.lower().split()}
        want = sorted(((-round(s, 6), i) for i, s in enumerate(scores) if i < len(corpus) and held & set(corpus[i].lower().split())))[:7]
        got = sorted((x["rank"], x["id"], x["score"], x["share"]) for x in found if x["query"] == q)
        assert [(i, pytest.approx(-s, abs=2e-6)) for s, i in want] == [(g[1], g[2]) for g in got]
        assert not got or got[0][3] == 1.0


def test_a_posting_moves_once(spark, tmp_path):
    """However many queries ask for a term; and only terms that are asked for are read."""
    corpus = [f"common shared everywhere rare{i % 100} words{i}" for i in range(3000)]
    index = inverted_index.build(spark.createDataFrame(list(enumerate(corpus)), "id long, text string"), str(tmp_path / "index"))
    found = inverted_index.search(index, spark.createDataFrame([(0, "common shared everywhere rare7 words107")], "query long, text string"), 5)
    assert [x["id"] for x in found.orderBy("rank").collect()] == [107, 7, 207, 307, 407]
    many = inverted_index.search(index, spark.createDataFrame([(i, f"common rare{i % 100}") for i in range(900)], "query long, text string"), 3)
    assert many.count() == 2700 and {x["id"] % 100 for x in many.where("query = 42").collect()} == {42}


def vectors(spark, n=1500, dims=16, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(12, dims))[r.integers(12, size=n)] + 0.4 * r.normal(size=(n, dims))
    x[50] = x[51]  # equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(n, None), (n + 1, [0.0] * dims), (n + 2, [float("nan")] * dims)]
    return x, spark.createDataFrame(rows, "id long, embedding array<double>")


def test_nearest_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 40)
    monkeypatch.setattr(vector_index, "QUERIES", 3)
    x, frame = vectors(spark)
    index = vector_index.build(frame, str(tmp_path / "cells"))
    assert index.lists.count() == len(x) and index.parts.max() > 1
    queries = frame.where(F.col("id") % 20 == 0).select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, len(x), 20):
        score = np.round(unit @ unit[q], 6)
        score[q] = -9
        want[q] = np.argsort(-score, kind="stable")[:10].tolist()
    exact = {}
    for r in vector_index.search(index, queries, 10, probes=2).orderBy("rank").collect():
        exact.setdefault(r["query"], []).append(r["id"])
    assert exact == want
    some = {}
    for r in vector_index.search(index, queries, 10, probes=8, exact=False).collect():
        some.setdefault(r["query"], set()).add(r["id"])
    recall = np.mean([len(some.get(q, set()) & set(w)) / 10 for q, w in want.items()])
    assert recall >= 0.9, recall


def test_nearest_vectors_of_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    index = vector_index.build(empty, str(tmp_path / "none"))
    assert vector_index.search(index, spark.createDataFrame([(1, [1.0])], "query long, vector array<double>"), 3).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id long, embedding array<double>")
    index = vector_index.build(same, str(tmp_path / "same"))
    out = vector_index.search(index, spark.createDataFrame([(5, [2.0, 4.0])], "query long, vector array<double>"), 4, probes=1).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in out] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)]


# --- extractors ----------------------------------------------------------------------------------------------------------

BILL = "MSEDCL and TATA POWER bill\nTotal Units Consumed: 1,234.5 kWh\nUnits billed: 7\nBilling Period: 01 April 2024 to 30 April 2024\nPower Factor: 1.20\nMaximum Demand: 88\nTotal Amount Due: Rs. 9,876.50\n"


def test_extractors():
    name, days, fields, overall = extractors.extract(BILL, extractors.ELECTRICITY)
    assert name == "MSEDCL" and [str(d) for d in days] == ["2024-04-01", "2024-04-30"] and overall == 0.96
    assert [f[:2] for f in fields] == [("purchased_electricity_kwh", 1234.5), ("maximum_demand_kva", 88.0), ("bill_amount_inr", 9876.5)]
    one = extractors.extract("An energy charges list of some length\nSanctioned Load: 5 kW", extractors.ELECTRICITY)
    assert one[0] == "GENERIC" and one[1] is None and one[3] == pytest.approx(0.52)
    assert extractors.extract("TATA POWER " + "x" * 40, extractors.ELECTRICITY) is None and extractors.extract("TATA POWER", extractors.ELECTRICITY) is None and extractors.extract(None, extractors.WATER) is None
    _, days, fields, overall = extractors.extract("WATER BILL\nTotal water withdrawn: 0 kL\nNet water consumed: 40 kL\nSource: municipal and borewell\nPeriod: 2024-01-01 to 2024-01-31", extractors.WATER)
    assert [f[:2] for f in fields] == [("water_withdrawn_total_kl", 40.0), ("water_withdrawn_groundwater_kl", 40.0), ("water_withdrawn_third_party_kl", 40.0)] and overall == 0.96 and str(days[1]) == "2024-01-31"
    name, days, fields, overall = extractors.extract("HR Report\nTotal Employees: 0\nSnapshot Date: 2024-02-01", extractors.HEADCOUNT)
    assert fields[0][:2] == ("employee_count_total", 0.0) and [str(d) for d in days] == ["2023-04-01", "2024-03-31"] and overall == pytest.approx(0.62)
    assert [str(d) for d in extractors.period("Billing Month: February 2024")] == ["2024-02-01", "2024-02-29"] and extractors.period("Billing Month: Smarch 2024") is None


def test_rows_of_numbers():
    head = "महाराष्ट्र स्टेट इलेक्ट्रिसिटी\nवीज पुरवठा देयक माहे: AUG-2025\n"
    name, days, fields, overall = extractors.extract(head + "चालू मागील एकूण\n 5200 5120 1 80 0 80\n देयक रक्कम रु: 3,380.00", extractors.ELECTRICITY)
    assert name == "MSEDCL" and [f[:2] for f in fields] == [("purchased_electricity_kwh", 80.0), ("bill_amount_inr", 3380.0)] and [str(d) for d in days] == ["2025-08-01", "2025-08-31"] and overall == pytest.approx(0.94)
    assert extractors.extract(head + "एकूण\n12 12 1 0\n", extractors.ELECTRICITY)[2] == [("purchased_electricity_kwh", 0.0, "kWh", 0.85)]
    assert extractors.extract(head + "एकूण : 75 युनिट", extractors.ELECTRICITY)[2][0][1] == 75.0


def test_table_function_needs_a_known_extractor(spark):
    rows = spark.createDataFrame([(1, BILL), (2, None)], "id long, text string")
    out = extractors.extracted(rows, "electricity")
    assert out.columns[:3] == ["id", "signature", "key"] and {r["key"] for r in out.collect()} == {"purchased_electricity_kwh", "maximum_demand_kva", "bill_amount_inr"}
    with pytest.raises(Exception, match="the extractor is one of"):
        extractors.extracted(rows, "gas").collect()


# --- orders, upserts, imports ----------------------------------------------------------------------------------------------


def test_a_long_chain_and_cycles(spark):
    chain = [(f"n{i:05d}", f"n{i - 1:05d}" if i else None) for i in range(5000)]
    random.Random(1).shuffle(chain)
    rows = spark.createDataFrame([*chain, ("orphan", "gone"), ("leaf", "orphan"), (None, "n00001")], "id string, parent_id string")
    out = {r["id"]: r["depth"] for r in hierarchy.depths(rows).collect()}
    assert out == {**{f"n{i:05d}": i for i in range(5000)}, "orphan": 0, "leaf": 1}
    ring = [("a", "c"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", None), ("s", "s")]
    with pytest.raises(ValueError, match="^cycle at a, b, c, s$"):
        hierarchy.depths(spark.createDataFrame(ring, "id string, parent_id string"))
    assert hierarchy.depths(spark.createDataFrame([], "id string, parent_id string")).count() == 0


def files_below(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_ino for d, _, names in os.walk(path) for n in names if n.endswith(".parquet") and "_staged" not in d}


def test_upsert_swaps_only_what_changes(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "t"), "k long, v string, at long, fy int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    table = lambda: sorted(map(tuple, upsert.partitions(spark, path, frame([]).schema).collect()))
    first = [(k, "old", 0, fy) for k in range(5) for fy in (2020, 2021, 2022)]
    upsert.created(frame(first), path, "fy")
    before = files_below(path)
    new = [(1, "new", 1, 2021), (1, "newer", 2, 2021), (9, "added", 1, 2021), (9, "first", 1, 2030)]
    # a crash before the swap
    with monkeypatch.context() as m:
        m.setattr(upsert.Folders, "touch", lambda self, p: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            upsert.upsert(frame(new), path, ["k"], "fy", "at")
    assert files_below(path) == before and table() == sorted(first)
    # a crash within the swap: what is staged is whole, and is brought to its end
    moves = []

    def once(self, a, b, real=upsert.Folders.move):
        moves.append(b)
        if len(moves) > 1:
            raise OSError("crash")
        real(self, a, b)

    with monkeypatch.context() as m:
        m.setattr(upsert.Folders, "move", once)
        with pytest.raises(OSError):
            upsert.upsert(frame(new), path, ["k"], "fy", "at")
    upsert.recovered(spark, path)
    want = sorted([r for r in first if (r[0], r[3]) != (1, 2021)] + [(1, "newer", 2, 2021), (9, "added", 1, 2021), (9, "first", 1, 2030)])
    assert table() == want and not [n for n in os.listdir(path) if n.startswith("_staged")]
    after = files_below(path)
    untouched = {f: i for f, i in before.items() if "fy=2021" not in f}
    assert untouched and all(after.get(f) == i for f, i in untouched.items())
    upsert.upsert(frame(new), path, ["k"], "fy", "at")
    assert table() == want


def test_import_with_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('key,name,value,day\n1,"Smith, J",3.5,2024-01-31\n2,short\n3,x,1,2024-01-01,more\n\n4,"open,5,2024-01-01\n5,,1,\n6,n,1e3,\n7,n,1.2.3,\n8,n,1,31.01.2024\n')
    (tmp_path / "b.csv").write_text("\n".join(["key,name,value,day", *(f"{i},n{i},{i},2024-02-0{i % 9 + 1}" for i in range(100, 400))]))
    good, bad = read_import(spark, str(tmp_path), ("key", "name", "value"), ("value",), ("day",))
    rows = {(r["file"].rsplit("/", 1)[1], r["line"]): r["name"] for r in good.collect()}
    told = {r["line"]: r["reason"] for r in bad.collect()}
    assert {k: v for k, v in rows.items() if k[0] == "a.csv"} == {("a.csv", 2): "Smith, J", ("a.csv", 8): "n"} and rows[("b.csv", 301)] == "n399" and len(rows) == 302
    assert told == {3: "cells do not fit the header", 4: "cells do not fit the header", 6: "cells do not fit the header", 7: "name is missing", 9: "value is no number", 10: "day is no date"}
    with pytest.raises(ValueError, match="Missing required column: unit"):
        read_import(spark, str(tmp_path), ("key", "unit"))


def test_places_in_large_groups(spark):
    rows = [("big" if i % 3 else None, i * 7919 % 1000, i) for i in range(1000)] + [("one", 5, 5000)]
    out = numbered(spark.createDataFrame(rows, "g string, o long, id long").repartition(7), ["g"], ["o", "id"]).collect()
    for g in ("big", None, "one"):
        want = sorted((o, i) for h, o, i in rows if h == g)
        assert [(r["o"], r["id"]) for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["place"])] == want
        assert {r["n"] for r in out if r["g"] == g} == {len(want)} and sorted(r["place"] for r in out if r["g"] == g) == list(range(len(want)))


# --- values --------------------------------------------------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_json_of_any_shape(spark):
    def shuffled(x, r):
        if isinstance(x, dict):
            keys = list(x)
            r.shuffle(keys)
            return {k: shuffled(x[k], r) for k in keys}
        return [shuffled(v, r) for v in x] if isinstance(x, list) else x

    x = {"b": [1, {"z": None, "a": {"k": "v:1.0,", "c": [True, 2.5]}}], "a": "é\"\\", "10": 100, "9": -3}
    plain = json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for seed in range(4):
        assert one(spark, stable_json(F.lit(json.dumps(shuffled(x, random.Random(seed)), indent=seed)))) == plain
    assert one(spark, json_hash(F.lit(json.dumps(x)))) == hashlib.sha256(plain.encode()).hexdigest()
    same = lambda a, b: one(spark, json_hash(F.lit(a)) == json_hash(F.lit(b)))
    assert same('{"a": 1.0, "b": 1e2}', '{"b":100,"a":1}') and not same("[1, 2]", "[2, 1]") and not same('{"a": null}', "{}")
    assert one(spark, stable_json(F.lit("nope"))) is None and one(spark, stable_json(F.lit('{"a":1,"a":2}'))) is None


def test_numbers_of_any_shape(spark):
    cases = {
        '{"events": [{"value_num": 1, "value": 9}, {"valueNum": 2.5}, {"x": 1}, 3, "4", null, true]}': [1.0, 2.5, 3.0, 1.0], '{"events": [], "data": [{"valueCanonical": 7}]}': [7.0], '[{"value": "8"}, {"value_num": "8", "value": 6}]': [6.0],
        '{"other": [1]}': [], '"text"': [], "5": [], "broken": [], "[]": [], '{"events": 3, "data": [2]}': [2.0],
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    assert {r["t"]: r["n"] for r in rows.select("t", numeric_series(F.col("t")).alias("n")).collect()} == {**cases, None: []}


def test_short_hashes(spark):
    want = hashlib.sha256(b"acme").hexdigest()[:16]
    assert [one(spark, short_hash(F.lit(x).cast("string"))) for x in ("acme", "", None)] == [want, "", ""]


def test_logs_hide(spark):
    text = "Bearer abc.def-1 and sk-" + "a" * 22 + " mail a.b@c.de 4111111111111111 x 1234 5678 9012 y ABCDE1234F +91 9876543210 bearer"
    out = redact(spark.createDataFrame([(text,), (None,)], "text string"), "text", LOG_PII).collect()
    assert out[0]["text"].startswith("Bearer [REDACTED] and [REDACTED_API_KEY] mail [REDACTED_EMAIL] ") and not any(x in out[0]["text"] for x in ("4111", "9012", "ABCDE", "98765")) and out[1]["text"] is None


def test_fields_that_disagree_stay(spark):
    rows = [
        (1, "k", "f1", 100.0, 0.5), (1, "k", "f2", 101.0, 0.9), (1, "k", "f3", 101.0, 0.9),  # agree: the surest, then the first
        (2, "k", "f4", 100.0, 0.5), (2, "k", "f5", 103.0, 0.9), (2, "k", "f6", 90.0, 0.9), (2, "k", "f7", 100.0, 0.1),  # the first two values
        (3, "k", "f8", 0.0, 0.5), (3, "k", "f9", 0.001, 0.9), (4, "k", "fa", 0.0, 0.5), (5, "k", "fb", 5.0, 0.5), (5, "k", "fc", 50.0, 0.5),
    ]
    f = spark.createDataFrame(rows, "document_id long, canonical_key string, id string, value_num double, confidence double")
    f = f.select("*", F.lit(None).cast("string").alias("value_text"), F.lit("APPROVED").alias("status"), F.lit("2024-01-01").cast("date").alias("created_at"))
    f = f.union(f.where("id = 'fb'").select("document_id", "canonical_key", F.lit("fd").alias("id"), F.lit(500.0), "confidence", "value_text", "status", F.lit("2025-01-01").cast("date")))
    got = sorted((r["document_id"], r["id"], r["needs_review"]) for r in extraction.merge_fields(f).collect())
    assert got == [(1, "f2", False), (2, "f4", True), (2, "f5", True), (3, "f8", True), (3, "f9", True), (4, "fa", False), (5, "fb", True), (5, "fc", True), (5, "fd", False)]


def test_roots_of_numbered_leaves(spark):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(2500)]
    rows = spark.createDataFrame([("t", i, h.hex()) for i, h in enumerate(leaves)], "g string, id long, h string")
    while len(leaves) > 1:
        leaves = [hashlib.sha256(leaves[i] + leaves[min(i + 1, len(leaves) - 1)]).digest() for i in range(0, len(leaves), 2)]
    out = merkle(rows, ["g"], ["id"]).collect()
    assert [(r["leaves"], r["root"]) for r in out] == [(2500, leaves[0].hex())]
