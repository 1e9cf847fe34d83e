"""Behaviour that needs hand-made rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallgrass.functions.paths import is_ancestor, parent_path
from tallgrass.functions.periods import parse_period, split_into_months
from tallgrass.functions.text import PII, estimated_tokens, intent, paragraph_chunks, plain_label, redact, redacted_documents, text_chunks, with_plain_label
from tallgrass.functions.units import converted, graph_converted
from tallgrass.operators.assurance import daily_anchor, hash_chain, merkle_roots
from tallgrass.operators.emissions import facilities_by_emissions, sum_by_key
from tallgrass.operators.bills import redact_then_embed
from tallgrass.operators.extraction import FIELDS, by_ordinal_all, pivoted
from tallgrass.operators.formulas import Formula, check_units, ordered, run_formulas
from tallgrass.operators.suppliers import cost_curve_all, js_round
from tallgrass.plans.binding import extraction_field, metric_event
from tallgrass.sources.files import read_csv


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def events(spark, rows):
    return spark.createDataFrame([(1, k, v, u, "APPROVED") for k, v, u in rows], "tenant_id long, canonical_key string, value double, unit string, status string")


def test_golden_number(spark):
    out = run_formulas(events(spark, [("purchased_electricity_kwh", 80.0, "kWh")]), ["tenant_id"])
    assert {r["output"]: r["value"] for r in out.collect()}["scope2_from_grid"] == pytest.approx(0.05728)


def test_mixed_units_stop(spark):
    with pytest.raises(Exception, match="mixed units"):
        sum_by_key(events(spark, [("a", 1.0, "t"), ("a", 1.0, "kg")])).collect()


def test_mixed_units_stop_a_formula_run(spark):
    with pytest.raises(ValueError, match="mixed units"):
        run_formulas(events(spark, [("purchased_electricity_kwh", 80.0, "kWh"), ("purchased_electricity_kwh", 2.0, "MWh")]), ["tenant_id"])


def test_unlike_units_in_a_choice_stop():
    units = {"x": "t", "y": "kWh", "z": "t"}
    for text in ("coalesce(x, y)", "x + (z + y)", "greatest(x, y)", "if(x > y, 1, 0)"):
        with pytest.raises(ValueError, match="is in"):
            check_units([Formula("c", text, "t", ("x", "y", "z"))], units)
    check_units([Formula("c", "try_divide(x, y) * 1e-3", "t/kWh", ("x", "y")), Formula("d", "coalesce(x, z) + z", "t", ("x", "z"))], units)


def test_ids_name_one_row(spark, sf_dir):
    for frame in (metric_event, extraction_field):
        ids = frame(spark, sf_dir).select("id")
        assert ids.count() == ids.distinct().count()


def test_formula_cycle_and_units():
    a, b = Formula("a", "b + 1", "", ("b",)), Formula("b", "a + 1", "", ("a",))
    with pytest.raises(ValueError, match="depend on each other"):
        ordered((a, b))
    with pytest.raises(ValueError, match="is in"):
        check_units([Formula("c", "x + y", "t", ("x", "y"))], {"x": "t", "y": "kWh"})


def test_periods(spark):
    got = lambda t: tuple(str(x) for x in one(spark, parse_period(F.lit(t))))
    assert got("Q4 FY2024-25") == ("2025-01-01", "2025-03-31")
    assert got("fy2024-25") == ("2024-04-01", "2025-03-31")
    assert got("2024-01-05..2024-02-01") == ("2024-01-05", "2024-02-01")
    assert got("february 2024") == ("2024-02-01", "2024-02-29")
    assert one(spark, parse_period(F.lit("2024-13"))) is None
    parts = one(spark, split_into_months(F.lit("2024-01-15").cast("date"), F.lit("2024-03-02").cast("date")))
    assert [(str(p["start"]), str(p["end"])) for p in parts] == [("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]


def test_units(spark):
    df = spark.createDataFrame([(2.0, " Tonnes", "KG"), (1.0, "kWh", "kg"), (1.0, "usd", "usd"), (1.0, "foo", "kg"), (3.0, "crate", "kg")], "v double, a string, b string")
    out = converted(df, "v", "a", "b", {"crate": ("MASS", 20.0)}).orderBy("a").collect()
    assert {r["a"].strip(): (r["converted"], r["problem"]) for r in out} == {"Tonnes": (2000.0, None), "kWh": (None, "other family"), "usd": (None, "money"), "foo": (None, "unknown unit"), "crate": (60.0, None)}


def test_paths_and_rounding(spark):
    assert one(spark, is_ancestor(F.lit("a.b"), F.lit("a.b1"))) is False
    assert one(spark, parent_path(F.lit("a"))) is None
    assert one(spark, js_round(F.lit(-2.5))) == -2


def test_redaction(spark):
    row = redact(spark.createDataFrame([("Mail a.b@c.org or call 9876543210. ABCDE1234F. Dr. Jane Roe\nSalary: INR 5,000 a month",)], "t string"), "t").first()
    assert row["t"] == "Mail [REDACTED_EMAIL] or call [REDACTED_PHONE]. [REDACTED_PAN]. Dr. [REDACTED_NAME]\n[REDACTED_SALARY_LINE]"
    assert (row["email"], row["phone"], row["pan"], row["salary_line"], row["named_person"]) == (1, 1, 1, 1, 1)


def test_intents(spark):
    got = lambda t: one(spark, intent(F.lit(t)))
    assert [got(t) for t in ("What is GWP?", "why did it rise", "generate a section", "how was this calculated", "hello")] == ["DEFINITION", "ANALYTICAL", "WRITER", "PROVENANCE", "GENERAL"]


def test_paragraph_chunks(spark):
    words = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    assert [estimated_tokens(t) for t in ("", " ", "a", words(10))] == [0, 1, 1, 13]
    # whole paragraphs as long as they fit, with the line ends between them
    a, b, c = words(30, "a"), words(30, "b"), words(40, "c")
    assert paragraph_chunks(f"{a}\n \n\n{b}\n\n{c}\n", 100, 0) == [f"{a}\n\n{b}", c]
    assert paragraph_chunks(f"{a}\n\n{b}\n\n{c}", 100, 2) == [f"{a}\n\n{b}", f"b28 b29 {c}"]
    # a paragraph above the budget by its sentences, never packed with its neighbours
    long = " ".join(f"Word{i} is here." for i in range(60))
    chunks = paragraph_chunks(f"{a}\n\n{long}\n\n{b}", 100, 0)
    assert chunks[0] == a and chunks[-1] == b and " ".join(chunks[1:-1]) == long and all(len(x.split()) <= 100 for x in chunks)
    assert paragraph_chunks(words(200), 100, 5) == [words(200)] and paragraph_chunks(" \n\n ", 100, 5) == []
    rows = [(1, f"{a}\n\n{b}"), (2, None), (None, "x"), (2**53 + 1, "y")]
    out = text_chunks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 40, 0).collect()
    assert [tuple(r) for r in out] == [(1, 0, a), (1, 1, b), (None, 0, "x"), (2**53 + 1, 0, "y")]


def test_redacted_documents_against_python(spark, sf_dir):
    """Patterns of the same meaning by Python's engine, on texts that both read alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = [(10**6, "Mr. A B earns wages of Rs 5,000\ncall +91 98765 43210 or 080-1234-5678 now"), (10**6 + 1, None), (10**6 + 2, "1234 5678 9012 and ABCDE1234F to a.b@c.org"), (10**6 + 3, "")]
    rows = docs.union(spark.createDataFrame(more, docs.schema))
    out = {r["doc_id"]: r for r in redacted_documents(rows).collect()}
    n = 0
    for doc_id, text in ((r["doc_id"], r["text"]) for r in rows.collect()):
        if text is None or not text.isascii():
            continue
        got, n = out[doc_id], n + 1
        for kind, pattern, instead in PII:
            found = list(re.finditer(pattern, text))
            assert got[kind] == len(found), (doc_id, kind)
            text = re.sub(pattern, instead.replace("$1", r"\1"), text)
        assert got["text_md5"] == hashlib.md5(text.encode()).hexdigest(), doc_id
    assert n > 20 and out[10**6 + 1]["text_md5"] is None


def test_redacted_turns(spark, sf_dir):
    c = spark.createDataFrame([(1, 0, "mail a@b.org"), (2, 0, None), (9, 1, "plain")], "conv_id long, turn int, text string")
    e = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    out = sorted(map(tuple, redact_then_embed(c, e).collect()))
    assert [r[:4] for r in out] == [(1, 0, md5("mail [REDACTED_EMAIL]"), 2), (2, 0, None, 1), (9, 1, md5("plain"), None)]
    assert out[0][4] == pytest.approx([5**-0.5, 2 * 5**-0.5]) and out[1][4] == [1.0] and out[2][4] is None


def log_rows(spark, times):
    rows = [(i, t, None, "a", "T", "x", 0.0, at) for i, (t, at) in enumerate(times)]
    return spark.createDataFrame(rows, "id long, tenant_id long, actor_id string, action string, target_type string, target_id string, value double, created_at string").withColumn("created_at", F.to_timestamp("created_at"))


def test_hash_chain(spark):
    times = [(1 + i % 2, f"2024-01-{1 + i // 20:02} {i % 20 // 4:02}:00:{i % 4:02}") for i in range(60)]
    out = {r["id"]: r for r in hash_chain(log_rows(spark, times)).collect()}
    assert len(out) == 60
    for tenant in (1, 2):
        anchor, hours = b"\0" * 32, sorted({at[:13] for t, at in times if t == tenant})
        for hour in hours:
            prev, ids = b"\0" * 32, sorted((at, i) for i, (t, at) in enumerate(times) if t == tenant and at[:13] == hour)
            for _, i in ids:
                assert out[i]["prev_hash"] == prev.hex()
                prev = hashlib.sha256(prev + f"{i}|{tenant}||T|x|a".encode()).digest()
                assert out[i]["row_hash"] == prev.hex()
            anchor = hashlib.sha256(anchor + prev).digest()
            assert {out[i]["anchor"] for _, i in ids} == {anchor.hex()}


def tree(leaves):
    while len(leaves) > 1:
        leaves = [hashlib.sha256(leaves[i] + leaves[min(i + 1, len(leaves) - 1)]).digest() for i in range(0, len(leaves), 2)]
    return leaves[0].hex()


def test_merkle_roots_in_blocks(spark, monkeypatch):
    from tallgrass.operators import assurance

    monkeypatch.setattr(assurance, "LEVELS", 2)  # four hashes a task
    times = [(t, f"2024-01-0{d} 00:00:00") for t, n in ((1, 1), (2, 4), (3, 5), (4, 17), (5, 70)) for d in (1, 2) for _ in range(n + d)]
    log, leaf = log_rows(spark, times), lambda i, t: hashlib.sha256(f"{i}|{t}||T|x|a".encode()).digest()
    want = {(t, at[:10]): [leaf(i, t) for i, x in enumerate(times) if x == (t, at)] for t, at in times}
    out = {(r["tenant_id"], r["day"]): (r["leaves"], r["root"]) for r in merkle_roots(log).collect()}
    assert out == {k: (len(v), tree(v)) for k, v in want.items()}
    day = {r["tenant_id"]: r for r in daily_anchor(log).collect()}
    for t in range(1, 6):
        r, ids = day[t], [i for i, x in enumerate(times) if x == (t, "2024-01-01 00:00:00")]
        root = tree(want[t, "2024-01-01"])
        assert (r["day"], r["leaves"], r["root"], r["chained"], r["first_id"], r["last_id"]) == ("2024-01-01", len(ids), root, hashlib.sha256(root.encode()).hexdigest(), ids[0], ids[-1])


def test_pivot_takes_the_last_value(spark):
    day = lambda d: f"1996-01-{d:02} 00:00:00"
    rows = [(7, 1, 0, 5, 40.0, day(1)), (7, 1, 0, 6, 10.0, day(2)), (7, 1, 0, 4, 30.0, day(1))]
    line = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_shipdate string")
    assert pivoted(line).first()[FIELDS[(49 + 5) % len(FIELDS)]] == 8.0


def test_graph_of_units(spark):
    rows = [(3.0, "Lakhs", "crore"), (1.0, "MW-h", "kcal"), (2.0, "scm", "L"), (2.0, "nm3", "S C M"), (5.0, "pct", "%"), (5.0, "nos", "pct"), (1.0, "USD", "Rs."), (1.0, "foo", "kg"), (1.0, None, "kg"), (7.0, "megalitre", "ml")]
    out = graph_converted(spark.createDataFrame(rows, "v double, a string, b string"), "v", "a", "b").collect()
    want = {"Lakhs": 0.03, "MW-h": 3.6e6 / 4.184, "scm": None, "nm3": 2.0, "pct": 5.0, "nos": None, "USD": None, "foo": None, None: None, "megalitre": 7.0}
    assert {r["a"]: r["converted"] for r in out} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}


def test_plain_labels(spark):
    assert plain_label(" Ｔｏtal ﬁne (m²)—a/b:c.d–e,[f]-g ") == "total fine m2 a b c d e f g" and plain_label("विद्युत") == "विद्युत"
    df = spark.createDataFrame([("A-B",), ("A-B",), (None,), ("",)], "l string")
    assert sorted(r["plain"] for r in with_plain_label(df, "l").collect()) == ["", "", "a b", "a b"]


def test_csv_cap(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1; 2\n\n3;4\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv")).collect()] == [("1", "2"), ("3", "4")]
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "x.csv"), 1)


def test_ranks_of_all_documents(spark):
    rows = [(f"f{i:05d}", i % 500, (i * 7 % 100) / 100) for i in range(3000)]
    out = by_ordinal_all(spark.createDataFrame(rows, "id string, document_id long, confidence double")).collect()
    place = lambda c: 0 if c >= 0.85 else 1 if c >= 0.65 else 2
    want = [i for i, _, c in sorted(rows, key=lambda r: (place(r[2]), r[0]))]
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in out) == list(range(1, 3001))


def test_sorts_return_all_rows(spark):
    part = spark.createDataFrame([(i, i * 37 % 50, 900.0 + i) for i in range(1, 301)], "p_partkey long, p_size int, p_retailprice double")
    out = [(r["mac"], r["id"]) for r in cost_curve_all(part).collect()]
    assert len(out) == 300 and out == sorted(out)
    rows = [(i, "ghg_scope1_total", float(i * 7 % 90 + 1), "t", "APPROVED") for i in range(120)]
    e = spark.createDataFrame(rows, "scope_node_id long, canonical_key string, value double, unit string, status string")
    out = [(-r["emissions"], r["scope_node_id"]) for r in facilities_by_emissions(e).collect()]
    assert len(out) == 120 and out == sorted(out)
