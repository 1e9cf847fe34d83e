"""Streams with offsets, commits and keyed state: any order of files, restarts, faults."""

import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallgrass.streaming import ordered, records, streams

START = 1_700_000_000


def log(spark, folder, name, a, b):
    """One file of records ``a`` to ``b`` with a name of its own, published by rename."""
    spark.range(a, b).select("id", F.concat(F.lit("v"), "id").alias("v")).coalesce(1).write.parquet(f"{folder}/_{name}")
    part = next(f for f in os.listdir(f"{folder}/_{name}") if f.endswith(".parquet"))
    os.rename(f"{folder}/_{name}/{part}", f"{folder}/{name}.parquet")


def flushed(folder):
    names = sorted(n for n in os.listdir(folder) if n.endswith(".jsonl"))
    return names, [json.loads(line)["id"] for n in names for line in open(f"{folder}/{n}")]


@pytest.fixture
def folders(tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    return [str(source), *(str(tmp_path / x) for x in ("out", "state", "acks/ack"))]


def test_batches_of_records_and_restart(spark, folders):
    source, out, state, ack = folders
    log(spark, source, "a", 0, 100)
    log(spark, source, "b", 100, 150)
    query = records.flush_sink(records.record_stream(spark, source, 64, ack), out, state, now="2024-05-01T23:59:59+00:00")
    records.drained(query)
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [64, 64, 22]
    names, ids = flushed(out)
    assert names == ["20240501T235959Z.jsonl", "20240502T000000Z.jsonl", "20240502T000001Z.jsonl"] and ids == list(range(150))
    assert not os.listdir(f"{out}/_pending") and json.load(open(ack))["record"] <= 150
    log(spark, source, "c", 150, 300)
    query = records.flush_sink(records.record_stream(spark, source, 64, ack), out, state)
    records.drained(query)
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [64, 64, 22]
    assert sorted(flushed(out)[1]) == list(range(300))


def test_empty_log_needs_a_schema(spark, folders):
    with pytest.raises(Exception, match="no Parquet file"):
        records.record_stream(spark, folders[0])


def test_flush_that_fails_leaves_no_file(spark, folders):
    source, out, state, ack = folders
    log(spark, source, "a", 0, 40)
    bad = records.record_stream(spark, source, 64, ack).select("id", F.when(F.col("id") == 30, F.raise_error(F.lit("broken"))).otherwise(F.col("v")).alias("v"))
    query = records.flush_sink(bad, out, state)
    with pytest.raises(StreamingQueryException, match="broken"):
        query.awaitTermination()
    assert flushed(out) == ([], []) and not os.path.exists(ack)
    records.drained(records.flush_sink(records.record_stream(spark, source, 64, ack), out, state))
    assert sorted(flushed(out)[1]) == list(range(40))


def writer(out):
    from pyspark.sql.types import StructType

    return records.FlushWriter(StructType().add("id", "long"), {"path": out, "now": "2024-05-01T10:00:00+00:00"})


def test_flush_is_published_once(tmp_path):
    out = str(tmp_path)
    w = writer(out)
    w.commit([w.write(iter([(1,), (2,)])), w.write(iter([])), None], 0)
    assert flushed(out) == (["20240501T100000Z.jsonl"], [1, 2])
    w.commit([w.write(iter([(1,), (2,)]))], 0)  # the same flush again, after a crash behind its commit
    assert flushed(out) == (["20240501T100000Z.jsonl"], [1, 2]) and not os.listdir(f"{out}/_pending")
    os.remove(f"{out}/20240501T100000Z.jsonl")  # a crash between the announcement and the names
    w.commit([w.write(iter([(1,), (2,)]))], 0)
    assert flushed(out) == (["20240501T100000Z.jsonl"], [1, 2])
    a, b = w.write(iter([(3,)])), w.write(iter([(4,)]))
    w.abort([a, b], 1)
    w.commit([], 1)
    assert len(flushed(out)[0]) == 1 and not os.listdir(f"{out}/_pending")


FOLDS = [ordered.SlidingLog(3, 60.0), ordered.DailyLedger(50.0)]


def timed(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, s long, amount double").select("key", "id", F.timestamp_seconds(F.col("s") + START).alias("at"), "amount")


def files_of(spark, folder, parts):
    os.makedirs(folder, exist_ok=True)
    had = len(os.listdir(folder))
    for i, p in enumerate(parts):
        timed(spark, p).coalesce(1).write.parquet(f"{folder}/{had + i:03d}")


def run(spark, folder, fold, late, out, state):
    stream = streams.file_stream(spark, f"{folder}/*", timed(spark, []), 1)
    rows = ordered.stream_fold(stream, fold, late)
    return streams.started(rows.writeStream.format("parquet").option("path", out), state, None)


def all_rows(spark, fold, out, state):
    return sorted(map(tuple, spark.read.schema(ordered.OUT).parquet(out).union(ordered.waiting_rows(spark, state, fold)).collect()))


@pytest.mark.parametrize("fold", FOLDS, ids=["log", "ledger"])
def test_any_order_within_the_bound(spark, tmp_path, fold):
    r = random.Random(2)
    rows = [(f"k{r.randrange(4)}", i, i * 7 + r.randrange(5), float(r.randrange(-2, 20))) for i in range(200)]
    rows[6:6] = [rows[5], rows[5]]  # repeated rows are rows
    parts = [rows[k : k + 25] for k in range(0, len(rows), 25)]
    parts[1], parts[3] = parts[3], parts[1]  # at most some 700 seconds late
    want = sorted(map(tuple, ordered.batch_fold(timed(spark, rows), fold).collect()))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    files_of(spark, source, parts[:5])
    assert ordered.dropped_rows(run(spark, source, fold, "800 seconds", out, state)) == 0
    early = spark.read.schema(ordered.OUT).parquet(out).count()
    files_of(spark, source, parts[5:])  # and goes on where it has stopped
    assert ordered.dropped_rows(run(spark, source, fold, "800 seconds", out, state)) == 0
    assert 0 < early < spark.read.schema(ordered.OUT).parquet(out).count() < len(rows)
    assert all_rows(spark, fold, out, state) == want and any(not x[2] for x in want)


def test_state_ends_and_late_rows_are_counted(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    files_of(spark, source, [[("a", 1, 0, 1.0), ("b", 2, 5, 1.0)], [("c", 3, 400_000, 1.0)], [("c", 4, 500_000, 1.0)], [("c", 6, 500_001, 1.0), ("a", 5, 10, 1.0)]])
    query = run(spark, source, ordered.DailyLedger(10.0), "10 seconds", out, state)
    assert ordered.dropped_rows(query) == 1  # row 5
    held = spark.read.format("statestore").load(state).select("key.key").collect()
    assert [h["key"] for h in held] == ["c"]  # the days of a and b are over
    assert sorted(r["id"] for r in spark.read.schema(ordered.OUT).parquet(out).collect()) == [1, 2, 3]
    assert [r[1] for r in all_rows(spark, ordered.DailyLedger(10.0), out, state)] == [1, 2, 3, 4, 6]


def test_windows_of_many_files_in_reverse(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = sorted(e.collect(), key=lambda r: r["ts"], reverse=True)
    n = -(-len(rows) // 70)
    for k in range(70):
        spark.createDataFrame(rows[k * n : (k + 1) * n], e.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}")) if rows[k * n : (k + 1) * n] else None
    stream = lambda: streams.file_stream(spark, str(tmp_path / "in" / "*"), e, 16)
    found = streams.counted(stream(), (F.col("user_id") % 8).cast("long"), "1 hour", 3, streams.span(e, "ts"))
    assert found.agg(F.sum("n")).first()[0] == len(rows)
    with pytest.raises(ValueError, match="late"):
        streams.counted(stream(), (F.col("user_id") % 8).cast("long"), "1 hour", 3, "1 hour")
