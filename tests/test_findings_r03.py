"""What the findings of round 3 named: one test for each step that was mended."""

import json
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tests.compare import answer
from tests.compare import rows as plain_rows

from tallgrass import registry
from tallgrass.functions import inverted_index, vector_index
from tallgrass.operators import layout
from tallgrass.streaming import ordered, records, streams

#: A value just three deviations from its eight priors, of which Welford's update makes 5.999999999999999.
EDGE = [48.0, 41.0, 47.0, 36.0, 42.0, 41.0, 34.0, 31.0, 22.0]


@pytest.mark.parametrize("name", ["sc_m12", "rules_field", "wn3"])
def test_three_deviations_as_the_sql_rounds_them(spark, tmp_path, name):
    rows = [(2, 7, 0, k % 7 + 1, v, 1.0, 0.0, 0.0, "N", "O", f"1996-12-{k + 1:02d}") for k, v in enumerate(EDGE)]
    line = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string")
    line.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")).write.parquet(path := f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * REPLACE (l_shipdate::TIMESTAMP AS l_shipdate) FROM '{path}/*.parquet'")
    cur = c.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = plain_rows(names, cur.fetchall())
    assert want and answer(registry.QUERIES[name](spark, str(tmp_path))) == (sorted(names), want)


def test_many_batches_in_a_trigger(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / x) for x in ("log", "out", "state"))
    os.makedirs(source)
    for name, a, b in (("a", 0, 100), ("b", 100, 330)):  # batches lie across files
        pq.write_table(pa.table({"id": range(a, b)}), f"{source}/{name}.parquet", row_group_size=30)
    monkeypatch.setattr(records, "SLICE", 128)
    stream = lambda: records.record_stream(spark, source, 64, None, 300, "_first")
    query = records.flush_sink(stream(), out, state, now="2024-05-01T23:59:58+00:00", flush="_first")
    records.drained(query)
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [256, 74]
    pq.write_table(pa.table({"id": range(330, 400)}), f"{source}/c.parquet")
    records.drained(records.flush_sink(stream(), out, state, now="2024-05-01T23:59:58+00:00", flush="_first"))
    names = sorted(n for n in os.listdir(out) if n.endswith(".jsonl"))
    assert names[:3] == ["20240501T235958Z.jsonl", "20240501T235959Z.jsonl", "20240502T000000Z.jsonl"]
    ids = [[json.loads(line)["id"] for line in open(f"{out}/{n}")] for n in names]
    assert [len(x) for x in ids] == [64, 64, 64, 64, 64, 10, 64, 6] and sum(ids, []) == list(range(400))


def test_crash_among_the_names_of_a_trigger(tmp_path):
    writer = records.FlushWriter(StructType().add("id", "long").add("f", "long"), {"path": str(tmp_path), "now": "2024-05-01T10:00:00+00:00", "flush": "f"})
    write = lambda: [writer.write(iter([(3, 2), (4, 2)])), writer.write(iter([(1, 0), (2, 1)]))]
    writer.commit(write(), 0)
    names = [f"20240501T10000{k}Z.jsonl" for k in range(3)]
    os.remove(f"{tmp_path}/{names[1]}")  # two names were taken, the third not
    writer.commit(write(), 0)
    assert [[json.loads(x)["id"] for x in open(f"{tmp_path}/{n}")] for n in names] == [[1], [2], [3, 4]] and not os.listdir(f"{tmp_path}/_pending")


@pytest.mark.parametrize("name", ["snk5", "src14", "str1"])
def test_triggers_do_not_grow_with_batches(spark, sf_dir, monkeypatch, name):
    queries = []
    monkeypatch.setattr(streams, "drained", lambda q: (queries.append(q), records.drained(q)))
    registry.QUERIES[name](spark, sf_dir).count()
    assert len([p for p in queries[0].recentProgress if p["numInputRows"]]) == 1


def test_postings_move_once_for_all_queries(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted_index, "QUERIES", 10)
    monkeypatch.setattr(inverted_index, "DOCUMENTS", 16)
    texts = spark.createDataFrame([(i, f"common word{i % 7} rare{i}") for i in range(60)], "id long, text string")
    index = inverted_index.build(texts, str(tmp_path / "index"))
    queries = spark.createDataFrame([(i, f"common rare{i}") for i in range(45)], "query long, text string")  # five rounds, four blocks
    paths = []
    monkeypatch.setattr(inverted_index, "scratch_path", lambda spark, name: paths.append(f"{tmp_path}/{name}") or paths[-1])
    found = inverted_index.search(index, queries, 3).where("rank = 1").select("query", "id").collect()
    assert sorted(map(tuple, found)) == [(i, i) for i in range(45)]
    assert spark.read.parquet(f"{tmp_path}/blocks").agg(F.sum(F.size("at"))).first()[0] == 60 + 45


def test_a_task_holds_few_cosines(monkeypatch):
    monkeypatch.setattr(vector_index, "COSINES", 1_000)
    r = np.random.default_rng(1)
    mids = vector_index.unit(r.normal(size=(100, 8)))
    queries = pd.DataFrame({"query": range(300), "vector": list(r.normal(size=(300, 8))), "floor": [None, *[0.9] * 299]}).astype({"floor": float})
    near, wide = list(vector_index.cells_of(iter([queries]), mids, np.full(100, 0.3), 4, False)), list(vector_index.cells_of(iter([queries]), mids, np.full(100, 0.3), 4, True))
    assert max(len(f) for f in near + wide) <= 1_000 and len(pd.concat(near)) == 1_200
    found = pd.concat(near + wide)
    assert (found.groupby("query")["cell"].nunique() == found.groupby("query").size()).all() and (found["query"] == 0).sum() == 100
    angle = np.arccos(np.clip(vector_index.unit(np.stack(queries["vector"])) @ mids.T, -1, 1)) - 0.3
    assert len(found) >= (angle <= np.arccos(0.9)).sum() and len(found) < 30_000


@pytest.mark.parametrize(("name", "limit"), [("ag22", "8k"), ("jn16", "64k")])
def test_labels_are_not_sorted_to_meet_their_keys(spark, sf_dir, name, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)  # as if the tables were larger
    try:
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("step", [layout.harvest, layout.mapped])
def test_texts_are_looked_at_once(spark, step):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def looked_at(text):
        seen.add(1)
        return text

    texts = spark.createDataFrame([(k, f"Units billed: {k}  kWh\nWaste  {k}  t") for k in range(20)], "id long, text string")
    rows = step(texts.select("id", looked_at("text").alias("text")), layout.alias_frame(texts)).collect()
    assert seen.value == 20 and len(rows) >= 40


def test_a_frame_holds_the_waiting_rows_of_many_keys(monkeypatch):
    monkeypatch.setattr(ordered, "ROWS", 50)
    columns = (("memory", [], float), ("at", [1, 2, 2], np.int64), ("id", [5, 3, 4], np.int64), ("amount", [60.0, -1.0, 70.0], float))
    state = pd.DataFrame({"key": [f"k{k}" for k in range(30)], **{c: [np.array(v, t).tobytes()] * 30 for c, v, t in columns}})
    frames = list(ordered.let_go(iter([state]), ordered.DailyLedger(100.0)))
    assert [len(f) for f in frames] == [51, 39]
    assert frames[0].iloc[:3].values.tolist() == [["k0", 5, True, 60.0], ["k0", 3, True, 60.0], ["k0", 4, True, 130.0]]
