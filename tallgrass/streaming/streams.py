"""Structured Streaming over the events: a log with offsets into committed files, tumbling counters, decisions by what a key has done; each runs over what is there and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..plans.catalog import ORACLES, QUERIES
from ..sources.scratch import scratch_path
from .ordered import OUT, DailyLedger, Fold, SlidingLog, dropped_rows, stream_fold, waiting_rows
from .records import drained, flush_sink, record_stream

#: Files that one batch of a stream takes at most.
BATCH_FILES = 64


def file_stream(spark: SparkSession, path: str, like: DataFrame, most: int = BATCH_FILES) -> DataFrame:
    """New Parquet files below a path or pattern as a stream, at most so many in a batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", most).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; a pattern, so that it may be one file or a folder."""
    return file_stream(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(f"{sf_dir}/events.parquet"))


def started(writer: DataStreamWriter, checkpoint: str, every: str | None) -> StreamingQuery:
    """Run until what is there has been read, or on and on with a trigger ``every`` so long; the query has ended."""
    writer = writer.option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    query.awaitTermination()
    return query


def span(rows: DataFrame, at: str) -> str:
    """The time between the first and the last row, and a second: no row of a table is later than that behind another, whatever the order of its files."""
    ends = rows.agg(F.unix_seconds(F.min(F.col(at).cast("timestamp"))).alias("a"), F.unix_seconds(F.max(F.col(at).cast("timestamp"))).alias("b")).first()
    return f"{(ends['b'] or 0) - (ends['a'] or 0) + 1} seconds"


def str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a log with offsets into files that a flush commits."""
    path = scratch_path(spark, "feedback")
    stream = record_stream(spark, f"{sf_dir}/events.parquet", 8_192, scratch_path(spark, "feedback-read"), TRIGGER, "_first")
    drained(flush_sink(stream.select("event_id", "user_id", "event_type", "_first"), path, scratch_path(spark, "feedback-state"), flush="_first"))
    return spark.read.schema("event_id long, user_id long, event_type string").json(path)


def src14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by batches of so many records, and how many each batch had."""
    path = scratch_path(spark, "events")
    stream = record_stream(spark, f"{sf_dir}/events.parquet", RECORDS, most=TRIGGER, number="_first")
    stream = stream.select("event_id", "event_type", "value", (F.col("_first") / RECORDS).cast("long").alias("batch"))
    writer = stream.writeStream.foreachBatch(by_batch(path, "trigger")).option("checkpointLocation", scratch_path(spark, "events-state"))
    drained(writer.start())
    rows = spark.read.schema("event_id long, event_type string, value double, batch long").parquet(path)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def snk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in files of JSON lines, one for each flush, named by its time; how many each has. The first flush is dated, so that names are known."""
    path = scratch_path(spark, "flushes")
    stream = record_stream(spark, f"{sf_dir}/events.parquet", FLUSH, most=TRIGGER, number="_first").select("event_id", "event_type", "_first")
    drained(flush_sink(stream, path, scratch_path(spark, "flushes-state"), now="2024-01-31T12:00:00+00:00", flush="_first"))
    rows = spark.read.schema("event_id long, event_type string").json(path)
    return rows.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("flush")).agg(F.count("*").alias("n"))


def tumbling_counts(stream: DataFrame, key: Column, length: str, late: str) -> DataFrame:
    """Events of a key in each window; state of windows older than the watermark goes, and rows that come more than ``late`` behind the newest are dropped (``dropped_rows``)."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", length).alias("w"), key.alias("key")).agg(F.count("*").alias("n"))


def by_batch(path: str, name: str = "batch") -> Callable[[DataFrame, int], None]:
    """Write each batch of Spark to a folder of its own, so that a batch that runs again replaces itself."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/{name}={batch}")


def counted(stream: DataFrame, key: Column, length: str, limit: int, late: str, every: str | None = None) -> DataFrame:
    """Counts and whether they are over the limit; a batch writes the windows that it has changed, the newest count of a window is its largest.

    A read that ends stops at once if the watermark has dropped a row: ``late``
    must be as long as rows can be behind, ``span`` of a table for all orders.
    """
    spark, path = stream.sparkSession, scratch_path(stream.sparkSession, "counts")
    counts = tumbling_counts(stream, key, length, late)
    query = started(counts.writeStream.foreachBatch(by_batch(path)).outputMode("update"), scratch_path(spark, "counts-state"), every)
    if lost := dropped_rows(query):
        raise ValueError(f"{lost} rows came more than {late} late")
    newest = spark.read.schema(counts.schema).parquet(path).groupBy("w.start", "key").agg(F.max("n").alias("n"))
    return newest.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "key", "n", (F.col("n") > limit).alias("over_limit"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def str2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(event_stream(spark, sf_dir), (F.col("user_id") % 8).cast("long"), "1 hour", 3, span(events(spark, sf_dir), "ts"))


def str4(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("tenant-"), (F.col("user_id") % 8).cast("string"))), F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return counted(event_stream(spark, sf_dir), key, "1 day", 5, span(events(spark, sf_dir), "ts"))


def keyed(e: DataFrame, key: Column) -> DataFrame:
    return e.select(key.cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("amount"))


def decided(spark: SparkSession, sf_dir: str, key: Column, fold: Fold) -> DataFrame:
    """``stream_fold`` over all events: what the stream has let go, and what it holds when it ends."""
    path, checkpoint = scratch_path(spark, "decided"), scratch_path(spark, "decided-state")
    rows = stream_fold(keyed(event_stream(spark, sf_dir), key), fold, span(events(spark, sf_dir), "ts"))
    started(rows.writeStream.format("parquet").option("path", path), checkpoint, None)
    return spark.read.schema(OUT).parquet(path).union(waiting_rows(spark, checkpoint, fold))


def str3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event is one of at most three that its tenant has in any six hours; events that are refused do not count."""
    found = decided(spark, sf_dir, F.col("user_id") % 50, SlidingLog(LIMIT, HOURS * 3600.0))
    return found.select(F.col("id").alias("event_id"), "accepted", F.col("told").cast("long").alias("n"))


def str5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user has spent on a day, up to the ceiling; who has reached it is refused until midnight."""
    found = decided(spark, sf_dir, F.col("user_id"), DailyLedger(CEILING))
    return found.select(F.col("id").alias("event_id"), F.round("told", 6).alias("spent"), "accepted")


LIMIT, HOURS, CEILING = 3, 6, 100.0
#: Records of a batch and of a flush in the queries; of a trigger, which takes many of them.
RECORDS, FLUSH, TRIGGER = 64, 2_000, 1 << 22
_COUNT = "SELECT strftime(time_bucket(INTERVAL {length}, ts), '%Y-%m-%d %H:%M:%S') AS start, {key} AS key, count(*)::BIGINT AS n, count(*) > {limit} AS over_limit FROM events GROUP BY 1, 2"
QUERIES.update(src14=src14, snk5=snk5, str1=str1, str2=str2, str3=str3, str4=str4, str5=str5)
ORACLES.update(
    src14=f"SELECT k // {RECORDS} AS batch, count(*)::BIGINT AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT event_id, row_number() OVER () - 1 AS k FROM events) GROUP BY 1",
    snk5=f"SELECT strftime(TIMESTAMP '2024-01-31 12:00:00' + to_seconds((k // {FLUSH})::BIGINT), '%Y%m%dT%H%M%SZ.jsonl') AS flush, count(*)::BIGINT AS n FROM (SELECT row_number() OVER () - 1 AS k FROM events) GROUP BY 1",
    str1="SELECT event_id, user_id, event_type FROM events",
    str2=_COUNT.format(length="1 HOUR", key="(user_id % 8)::BIGINT", limit=3),
    str3=f"""WITH RECURSIVE e AS (SELECT event_id, user_id % 50 AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT DISTINCT key, 0::BIGINT AS k, []::BIGINT[] AS log, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted FROM e
UNION ALL SELECT key, k, CASE WHEN len(kept) < {LIMIT} THEN list_append(kept, us) ELSE kept END, event_id, len(kept) < {LIMIT} FROM (SELECT e.*, list_filter(r.log, lambda t: t >= e.us - {HOURS * 3_600_000_000}) AS kept FROM r JOIN e ON r.key = e.key AND e.k = r.k + 1))
SELECT event_id, accepted, len(log)::BIGINT AS n FROM r WHERE k > 0""",
    str4=_COUNT.format(length="1 DAY", key="CASE WHEN user_id % 3 = 0 THEN concat('tenant-', user_id % 8) ELSE concat('user-', user_id) END", limit=5),
    str5=f"""WITH RECURSIVE e AS (SELECT event_id, user_id, ts::DATE AS day, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, day, 0::BIGINT AS k, 0::DOUBLE AS spent, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted FROM e
UNION ALL SELECT e.user_id, e.day, e.k, CASE WHEN spent < {CEILING} THEN spent + greatest(value, 0) ELSE spent END, e.event_id, spent < {CEILING} FROM r JOIN e ON r.user_id = e.user_id AND r.day = e.day AND e.k = r.k + 1)
SELECT event_id, round(spent, 6) AS spent, accepted FROM r WHERE k > 0""",
)
