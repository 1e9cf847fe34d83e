"""A log of records as a stream with offsets, and a sink of JSON lines that commits.

The source (format ``record_log``) numbers the records of a folder of Parquet
files by file name and place.  A batch has so many records at most; a trigger
takes one batch or, told so, many, each of which lies whole and in order in one
task and is named by its first record.  What a query has written for good is
acknowledged in a small file, for others to see.
The sink (format ``flushed_lines``) writes a file for each flush below a folder
that readers pass over, and gives it its name ``yyyymmddThhmmssZ.jsonl`` only
when all flushes of the trigger are there.  Paths may be of any file system that pyarrow
knows by its address.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Records that a batch has at most; those of a task, in whole batches.
BATCH, SLICE = 64, 131_072


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(files: fs.FileSystem, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all; its folder is made if need be."""
    files.create_dir(path.rpartition("/")[0] or "/", recursive=True)
    with files.open_output_stream(f"{path}.part") as out:
        out.write(text.encode())
    files.move(f"{path}.part", path)


def got(files: fs.FileSystem, path: str) -> str | None:
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as f:
        return f.read().decode()


def log_files(path: str) -> list[str]:
    """The Parquet files of a log by name; one that is published later must have a later name."""
    files, top = opened(path)
    if files.get_file_info(top).type == fs.FileType.File:
        return [top]
    found = files.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(top) :].split("/"))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not hidden(f.path))


@dataclass
class Slice(InputPartition):
    """Records from number ``first`` on, as (file, start, end); ``trigger`` is the record that their trigger began with."""

    ranges: list[tuple[str, int, int]]
    first: int
    trigger: int


class RecordLogReader(DataSourceStreamReader):
    """Offsets are numbers of records; a batch ends ``batch`` records after the one before it, a trigger with a batch."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.batch, self.ack = options["path"], int(options.get("batch", BATCH)), options.get("ack")
        if self.batch < 1:
            raise ValueError("batch is 1 at least")
        self.most = max(1, int(options.get("most", self.batch)) // self.batch) * self.batch
        self.number = options.get("number")
        self.columns = [c for c in schema.fieldNames() if c != self.number]
        self.at: int | None = None
        self.sizes: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"record": 0}

    def known(self) -> list[tuple[str, int]]:
        """Files and their records, by the files' footers."""
        files, _ = opened(self.path)
        names = log_files(self.path)
        for f in names:
            if f not in self.sizes:
                with files.open_input_file(f) as x:
                    self.sizes[f] = pq.ParquetFile(x).metadata.num_rows
        return [(f, self.sizes[f]) for f in names]

    def latestOffset(self) -> dict:
        # after a restart Spark asks for the partitions of the last batch first, which tells where it ended
        self.at = min((self.at or 0) + self.most, sum(n for _, n in self.known()))
        return {"record": self.at}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        size = max(1, SLICE // self.batch) * self.batch
        at = range(start["record"], end["record"], size)
        out, first = [Slice([], a, start["record"]) for a in at], 0
        for f, n in self.known():
            a, b = max(start["record"], first), min(end["record"], first + n)
            while a < b:
                x = out[(a - start["record"]) // size]
                c = min(b, x.first + size)
                x.ranges.append((f, a - first, c - first))
                a = c
            first += n
        self.at = end["record"]
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        record = part.first
        for name, start, end in part.ranges:
            with files.open_input_file(name) as f:
                parquet, at = pq.ParquetFile(f), 0
                for k in range(parquet.metadata.num_row_groups):
                    n = parquet.metadata.row_group(k).num_rows
                    a, b = max(start, at), min(end, at + n)
                    if a < b:
                        for x in parquet.read_row_group(k, self.columns).slice(a - at, b - a).select(self.columns).to_batches(16_384):
                            yield self.told(x, record - part.trigger, part.trigger)
                            record += x.num_rows
                    at += n

    def told(self, rows: pa.RecordBatch, before: int, trigger: int) -> pa.RecordBatch:
        """``rows``, ``before`` of which lie between the trigger's start and them, with the first record of their batch if that was asked for."""
        if not self.number:
            return rows
        firsts = np.arange(before, before + rows.num_rows) // self.batch * self.batch + trigger
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(firsts, pa.int64())], [*rows.schema.names, self.number])

    def commit(self, end: dict) -> None:
        if self.ack:
            files, path = opened(self.ack)
            put(files, path, json.dumps(end))


class RecordLog(DataSource):
    """Options: ``path``; ``batch``, records in a batch; ``most``, those of a trigger; ``number``, a column for the record that a row's batch begins with; ``ack``, the file that tells what is written for good."""

    @classmethod
    def name(cls) -> str:
        return "record_log"

    def schema(self) -> StructType:
        names = log_files(self.options["path"])
        if not names:
            raise ValueError(f"no Parquet file below {self.options['path']}: give the schema")
        files, _ = opened(self.options["path"])
        with files.open_input_file(names[0]) as f:
            found = from_arrow_schema(pq.ParquetFile(f).schema_arrow)
        number = self.options.get("number")
        if number in found.fieldNames():
            raise ValueError(f"{number} is a column of the log")
        return found.add(number, "long") if number else found

    def streamReader(self, schema: StructType) -> RecordLogReader:
        return RecordLogReader(schema, dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """(flush, file) of a task, in their order."""

    files: list[tuple[int, str]] = field(default_factory=list)


class FlushWriter(DataSourceStreamWriter):
    """One file for each flush of a task; a trigger is a flush unless the column ``flush`` tells them apart."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.now, self.flush = options["path"], options.get("now"), options.get("flush")
        self.names = schema.fieldNames()

    def write(self, rows: Iterator) -> Written:
        files, top = opened(self.path)
        files.create_dir(f"{top}/_pending")
        place = self.names.index(self.flush) if self.flush else None
        kept = [(k, n) for k, n in enumerate(self.names) if k != place]
        out = Written()
        for flush, some in groupby(rows, lambda r: 0 if place is None else r[place]):
            out.files.append((flush, path := f"{top}/_pending/{uuid.uuid4().hex}"))
            with files.open_output_stream(path) as lines:
                for r in some:
                    lines.write((json.dumps({n: r[k] for k, n in kept}, default=str, ensure_ascii=False) + "\n").encode())
        return out

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, top = opened(self.path)
        files.create_dir(f"{top}/_flushes")
        written, told = sorted(x for m in messages if m for x in m.files), f"{top}/_flushes/{batchId}"
        paths, alone = [p for _, p in written], len({f for f, _ in written}) == len(written)
        if (before := got(files, told)) is not None:
            # these flushes were announced before: names that they have not taken yet are taken now
            names = json.loads(before)
            missing = [n for n in names if files.get_file_info(f"{top}/{n}").type != fs.FileType.File]
            if missing and len(names) == len(paths) and (alone or len(missing) == len(names)):
                pairs = list(zip(paths, names, strict=True))
                self.publish(files, top, [x for x in pairs if x[1] in set(missing)])
                self.gone(files, [p for p, n in pairs if n not in set(missing)])
            elif missing:
                raise RuntimeError(f"flush {batchId} is there in part: {', '.join(missing)} missing")
            else:
                self.gone(files, paths)
            return
        parts = [len(list(some)) for _, some in groupby(written, lambda x: x[0])]
        names = [f"{stamp}{f'-{k}' if k else ''}.jsonl" for stamp, n in zip(self.stamps(files, top, len(parts)), parts, strict=True) for k in range(n)]
        put(files, told, json.dumps(names))
        self.publish(files, top, list(zip(paths, names, strict=True)))

    def stamps(self, files: fs.FileSystem, top: str, n: int) -> list[str]:
        """The first ``n`` seconds from now on that name no file yet."""
        at = datetime.fromisoformat(self.now) if self.now else datetime.now(timezone.utc)
        out, taken = [], None
        while len(out) < n:
            stamp = at.strftime("%Y%m%dT%H%M%SZ")
            if taken is None and files.get_file_info(f"{top}/{stamp}.jsonl").type == fs.FileType.File:
                taken = {x.base_name for x in files.get_file_info(fs.FileSelector(top))}
            if taken is None or f"{stamp}.jsonl" not in taken:
                out.append(stamp)
            at += timedelta(seconds=1)
        return out

    def publish(self, files: fs.FileSystem, top: str, pairs: list[tuple[str, str]]) -> None:
        for p, n in pairs:
            files.move(p, f"{top}/{n}")

    def gone(self, files: fs.FileSystem, paths: list[str]) -> None:
        for p in paths:
            if files.get_file_info(p).type == fs.FileType.File:
                files.delete_file(p)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.gone(opened(self.path)[0], [p for m in messages if m for _, p in m.files])


class FlushedLines(DataSource):
    """Options: ``path``; ``now``, an ISO time with zone that stands for the time of a flush; ``flush``, a column that tells the flushes of a trigger apart and is not written."""

    @classmethod
    def name(cls) -> str:
        return "flushed_lines"

    def streamWriter(self, schema: StructType, overwrite: bool) -> FlushWriter:
        return FlushWriter(schema, dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    for kind in (RecordLog, FlushedLines):
        spark.dataSource.register(kind)
    return spark


def record_stream(spark: SparkSession, path: str, batch: int = BATCH, ack: str | None = None, most: int | None = None, number: str | None = None) -> DataFrame:
    """The records of a log as a stream of at most ``batch`` records a batch; a trigger takes one, or whole ones of ``most`` records together.

    The column ``number`` holds the record that a row's batch begins with.
    """
    told = {"path": path, "batch": str(batch), "ack": ack, "most": most and str(most), "number": number}
    return registered(spark).readStream.format("record_log").options(**{k: v for k, v in told.items() if v}).load()


def flush_sink(stream: DataFrame, path: str, checkpoint: str, every: str | None = None, now: str | None = None, flush: str | None = None):
    """Start to flush a stream to ``path``, a file for each trigger or for each value of the column ``flush``, and on and on with a trigger ``every`` so long; the caller stops it.

    Rows with one ``flush`` come one after the other and in one task, as ``record_stream`` numbers them.
    """
    writer = (stream if flush else stream.coalesce(1)).writeStream.format("flushed_lines").option("path", path).option("checkpointLocation", checkpoint)
    for k, v in (("now", now), ("flush", flush)):
        writer = writer.option(k, v) if v else writer
    registered(stream.sparkSession)
    return writer.trigger(processingTime=every or "0 seconds").start()


def drained(query) -> None:
    """Let a query read all that is there, then stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
