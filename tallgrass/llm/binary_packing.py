"""Operator 8: token ids as packed binary matrices, by best-fit-decreasing with a segment tree over capacities.

Overlong documents are split without loss.  Every task packs its own rows in
buffers of bounded size: the pieces of a buffer are placed from the longest
down, each in the open row with the least room that holds it, which a segment
tree over capacities finds in logarithmic time.  Blocks of rows are written as
one id matrix each with the cumulative segment lengths and the places where
positions start again from 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .chunks import chunk_table, vocabulary
from .common import arrow_rows, arrow_schema, scratch_path, table, text_rows

TOKENIZER, ROW, END_ID, PAD_ID = "word_bpe_49k.json", 2048, 1, 0
#: Tokens that one task buffers before it packs them, rows of a matrix, and bytes of the matrices that Spark's writer holds.
BUFFER_TOKENS, MATRIX_ROWS, GROUP_BYTES = 4_000_000, 64, 16 << 20
BLOCKS = "block_id long, n_rows int, row_length int, id_bytes int, ids binary, row_segments array<int>, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, sequence_id long, offset long"


class CapacityTree:
    """Counts of open rows by free room; finds the least room that is at least so much."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i, count = room + self.size, self.count
        while i:
            count[i] += by
            i >>= 1

    def least(self, room: int) -> int:
        """The smallest capacity of at least ``room`` that is there; -1 if there is none."""
        i, count = room + self.size, self.count
        if count[i]:
            return room
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Rows of indexes into ``lengths`` (each at most ``most``), longest first, ties in the order given."""
    tree, by_room, rows = CapacityTree(most), [[] for _ in range(most + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if (room := tree.least(n)) < 0:
            row, room = len(rows), most
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if room > n:
            by_room[room - n].append(row)
            tree.add(room - n, 1)
    return rows


def write_packed(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, row_length: int = ROW, end_id: int = END_ID, pad_id: int = PAD_ID) -> None:
    """Write packed id matrices of all documents as Parquet rows of ``BLOCKS``.

    ``ids`` is row-major, little-endian, ``id_bytes`` wide, padded with
    ``pad_id``; ``cu_seqlens`` runs over the rows of a matrix laid end to end
    without their padding, ``row_segments`` counts the segments of each row and
    ``position_resets`` are the places in the padded matrix where positions
    start from 0, padding included.  A null text is an empty document (its end
    id alone), repeated rows are packed again, a null ``doc_id`` is written as
    null, an empty table writes no block.
    """
    path_ = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, coder = arrow_schema(BLOCKS), chunk_table(path_)
        block = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()
        pieces: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, pieces, size
            rows = best_fit([len(p[2]) for p in pieces], row_length)
            for at in range(0, len(rows), MATRIX_ROWS):
                some = rows[at : at + MATRIX_ROWS]
                matrix = np.full((len(some), row_length), pad_id, "<u4")
                lengths, resets, ids, starts = [], [], [], []
                for r, row in enumerate(some):
                    place = 0
                    for i in row:
                        doc_id, start, tokens = pieces[i]
                        matrix[r, place : place + len(tokens)] = tokens
                        resets.append(r * row_length + place)
                        lengths.append(len(tokens))
                        ids.append(doc_id)
                        starts.append(start)
                        place += len(tokens)
                    if place < row_length:
                        resets.append(r * row_length + place)
                narrow = matrix.max(initial=0) < 1 << 16
                yield arrow_rows(schema, [(block, len(some), row_length, 2 if narrow else 4, matrix.astype("<u2" if narrow else "<u4").tobytes(), [len(row) for row in some], [0, *np.cumsum(lengths).tolist()], resets, ids, starts)])
                block += 1
            pieces, size = [], 0

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, raw in zip(part["doc_id"].to_pylist(), coder.texts(part["text"].to_pylist()), strict=True):
                    tokens = np.frombuffer(raw + end, "<u4")
                    pieces += [(doc_id, s, tokens[s : s + row_length]) for s in range(0, len(tokens), row_length)]
                    size += len(tokens)
                if size >= BUFFER_TOKENS:
                    yield from flush()
        yield from flush()

    text_rows(docs).mapInArrow(run, BLOCKS).write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of packed matrices, with a checksum of the ids that the matrix holds for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PIECES)
        for batch in batches:
            for at in range(batch.num_rows):
                b, rows, k = batch.slice(at, 1).to_pylist()[0], [], 0
                matrix = np.frombuffer(b["ids"], f"<u{b['id_bytes']}").reshape(b["n_rows"], b["row_length"]).astype("<u4")
                bounds = np.diff(b["cu_seqlens"]).tolist()
                for r, segments in enumerate(b["row_segments"]):
                    place = 0
                    for _ in range(segments):
                        n = bounds[k]
                        rows.append((b["doc_ids"][k], b["starts"][k], n, zlib.crc32(matrix[r, place : place + n]), (b["block_id"] << 10) + r, place))
                        place += n
                        k += 1
                yield arrow_rows(schema, rows)

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(run, PIECES)


def op8_best_fit_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_packed(table(spark, sf_dir, "documents"), path := scratch_path(spark, "packed"))
    return read_packed(spark, path)
