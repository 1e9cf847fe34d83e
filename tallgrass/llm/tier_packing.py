"""Operator 4: hierarchical multi-length packing.

A document is cut into full windows of the longest tier; what remains of it is
routed to the shortest tier (a power of two) that holds it.  Each tier is
packed from the longest down: a window takes one document of its tier, its gap
takes the longest pieces that fit, of shorter tiers or what is short enough of
its own, and the last bit of a gap is closed by cutting a piece, which loses
nothing.  Pieces lie in one pool by length, so the longest tier is packed first,
then the next.  The windows of one buffer are dealt to step groups of equal
token counts.

It is one pass over the table without a shuffle: every task packs its own rows
in buffers of bounded size and carries an open window from buffer to buffer.
Only a task's last few tokens need windows of their own, of falling powers of
two, so nothing is padded.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import chunk_table, vocabulary
from .common import arrow_rows, arrow_schema, table, text_rows

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that one task buffers before it packs them, and windows of the longest tier in a step group.
BUFFER_TOKENS, STEP_WINDOWS = 4_000_000, 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


class TierPacker:
    """Packs (key, length) pieces into windows; knows nothing of Spark."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        if any(t & (t - 1) for t in tiers):
            raise ValueError("tiers are powers of two")
        self.tiers = tuple(sorted(tiers))
        self.rest: list[tuple[int, int, int]] = []  # pieces (document, start, length) of an open window

    def windows(self, docs: list[tuple[int, int]], last: bool) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """Windows (tier, pieces) that hold every token of ``docs`` (document, tokens) once; an open one waits unless ``last``."""
        top = self.tiers[-1]
        out, pool = [], defaultdict(list)
        for doc, n in docs:
            full = n - n % top
            out += [(top, [(doc, s, top)]) for s in range(0, full, top)]
            if n > full:
                pool[n - full].append((doc, full, n - full))
        for piece in self.rest:
            pool[piece[2]].append(piece)
        self.rest = []
        mask = sum(1 << k for k in pool)  # bit k: there are pieces of length k

        def take(most: int) -> tuple[int, int, int] | None:
            nonlocal mask
            if not (k := (mask & ((1 << (most + 1)) - 1)).bit_length() - 1) > 0:
                return None
            piece = pool[k].pop()
            if not pool[k]:
                mask ^= 1 << k
            return piece

        def give(piece: tuple[int, int, int]) -> None:
            nonlocal mask
            pool[piece[2]].append(piece)
            mask |= 1 << piece[2]

        while mask:
            head = take(top)
            tier = next(t for t in self.tiers if t >= head[2])
            window, gap = [head], tier - head[2]
            while gap and mask:
                if piece := take(gap):  # whole pieces of shorter tiers first, the longest that fits
                    window.append(piece)
                    gap -= piece[2]
                else:  # then a cut through the shortest piece that is left
                    doc, start, n = take((mask & -mask).bit_length() - 1)
                    window.append((doc, start, gap))
                    give((doc, start + gap, n - gap))
                    gap = 0
            if gap:
                self.rest = window
            else:
                out.append((tier, window))
        if last and self.rest:
            out += self.tail()
        return out

    def tail(self) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """The open window as windows of falling powers of two."""
        left, pieces, out = sum(p[2] for p in self.rest), list(reversed(self.rest)), []
        while left:
            size = room = 1 << (left.bit_length() - 1)
            window = []
            while room:
                doc, start, n = pieces.pop()
                window.append((doc, start, min(n, room)))
                if n > room:
                    pieces.append((doc, start + room, n - room))
                room -= window[-1][2]
            out.append((size, window))
            left -= size
        self.rest = []
        return out


def step_groups(sizes: list[int], budget: int) -> list[int]:
    """A step for each window: long windows first, each to the step with the fewest tokens."""
    steps = max(1, -(-sum(sizes) // budget))
    heap, out = [(0, s) for s in range(steps)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, step = heapq.heappop(heap)
        out[i] = step
        heapq.heappush(heap, (load + sizes[i], step))
    return out


def tier_pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_windows: int = STEP_WINDOWS, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Pieces of all documents in windows of the given tiers.

    A null text is an empty document, which still has its end id; a repeated
    row is packed again, a null ``doc_id`` is kept, an empty table gives an
    empty one, other columns are dropped.  ``sequence_id`` and ``step_id`` are
    unique over tasks; ties between equal lengths go to the row read last.
    """
    path = vocabulary(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, coder, packer, top = arrow_schema(SCHEMA), chunk_table(path), TierPacker(tiers), max(tiers)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, tuple] = {}
        fresh, number, size, sequence, step = [], 0, 0, base, base
        end = np.array([end_id], "<u4").tobytes()

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, fresh, size, sequence, step
            windows = packer.windows(fresh, last)
            groups = step_groups([t for t, _ in windows], top * step_windows)
            rows = []
            for (tier, pieces), group in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids = held[doc]
                    rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, sequence, offset, tier, step + group))
                    offset += n
                sequence += 1
            step += max(groups, default=-1) + 1
            held = {p[0]: held[p[0]] for p in packer.rest}
            fresh, size = [], 0
            return arrow_rows(schema, rows)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, ids in zip(part["doc_id"].to_pylist(), coder.texts(part["text"].to_pylist()), strict=True):
                    held[number] = (doc_id, ids + end)
                    fresh.append((number, len(ids) // 4 + 1))
                    size += len(ids) // 4 + 1
                    number += 1
                if size >= buffer_tokens:
                    yield flush(False)
        yield flush(True)

    return text_rows(docs).mapInArrow(run, SCHEMA)


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_pack(table(spark, sf_dir, "documents"))


def padding(pieces: DataFrame, top: int = TIERS[-1]) -> DataFrame:
    """Tokens and padding of packed pieces: a sequence is padded to ``top`` unless its length is a power of two."""
    length = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(top - F.col("n"))
    return length.agg(F.sum("n").alias("tokens"), F.sum(pad).alias("padding"), F.count("*").alias("sequences"))
