"""Operator 9: SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the model crosses the place before a word marker, so a table of
distinct marked words stands for the texts: a worker segments a word when it
first meets it, and the ids are joined back by position.  The table is of
bounded size, so a word that comes when it is full is segmented where it is met;
a table of all words, joined by position over the cluster, would move more bytes
than the texts have (figures in the README).  The library itself decodes the
joined ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import chunk_table, vocabulary
from .common import table, text_rows

MODEL = "piece_bpe_32k.model"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_pieces(docs: DataFrame, model: str = MODEL, keep: bool = False) -> DataFrame:
    """Ids with begin and end of every whole text and the text that they decode to, as digests; ``keep`` adds ``ids`` and ``decoded``.

    A null text is empty and has the begin and end ids alone; repeated rows and
    null ids return as they are, an empty table gives an empty one, other
    columns are dropped.
    """
    path = vocabulary(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_table(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (coder.model.bos_id(), coder.model.eos_id()))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [begin + x + end for x in coder.texts(part["text"].to_pylist())]
                ids = [np.frombuffer(x, "<u4").tolist() for x in raw]
                decoded = [coder.model.decode(x) for x in ids]
                out = {"doc_id": part["doc_id"], "n_tokens": pa.array(map(len, ids), pa.int64()), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded]}
                if keep:
                    out |= {"ids": pa.array(ids, pa.list_(pa.int64())), "decoded": decoded}
                yield pa.RecordBatch.from_pydict(out)

    return text_rows(docs).mapInArrow(run, SCHEMA + ", ids array<long>, decoded string" * keep)


def op9_marked_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))
