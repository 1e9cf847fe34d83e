"""Shared helpers of the training-data operators: scratch tables, Arrow batches and small column utilities.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, the one
folder that the driver and all executors of a cluster share.  They cut lineage
and survive the loss of executors, which a local checkpoint would not.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.sources.scratch import scratch_path

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def staged(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; recovery needs no recomputation.

    Scratch tables ``done``, which nothing but ``df`` was to read, are deleted.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    dropped(*done)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; other frames stay."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of plain ``name type`` columns and arrays of them."""

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _ARROW[name]

    return pa.schema([(n, kind(t)) for n, t in (c.split() for c in ddl.split(", "))])


def arrow_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as an Arrow batch, which keeps long integers beside nulls as they are."""
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), other columns dropped unless asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
