"""Upserts into a partitioned Parquet table: only partitions that change are written, beside the table, and swapped at the end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A staged write is complete once this file is in it.
READY = "_READY"


class Folders:
    """Renames and deletions in whatever file system a path belongs to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(path))) if self.there(path) else []

    def there(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def drop(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def move(self, path: str, to: str) -> None:
        if not self.fs.rename(self.at(path), self.at(to)):
            raise OSError(f"{path} cannot become {to}")

    def touch(self, path: str) -> None:
        self.fs.create(self.at(path)).close()


def created(rows: DataFrame, path: str, part: str) -> None:
    rows.repartition(part).write.partitionBy(part).parquet(path)


def partitions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at a path; what is staged below it does not belong to it."""
    return spark.read.schema(schema).parquet(path)


def recovered(spark: SparkSession, path: str) -> None:
    """Finish swaps that a crash has cut short, and forget writes that were not complete; repeated without harm."""
    f = Folders(spark, path)
    for name in f.names(path):
        if not name.startswith("_staged-"):
            continue
        staged = f"{path}/{name}"
        if f.there(f"{staged}/{READY}"):
            for part in f.names(staged):
                if "=" in part:
                    f.drop(f"{path}/{part}")
                    f.move(f"{staged}/{part}", f"{path}/{part}")
        f.drop(staged)


def upsert(rows: DataFrame, path: str, keys: list[str], part: str, order: str) -> None:
    """Rows replace those of the table with the same ``keys`` and partition, others are added.

    Of new rows with equal keys the one that is last by ``order`` counts.  Only
    partitions that new rows fall into are read and written; the others keep
    their files.  Until the last file of the staged write is there a crash
    changes nothing; after it, ``recovered`` (which every call begins with)
    brings the swap to its end.  One writer at a time.
    """
    spark = rows.sparkSession
    f = Folders(spark, path)
    recovered(spark, path)
    by = [*keys, part]
    new = rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(order), *[c for c in rows.columns if c != order])).alias("_r")).select("_r.*")
    changed = [r[part] for r in rows.select(part).distinct().collect()]  # as many as there are partitions
    old = partitions(spark, path, rows.schema).where(F.col(part).isin([c for c in changed if c is not None]) | (F.col(part).isNull() if None in changed else F.lit(False)))
    same = [old[c].eqNullSafe(new[c]) for c in by]
    merged = old.join(new, same, "left_anti").select(rows.columns).union(new.select(rows.columns))
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    merged.repartition(part).write.partitionBy(part).parquet(staged)
    f.touch(f"{staged}/{READY}")
    recovered(spark, path)
