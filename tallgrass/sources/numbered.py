"""Places of rows within groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import scratch_path


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 by ``order`` within the groups ``by``, and ``n``, the rows of the group.

    Rows are sorted in ranges, so a large group lies in several; the window that
    tells how many rows of its group lie before a range runs over one row for
    each range and group.  Rows with equal ``order`` keep any order, and may not
    be parted.
    """
    spark, keys = rows.sparkSession, [F.col(c).asc_nulls_first() for c in (*by, *order)]
    x = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    x.write.parquet(path := scratch_path(spark, "sorted"))
    x = spark.read.schema(x.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = x.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_part").alias("_p"), "_first", before.alias("_before"), F.sum("_n").over(group).alias("n"))
    same: Column = x["_part"] == F.col("_p")
    for c in by:
        same &= x[c].eqNullSafe(F.col(f"_{c}"))
    return x.join(sizes, same).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "place", "n")
