"""Dense row numbers over a global order, without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.sources.io import scratch_dir, written


def dense_row_id(rows: DataFrame) -> DataFrame:
    """Add `row_id` 0..n-1 in (document, token) order.

    Documents with their row counts are range-partitioned into as many ranges as the session shuffles
    into, and written with their range, so a recomputed task finds the same ranges. The sizes of earlier
    ranges and of earlier documents of the range give each document its first id; rows are numbered
    inside their document. The rows are written too: ranges, their sizes and the numbering all read them.
    """
    spark = rows.sparkSession
    rows = written(rows)
    path = scratch_dir(spark)
    sizes = rows.groupBy("document").agg(F.count("*").alias("_n")).repartitionByRange("document")
    sizes.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    sizes = spark.read.parquet(path)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    ranges = sizes.groupBy("_range").agg(F.sum("_n").alias("_size")).select("_range", F.sum("_size").over(earlier).alias("_base"))
    before = Window.partitionBy("_range").orderBy("document").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum("_n").over(before), F.lit(0))
    firsts = sizes.join(ranges, "_range").select("document", first.alias("_first"))
    inner = Window.partitionBy("document").orderBy("token")
    return rows.withColumn("_i", F.row_number().over(inner)).join(firsts, "document").withColumn(
        "row_id", F.col("_first") + F.col("_i") - 1
    ).drop("_i", "_first")
