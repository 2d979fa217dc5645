"""Working tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder's path below the one that the cluster names in spark.checkpoint.dir; below a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="sievetrace-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df``, written and read again: computed once, whatever is done with it and whichever executors are lost."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with the number (from 0) of each row in an order over all rows, without one task that holds them all.

    Rows are ranged and sorted; a row's number is its place in its partition and the rows of those before, of which
    there is one count for each partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_piece", F.spark_partition_id()))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_piece").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    counts = counts.select("_piece", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(counts), "_piece").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_piece", "_shift")
