"""Streams of traces and events: ingestion with late copies dropped, windowed rates, routed sinks, progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from sievetrace.functions.arithmetic import ratio


def read(spark: SparkSession, path: str, ddl: str | StructType, files_each: int = 100) -> DataFrame:
    """A stream of Parquet files that land in a folder."""
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_each).parquet(path)


def drop_copies(stream: DataFrame, keys: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state older than it is let go."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_rates(stream: DataFrame, time: str, key: str, success: F.Column, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(window_start, key, attempts, successes, success_rate) for each window; works on tables as well."""
    rows = stream.withWatermark(time, lateness) if stream.isStreaming else stream
    counted = rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("attempts"), F.count_if(success).alias("successes"))
    return counted.select(F.col("w.start").alias("window_start"), key, "attempts", "successes", ratio(F.col("successes"), F.col("attempts")).alias("success_rate"))


def write_routed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append attempts to success and failure folders; a crash leaves whole batches."""
    return stream.writeStream.partitionBy("success").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def run_all(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand everything that is there to ``sink``, batch by batch."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


class Progress(StreamingQueryListener):
    """Calls back with each batch's number and rows."""

    def __init__(self, tell: Callable[[int, int], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
