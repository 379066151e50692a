"""The row-local operators on streams, and windowed counts over late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def run(stream: DataFrame, output: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Writes a transformed stream as Parquet, all that is there, and returns. A second run goes on where the first ended."""
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(output)
    query.awaitTermination()


def arrivals(stream: DataFrame, time: str, by: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows by window and key; windows close when nothing up to ``late`` behind can still come."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counts = timed.groupBy(F.window("_t", window), by).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("window.start").alias("start"), by, "count")
