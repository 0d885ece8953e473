"""Records as they arrive: how many of each kind in windows of event time, and the latest entry of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """Parquet files of a folder (or a pattern) as a stream, with the schema of those that are there."""
    options = {"maxFilesPerTrigger": str(files_at_once)} if files_at_once else {}
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path)


def windowed_rates(records: DataFrame, ts: str, kind: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, errors, mean) for each window of event time and kind; needs `success` and `value`. On a stream, state
    of a window is dropped once the watermark (the latest time less `late`) has passed its end, and later rows with it;
    null times are left out."""
    rows = records.where(F.col(ts).isNotNull()).withColumn("_t", F.col(ts).cast("timestamp"))
    by = rows.withWatermark("_t", late).groupBy(F.window("_t", window).alias("w"), F.col(kind).alias("kind"))
    return by.agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("errors"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "kind", "n", "errors", F.round("mean", 3).alias("mean"))


def write_until_now(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that has arrived into Parquet files and stop; the next call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def first_arrivals(records: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Records without those that repeat an earlier one's keys within the watermark."""
    return records.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")
