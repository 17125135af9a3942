"""Pair tables that arrive bit by bit, on Structured Streaming.

Row operators and conditions work on a stream as they do on a table. What needs state is here: exact duplicates by
keys (state: one row per key, or per key inside the watermark), and running statistics.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..operators.stats import totals
from ..schema import UNMAPPED_CHROM

EXACT = ("chrom1", "chrom2", "pos1", "pos2", "strand1", "strand2")


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream, with the schema that it has now."""
    now = spark.read.parquet(path)
    reader = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    if [f.rpartition("/")[2] for f in now.inputFiles()] == [name]:  # a stream reads folders
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drop_duplicates(stream: DataFrame, keys: Sequence[str] = EXACT, time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key. With a time column and a delay, keys are forgotten once the watermark has passed them."""
    mapped = stream.where((F.col("chrom1") != UNMAPPED_CHROM) & (F.col("chrom2") != UNMAPPED_CHROM)) if "chrom1" in stream.columns else stream
    if time is None:
        return mapped.dropDuplicates(list(keys))
    return mapped.withWatermark(time, delay or "0 seconds").dropDuplicatesWithinWatermark(list(keys))


def running_totals(stream: DataFrame) -> DataFrame:
    """The totals of everything seen so far; for output mode complete."""
    return totals(stream)


def windowed_counts(stream: DataFrame, time: str, width: str, by: Sequence[str], delay: str, slide: str | None = None) -> DataFrame:
    """Counts by time window and columns; rows later than the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = stream.withWatermark(time, delay).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything there is now, once, as a table. Appended rows go to Parquet in the shared folder, other modes to the last batch's table."""
    spark = stream.sparkSession
    cut(spark.range(1))  # sees to a checkpoint folder
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode(mode).format("parquet").option("path", f"{base}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/rows")).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")
