"""Caption scores of files as they arrive.

The source's checkpoint knows what was seen, which takes the place of skipping outputs
that exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import captions


def read(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"), F.col("value").alias("text"))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return captions.score(read(spark, folder))


def totals(stream: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Captions and their scores by window of arrival; a window closes when later files
    are past it by `late`."""
    rows = stream.withWatermark("at", late).groupBy(F.window("at", window))
    return rows.agg(F.count("*").alias("n"), F.avg("overall").alias("average"), F.min("overall").alias("lowest")).select("window.start", "window.end", "n", "average", "lowest")


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
