"""Buckets of clips of one shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BUCKET_LEAST, BUCKET_STEP, WARNING
from ..functions.media import bucket_key
from .video_spec import gathered, issue


def assign(clips: DataFrame, step: int = BUCKET_STEP) -> DataFrame:
    """clips with bucket_key; those without a dimension are left out."""
    return clips.dropna(subset=["width", "height", "frame_count"]).withColumn("bucket_key", bucket_key(F.col("width"), F.col("height"), F.col("frame_count"), step))


def groups(assigned: DataFrame, stem: str, order: str | None = None) -> DataFrame:
    """bucket_key, n, samples; the largest first."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order or stem).alias("at"), F.col(stem).alias("name")))), lambda x: x["name"])
    return assigned.groupBy("bucket_key").agg(F.count("*").alias("n"), names.alias("samples")).orderBy(F.desc("n"), "bucket_key")


def previews(assigned: DataFrame, stem: str, order: str | None = None, shown: int = 6) -> DataFrame:
    """bucket_key, n, samples (the first `shown` alone), more (how many others); the largest
    first. Each task keeps the first names of a bucket before anything is shuffled, so a
    bucket of very many clips is no cell and no task's."""
    first = Window.partitionBy("bucket_key").orderBy(order or stem, stem)
    rows = assigned.select("bucket_key", stem, *([order] if order else [])).withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= shown)
    names = rows.groupBy("bucket_key").agg(F.sort_array(F.collect_list(F.struct("_nth", F.col(stem).alias("name"))))["name"].alias("samples"))
    counts = assigned.groupBy("bucket_key").agg(F.count("*").alias("n"))
    return counts.join(names, "bucket_key").select("bucket_key", "n", "samples", (F.col("n") - F.size("samples")).alias("more")).orderBy(F.desc("n"), "bucket_key")


def undersized_issues(few: DataFrame, least: int = BUCKET_LEAST) -> DataFrame:
    """Buckets with too few clips (bucket_key, n) with the issue that each is."""
    found = issue(F.lit(True), "BUCKET_UNDERSIZED", WARNING, "bucketing", F.col("n"), str(least), "too few clips have this shape")
    return few.withColumn("issues", gathered(found))


def undersized(assigned: DataFrame, least: int = BUCKET_LEAST) -> DataFrame:
    return assigned.groupBy("bucket_key").agg(F.count("*").alias("n")).where(F.col("n") < least)
