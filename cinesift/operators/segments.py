"""Scenes from cuts, clips from scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import VideoConfig
from ..constants import FRAMES_PER_SCENE, LEAST_FRAMES, SCENE_LEAST_SECONDS, TAIL_SECONDS
from ..functions import media as M


def scenes(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    """video, scene_index, start, end from cuts (video, t) and durations (video, duration).

    A scene begins at 0 and at each cut and ends at the next one or the end."""
    starts = durations.select("video", F.lit(0.0).alias("t")).unionByName(cuts.select("video", "t")).distinct()
    w = Window.partitionBy("video").orderBy("t")
    rows = starts.join(durations, "video").withColumn("end", F.lead("t").over(w)).withColumn("scene_index", (F.row_number().over(w) - 1).cast("long"))
    return rows.select("video", "scene_index", F.col("t").alias("start"), F.coalesce("end", "duration").alias("end"))


def subdivide(scene: DataFrame, config: VideoConfig = VideoConfig()) -> DataFrame:
    """Clips of at most max_frames of a scene: start, end, sub_index (-1: not divided).
    A last piece of TAIL_SECONDS or less is dropped."""
    if config.max_frames is None:
        return scene.withColumn("sub_index", F.lit(-1).cast("long"))
    most = config.max_frames / config.fps
    length = F.col("end") - F.col("start")
    n = F.ceil((length - TAIL_SECONDS) / most).cast("int")
    pieces = F.when(length <= most, F.array(F.lit(-1))).when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))
    rows = scene.withColumn("sub_index", F.explode(F.transform(pieces, lambda k: k.cast("long"))))
    whole = F.col("sub_index") < 0
    begin = F.when(whole, F.col("start")).otherwise(F.col("start") + F.col("sub_index") * most)
    finish = F.when(whole, F.col("end")).otherwise(F.least(F.col("end"), F.col("start") + (F.col("sub_index") + 1) * most))
    return rows.withColumns({"start": begin, "end": finish})


def clip_name(stem: Column, scene_index: Column, sub_index: Column, suffix: Column) -> Column:
    letter = F.when(sub_index < 0, "").when(sub_index < 26, F.chr(sub_index + 97)).otherwise(F.concat(F.lit("_"), sub_index.cast("string")))
    return F.concat(stem, F.format_string("_scene%03d", scene_index), letter, suffix)


def clips(scene: DataFrame, stem: Column, suffix: Column, config: VideoConfig = VideoConfig()) -> DataFrame:
    """Clips to cut: subdivided scenes long enough to train on, with their frames and names."""
    rows = subdivide(scene, config).withColumn("estimated", F.floor((F.col("end") - F.col("start")) * config.fps).cast("long"))
    rows = rows.withColumn("frames", M.snap_down(F.col("estimated"))).where((F.col("estimated") >= LEAST_FRAMES) & (F.col("frames") >= LEAST_FRAMES))
    rows = rows.withColumn("trimmed", F.greatest(F.lit(0), F.col("estimated") - F.col("frames")).cast("long"))
    return rows.withColumn("name", clip_name(stem, F.col("scene_index"), F.col("sub_index"), suffix))


def sample_times(scene: DataFrame, n: int = FRAMES_PER_SCENE) -> DataFrame:
    """A row for each frame to look at: frame_index, t. Scenes of no length have none."""
    return scene.select("*", F.posexplode(M.interior_times(F.col("start"), F.col("end"), n)).alias("frame_index", "t"))


def spaced_cuts(cuts: DataFrame, least: float = SCENE_LEAST_SECONDS) -> DataFrame:
    """Of cuts (video, t), those at least `least` seconds after the last one kept (or
    the start). Whether a cut stays depends on what was kept before, so each video's
    cuts are folded in order."""
    kept = F.aggregate(
        F.array_sort(F.collect_list("t")), F.array(F.lit(0.0)),
        lambda acc, t: F.when(t - F.element_at(acc, -1) >= least, F.concat(acc, F.array(t))).otherwise(acc),
    )
    return cuts.groupBy("video").agg(kept.alias("kept")).select("video", F.explode(F.slice("kept", 2, 2**31 - 1)).alias("t"))


def without_cuts(videos: DataFrame, cuts: DataFrame) -> DataFrame:
    return videos.join(cuts.select("video").distinct(), "video", "left_anti")
