"""Clips against the specification of a trainer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import VideoConfig
from ..constants import ERROR, INFO, LEAST_FRAMES, MOST_VALID_FRAMES, WARNING
from ..functions import media as M


def issue(when: Column, code: str, severity: str, field: str, actual: Column, expected: str, message: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(field).alias("field"), actual.cast("string").alias("actual"), F.lit(expected).alias("expected")))


def gathered(*found: Column) -> Column:
    """The issues that apply, in order."""
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def has_error(issues: str = "issues") -> Column:
    return F.exists(issues, lambda x: x["severity"] == ERROR)


def validate(clips: DataFrame, config: VideoConfig = VideoConfig()) -> DataFrame:
    """clips (width, height, fps, frame_count, sar) with issues, needs_reencode,
    recommended_frame_count and is_valid. Every rule is judged by itself; issues are
    in the order resolution, pixel shape, frame rate, frame count."""
    height, frames, target = F.col("height"), F.col("frame_count"), config.resolution
    below, odd_pixels = height < target, ~M.is_square(M.sample_aspect(F.col("sar")))
    fps_off = F.abs(F.col("fps") - config.fps) > 0.5
    valid = ((frames - 1) % 4 == 0) & (frames >= 1) & (frames <= MOST_VALID_FRAMES)
    recommended = F.when(~valid, M.snap_down(frames))
    trim = frames - recommended
    out = gathered(
        issue(below & F.lit(config.upscale_policy == "never"), "RESOLUTION_BELOW_TARGET", ERROR, "height", height, str(target), "lower than the target and upscaling is off"),
        issue(below & F.lit(config.upscale_policy == "warn"), "RESOLUTION_BELOW_TARGET", WARNING, "height", height, str(target), "lower than the target; will be scaled up"),
        issue(height > target, "RESOLUTION_ABOVE_TARGET", INFO, "height", height, str(target), "higher than the target; will be scaled down"),
        issue(odd_pixels & F.lit(config.sar_policy == "reject"), "NON_SQUARE_SAR", ERROR, "sar", F.col("sar"), "1:1", "pixels are not square"),
        issue(odd_pixels & F.lit(config.sar_policy == "auto_correct"), "NON_SQUARE_SAR", WARNING, "sar", F.col("sar"), "1:1", "pixels are not square; will be scaled"),
        issue(fps_off, "FPS_MISMATCH", WARNING, "fps", F.col("fps"), str(config.fps), "another frame rate"),
        issue(~valid & (trim <= 3), "INVALID_FRAME_COUNT", WARNING, "frame_count", frames, "4n+1", "frame count will be trimmed"),
        issue(~valid & (trim > 3), "FRAME_COUNT_LARGE_TRIM", WARNING, "frame_count", frames, "4n+1", "many frames will be trimmed"),
        issue(F.coalesce(recommended, frames) < LEAST_FRAMES, "FRAME_COUNT_TOO_SHORT", ERROR, "frame_count", frames, str(LEAST_FRAMES), "too short to train on"),
    )
    again = (below & F.lit(config.upscale_policy == "warn")) | (height > target) | (odd_pixels & F.lit(config.sar_policy == "auto_correct")) | fps_off | ~valid
    rows = clips.withColumns({"issues": out, "needs_reencode": F.coalesce(again, F.lit(False)), "recommended_frame_count": recommended})
    return rows.withColumn("is_valid", ~has_error())


def issue_summary(*parts: DataFrame) -> DataFrame:
    """code, n over all issue arrays of the parts."""
    rows = None
    for p in parts:
        one = p.select(F.explode_outer("issues.code").alias("code")).where("code is not null")  # explode() would judge every row twice
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("code").agg(F.count("*").alias("n"))


def scan_counts(validated: DataFrame) -> DataFrame:
    """One row of totals. fixable = needs_reencode - invalid, which can be negative,
    as invalid clips needn't need re-encoding; both counts are given too."""
    rows = validated.agg(
        F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if("needs_reencode").alias("needs_reencode"), F.count_if(F.size("issues") == 0).alias("ready"),
    )
    return rows.withColumn("fixable", F.col("needs_reencode") - F.col("invalid"))


def pattern(issues: str = "issues") -> Column:
    return F.array_join(F.transform(issues, lambda x: F.concat_ws(":", x["code"], x["severity"])), "|")


def issue_patterns(validated: DataFrame, name: str) -> DataFrame:
    """Clips that share the same issues: how many, and the ranges of what is off; heights
    and frame rates, of which there are few, also value by value."""
    span = lambda c: [F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high")]
    each = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ", ").alias(f"{c}_values")
    rows = validated.where(F.size("issues") > 0).groupBy(pattern().alias("pattern"))
    return rows.agg(F.count("*").alias("n"), *span("height"), *span("fps"), *span("frame_count"), each("height"), each("fps"), F.min(name).alias("first"))


#: Groups of up to so many clips are listed by name.
LISTED = 6


def issue_groups(validated: DataFrame, name: str, listed: int = LISTED) -> DataFrame:
    """Clips that share the same issues, as a report shows them: pattern, n, spec (heights, frame
    rates and frames, each a value or a range), messages (of the first by name), first, and
    files: all names of 2 to `listed` clips, else null. No group is a cell: tasks keep
    `listed` + 1 names of a group before anything is shuffled."""
    rows = validated.where(F.size("issues") > 0).withColumn("pattern", pattern())
    span = lambda c, unit: F.concat(F.when(F.min(c) == F.max(c), F.min(c).cast("string")).otherwise(F.concat_ws("-", F.min(c).cast("string"), F.max(c).cast("string"))), F.lit(unit))
    groups = rows.groupBy("pattern").agg(F.count("*").alias("n"), F.concat_ws(", ", span("height", "p"), span("fps", "fps"), span("frame_count", " frames")).alias("spec"))
    nth = F.row_number().over(Window.partitionBy("pattern").orderBy(name))
    some = rows.select("pattern", name, "issues").withColumn("_nth", nth).where(F.col("_nth") <= listed + 1)
    names = some.groupBy("pattern").agg(
        F.min(name).alias("first"), F.min_by(F.transform("issues", lambda x: F.struct(x["severity"].alias("severity"), x["message"].alias("message"))), "_nth").alias("messages"),
        F.array_join(F.sort_array(F.collect_list(F.struct("_nth", F.col(name).cast("string").alias("name"))))["name"], ", ").alias("files"),
    )
    rows = groups.join(names, "pattern").withColumn("files", F.when(F.col("n").between(2, listed), F.col("files")))
    return rows.select("pattern", "n", "spec", "messages", "first", "files")


def normalize_plan(validated: DataFrame, config: VideoConfig = VideoConfig()) -> DataFrame:
    """validated with target_frames, trimmed and action (encode or copy)."""
    changing = F.abs(F.col("fps") - config.fps) > 0.5
    after = M.snap_down(F.floor(F.col("duration") * config.fps))
    kept = M.snap_down(F.coalesce("recommended_frame_count", "frame_count"))
    rows = validated.withColumn("target_frames", F.when(changing, after).otherwise(kept).cast("long"))
    rows = rows.withColumn("trimmed", (F.col("frame_count") - F.col("target_frames")).cast("long"))
    return rows.withColumn("action", F.when(F.col("needs_reencode"), "encode").otherwise("copy"))


def encode_command(source: Column, output: Column, frames: Column, config: VideoConfig = VideoConfig(), start: Column | None = None) -> Column:
    """Arguments of the encoder for a clip, as an array."""
    fixed = lambda *xs: [F.lit(str(x)) for x in xs]
    seek = fixed("-ss") + [F.format_string("%.3f", start)] if start is not None else []
    return F.array(
        *fixed("ffmpeg", "-y"), *seek, F.lit("-i"), source, *fixed("-c:v", "libx264", "-crf", 18, "-preset", "medium", "-pix_fmt", "yuv420p", "-r", config.fps),
        *fixed("-vf", f"scale=-2:{config.resolution}:flags={config.downscale_method}", "-frames:v"), frames.cast("string"), *fixed("-an", "-movflags", "+faststart"), output,
    )


def copy_command(source: Column, output: Column, frames: Column) -> Column:
    fixed = lambda *xs: [F.lit(x) for x in xs]
    return F.array(*fixed("ffmpeg", "-y", "-i"), source, *fixed("-c:v", "copy", "-frames:v"), frames.cast("string"), *fixed("-an"), output)
