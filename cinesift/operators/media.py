"""Frames, references and cuts: tools run in partitions, failures are rows."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLIP_SUFFIXES, FRAMES_PER_CLIP, REFERENCE_SUFFIXES

Runner = Callable[[list[str], float], None]


def tool(command: list[str], seconds: float) -> None:
    """Runs a command; what goes wrong is an OSError."""
    if shutil.which(command[0]) is None:
        raise OSError(f"{command[0]} is not installed")
    out = subprocess.run(command, capture_output=True, text=True, timeout=seconds)
    if out.returncode:
        raise OSError(out.stderr.strip()[-500:] or f"{command[0]} ended with {out.returncode}")


def execute(planned: DataFrame, runner: Runner = tool, seconds: float = 300) -> DataFrame:
    """Run a plan's commands (output, command): output, success, error. The output is
    made under another name first, so a task that is run again leaves no half files."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for output, command in zip(batch["output"], batch["command"], strict=True):
                folder = os.path.dirname(output) or "."
                try:
                    os.makedirs(folder, exist_ok=True)
                    with tempfile.TemporaryDirectory(dir=folder) as d:
                        made = os.path.join(d, os.path.basename(output))
                        runner([made if x == output else x for x in command], seconds)
                        os.replace(made, output)
                    out.append((output, True, None))
                except (OSError, subprocess.SubprocessError) as e:
                    out.append((output, False, str(e)))
            yield pd.DataFrame(out, columns=["output", "success", "error"])

    return planned.select("output", "command").mapInPandas(go, "output string, success boolean, error string")


def execute_many(planned: DataFrame, runner: Runner = tool, seconds: float = 300) -> DataFrame:
    """Run commands (output, command) whose output is a pattern of numbered files:
    output, success, error. What its folder held before is replaced, and only by a whole
    run; a command that makes no file has failed."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for output, command in zip(batch["output"], batch["command"], strict=True):
                folder, pattern = os.path.split(output)
                try:
                    os.makedirs(os.path.dirname(folder) or ".", exist_ok=True)
                    with tempfile.TemporaryDirectory(dir=os.path.dirname(folder) or ".") as d:
                        made = os.path.join(d, "made")
                        os.mkdir(made)
                        runner([os.path.join(made, pattern) if x == output else x for x in command], seconds)
                        if not os.listdir(made):
                            raise OSError("no frame was made")
                        shutil.rmtree(folder, ignore_errors=True)
                        os.replace(made, folder)
                    out.append((output, True, None))
                except (OSError, subprocess.SubprocessError) as e:
                    out.append((output, False, str(e)))
            yield pd.DataFrame(out, columns=["output", "success", "error"])

    return planned.select("output", "command").mapInPandas(go, "output string, success boolean, error string")


def write_texts(planned: DataFrame) -> DataFrame:
    """Texts (output, text) as UTF-8 files: output, success, error. A file is made under
    another name first, so none is ever half written."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for output, text in zip(batch["output"], batch["text"], strict=True):
                made = f"{output}.{os.getpid()}.part"
                try:
                    with open(made, "w", encoding="utf-8") as f:
                        f.write(text)
                    os.replace(made, output)
                    out.append((output, True, None))
                except OSError as e:
                    out.append((output, False, str(e)))
            yield pd.DataFrame(out, columns=["output", "success", "error"])

    return planned.select("output", "text").mapInPandas(go, "output string, success boolean, error string")


def still_command(source: Column, output: Column) -> Column:
    """A picture in another format; there is no time to seek to."""
    f = lambda *xs: [F.lit(x) for x in xs]
    return F.array(*f("ffmpeg", "-y", "-i"), source, *f("-frames:v", "1"), output)


def frame_command(source: Column, output: Column, time: Column) -> Column:
    """One frame at a time in seconds; seeking before the input decodes little."""
    f = lambda *xs: [F.lit(x) for x in xs]
    return F.array(*f("ffmpeg", "-y", "-ss"), F.format_string("%.3f", time), F.lit("-i"), source, *f("-frames:v", "1"), output)


def sampled_command(source: Column, pattern: Column, fps: Column, most: int | None = None) -> Column:
    """Frames at a fixed rate, into numbered files, at most `most`."""
    f = lambda *xs: [F.lit(x) for x in xs]
    return F.array(*f("ffmpeg", "-y", "-i"), source, F.lit("-vf"), F.concat(F.lit("fps="), fps.cast("string")), *(f("-frames:v", str(most)) if most else []), pattern)


def clip_rate(duration: Column, n: int = FRAMES_PER_CLIP, least: float = 0.0) -> Column:
    """The rate that gives n evenly spaced frames."""
    return F.greatest(F.coalesce(F.try_divide(F.lit(float(n)), duration), F.lit(1.0)), F.lit(least))


def frame_at(number: Column, seconds: Column, fps: Column) -> Column:
    """The time of a frame given by number or by seconds; both or neither is an error."""
    one = number.isNotNull() != seconds.isNotNull()
    return F.when(one, F.coalesce(seconds, number / fps)).otherwise(F.raise_error(F.lit("give a frame number or a time, not both")))


def reference_plan(files: DataFrame, out: str, strategy: str = "first_frame", existing: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """files (path, stem, suffix) with source_type, output, strategy, skipped and, for
    other types than pictures and clips, an error."""
    kind = F.when(F.col("suffix").isin(REFERENCE_SUFFIXES), "image").when(F.col("suffix").isin(CLIP_SUFFIXES), "video")
    rows = files.withColumn("source_type", kind).withColumn("output", F.concat(F.lit(out.rstrip("/") + "/"), F.col("stem"), F.lit(".png")))
    rows = rows.withColumn("strategy", F.when(F.col("source_type") == "video", strategy)).withColumn("error", F.when(F.col("source_type").isNull(), "not a clip or picture"))
    if existing is None or overwrite:
        return rows.withColumn("skipped", F.lit(False))
    there = existing.select(F.col("path").alias("output"), F.lit(True).alias("there")).distinct()
    return rows.join(there, "output", "left").withColumn("skipped", F.coalesce("there", F.lit(False))).drop("there")


def best_frame(frames: DataFrame, *by: str, fps: float = 16.0) -> DataFrame:
    """The sharpest of a clip's candidate frames (index, sharpness, at), the first of
    equals, the first frame if none can be read; frame_number assumes 16 frames a second."""
    key = F.struct(F.coalesce("sharpness", F.lit(-1.0)), -F.col("index"))
    return frames.groupBy(*by).agg(F.max_by("index", key).alias("index"), F.max("sharpness").alias("sharpness"), F.max_by("at", key).alias("at")).withColumn("frame_number", F.floor(F.coalesce("at", F.lit(0.0)) * fps).cast("long"))


def cuts_from_scores(scores: DataFrame, threshold: float, least_frames: int | Column) -> DataFrame:
    """video, frame of cuts where a frame's score of change reaches the threshold, each
    at least `least_frames` (a number, or a column that is the same in a video's rows)
    after the one before."""
    least = least_frames if isinstance(least_frames, Column) else F.lit(least_frames)
    kept = F.aggregate(
        "frames", F.array(F.lit(0).cast("long")),
        lambda acc, t: F.when(t - F.element_at(acc, -1) >= F.col("least"), F.concat(acc, F.array(t.cast("long")))).otherwise(acc),
    )
    rows = scores.where(F.col("score") >= threshold).groupBy("video").agg(F.array_sort(F.collect_list("frame")).alias("frames"), F.max(least).alias("least"))
    return rows.select("video", kept.alias("kept")).select("video", F.explode(F.slice("kept", 2, 2**31 - 1)).alias("frame"))
