"""Container metadata and segment arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BUCKET_STEP


def frame_rate(text: Column) -> Column:
    """'24000/1001' or '25' as frames a second with 3 decimals; 0 for what is neither
    or has no denominator."""
    part = F.split(text, "/")
    a, b = F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double")
    whole = F.when(F.size(part) == 1, a)
    return F.coalesce(F.bround(F.coalesce(F.try_divide(a, b), whole), 3), F.lit(0.0))


def sample_aspect(text: Column) -> Column:
    """A sample aspect ratio as 'a:b'; 1:1 for none."""
    return F.when(text.isNull() | text.isin("", "N/A", "0:0", "0/0"), "1:1").otherwise(F.replace(text, F.lit("/"), F.lit(":")))


def is_square(sar: Column) -> Column:
    return sar.isNull() | sar.isin("1:1", "1/1")


def aspect_ratio(width: Column, height: Column, sar: Column) -> Column:
    part = F.split(sample_aspect(sar), ":")
    a, b = F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double")
    good = (F.size(part) == 2) & (a > 0) & (b > 0)
    a, b = F.when(good, a).otherwise(1.0), F.when(good, b).otherwise(1.0)
    return F.try_divide(width * a, height * b)


def snap_down(n: Column) -> Column:
    """The largest 4k+1 up to n, 1 at least."""
    return F.when(n <= 0, F.lit(1)).otherwise(F.floor((n - 1) / 4) * 4 + 1).cast("long")


def snap_up(n: Column) -> Column:
    return F.when(n <= 0, F.lit(1)).otherwise(F.floor((n + 2) / 4) * 4 + 1).cast("long")


def bucket_key(width: Column, height: Column, frames: Column, step: int = BUCKET_STEP) -> Column:
    down = lambda x: (F.floor(x / step) * step).cast("long")
    return F.concat_ws("x", down(width).cast("string"), down(height).cast("string"), frames.cast("string"))


def interior_times(start: Column, end: Column, n: int) -> Column:
    """n evenly spaced times inside a scene; none for a scene of no length."""
    times = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: start + (end - start) * i / (n + 1))
    return F.when(end > start, times).otherwise(F.array().cast("array<double>"))


def pair_starts(n_frames: Column, samples: int = 5) -> Column:
    """Indices of the frames whose difference to the next one measures motion."""
    every = F.sequence(F.lit(0).cast("long"), n_frames - 2)
    some = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.floor(i * (n_frames - 2) / samples).cast("long"))
    return F.when(n_frames < 2, F.array().cast("array<bigint>")).when(n_frames - 1 <= samples, every).otherwise(some)


def trainer_size(resolution: Column) -> Column:
    """[width, height] of a nominal height."""
    width = F.when(resolution == 480, 854).when(resolution == 720, 1280).when(resolution == 1080, 1920).otherwise(F.floor(resolution * 16 / 9))
    return F.array(width.cast("long"), resolution.cast("long"))


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def file_stem(name: Column) -> Column:
    """The name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
