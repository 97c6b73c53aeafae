"""Measurements of pictures, in Arrow batches of numpy work."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..constants import BLANK_SHARPNESS, HASH_SIZE, REFERENCE_SUFFIXES
from ..sources.probe import ffprobe
from ..sources.snapshot import incremental

#: Names of pictures, in either case.
PICTURES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in REFERENCE_SUFFIXES) + "}"


def read(spark: SparkSession, path: str, deep: bool = True) -> DataFrame:
    """path, width, height, n_channels, data, decoded of the pictures of a folder and, if
    deep, of those under it; other files aren't read."""
    rows = spark.read.format("image").option("recursiveFileLookup", str(deep).lower()).option("pathGlobFilter", PICTURES).load(path).select("image.*")
    origin = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))
    return rows.select(F.regexp_replace(origin, "^file:/*", "/").alias("path"), "width", "height", F.col("nChannels").alias("n_channels"), "data", (F.col("width") > 0).alias("decoded"))


def gray(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Brightness of a picture whose channels are blue, green, red (and alpha)."""
    p = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    return p[..., 0] if channels == 1 else np.rint(p[..., 0] * 0.114 + p[..., 1] * 0.587 + p[..., 2] * 0.299)


def laplacian_variance(g: np.ndarray) -> float:
    """Edges mirror without repeating the edge; a side of one pixel repeats it."""
    pad = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    out = pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * g
    return float(out.var())


def resize(g: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""

    def along(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, n - 1), x - low

    r0, r1, fr = along(g.shape[0], height)
    c0, c1, fc = along(g.shape[1], width)
    top = g[r0][:, c0] * (1 - fc) + g[r0][:, c1] * fc
    low = g[r1][:, c0] * (1 - fc) + g[r1][:, c1] * fc
    return np.rint(top * (1 - fr[:, None]) + low * fr[:, None])


def difference_hash(g: np.ndarray, size: int = HASH_SIZE) -> int:
    s = resize(g, size + 1, size)
    out = 0
    for bit in (s[:, 1:] > s[:, :-1]).ravel():
        out = out << 1 | int(bit)
    return out - (1 << 64) if out >> 63 & 1 and size == 8 else out


def _measure(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.DataFrame:
    out = []
    for d, w, h, c in zip(data, width, height, channels, strict=True):
        if d is None or w is None or w <= 0:
            out.append((None, None, None, None))
            continue
        g = gray(d, int(w), int(h), int(c))
        out.append((laplacian_variance(g), g.mean() / 255, g.std() / 255, difference_hash(g)))
    return pd.DataFrame(out, columns=["sharpness", "brightness", "contrast", "hash"]).astype({"hash": "Int64"})


def measure(pictures: DataFrame) -> DataFrame:
    """pictures with sharpness, brightness, contrast, hash and is_blank; null for those
    that can't be decoded."""
    f = pandas_udf(_measure, "struct<sharpness:double,brightness:double,contrast:double,hash:bigint>")
    rows = pictures.withColumn("m", f("data", "width", "height", "n_channels")).drop("data")
    return rows.select("*", "m.*", (F.col("m.sharpness") < BLANK_SHARPNESS).alias("is_blank")).drop("m")


def check(measured: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """measured with resolution_ok: null unless both expected sides are given."""
    fits = None if width is None or height is None else (F.col("width") == width) & (F.col("height") == height)
    return measured.withColumn("resolution_ok", F.lit(None).cast("boolean") if fits is None else fits)


def motion_intensity(frames: list[np.ndarray], samples: int = 5) -> float | None:
    """Mean difference of frames to the next one, in percent of full brightness; null
    with fewer than two frames."""
    n = len(frames)
    if n < 2:
        return None
    starts = range(n - 1) if samples >= n - 1 else [i * (n - 2) // samples for i in range(samples)]
    return float(np.mean([np.abs(frames[i + 1].astype(float) - frames[i].astype(float)).mean() / 255 * 100 for i in starts]))


def video_motion(path: str, samples: int = 5) -> float | None:
    """motion_intensity of a clip by the pairs of frames that it looks at, decoded by ffmpeg."""
    m = json.loads(ffprobe(path))
    v = next((s for s in m.get("streams", []) if s.get("codec_type") == "video"), None)
    if v is None:
        raise OSError("no video stream")
    a, _, b = v.get("avg_frame_rate", "0/1").partition("/")
    counted, length = str(v.get("nb_frames", "")), float(m.get("format", {}).get("duration", 0) or 0)
    n = int(counted) if counted.isdigit() else round(length * float(a) / float(b or 1)) if float(b or 1) else 0
    if n < 2:
        return None
    starts = list(range(n - 1)) if samples >= n - 1 else [i * (n - 2) // samples for i in range(samples)]
    at = sorted({j for i in starts for j in (i, i + 1)})
    command = ["ffmpeg", "-v", "error", "-noautorotate", "-i", path, "-vf", "select=" + "+".join(f"eq(n\\,{j})" for j in at), "-fps_mode", "passthrough", "-f", "rawvideo", "-pix_fmt", "gray", "-"]
    if shutil.which("ffmpeg") is None:
        raise OSError("ffmpeg is not installed")
    out = subprocess.run(command, capture_output=True, timeout=300)
    if out.returncode:
        raise OSError(out.stderr.decode(errors="replace").strip()[-500:] or f"ffmpeg ended with {out.returncode}")
    frames = dict(zip(at, np.frombuffer(out.stdout, np.uint8).reshape(-1, int(v["height"]), int(v["width"])), strict=False))
    pairs = [motion_intensity([frames[i], frames[i + 1]]) for i in starts if i + 1 in frames]
    return float(np.mean(pairs)) if pairs else None


def motion(clips: DataFrame, column: str, meter: Callable[[str], float | None] = video_motion, snapshot: str | None = None) -> DataFrame:
    """column, motion, motion_error of each clip of a column of paths. snapshot: a folder that
    keeps what was measured; unchanged clips in it are not measured again."""
    if snapshot is not None:
        return incremental(clips, snapshot, f"motion-{column}", lambda some: motion(some, column, meter), F.col("motion_error").isNull(), column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch[column]:
                try:
                    found = meter(path)
                    out.append((path, found, "fewer than two frames" if found is None else None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=[column, "motion", "motion_error"])

    return clips.select(column).distinct().mapInPandas(run, f"`{column}` string, motion double, motion_error string")
