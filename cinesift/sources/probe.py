"""Container metadata: the JSON of a prober, parsed by plans."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import frame_rate, sample_aspect
from .snapshot import incremental

SCHEMA = "struct<streams:array<struct<codec_type:string,codec_name:string,width:string,height:string,r_frame_rate:string,avg_frame_rate:string,nb_frames:string,duration:string,pix_fmt:string,sample_aspect_ratio:string,bit_rate:string>>,format:struct<duration:string,format_name:string,bit_rate:string,size:string>>"
SECONDS = 30


def ffprobe(path: str) -> str:
    out = subprocess.run(["ffprobe", "-v", "error", "-print_format", "json", "-show_format", "-show_streams", path], capture_output=True, text=True, timeout=SECONDS)
    if out.returncode:
        raise OSError(out.stderr.strip() or f"ffprobe ended with {out.returncode}")
    return out.stdout


def run(files: DataFrame, prober: Callable[[str], str] = ffprobe, snapshot: str | None = None) -> DataFrame:
    """path, json, error for each file (path): what fails is a row with an error. snapshot: a
    folder that keeps what was probed; unchanged files in it are not probed again."""
    if snapshot is not None:
        found = incremental(files, snapshot, "probed", lambda some: _run(some, prober), F.col("error").isNull())
        return files.select("path").join(found, "path")
    return _run(files, prober)


def _run(files: DataFrame, prober: Callable[[str], str]) -> DataFrame:

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        missing = prober is ffprobe and shutil.which("ffprobe") is None
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    if missing:
                        raise OSError("ffprobe is not installed")
                    out.append((path, prober(path), None))
                except Exception as e:  # noqa: BLE001  a file that can't be probed is a row, not the end of the job
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "json", "error"])

    return files.select("path").mapInPandas(probe, "path string, json string, error string")


def parse(probed: DataFrame) -> DataFrame:
    """Metadata of each row of run(): the first video stream's; error says what is missing."""
    m = F.from_json("json", SCHEMA)
    v = F.get(F.filter(m["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = lambda c: frame_rate(F.coalesce(v[c], F.lit("")))
    rows = probed.select("path", "error", v.alias("v"), m["format"].alias("f"), F.coalesce(F.exists(m["streams"], lambda s: s["codec_type"] == "audio"), F.lit(False)).alias("has_audio"), F.when(rate("r_frame_rate") > 0, rate("r_frame_rate")).otherwise(rate("avg_frame_rate")).alias("fps"))
    number = lambda c, k: F.col(c).try_cast(k)
    duration = F.coalesce(number("f.duration", "double"), number("v.duration", "double"), F.lit(0.0))
    rows = rows.withColumn("duration", duration)
    counted = F.coalesce(number("v.nb_frames", "bigint"), F.bround(F.col("duration") * F.col("fps")).cast("bigint"))
    return rows.select(
        "path", number("v.width", "int").alias("width"), number("v.height", "int").alias("height"), "fps", counted.alias("frame_count"), "duration", F.col("v.codec_name").alias("codec"), F.col("v.pix_fmt").alias("pix_fmt"),
        sample_aspect(F.col("v.sample_aspect_ratio")).alias("sar"), F.coalesce(number("v.bit_rate", "bigint"), number("f.bit_rate", "bigint")).alias("bit_rate"), number("f.size", "bigint").alias("file_size"), "has_audio",
        F.col("f.format_name").alias("container"), F.coalesce("error", F.when(F.col("v").isNull(), "no video stream")).alias("error"),
    )
