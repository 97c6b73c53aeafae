"""Configurations of trainers, from a dataset's totals."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import DataConfig


@dataclass(frozen=True)
class Totals:
    frame_counts: list[int]
    has_references: bool
    width: int
    height: int


def totals(samples: DataFrame, config: DataConfig) -> Totals:
    """One row over all samples (frame_count, reference)."""
    row = samples.agg(F.array_sort(F.collect_set("frame_count")).alias("n"), F.coalesce(F.bool_or(F.col("reference").isNotNull()), F.lit(False)).alias("refs")).first()
    height = config.video.resolution
    return Totals(list(row["n"]), bool(row["refs"]), {480: 854, 720: 1280, 1080: 1920}.get(height, int(height * 16 / 9)), height)


TRAINERS: dict[str, tuple[str, Callable[[str, str, Totals, DataConfig], str]]] = {}


def register(name: str, file: str) -> Callable:
    def add(make):
        TRAINERS[name] = (file, make)
        return make

    return add


def generate(name: str, folder: str, layout: str, t: Totals, config: DataConfig) -> tuple[str, str]:
    """File name and text of a trainer's configuration."""
    if name not in TRAINERS:
        raise ValueError(f"no trainer {name}; there are {', '.join(sorted(TRAINERS))}")
    file, make = TRAINERS[name]
    return file, make(folder.replace("\\", "/").rstrip("/"), layout, t, config)


def _folders(folder: str, layout: str) -> tuple[str, str]:
    return (folder, folder) if layout == "flat" else (f"{folder}/training/targets", f"{folder}/training/signals/references")


@register("musubi", "musubi_dataset.toml")
def musubi(folder: str, layout: str, t: Totals, config: DataConfig) -> str:
    videos, references = _folders(folder, layout)
    repeats = config.datasets[0].repeats if config.datasets else 1
    lines = ["[general]", f"resolution = [{t.width}, {t.height}]", 'caption_extension = ".txt"', "batch_size = 1", "enable_bucket = true", "bucket_no_upscale = true", ""]
    lines += ["[[datasets]]", f'video_directory = "{videos}"', f'cache_directory = "{folder}/cache"', f"target_frames = {json.dumps(t.frame_counts or [config.video.max_frames or 81])}", 'frame_extraction = "head"', f"num_repeats = {repeats}"]
    if t.has_references:
        lines.append(f'control_directory = "{references}"')
    return "\n".join(lines) + "\n"


@register("aitoolkit", "aitoolkit_config.yaml")
def aitoolkit(folder: str, layout: str, t: Totals, config: DataConfig) -> str:
    videos, references = _folders(folder, layout)
    lines = ["job: extension", "config:", f"  name: {json.dumps(config.name or 'dataset')}", "  process:", "    - type: sd_trainer", "      datasets:", f"        - folder_path: {json.dumps(videos)}", "          caption_ext: txt"]
    lines += [f"          num_frames: {max(t.frame_counts, default=config.video.max_frames or 81)}", f"          resolution: [{t.width}, {t.height}]"]
    if t.has_references:
        lines.append(f"          control_path: {json.dumps(references)}")
    return "\n".join(lines) + "\n"
