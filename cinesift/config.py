"""Settings: the file a user writes, checked field by field."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from .constants import BUCKET_LEAST

USE_CASES = ("character", "style", "motion", "object")


class ConfigError(ValueError):
    """All that is wrong with a configuration, a line for each field."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class VideoConfig:
    fps: int = 16
    resolution: int = 720
    frame_count: int | None = None  # None: auto
    upscale_policy: str = "never"
    sar_policy: str = "auto_correct"
    max_frames: int | None = 81
    downscale_method: str = "lanczos"

    def problems(self) -> list[str]:
        bad = []
        if not self.fps > 0:
            bad.append("video.fps: must be positive")
        if self.resolution not in (480, 720):
            bad.append("video.resolution: 480 or 720")
        if self.frame_count is not None and not (1 <= self.frame_count <= 161 and (self.frame_count - 1) % 4 == 0):
            bad.append("video.frame_count: auto or 4n+1 up to 161")
        if self.upscale_policy not in ("never", "warn"):
            bad.append("video.upscale_policy: never or warn")
        if self.sar_policy not in ("auto_correct", "reject"):
            bad.append("video.sar_policy: auto_correct or reject")
        if self.max_frames is not None and self.max_frames < 1:
            bad.append("video.max_frames: 1 or more, or null")
        if self.downscale_method not in ("lanczos", "bicubic", "bilinear", "area"):
            bad.append("video.downscale_method: lanczos, bicubic, bilinear or area")
        return bad


@dataclass(frozen=True)
class QualityConfig:
    blur_threshold: float | None = None
    exposure_range: tuple[float, float] | None = None
    motion_min: float | None = None
    motion_max: float | None = None
    check_duplicates: bool = False
    min_resolution: int = 720


@dataclass(frozen=True)
class Source:
    path: str
    repeats: int = 1
    loss_multiplier: float = 1.0
    is_regularization: bool = False

    def problems(self) -> list[str]:
        out = [] if self.repeats >= 1 else ["datasets.repeats: 1 or more"]
        return out if self.loss_multiplier > 0 else [*out, "datasets.loss_multiplier: must be positive"]


@dataclass(frozen=True)
class DataConfig:
    name: str | None = None
    use_case: str | None = None
    description: str = ""
    datasets: tuple[Source, ...] = ()
    video: VideoConfig = VideoConfig()
    quality: QualityConfig = QualityConfig()
    caption_required: bool = True
    reference_required: bool = False
    max_tokens: int = 512
    min_bucket_size: int = BUCKET_LEAST
    #: Parsed and kept, though no operator reads them.
    text: dict[str, Any] = field(default_factory=dict)
    reference: dict[str, Any] = field(default_factory=dict)
    bucketing: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)

    def problems(self) -> list[str]:
        bad = self.video.problems() + [p for d in self.datasets for p in d.problems()]
        if self.use_case not in (None, *USE_CASES):
            bad.append(f"dataset.use_case: one of {', '.join(USE_CASES)}")
        if self.max_tokens < 1:
            bad.append("controls.text.max_tokens: must be positive")
        if self.min_bucket_size < 1:
            bad.append("bucketing.min_bucket_size: 1 or more")
        if not self.datasets:
            bad.append("datasets: at least one")
        return bad


def _known(kind, values: dict, where: str, bad: list[str]) -> dict:
    names = {f.name for f in fields(kind)} if is_dataclass(kind) else set()
    bad += [f"{where}.{k}: no such setting" for k in values if k not in names]
    return {k: v for k, v in values.items() if k in names}


def build(raw: dict[str, Any], base: str = ".") -> DataConfig:
    """A configuration from the nested mapping of a file; paths are relative to base."""
    bad: list[str] = []
    dataset, controls = raw.get("dataset") or {}, raw.get("controls") or {}
    entries = raw.get("datasets") or ([{"path": dataset["path"]}] if dataset.get("path") else [])
    sources = []
    for entry in entries:
        values = _known(Source, entry, "datasets", bad)
        if "path" not in values:
            bad.append("datasets.path: missing")
            continue
        values["path"] = os.path.normpath(os.path.join(base, values["path"]))
        sources.append(Source(**values))
    video = dict(raw.get("video") or {})
    if video.get("frame_count") == "auto":
        video["frame_count"] = None
    quality = dict(raw.get("quality") or {})
    motion = quality.pop("motion", None) or {}
    quality |= {"motion_min": motion.get("min_intensity"), "motion_max": motion.get("max_intensity")}
    if quality.get("exposure_range") is not None:
        quality["exposure_range"] = tuple(quality["exposure_range"])
    text, images, buckets = controls.get("text") or {}, controls.get("images") or {}, raw.get("bucketing") or {}
    reference = images.get("reference") or {}
    out = DataConfig(
        name=dataset.get("name"), use_case=dataset.get("use_case"), description=dataset.get("description") or "", datasets=tuple(sources),
        video=VideoConfig(**_known(VideoConfig, video, "video", bad)), quality=QualityConfig(**_known(QualityConfig, quality, "quality", bad)),
        caption_required=text.get("required", True), reference_required=reference.get("required", False), max_tokens=text.get("max_tokens", 512), min_bucket_size=buckets.get("min_bucket_size", BUCKET_LEAST),
        text=text, reference=reference, bucketing=buckets, metadata=raw.get("metadata") or {},
    )
    if bad := bad + out.problems():
        raise ConfigError(bad)
    return out


def load(path: str, file_name: str = "data.yaml") -> DataConfig:
    """From a YAML (or JSON) file, a folder with one, or a bare dataset folder."""
    if os.path.isdir(path):
        inside = os.path.join(path, file_name)
        if not os.path.isfile(inside):
            return build({"datasets": [{"path": os.path.abspath(path)}]})
        path = inside
    if not os.path.isfile(path):
        raise ConfigError([f"{path}: no such file"])
    with open(path, encoding="utf-8") as f:
        content = f.read()
    try:
        import yaml

        raw = yaml.safe_load(content)
    except ImportError:  # JSON is the part of YAML that needs no library
        import json

        raw = json.loads(content) if content.strip() else {}
    out = build(raw if isinstance(raw, dict) else {}, os.path.dirname(os.path.abspath(path)))
    if missing := [f"datasets.path: {d.path} does not exist" for d in out.datasets if not os.path.exists(d.path)]:
        raise ConfigError(missing)
    return out
