"""Manifests as JSON, made and read by plans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import CLIP_SUFFIXES, ERROR, REFERENCE_SUFFIXES, WARNING
from .functions.media import file_suffix
from .lineage import discard, hadoop_path
from .operators.video_spec import has_error

SCENE_SCHEMA = "struct<triage_mode:string,videos:array<struct<file:string,path:string,total_scenes:bigint,scenes:array<struct<scene_index:bigint,start_time:double,end_time:double,text_overlay:boolean,include:boolean>>>>>"


def frame_counts(column: str = "frame_count") -> Column:
    return F.array_sort(F.collect_set(column))


def _problems() -> Column:
    return F.filter("issues", lambda x: x["severity"].isin(ERROR, WARNING))


def _brief() -> Column:
    return F.transform(_problems(), lambda x: F.struct(x["code"].alias("code"), x["severity"].alias("severity"), x["message"].alias("message")))


def _source_totals() -> list[Column]:
    """The counts and suffixes of a source's samples."""
    suffixes = lambda c: F.array_sort(F.collect_set(file_suffix(F.col(c))))
    of = lambda s: F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s)))
    return [
        F.count("*").alias("total_samples"), F.count_if(~has_error()).alias("valid_samples"), of(ERROR).alias("errors"), of(WARNING).alias("warnings"),
        F.struct(suffixes("target").alias("target"), suffixes("caption").alias("caption"), suffixes("reference").alias("reference")).alias("suffixes"),
    ]


def dataset_manifest(samples: DataFrame, source: str = "source") -> DataFrame:
    """source, manifest: for each source a JSON object with its counts, suffixes by role
    and the samples that have errors or warnings, in order of their stems. All of them are in one
    cell, so for sources of a size that one object holds; dataset_lines() has no such bound."""
    entry = F.struct("stem", "target", _brief().alias("issues"))
    rows = samples.groupBy(source).agg(*_source_totals(), F.array_sort(F.collect_list(F.when(F.size(_problems()) > 0, entry))).alias("samples"))
    return rows.select(source, F.to_json(F.struct(*[c for c in rows.columns])).alias("manifest"))


def dataset_lines(samples: DataFrame, source: str = "source") -> DataFrame:
    """line: what dataset_manifest() says, as a JSON line (kind source) for each source, with its
    counts and suffixes, and one (kind sample) for each sample that has errors or warnings."""
    totals = samples.groupBy(F.col(source).alias("source")).agg(*_source_totals())
    found = samples.where(F.size(_problems()) > 0).select(F.col(source).alias("source"), "stem", "target", _brief().alias("issues"))
    line = lambda rows, kind: rows.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *rows.columns)).alias("line"))
    return line(totals, "source").unionByName(line(found, "sample"))


LINE_SCHEMA = "struct<kind:string,source:string,total_samples:bigint,valid_samples:bigint,errors:bigint,warnings:bigint,suffixes:struct<target:array<string>,caption:array<string>,reference:array<string>>,stem:string,target:string,issues:array<struct<code:string,severity:string,message:string>>>"


def read_dataset_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The sources, and the samples with errors or warnings, of written lines."""
    rows = spark.read.text(path).select(F.from_json("value", LINE_SCHEMA).alias("m")).select("m.*")
    sources = rows.where("kind = 'source'").select("source", "total_samples", "valid_samples", "errors", "warnings", "suffixes")
    return sources, rows.where("kind = 'sample'").select("source", "stem", "target", "issues")


def publish(lines: DataFrame, path: str) -> None:
    """Writes lines (one column of text) as the files of a folder, which appears when all of them
    are written: a job that fails leaves the folder that was there, and none that is half new.
    Lines stay in their partitions, so no task holds a manifest."""
    spark, whole = lines.sparkSession, path.rstrip("/")
    parent, _, name = whole.rpartition("/")
    beside = lambda what: f"{parent}/.{name}.{what}-{uuid.uuid4().hex}" if parent else f".{name}.{what}-{uuid.uuid4().hex}"
    fresh, older = beside("new"), beside("old")
    try:
        lines.write.text(fresh)
    except BaseException:
        discard(spark, fresh)
        raise
    at, to = hadoop_path(spark, fresh), hadoop_path(spark, whole)
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(to) and not files.rename(to, hadoop_path(spark, older)):
        raise OSError(f"{whole} can't be replaced")
    if not files.rename(at, to):
        raise OSError(f"{fresh} can't be named {whole}")
    discard(spark, older)


DATASET_SCHEMA = "struct<source:string,total_samples:bigint,valid_samples:bigint,errors:bigint,warnings:bigint,suffixes:struct<target:array<string>,caption:array<string>,reference:array<string>>,samples:array<struct<stem:string,target:string,issues:array<struct<code:string,severity:string,message:string>>>>>"


def read_dataset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The fields of written dataset manifests, a row for each source."""
    return spark.read.text(path).select(F.from_json("value", DATASET_SCHEMA).alias("m")).select("m.*")


def _videos(scenes: DataFrame) -> DataFrame:
    """file, path, total_scenes, scenes of each video, times with 3 decimals."""
    scene = F.struct("scene_index", F.round("start", 3).alias("start_time"), F.round("end", 3).alias("end_time"), F.col("has_overlay").alias("text_overlay"), "include")
    videos = scenes.groupBy("video").agg(F.array_sort(F.collect_list(scene)).alias("scenes"))
    path = F.col("video").cast("string")
    return videos.select(F.element_at(F.split(path, "/"), -1).alias("file"), path.alias("path"), F.size("scenes").cast("long").alias("total_scenes"), "scenes")


def scene_manifest(scenes: DataFrame) -> DataFrame:
    """One row, manifest: scenes (video, scene_index, start, end, has_overlay, include) by
    video. All of them are in one cell; scene_lines() has no such bound."""
    rows = _videos(scenes)
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("videos")).select(F.to_json(F.struct(F.lit("scene").alias("triage_mode"), "videos")).alias("manifest"))


def scene_lines(scenes: DataFrame) -> DataFrame:
    """line: what scene_manifest() says, as a JSON line for each video."""
    rows = _videos(scenes)
    return rows.select(F.to_json(F.struct(F.lit("scene").alias("triage_mode"), *rows.columns)).alias("line"))


def included_scenes(manifest: DataFrame) -> DataFrame:
    """video, scene_index, start, end of the scenes to ingest, and at, the place of the video
    in the manifest; a scene without include is left out. A manifest of another mode is an
    error."""
    m = F.from_json("manifest", SCENE_SCHEMA)
    checked = F.when(F.coalesce(m["triage_mode"], F.lit("")) == "scene", m).otherwise(F.raise_error(F.lit("not a manifest of scenes")))
    videos = manifest.select(F.posexplode(checked["videos"]).alias("at", "v"))
    scenes = videos.select("at", F.col("v.path").alias("video"), F.explode("v.scenes").alias("s")).where(F.coalesce("s.include", F.lit(False)))
    return scenes.select(F.col("video"), "s.scene_index", F.col("s.start_time").alias("start"), F.col("s.end_time").alias("end"), "at")


def included_of_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """included_scenes() of scene_lines(), without places: of equal names the first path counts."""
    video = SCENE_SCHEMA.removeprefix("struct<triage_mode:string,videos:array<struct<").removesuffix(">>>")
    m = F.from_json(column, f"struct<triage_mode:string,{video}>")
    # Decided in the row itself, as a condition that a filter holds may be judged before it.
    scenes = F.when(F.coalesce(m["triage_mode"], F.lit("")) == "scene", m["scenes"]).otherwise(F.raise_error(F.lit("not a manifest of scenes")))
    rows = lines.where(F.trim(column) != "").select(m["path"].alias("video"), F.explode(scenes).alias("s"))
    return rows.where(F.coalesce("s.include", F.lit(False))).select("video", "s.scene_index", F.col("s.start_time").alias("start"), F.col("s.end_time").alias("end"))


def read_scene_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The scenes to ingest of a written manifest: lines, or one object."""
    lines = spark.read.text(path)
    if lines.where(F.get_json_object("value", "$.path").isNotNull()).limit(1).count():
        return included_of_lines(lines)
    return included_scenes(spark.read.text(path, wholetext=True).withColumnRenamed("value", "manifest"))


def clip_manifest(clips: DataFrame) -> DataFrame:
    """A JSON line for each clip; durations with 3 decimals, keys without a value left out."""
    return clips.select(F.to_json(F.struct(*[F.bround(c, 3).alias(c) if c == "duration" else F.col(c) for c in clips.columns])).alias("line"))


def reference_manifest(extracted: DataFrame) -> DataFrame:
    """A JSON line for each reference made in this run."""
    rows = extracted.where("success and not skipped")
    return rows.select(F.to_json(F.struct(*[F.bround(c, 2).alias(c) if c == "sharpness" else F.col(c) for c in rows.columns])).alias("line"))


def extraction_report(extracted: DataFrame) -> DataFrame:
    return extracted.agg(
        F.count("*").alias("total"), F.count_if(F.col("success") & ~F.col("skipped")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
        F.count_if("skipped").alias("skipped"), F.count_if(F.col("source_type") == "video").alias("videos"), F.count_if(F.col("source_type") != "video").alias("images"),
    )


def triage_manifest(triaged: DataFrame, key: str) -> DataFrame:
    """A JSON line for each triaged clip: matches with 3 decimals, best first. Of clips of
    triage.typed() also the types of their matches, and which use case and anchor captions take."""
    known = "use_case" in triaged.columns
    brief = F.transform("matches", lambda m: F.struct(m["concept"].alias("concept"), *([m["type"].alias("type")] if known else []), F.bround(m["similarity"], 3).alias("similarity"), m["best_frame"].alias("best_frame")))
    more = ["use_case", "anchor_word"] if known else []
    return triaged.select(F.to_json(F.struct(F.col(key), F.col("has_overlay").alias("text_overlay"), "include", "folder", brief.alias("matches"), *more)).alias("line"))


def selections(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, auto from a JSON object of file names."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<frame:int,auto:boolean>>").alias("m"))
    return rows.select(F.explode("m").alias("file", "pick")).select("file", "pick.frame", F.coalesce("pick.auto", F.lit(False)).alias("auto"))


def selection_template(files: DataFrame) -> DataFrame:
    """One row, template: a JSON object of the names of clips, each to be picked at frame 0
    until the user says otherwise, and of pictures, which are taken as they are. For a user
    to edit, so for folders of a size that one can."""
    still = F.col("suffix").isin(REFERENCE_SUFFIXES)
    entry = F.struct("name", F.struct(F.when(~still, F.lit(0)).alias("frame"), F.when(still, F.lit(True)).alias("auto")).alias("pick"))
    rows = files.where(still | F.col("suffix").isin(CLIP_SUFFIXES))
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("template"))


def selected(files: DataFrame, picks: DataFrame) -> DataFrame:
    """picks with the path, stem and suffix of their file; error says which are not there."""
    rows = picks.join(files.select(F.col("name").alias("file"), "path", "stem", "suffix"), "file", "left")
    return rows.withColumn("error", F.when(F.col("path").isNull(), "no such file"))
