"""Targets, captions and references of a dataset folder, paired by stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DataConfig
from ..constants import BLANK_SHARPNESS, CAPTION_SUFFIXES, ERROR, REFERENCE_SUFFIXES, TARGET_SUFFIXES, TOKEN_LIMIT, WARNING
from ..functions import text as T
from .video_spec import gathered, has_error, issue


def role(suffix: Column) -> Column:
    s = F.lower(suffix)
    return F.when(s.isin(TARGET_SUFFIXES), "target").when(s.isin(CAPTION_SUFFIXES), "caption").when(s.isin(REFERENCE_SUFFIXES), "reference").otherwise("other")


def with_roles(files: DataFrame, only: str | None = None) -> DataFrame:
    """files (path, suffix) with the role. only: the role of the folder that they were
    listed in, in the hierarchical layout; files of another kind are other there."""
    kind = role(F.col("suffix"))
    return files.withColumn("role", kind if only is None else F.when(kind == only, kind).otherwise("other"))


def last_by_stem(signals: DataFrame, keys: list[str], path: str, name: str) -> DataFrame:
    """Of signals with one stem the last path; earlier ones are not seen again."""
    return signals.groupBy(*keys).agg(F.max(path).alias(name))


def pair(targets: DataFrame, captions: DataFrame, references: DataFrame, keys: list[str] | None = None, config: DataConfig = DataConfig()) -> DataFrame:
    """targets (keys, target) with caption, reference and issues of what is missing.
    Targets of one stem share its signals."""
    keys = keys or ["stem"]
    rows = targets.join(last_by_stem(captions, keys, "caption", "caption"), keys, "left").join(last_by_stem(references, keys, "reference", "reference"), keys, "left")
    found = gathered(
        issue(F.col("caption").isNull() & F.lit(config.caption_required), "CAPTION_MISSING", ERROR, "caption", F.col("target"), "a caption", "no caption for the target"),
        issue(F.col("reference").isNull() & F.lit(config.reference_required), "REFERENCE_MISSING", ERROR, "reference", F.col("target"), "a reference", "no reference for the target"),
    )
    return rows.withColumn("issues", found)


def orphans(targets: DataFrame, signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["stem"]
    return signals.join(targets.select(*keys).distinct(), keys, "left_anti")


def empty_sources(sources: DataFrame, targets: DataFrame) -> DataFrame:
    return sources.join(targets.select("source").distinct(), "source", "left_anti")


def orphan_issues(orphans: DataFrame) -> DataFrame:
    """orphans (path) with the issue that each is."""
    found = issue(F.lit(True), "ORPHANED_FILE", WARNING, "dataset", F.col("path"), "a target of that stem", "no target goes with the file")
    return orphans.withColumn("issues", gathered(found))


def empty_issues(empty: DataFrame) -> DataFrame:
    """Sources without targets (source) with the issue that each is."""
    found = issue(F.lit(True), "DATASET_EMPTY", ERROR, "dataset", F.col("source"), "targets", "the dataset has no targets")
    return empty.withColumn("issues", gathered(found))


def check_captions(samples: DataFrame, content: str = "content", limit: int = TOKEN_LIMIT) -> DataFrame:
    """samples (caption, content as bytes, issues) with what is wrong with the text. One
    that isn't UTF-8 is corrupt and counts as empty as well."""
    raw = F.coalesce(F.col(content), F.lit(b""))
    good = F.is_valid_utf8(raw.cast("string"))
    text = F.when(good, T.strip(raw.cast("string"))).otherwise("")
    here = F.col("caption").isNotNull()
    n = T.token_estimate(T.words(text))
    found = gathered(
        issue(here & ~good, "FILE_CORRUPTED", ERROR, "caption", F.col("caption"), "UTF-8", "the caption can't be read"),
        issue(here & (text == ""), "CAPTION_EMPTY", WARNING, "caption", F.col("caption"), "text", "the caption is empty"),
        issue(here & (n > limit), "CAPTION_TOO_LONG", WARNING, "caption", n, str(limit), "the caption has too many tokens"),
    )
    return samples.withColumn("issues", F.concat("issues", found))


def check_references(samples: DataFrame, blur: float | None = None, exposure: tuple[float, float] | None = None) -> DataFrame:
    """samples (reference, decoded, sharpness, brightness, issues) with what is wrong
    with the reference image."""
    here, sharp, light = F.col("reference").isNotNull(), F.col("sharpness"), F.col("brightness")
    low, high = exposure or (0.0, 1.0)
    found = gathered(
        issue(here & ~F.col("decoded"), "FILE_CORRUPTED", ERROR, "reference", F.col("reference"), "an image", "the reference can't be decoded"),
        issue(here & (sharp < BLANK_SHARPNESS), "REFERENCE_BLANK", ERROR, "reference", sharp, str(BLANK_SHARPNESS), "the reference is blank"),
        issue(here & F.lit(blur is not None) & (sharp < (blur or 0.0)), "BLUR_BELOW_THRESHOLD", WARNING, "reference", sharp, str(blur), "the reference is blurred"),
        issue(here & F.lit(exposure is not None) & ((light < low) | (light > high)), "EXPOSURE_OUT_OF_RANGE", WARNING, "reference", light, f"{low}-{high}", "the reference is too dark or too bright"),
    )
    return samples.withColumn("issues", F.concat("issues", found))


def check_types(samples: DataFrame, target: Column, reference: Column) -> DataFrame:
    """samples with an issue where the first bytes of a file are of another kind than its
    role: target, reference say whether they fit, null if that isn't known."""
    found = gathered(
        issue(~target, "FILE_TYPE_INVALID", ERROR, "target", F.col("target"), "a video", "the target is no video"),
        issue(~reference, "FILE_TYPE_INVALID", ERROR, "reference", F.col("reference"), "an image", "the reference is no image"),
    )
    return samples.withColumn("issues", F.concat("issues", found))


def check_motion(samples: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """samples (motion, issues); what can't be measured (null) is passed over."""
    m = F.col("motion")
    found = gathered(
        issue(F.lit(low is not None) & (m < (low or 0.0)), "MOTION_BELOW_MIN", WARNING, "motion", m, str(low), "too little motion"),
        issue(F.lit(high is not None) & (m > (high or 0.0)), "MOTION_ABOVE_MAX", WARNING, "motion", m, str(high), "too much motion"),
    )
    return samples.withColumn("issues", F.concat("issues", found))


def counts(samples: DataFrame, *by: str) -> DataFrame:
    of = lambda s: F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s))).cast("long")
    rows = samples.withColumn("is_valid", ~has_error()).groupBy(*by)
    return rows.agg(F.count("*").alias("samples"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"), F.coalesce(of(ERROR), F.lit(0)).alias("errors"), F.coalesce(of(WARNING), F.lit(0)).alias("warnings"))


def levels(samples: DataFrame, cross: DataFrame | None = None) -> DataFrame:
    """level (sample, dataset or report), source, stem, samples, valid, errors and warnings, in one
    pass over grouping sets. cross: rows with issues of datasets rather than of a sample; they count
    once, in the report alone."""
    of = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s)).cast("long")
    named = {"errors": of(ERROR), "warnings": of(WARNING), "valid": (~has_error()).cast("long"), "samples": F.lit(1).cast("long")}
    rows = samples.select("source", "stem", *[c.alias(k) for k, c in named.items()])
    if cross is not None:
        none = F.lit(0).cast("long")
        own = cross.select(of(ERROR).alias("errors"), of(WARNING).alias("warnings"), none.alias("valid"), none.alias("samples"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    mine = F.col("samples") == 1
    sets = rows.groupingSets([["source", "stem"], ["source"], []], "source", "stem")
    sums = [F.sum(c).alias(c) for c in ("samples", "valid")]
    sums += [f.alias(k) for c in ("errors", "warnings") for k, f in ((c, F.sum(F.when(mine, F.col(c)))), (f"cross_{c}", F.sum(F.when(~mine, F.col(c)))))]
    found = sets.agg(F.grouping_id().alias("id"), *sums).where("id = 3 or samples > 0")
    total = lambda c: F.coalesce(c, F.lit(0)) + F.when(F.col("id") == 3, F.coalesce(f"cross_{c}", F.lit(0))).otherwise(0)
    level = F.when(F.col("id") == 0, "sample").when(F.col("id") == 1, "dataset").otherwise("report")
    return found.select(level.alias("level"), "source", "stem", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("valid", F.lit(0)).alias("valid"), total("errors").alias("errors"), total("warnings").alias("warnings"))
