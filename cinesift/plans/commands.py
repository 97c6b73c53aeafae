"""The ten commands over folders of clips, captions and references."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import backends, manifests, prompts
from ..config import DataConfig, VideoConfig
from ..constants import CANDIDATE_FRAMES, CAPTION_SUFFIXES, CLIP_SUFFIXES, CONCEPT_SIMILARITY, OVERLAY_SIMILARITY, SCENE_LEAST_SECONDS, SCENE_THRESHOLD, WARNING
from ..functions import media as M
from ..functions import text as T
from ..lineage import materialize
from ..operators import buckets, captions, duplicates, images, media, organize, pairing, segments, triage, video_spec
from ..sources import listing, probe


def scan(spark: SparkSession, folder: str, config: VideoConfig = VideoConfig(), prober: Callable[[str], str] = probe.ffprobe, snapshot: str | None = None) -> DataFrame:
    """Every clip with its metadata and issues; those that can't be probed have an error.
    snapshot: see probe.run()."""
    return video_spec.validate(probe.parse(probe.run(listing.clips(spark, folder), prober, snapshot)), config)


def normalize(spark: SparkSession, folder: str, out: str, config: VideoConfig = VideoConfig(), prober: Callable[[str], str] = probe.ffprobe, suffix: str | None = None) -> DataFrame:
    """output, command, action and frames for each clip of a folder. suffix: of all outputs,
    instead of each clip's own."""
    rows = video_spec.normalize_plan(scan(spark, folder, config, prober).where("error is null"), config)
    name = F.element_at(F.split("path", "/"), -1)
    name = name if suffix is None else F.concat(M.file_stem(name), F.lit(suffix))
    rows = rows.withColumn("output", F.concat(F.lit(out.rstrip("/") + "/"), name))
    frames = F.col("target_frames")
    command = F.when(F.col("action") == "encode", video_spec.encode_command(F.col("path"), F.col("output"), frames, config)).otherwise(video_spec.copy_command(F.col("path"), F.col("output"), frames))
    return rows.withColumn("command", command)


def sidecars(spark: SparkSession, folder: str, out: str, done: DataFrame) -> DataFrame:
    """source, dest of the files that go with a folder's clips and aren't under out yet.
    done: path of the clips that were made."""
    from ..constants import SIDECAR_SUFFIXES

    rows = listing.files(spark, folder, suffixes=SIDECAR_SUFFIXES).select("stem", F.col("path").alias("source"), "name")
    clips = done.select(M.file_stem(F.element_at(F.split("path", "/"), -1)).alias("stem")).distinct()
    rows = rows.join(clips, "stem", "left_semi")
    if os.path.isdir(out):
        rows = rows.join(listing.files(spark, out).select("name"), "name", "left_anti")
    return rows.select("source", F.concat(F.lit(out.rstrip("/") + "/"), "name").alias("dest"))


def entries(videos: DataFrame, included: DataFrame) -> DataFrame:
    """path, entry: the video of a manifest's scenes that each of videos (path) is, by
    its path, else by its name (the first entry)."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    by_path = included.select("video", F.col("video").alias("path"))
    first = F.min_by("video", "at") if "at" in included.columns else F.min("video")
    by_name = included.groupBy(base(F.col("video")).alias("name")).agg(first.alias("named"))
    found = videos.select("path").join(by_path.distinct(), "path", "left").withColumn("name", base(F.col("path"))).join(by_name, "name", "left")
    return found.select("path", F.coalesce("video", "named").alias("entry")).where("entry is not null")


def detect(videos: DataFrame, make: Callable[[], backends.SceneDetector], threshold: float = SCENE_THRESHOLD, least: float = SCENE_LEAST_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Cuts (video, t) of videos (path), each at least `least` seconds, in whole frames,
    after the one before; and path, error of videos that no detector has looked at."""
    found = materialize(backends.change_scores(videos, make, threshold), "scores")
    scores = found.where("error is null").select(F.col("path").alias("video"), "fps", F.explode("frames").alias("s")).select("video", "fps", "s.frame", "s.score")
    cuts = media.cuts_from_scores(scores, threshold, F.floor(F.col("fps") * least))
    cuts = cuts.join(found.select(F.col("path").alias("video"), "fps"), "video").select("video", (F.col("frame") / F.col("fps")).alias("t"))
    return cuts, found.where("error is not null").select("path", "error")


def ingest_folder(spark: SparkSession, folder: str, out: str, make: Callable[[], backends.SceneDetector], config: VideoConfig = VideoConfig(), included: DataFrame | None = None, threshold: float = SCENE_THRESHOLD, prober: Callable[[str], str] = probe.ffprobe) -> tuple[DataFrame, DataFrame]:
    """Clips to cut from a folder's videos, and path, error of the videos that can't be
    probed or searched for cuts; those aren't taken for videos without cuts. Videos
    found in a manifest (included) are not searched."""
    probed = materialize(probe.parse(probe.run(listing.clips(spark, folder), prober)).select("path", "duration", "error"), "videos")
    videos = probed.where("error is null").select("path", "duration")
    todo = videos if included is None else videos.join(entries(videos, included), "path", "left_anti")
    cuts, failed = detect(todo, make, threshold)
    return ingest(videos.join(failed, "path", "left_anti"), cuts, out, config, included), probed.where("error is not null").select("path", "error").unionByName(failed)


def ingest(videos: DataFrame, cuts: DataFrame, out: str, config: VideoConfig = VideoConfig(), included: DataFrame | None = None) -> DataFrame:
    """Clips to cut from videos (path, duration): output, command, frames and times.

    included: scenes of a manifest (video, start, end). A video is found there by its
    path, else by its name (the first entry); one that isn't found is split at its cuts.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    scene = segments.scenes(cuts, videos.select(F.col("path").alias("video"), "duration"))
    if included is not None:
        found = entries(videos, included)
        chosen = included.join(found, included["video"] == found["entry"]).select(F.col("path").alias("video"), "scene_index", "start", "end")
        scene = scene.join(found.select(F.col("path").alias("video")), "video", "left_anti").unionByName(chosen)
    name = base(F.col("video"))
    rows = segments.clips(scene, M.file_stem(name), M.file_suffix(name), config).withColumn("output", F.concat(F.lit(out.rstrip("/") + "/"), "name"))
    return rows.withColumn("command", video_spec.encode_command(F.col("video"), F.col("output"), F.col("frames"), config, F.col("start")))


def score(spark: SparkSession, folder: str) -> DataFrame:
    """Captions of a folder, worst first; empty files are empty captions."""
    rows = listing.captions(spark, folder).withColumn("text", F.col("content").cast("string")).drop("content")
    return captions.worst_first(captions.score(rows), "path")


def caption(spark: SparkSession, folder: str, make: Callable[[], backends.CaptionBackend], use_case: str | None = None, anchor: str = "", overwrite: bool = False, tags: tuple[str, ...] = (), custom: str | None = None, delay: float = 0.0, log: str | None = None, rate: float | None = None) -> DataFrame:
    """Captions of clips that have none yet: path, caption, success, error, skipped. To overwrite
    captions is to ask again, whatever earlier runs have in the log."""
    rows = listing.clips(spark, folder)
    done = listing.files(spark, folder, suffixes=[".txt"]).select("stem").distinct()
    todo = rows if overwrite else rows.join(done, "stem", "left_anti")
    prompt = prompts.build(use_case, "video", anchor, tags, custom)
    out = backends.caption(todo.select("path", prompt.alias("prompt"), F.lit(True).alias("is_video")), make, delay, log=log, rate=rate, again=overwrite).withColumn("skipped", F.lit(False))
    if overwrite:
        return out
    kept = rows.join(done, "stem", "left_semi").select("path", F.lit(None).cast("string").alias("caption"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("seconds"), F.lit(True).alias("skipped"))
    return out.unionByName(kept)


def caption_files(done: DataFrame, suffix: str = ".txt") -> DataFrame:
    """output, success, error: each new caption (path, caption) written beside its clip, whose
    own suffix gives way. Give it a written table, or texts are asked for again."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    rows = done.where(F.col("success") & F.col("caption").isNotNull())
    if "skipped" in rows.columns:
        rows = rows.where("not skipped")
    return media.write_texts(rows.select(F.concat(stem, F.lit(suffix)).alias("output"), F.col("caption").alias("text")))


def caption_summary(done: DataFrame) -> DataFrame:
    """Captions made, failed and skipped; a skipped one isn't also counted as made."""
    return done.agg(F.count_if(F.col("success") & ~F.col("skipped")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count_if("skipped").alias("skipped"))


def audit(spark: SparkSession, folder: str, make: Callable[[], backends.CaptionBackend], use_case: str | None = None, custom: str | None = None, delay: float = 0.0, log: str | None = None, rate: float | None = None) -> DataFrame:
    """Existing captions beside fresh ones, for clips that have one; the prompt is without
    anchor. A clip that fails has an error and no recommendation."""
    have = listing.captions(spark, folder).select("stem", F.col("content").cast("string").alias("existing"))
    clips = listing.clips(spark, folder).join(have, "stem")
    prompt = prompts.build(use_case, custom=custom)
    fresh = backends.caption(clips.select("path", prompt.alias("prompt"), F.lit(True).alias("is_video")), make, delay, log=log, rate=rate)
    rows = captions.audit(clips.select("path", "existing").join(fresh, "path"), "existing", "caption")
    return rows.withColumns({c: F.when(F.col("success"), F.col(c)) for c in ("similarity", "recommendation")})


def extract(spark: SparkSession, folder: str, out: str, strategy: str = "first_frame", overwrite: bool = False) -> DataFrame:
    """A plan of one reference picture for each clip or picture of a folder. The command
    takes the first frame; best_references() carries out best_frame."""
    existing = listing.files(spark, out) if os.path.isdir(out) else None
    rows = media.reference_plan(listing.files(spark, folder), out, strategy, existing, overwrite)
    still = F.col("source_type") == "image"
    return rows.withColumn("command", F.when(still, media.still_command(F.col("path"), F.col("output"))).otherwise(media.frame_command(F.col("path"), F.col("output"), F.lit(0.0))))


def extract_selected(spark: SparkSession, folder: str, out: str, picks: DataFrame, prober: Callable[[str], str] = probe.ffprobe) -> DataFrame:
    """A plan like that of extract() for the files and frames of a user's selections (file,
    frame, auto). A file that isn't there, is no clip or picture, or can't be probed has an
    error; pictures and picks marked auto are taken whole, or at their first frame."""
    rows = manifests.selected(listing.files(spark, folder), picks).withColumnRenamed("error", "missing")
    plan = media.reference_plan(rows.where("missing is null"), out, "selected").withColumn("error", F.col("error").cast("string"))
    clips = plan.where("source_type = 'video' and error is null")
    probed = materialize(probe.parse(probe.run(clips, prober)).select("path", "fps", F.coalesce("error", F.when(F.col("fps") <= 0, "no frame rate")).alias("bad")), "selected")
    plan = plan.join(probed, "path", "left").withColumn("error", F.coalesce("error", "bad"))
    number = F.when(F.col("auto"), 0).otherwise(F.coalesce("frame", F.lit(0)))
    at = F.when(F.col("fps") > 0, media.frame_at(number, F.lit(None).cast("double"), F.col("fps"))).otherwise(0.0)
    still = F.col("source_type") == "image"
    command = F.when(still, media.still_command(F.col("path"), F.col("output"))).otherwise(media.frame_command(F.col("path"), F.col("output"), at))
    gone = rows.where("missing is not null").select(F.col("file").alias("path"), F.lit(None).cast("string").alias("output"), F.col("missing").alias("error"))
    kept = plan.withColumn("command", command).select("path", "source_type", "output", "strategy", "skipped", "error", "command")
    return kept.unionByName(gone, allowMissingColumns=True).withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def best_references(spark: SparkSession, plan: DataFrame, out: str, n: int = CANDIDATE_FRAMES, prober: Callable[[str], str] = probe.ffprobe, runner: media.Runner = media.tool) -> DataFrame:
    """output, success, error, frame_number, sharpness for the clips of a plan (path,
    output): n evenly spaced frames of each are made and measured, and the sharpest is
    copied to output. Frames are made in a folder under out that is removed afterwards."""
    work = os.path.join(os.path.abspath(out), f"candidates-{uuid.uuid4().hex}")
    try:
        probed = probe.parse(probe.run(plan, prober)).select("path", "duration", F.coalesce("error", F.when(F.col("duration") <= 0, "no duration")).alias("bad"))
        rows = materialize(plan.select("path", F.col("output").alias("dest")).join(probed, "path"), "clips")
        rate = media.clip_rate(F.col("duration"), n, 1.0)
        rows = rows.withColumn("rate", rate).withColumn("dir", F.concat(F.lit(work + "/"), F.sha2("dest", 256))).withColumn("output", F.concat("dir", F.lit("/%06d.png")))
        rows = rows.withColumn("command", media.sampled_command(F.col("path"), F.col("output"), F.col("rate"), n))
        made = materialize(media.execute_many(rows.where("bad is null"), runner), "candidates")
        rows = rows.join(made, "output", "left")
        os.makedirs(work, exist_ok=True)
        frames = images.measure(images.read(spark, work)).withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]+$", 1))
        frames = frames.withColumn("index", F.regexp_extract("path", r"(\d+)\.png$", 1).cast("long") - 1).join(rows.select("dir", "rate"), "dir")
        best = materialize(media.best_frame(frames.withColumn("at", F.col("index") / F.col("rate")), "dir"), "best")
        chosen = rows.where("success").join(best, "dir")
        copied = materialize(organize.transfer(chosen.select(F.format_string("%s/%06d.png", "dir", F.col("index") + 1).alias("source"), "dest")), "copied")
        done = chosen.select("dest", "frame_number", "sharpness").join(copied.select("dest", F.col("success").alias("copied"), F.col("error").alias("uncopied")), "dest")
        rows = rows.select("dest", F.coalesce("bad", "error").alias("bad")).join(done, "dest", "left")
        error = F.coalesce("bad", "uncopied", F.when(F.col("copied").isNull(), "no frame can be read"))
        return materialize(rows.select(F.col("dest").alias("output"), error.isNull().alias("success"), error.alias("error"), "frame_number", "sharpness"), "references")
    finally:
        shutil.rmtree(work, ignore_errors=True)


def targets(spark: SparkSession, config: DataConfig) -> DataFrame:
    """path of the targets of all sources."""
    found = None
    for s in config.datasets:
        one = listing.dataset(spark, s.path).where("role = 'target'").select("path")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def validate(spark: SparkSession, config: DataConfig, metadata: DataFrame | None = None, meter: Callable[[str], float | None] = images.video_motion, snapshot: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Samples of all sources with their issues, and orphans. metadata: probed targets
    (path, width, height, frame_count, fps), joined so that buckets have dimensions.
    snapshot: a folder that keeps the motion of targets; unchanged ones aren't measured again.

    References are always measured, except those that Spark's reader leaves out or has
    no decoder for (webp, names that begin with _ or .): their measures are null and
    not judged. Motion is measured (motion, motion_error) if the settings limit it."""
    found, measured, texts = None, None, None
    for s in config.datasets:
        one = listing.dataset(spark, s.path)
        found = one if found is None else found.unionByName(one)
        if at := listing.references(s.path):
            some = images.measure(images.read(spark, at, False)).select(F.col("path").alias("reference"), "decoded", "sharpness", "brightness", "hash")
            measured = some if measured is None else measured.unionByName(some)
    of = lambda r: found.where(F.col("role") == r).select("source", "stem", F.col("path").alias(r))
    keys = ["source", "stem"]
    rows = pairing.pair(of("target"), of("caption"), of("reference"), keys, config)
    for s in config.datasets:
        one = listing.content(spark, s.path, suffixes=CAPTION_SUFFIXES)
        texts = one if texts is None else texts.unionByName(one)
    for role in ("target", "reference"):
        rows = rows.join(listing.heads(of(role), role).withColumnRenamed("head", f"{role}_head"), role, "left")
    rows = pairing.check_types(rows, listing.looks_like(F.col("target_head"), "target"), listing.looks_like(F.col("reference_head"), "reference"))
    rows = rows.join(texts.withColumnRenamed("path", "caption").dropDuplicates(["caption"]), "caption", "left")
    rows = pairing.check_captions(rows, limit=config.max_tokens).drop("content")
    if measured is not None:
        rows = rows.join(measured.dropDuplicates(["reference"]), "reference", "left")
        webp = (F.lower("reference").endswith(".webp")) & F.coalesce(F.startswith(F.hex("reference_head"), F.lit("52494646")), F.lit(False))
        hidden = F.element_at(F.split("reference", "/"), -1).rlike("^[_.]")
        decoded = F.when(F.col("reference").isNotNull() & (F.col("decoded") | ~(webp | hidden)), F.coalesce("decoded", F.lit(False))).when(F.col("reference").isNull(), F.lit(False))
        rows = pairing.check_references(rows.withColumn("decoded", decoded), config.quality.blur_threshold, config.quality.exposure_range)
    rows = rows.drop("target_head", "reference_head")
    if config.quality.motion_min is not None or config.quality.motion_max is not None:
        rows = rows.join(materialize(images.motion(of("target"), "target", meter, snapshot), "motion"), "target", "left")
        rows = pairing.check_motion(rows, config.quality.motion_min, config.quality.motion_max)
    if metadata is not None:
        rows = rows.join(metadata.select(F.col("path").alias("target"), "width", "height", "frame_count", "fps"), "target", "left")
    signals = of("caption").withColumnRenamed("caption", "path").unionByName(of("reference").withColumnRenamed("reference", "path"))
    return rows, pairing.orphans(of("target"), signals, keys)


def dataset_issues(spark: SparkSession, samples: DataFrame, orphans: DataFrame, config: DataConfig, undersized: DataFrame | None = None) -> DataFrame:
    """subject, issues (one) of what is wrong with datasets rather than with a sample: files
    that go with no target, sources without targets, buckets with too few clips."""
    sources = spark.createDataFrame([(os.path.abspath(s.path),) for s in config.datasets], "source string")
    rows = pairing.orphan_issues(orphans).select(F.col("path").alias("subject"), "issues")
    rows = rows.unionByName(pairing.empty_issues(pairing.empty_sources(sources, samples)).select(F.col("source").alias("subject"), "issues"))
    if undersized is not None:
        rows = rows.unionByName(buckets.undersized_issues(undersized, config.min_bucket_size).select(F.col("bucket_key").alias("subject"), "issues"))
    return rows


def duplicate_issues(samples: DataFrame) -> DataFrame:
    """group_id, n, crosses and issues (one) of each group of references that look alike."""
    rows = duplicate_references(samples).groupBy("group_id").agg(F.count("*").alias("n"), F.bool_or("crosses").alias("crosses"))
    found = video_spec.issue(F.lit(True), "DUPLICATE_DETECTED", WARNING, "reference", F.col("n"), "1", "references look alike")
    return rows.withColumn("issues", video_spec.gathered(found))


def duplicate_references(samples: DataFrame, distance: int = 6) -> DataFrame:
    """source, reference, group_id, crosses of references that look alike, in one source or
    across sources."""
    rows = samples.select("source", "reference", "hash").dropna().distinct()
    grouped = duplicates.groups(rows.select(F.col("reference").alias("id"), "hash"), distance).withColumnRenamed("id", "reference").join(rows, "reference")
    crossing = duplicates.across_sources(grouped).select("group_id", F.lit(True).alias("crosses"))
    return grouped.join(crossing, "group_id", "left").select("source", "reference", "group_id", F.coalesce("crosses", F.lit(False)).alias("crosses"))


def organize_plan(samples: DataFrame, out: str, layout: str = "flat", strict: bool = False) -> DataFrame:
    """samples with skip_reason; those that stay with a stem of their own and destinations."""
    rows = samples.drop("decoded", "sharpness", "brightness", "hash", "motion", "motion_error").withColumn("skip_reason", organize.skip_reason(strict=strict))
    kept = organize.unique_stems(rows.where("skip_reason is null"), "stem", "source", "target")
    kept = organize.destinations(kept, out, layout)
    skipped = rows.where("skip_reason is not null").withColumns({c: F.lit(None).cast("string") for c in ("final_stem", "target_dest", "caption_dest", "reference_dest")})
    return kept.unionByName(skipped)


def transfers(planned: DataFrame) -> DataFrame:
    """source, dest of every file of a plan."""
    each = F.explode(F.array(*[F.struct(F.col(c).alias("source"), F.col(f"{c}_dest").alias("dest")) for c in ("target", "caption", "reference")]))
    return planned.where("skip_reason is null").select(each.alias("f")).select("f.*").where("source is not null and dest is not null")


def triage_frames(frames: DataFrame, references: DataFrame, prompts_: DataFrame, by: list[str], least: float, overlay: float) -> DataFrame:
    """Triaged items (by) from frames (by, frame_idx, embedding). Items whose frames
    can't be read have no frames and are unmatched if they are in frames at all."""
    items = frames.select(*by).distinct()
    with_vector = frames.where("embedding is not null")
    matched = triage.best_matches(with_vector, references, *by, least=least)
    return triage.triage(items, matched, triage.overlay_scores(with_vector, prompts_, *by, least=overlay), *by)


def bucket_preview(samples: DataFrame, config: DataConfig) -> tuple[DataFrame, DataFrame]:
    assigned = buckets.assign(samples)
    return buckets.previews(assigned, "stem"), buckets.undersized(assigned, config.min_bucket_size)


def made_frames(rows: DataFrame, keys: list[str], source: str, name: Column, out: str, runner: media.Runner) -> DataFrame:
    """keys, frame_idx, path, error of frames (keys, frame_idx, t): one that can't be made
    has an error and no path."""
    rows = rows.withColumn("output", F.concat(F.lit(out.rstrip("/") + "/"), name)).withColumn("command", media.frame_command(F.col(source), F.col("output"), F.col("t")))
    done = media.execute(rows, runner, 60)
    return rows.join(done, "output").select(*keys, F.col("frame_idx").cast("long").alias("frame_idx"), F.when(F.col("success"), F.col("output")).alias("path"), "error")


def sampled_frames(spark: SparkSession, folder: str, out: str, n: int = 5, prober: Callable[[str], str] = probe.ffprobe, runner: media.Runner = media.tool) -> DataFrame:
    """clip, frame_idx, path, error of n evenly spaced frames of each clip; a frame that
    can't be made has no path."""
    clips = probe.parse(probe.run(listing.clips(spark, folder), prober)).select(F.col("path").alias("clip"), "duration")
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("duration") * (i + 0.5) / n)
    rows = clips.select("clip", F.posexplode(times).alias("frame_idx", "t"))
    name = F.format_string("%s_%03d.png", F.replace(F.element_at(F.split("clip", "/"), -1), F.lit("."), F.lit("_")), F.col("frame_idx"))
    return made_frames(rows, ["clip"], "clip", name, out, runner)


def judged(spark: SparkSession, concepts: str, frames: DataFrame, make: Callable[[], backends.EmbeddingBackend], by: list[str], least: float, overlay: float) -> DataFrame:
    """Triaged items (by) of frames (by, frame_idx, path and, if known, error). error says
    why an item wasn't judged: none of its frames could be made and embedded, or a
    reference or prompt couldn't be. Such items are unmatched as they stand."""
    reason = F.col("error") if "error" in frames.columns else F.lit(None).cast("string")
    none = frames.where("path is null").select(*by, "frame_idx", "path", F.lit(None).cast("array<float>").alias("embedding"), F.coalesce(reason, F.lit("no frame")).alias("error"))
    known = frames.where("path is not null").select(*by, "frame_idx", "path")
    vectors = materialize(backends.embed_or_say(known, make, "path").unionByName(none), "frames")
    refs = materialize(backends.embed_or_say(listing.concepts(spark, concepts).select(F.col("name").alias("concept"), "ref_order", "image_path"), make, "image_path"), "references")
    lines = spark.createDataFrame([(p,) for p in prompts.OVERLAY], "prompt string")
    texts = materialize(backends.embed_or_say(lines, make, "prompt", "texts"), "prompts")
    failed = refs.select(F.col("image_path").alias("what"), "error").unionByName(texts.select(F.col("prompt").alias("what"), "error"))
    broken = failed.where("error is not null").agg(F.min(F.concat_ws(": ", "what", "error")).alias("broken"))
    refs = refs.where("error is null").select("concept", "ref_order", F.col("embedding").alias("ref_embedding"))
    texts = texts.where("error is null").select("prompt", F.col("embedding").alias("prompt_embedding"))
    rows = triage_frames(vectors.drop("path", "error"), refs, texts, by, least, overlay)
    own = vectors.groupBy(*by).agg(F.when(F.count("embedding") == 0, F.min("error")).alias("own"))
    return rows.join(own, by).crossJoin(broken).withColumn("error", F.coalesce("own", "broken")).drop("own", "broken")


def triage_folder(spark: SparkSession, folder: str, concepts: str, frames: DataFrame, make: Callable[[], backends.EmbeddingBackend], least: float = CONCEPT_SIMILARITY, overlay: float = OVERLAY_SIMILARITY) -> DataFrame:
    """Clips of a folder against reference pictures, from sampled frames."""
    return judged(spark, concepts, frames, make, ["clip"], least, overlay)


def triage_mode(videos: DataFrame) -> str:
    """clip or scene, by the vote of the videos (duration)."""
    return triage.mode_vote(videos).first()["mode"]


def triage_scenes(
    spark: SparkSession, folder: str, concepts: str, out: str, make: Callable[[], backends.EmbeddingBackend], detector: Callable[[], backends.SceneDetector],
    least: float = CONCEPT_SIMILARITY, overlay: float = OVERLAY_SIMILARITY, cut: float = SCENE_THRESHOLD, prober: Callable[[str], str] = probe.ffprobe, runner: media.Runner = media.tool,
) -> tuple[DataFrame, DataFrame]:
    """Scenes (video, scene_index, start, end) of a folder's videos against reference
    pictures, by frames inside of each; and path, error of videos that can't be probed or
    searched for cuts."""
    probed = materialize(probe.parse(probe.run(listing.clips(spark, folder), prober)).select("path", "duration", "error"), "videos")
    videos = probed.where("error is null").select("path", "duration")
    cuts, failed = detect(videos, detector, cut)
    scene = segments.scenes(cuts, videos.join(failed, "path", "left_anti").select(F.col("path").alias("video"), "duration"))
    rows = segments.sample_times(scene).withColumnRenamed("frame_index", "frame_idx")
    name = F.format_string("%s_scene%03d_%03d.png", F.replace(F.element_at(F.split("video", "/"), -1), F.lit("."), F.lit("_")), F.col("scene_index"), F.col("frame_idx"))
    keys = ["video", "scene_index", "start", "end"]
    frames = made_frames(rows, keys, "video", name, out, runner)
    return judged(spark, concepts, frames, make, keys, least, overlay), probed.where("error is not null").select("path", "error").unionByName(failed)


def routes(triaged: DataFrame, out: str) -> DataFrame:
    """source, dest of each triaged clip: a folder for each concept, one for overlaid text
    and one for the rest."""
    name = F.element_at(F.split("clip", "/"), -1)
    return triaged.select(F.col("clip").alias("source"), F.concat_ws("/", F.lit(out.rstrip("/")), "folder", name).alias("dest"))
