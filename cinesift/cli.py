"""Commands: python -m cinesift.cli scan FOLDER, ..."""

from __future__ import annotations

import argparse
import dataclasses
import os
import re
import sys

from pyspark.sql import functions as F

from . import backends, config, manifests, prompts, reports, trainers
from .constants import BUCKET_STEP, SCENE_THRESHOLD
from .lineage import materialize
from .operators import captions, pairing, triage, video_spec
from .plans import commands
from .session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cinesift", description="Curate clips, captions and references for training.")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, out: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("folder")
        c.add_argument("--config")
        if out:
            c.add_argument("-o", "--output", required=True)
        return c

    scan = add("scan", "clips against the specification")
    normal = add("normalize", "encode or copy clips to the specification", out=True)
    for c in (scan, normal):
        c.add_argument("--fps", type=int)
        c.add_argument("--resolution", type=int)
    normal.add_argument("--format", help="suffix of all outputs, as .mp4; by default each clip's own")
    add("score", "captions, worst first").add_argument("--shown", type=int, default=10)
    cap = add("caption", "captions of clips that have none, written beside them")
    cap.add_argument("--anchor", default="")
    cap.add_argument("--tags", nargs="*", default=[], help="words to mention where they are seen")
    cap.add_argument("--overwrite", action="store_true")
    aud = add("audit", "existing captions against fresh ones")
    aud.add_argument("--save", action="store_true", help="write fresh captions as .audit.txt")
    for c in (cap, aud):
        c.add_argument("--provider", default="gemini", choices=sorted(backends.BACKENDS))
        c.add_argument("--use-case", choices=sorted(k for k in prompts.VIDEO if k))
        c.add_argument("--prompt", help="replaces the prompt of the use case")
        c.add_argument("--model")
        c.add_argument("--base-url", help="of a chat endpoint")
        c.add_argument("--log", help="a folder that keeps each answer, so that none is asked for twice")
        c.add_argument("--rate", type=float, help="calls a minute of all tasks together, on the whole")
        c.add_argument("--caption-fps", type=int, default=1, help="frames a second that a chat endpoint gets")
        c.add_argument("--delay", type=float, default=10.0, help="seconds after each call")
    ext = add("extract", "one reference picture for each clip")
    ext.add_argument("-o", "--output")
    ext.add_argument("--template", help="write a file in which the user picks frames, and stop")
    ext.add_argument("--selections", help="a file of picked frames")
    ext.add_argument("--strategy", choices=("first_frame", "best_frame"), default="first_frame")
    ext.add_argument("--overwrite", action="store_true")
    tri = add("triage", "clips against reference pictures", out=True)
    tri.add_argument("--concepts-dir", required=True)
    tri.add_argument("--threshold", type=float, default=0.70)
    tri.add_argument("--organize", action="store_true", help="route clips to folders; not for scenes")
    tri.add_argument("--embeddings", default="clip", choices=sorted(backends.EMBEDDINGS), help="the model that compares pictures and text")
    tri.add_argument("--mode", choices=("auto", "clip", "scene"), default="auto", help="auto: scene if over half of the videos are long")
    tri.add_argument("--detector", default="pyscenedetect", choices=sorted(backends.DETECTORS), help="what searches videos for cuts")
    ing = add("ingest", "cut long videos into clips", out=True)
    ing.add_argument("--triage", help="a manifest of scenes; only included ones are cut")
    ing.add_argument("--detector", default="pyscenedetect", choices=sorted(backends.DETECTORS), help="what searches videos for cuts")
    ing.add_argument("--threshold", type=float, default=SCENE_THRESHOLD, help="score of change of a cut")
    val = add("validate", "completeness and quality of a dataset")
    org = add("organize", "lay out the valid samples of a dataset", out=True)
    for c in (val, org):
        c.add_argument("--quality", action="store_true", help="blur under 50, brightness outside 0.05 to 0.95")
        c.add_argument("--duplicates", action="store_true")
        c.add_argument("--concepts", nargs="*", help="sub-folders to take")
        c.add_argument("--verbose", action="store_true", help="the issues of each sample")
        c.add_argument("--snapshot", help="a folder that keeps what was measured; unchanged files are not measured again")
    org.add_argument("--layout", choices=("flat", "hierarchical"), default="flat")
    org.add_argument("--strict", action="store_true")
    org.add_argument("--dry-run", action="store_true")
    org.add_argument("--move", action="store_true")
    org.add_argument("-t", "--trainer", action="append", default=[])
    return p


def settings(args: argparse.Namespace) -> config.DataConfig:
    out = config.load(args.config or args.folder)
    video = {k: v for k in ("fps", "resolution") if (v := getattr(args, k, None)) is not None}
    if video:
        out = dataclasses.replace(out, video=dataclasses.replace(out.video, **video))
    if getattr(args, "quality", False):
        out = dataclasses.replace(out, quality=dataclasses.replace(out.quality, blur_threshold=50.0, exposure_range=(0.05, 0.95)))
    if getattr(args, "duplicates", False):
        out = dataclasses.replace(out, quality=dataclasses.replace(out.quality, check_duplicates=True))
    if names := getattr(args, "concepts", None):
        there = {e.name for e in os.scandir(args.folder) if e.is_dir()}
        if gone := sorted(set(names) - there):
            raise config.ConfigError([f"no folder {n}; there are {', '.join(sorted(there))}" for n in gone])
        out = dataclasses.replace(out, datasets=tuple(config.Source(os.path.join(args.folder, n)) for n in names))
    if bad := out.problems():
        raise config.ConfigError(bad)
    return out


def answer_log(args: argparse.Namespace) -> str | None:
    """The log of one service and model, as answers of another are other answers."""
    return args.log and os.path.join(args.log, re.sub(r"[^A-Za-z0-9.-]+", "_", f"{args.provider}-{args.model or 'default'}"))


def provider(args: argparse.Namespace):
    """What makes the chosen service, in a task."""
    name, settings_ = args.provider, {"model": args.model} if args.model else {}
    if name == "openai":
        settings_ |= {"fps": args.caption_fps} | ({"url": args.base_url} if args.base_url else {})
    return lambda: backends.backend(name, **settings_)


def run_extract(spark, args: argparse.Namespace) -> int:
    if args.template:
        files = commands.listing.files(spark, args.folder)
        commands.media.write_texts(manifests.selection_template(files).select(F.lit(os.path.abspath(args.template)).alias("output"), F.col("template").alias("text"))).collect()
        return 0
    if not args.output:
        raise ValueError("give an output folder")
    best = args.strategy == "best_frame" and not args.selections
    if args.selections:
        plan = commands.extract_selected(spark, args.folder, args.output, manifests.selections(spark, args.selections))
    else:
        plan = commands.extract(spark, args.folder, args.output, args.strategy, args.overwrite)
    plan = materialize(plan.select("path", "source_type", "output", "strategy", "skipped", "error", "command"), "plan")
    rows = plan.where("not skipped and error is null")
    done = commands.media.execute(rows.where("source_type = 'image'") if best else rows).withColumn("sharpness", F.lit(None).cast("double"))
    if best:
        done = commands.best_references(spark, rows.where("source_type = 'video'"), args.output).select(*done.columns).unionByName(done)
    done = materialize(done, "references").withColumnRenamed("error", "failure")
    every = plan.join(done, "output", "left").withColumn("success", F.coalesce("success", F.col("skipped"))).withColumn("error", F.coalesce("error", "failure"))
    every = materialize(every.drop("failure", "command"), "extracted")
    print(reports.section("References", manifests.extraction_report(every)))
    print(reports.section("Failed", every.where("not success").select("path", "error").orderBy("path"), 20))
    manifests.publish(manifests.reference_manifest(every), os.path.join(args.output, "manifest"))
    return int(every.where("not success").limit(1).count() > 0)


def run_triage(spark, args: argparse.Namespace) -> int:
    """What wasn't judged is reported with its error; it's in no manifest and not routed."""
    make, out = backends.embeddings(args.embeddings), os.path.join(args.output, "frames")
    mode = args.mode
    if mode == "auto":
        mode = commands.triage_mode(commands.probe.parse(commands.probe.run(commands.listing.clips(spark, args.folder))))
    if mode == "scene" and args.organize:
        raise ValueError("scenes are not files that could be organized; ingest cuts those of the manifest")
    failed = None
    if mode == "scene":
        rows, failed = commands.triage_scenes(spark, args.folder, args.concepts_dir, out, make, backends.detector(args.detector), args.threshold)
    else:
        rows = commands.triage_folder(spark, args.folder, args.concepts_dir, commands.sampled_frames(spark, args.folder, out), make, args.threshold)
    rows = materialize(rows, "triage")
    good, bad = rows.where("error is null"), rows.where("error is not null").select("video" if mode == "scene" else "clip", *(["scene_index"] if mode == "scene" else []), "error")
    print(reports.section("Scenes" if mode == "scene" else "Clips", triage.report(good)))
    print(reports.section("Not judged", bad.orderBy(*bad.columns)))
    if failed is not None:
        print(reports.section("Videos not searched for cuts", failed.orderBy("path")))
    if good.limit(1).count():
        concepts = commands.listing.concepts(spark, args.concepts_dir)
        print(reports.section("Concepts", triage.concept_summary(concepts)))
        lines = manifests.scene_lines(good) if mode == "scene" else manifests.triage_manifest(triage.typed(good, concepts), "clip")
        manifests.publish(lines, os.path.join(args.output, "manifest"))
        if args.organize:
            print(reports.section("Files", commands.organize.transfer(commands.routes(good, args.output)).groupBy("success").count()))
    return int(bad.limit(1).count() > 0 or (failed is not None and failed.limit(1).count() > 0))


def run(args: argparse.Namespace) -> int:
    conf = settings(args)
    spark = build_session()
    if args.command == "scan":
        rows = commands.scan(spark, args.folder, conf.video)
        print(reports.scan(video_spec.scan_counts(rows), video_spec.issue_groups(rows.withColumn("path", F.element_at(F.split("path", "/"), -1)), "path")))
    elif args.command == "normalize":
        plan = materialize(commands.normalize(spark, args.folder, args.output, conf.video, suffix=args.format), "plan")
        done = materialize(commands.media.execute(plan), "normalized")
        print(reports.section("Clips", done.groupBy("success").count()))
        print(reports.section("Failed", done.where("not success").select("output", "error").orderBy("output"), 20))
        side = commands.sidecars(spark, args.folder, args.output, plan.join(done.where("success"), "output"))
        print(reports.section("Files beside them", commands.organize.transfer(side).groupBy("success").count()))
    elif args.command == "score":
        rows = commands.score(spark, args.folder)
        print(reports.captions(captions.summary(rows), rows.select("path", "overall", "issues"), args.shown))
    elif args.command == "caption":
        done = materialize(commands.caption(spark, args.folder, provider(args), args.use_case, args.anchor, args.overwrite, tuple(args.tags), args.prompt, args.delay, answer_log(args), args.rate), "captions")
        files = materialize(commands.caption_files(done), "caption-files")
        print(reports.section("Captions", commands.caption_summary(done)))
        bad = done.where("not success").select("path", "error").unionByName(files.where("not success").select(F.col("output").alias("path"), "error"))
        print(reports.section("Failed", bad.orderBy("path")))
        return int(bad.limit(1).count() > 0)
    elif args.command == "audit":
        done = materialize(commands.audit(spark, args.folder, provider(args), args.use_case, args.prompt, args.delay, answer_log(args), args.rate), "audit")
        print(reports.section("Captions", done.where("success").groupBy("recommendation").count().orderBy("recommendation")))
        review = done.where("recommendation = 'review'").select("path", F.round("similarity", 2).alias("similarity"), F.substring("existing", 1, 80).alias("existing"), F.substring("caption", 1, 80).alias("fresh"))
        print(reports.section("To review", review.orderBy("path")))
        print(reports.section("Failed", done.where("not success").select("path", "error").orderBy("path")))
        if args.save:
            print(reports.section("Files", commands.caption_files(done, ".audit.txt").groupBy("success").count()))
    elif args.command == "extract":
        return run_extract(spark, args)
    elif args.command == "triage":
        return run_triage(spark, args)
    elif args.command == "ingest":
        kept = manifests.read_scene_manifest(spark, args.triage) if args.triage else None
        plan, failed = commands.ingest_folder(spark, args.folder, args.output, backends.detector(args.detector), conf.video, kept, args.threshold)
        plan = materialize(plan, "plan")
        done = materialize(commands.media.execute(plan), "clips")
        if os.path.isdir(args.output):
            made = plan.join(commands.listing.files(spark, args.output).select("name"), "name", "left_semi")
            made = made.select("video", "output", "start", F.col("frames").alias("frame_count"), (F.col("frames") / conf.video.fps).alias("duration"))
            manifests.publish(manifests.clip_manifest(made), os.path.join(args.output, "manifest"))
        print(reports.section("Clips", done.groupBy("success").count()))
        print(reports.section("Videos not cut", failed.orderBy("path")))
        return int(failed.limit(1).count() > 0)
    else:
        probed = materialize(commands.probe.parse(commands.probe.run(commands.targets(spark, conf), snapshot=args.snapshot)), "probed")
        samples, orphans = commands.validate(spark, conf, probed, snapshot=args.snapshot)
        samples = materialize(samples, "samples")
        parts, groups_alike = [samples], []
        if conf.quality.check_duplicates:
            groups_alike.append(materialize(commands.duplicate_issues(samples), "duplicates"))
        groups, few = commands.bucket_preview(samples, conf)
        whole = materialize(commands.dataset_issues(spark, samples, orphans, conf, few), "dataset-issues")
        parts += [whole, *groups_alike]
        print(reports.dataset(pairing.counts(samples, "source"), video_spec.issue_summary(*parts), few))
        print(reports.buckets(groups, BUCKET_STEP))
        print(reports.each("Issues of datasets", whole, "subject", 20))
        if args.verbose:
            print(reports.each("Issues of samples", samples, "stem"))
        for part in groups_alike:
            print(reports.section("References that look alike", part.select("group_id", "n", "crosses").orderBy("group_id"), 20))
        print(reports.section("Not probed", probed.where("error is not null").select("path", "error").orderBy("path"), 20))
        if "motion_error" in samples.columns:
            print(reports.section("Motion not measured", samples.where("motion_error is not null").select("target", "motion_error").orderBy("target"), 20))
        if args.command == "validate":
            return int(samples.select("issues").unionByName(whole.select("issues")).where(video_spec.has_error()).limit(1).count() > 0)
        plan = commands.organize_plan(samples, args.output, args.layout, args.strict)
        if plan.where("skip_reason is null").limit(1).count() == 0:
            raise ValueError("no valid sample is left")
        print(reports.organized(plan, args.output, args.layout, args.dry_run))
        if not args.dry_run:
            manifests.publish(manifests.dataset_lines(samples), os.path.join(args.output, "manifest"))
            print(reports.section("Files", commands.organize.transfer(commands.transfers(plan), not args.move).groupBy("success").count()))
            total = trainers.totals(plan.where("skip_reason is null"), conf)
            for name in args.trainer:
                file, text = trainers.generate(name, args.output, args.layout, total, conf)
                with open(os.path.join(args.output, file), "w", encoding="utf-8") as f:
                    f.write(text)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (config.ConfigError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
