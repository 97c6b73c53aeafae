"""Commands over folders."""

import functools
import json
import os
import pathlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cinesift import backends, cli, manifests, trainers
from cinesift.config import DataConfig, QualityConfig, Source, VideoConfig
from cinesift.plans import commands
from cinesift.sources import listing, probe
from cinesift.streaming import captions as streaming


def png(path, rows):
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "set"
    d.mkdir()
    checks = [[(r + c) % 2 * 255 for c in range(32)] for r in range(32)]
    for stem, caption, rows in (("a", "She walks slowly, then turns", checks), ("b", "", checks), ("c", None, [[9] * 32] * 32)):
        (d / f"{stem}.mp4").write_bytes(b"")
        png(d / f"{stem}.png", rows)
        if caption is not None:
            (d / f"{stem}.txt").write_text(caption)
    (d / "lost.txt").write_text("no clip")
    return d


def test_files_of_no_bytes_are_listed(spark, folder):
    assert sorted(r.name for r in listing.clips(spark, str(folder)).collect()) == ["a.mp4", "b.mp4", "c.mp4"]
    assert {r.stem: bytes(r.content) for r in listing.captions(spark, str(folder)).collect()}["b"] == b""
    assert [r.path.rsplit("/", 1)[-1] for r in commands.score(spark, str(folder)).collect()][0] == "b.txt"


def test_validate_and_organize(spark, folder, tmp_path):
    config = DataConfig(datasets=(Source(str(folder)),), quality=QualityConfig(check_duplicates=True))
    samples, orphans = commands.validate(spark, config)
    found = {r.stem: [i.code for i in r.issues] for r in samples.collect()}
    assert found == {"a": [], "b": ["CAPTION_EMPTY"], "c": ["CAPTION_MISSING", "REFERENCE_BLANK"]}
    assert [r.stem for r in orphans.collect()] == ["lost"]
    assert len({r.group_id for r in commands.duplicate_references(samples).where("reference not like '%c.png'").collect()}) == 1
    plan = commands.organize_plan(samples, str(tmp_path / "out"), "hierarchical", strict=True)
    reasons = {r.stem: r.skip_reason for r in plan.collect()}
    assert reasons["a"] is None and reasons["c"] == "2 errors" and reasons["b"] == "the caption is empty"
    assert all(r.success for r in commands.organize.transfer(commands.transfers(plan)).collect())
    assert sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, fs in os.walk(tmp_path / "out") for f in fs) == ["training/signals/captions/a.txt", "training/signals/references/a.png", "training/targets/a.mp4"]
    assert sorted(r.role for r in listing.dataset(spark, str(tmp_path / "out")).collect()) == ["caption", "reference", "target"]
    m = json.loads(manifests.dataset_manifest(samples).first().manifest)
    assert (m["total_samples"], m["valid_samples"], m["suffixes"]["target"]) == (3, 2, [".mp4"]) and [s["stem"] for s in m["samples"]] == ["b", "c"]


PROBED = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "width": 1280, "height": 720, "r_frame_rate": "0/0", "avg_frame_rate": "24000/1001", "nb_frames": "N/A", "sample_aspect_ratio": "4/3"}], "format": {"duration": "5.0", "format_name": "mov", "bit_rate": "N/A", "size": "12"}}


def test_probe(spark, folder):
    def prober(path):
        if path.endswith("b.mp4"):
            raise OSError("broken")
        return json.dumps(PROBED if path.endswith("a.mp4") else {"streams": [], "format": {}})

    got = {r.path.rsplit("/", 1)[-1]: r for r in commands.scan(spark, str(folder), prober=prober).collect()}
    a = got["a.mp4"]
    assert (a.fps, a.frame_count, a.sar, a.has_audio, a.bit_rate, a.file_size, a.error) == (23.976, 120, "4:3", True, None, 12, None)
    assert (got["b.mp4"].error, got["c.mp4"].error) == ("broken", "no video stream")
    row = next(r for r in commands.normalize(spark, str(folder), "out", prober=prober).collect())
    assert row.action == "encode" and row.target_frames == 77 and row.command[0] == "ffmpeg"


def test_ingest_takes_included_scenes(spark):
    videos = spark.createDataFrame([("in/a.mp4", 20.0), ("in/b.mp4", 4.0)], "path string, duration double")
    cuts = spark.createDataFrame([("in/b.mp4", 2.0)], "video string, t double")
    scenes = spark.createDataFrame([("x/a.mp4", 0, 0.0, 5.0, False, True), ("x/a.mp4", 1, 5.0, 9.0, True, False)], "video string, scene_index long, start double, end double, has_overlay boolean, include boolean")
    kept = manifests.included_scenes(manifests.scene_manifest(scenes))
    rows = commands.ingest(videos, cuts, "out", VideoConfig(), kept).collect()
    assert sorted((r.name, r.start) for r in rows) == [("a_scene000.mp4", 0.0), ("b_scene000.mp4", 0.0), ("b_scene001.mp4", 2.0)]
    other = spark.createDataFrame([('{"triage_mode": "clip"}',)], "manifest string")
    with pytest.raises(Exception, match="not a manifest of scenes"):
        manifests.included_scenes(other).collect()


def test_captions_skip_what_is_there(spark, folder):
    done = commands.caption(spark, str(folder), backends.EchoCaptions)
    assert commands.caption_summary(done).first().asDict() == {"succeeded": 1, "failed": 0, "skipped": 2}
    assert commands.audit(spark, str(folder), backends.EchoCaptions).count() == 2
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("429")
        return "ok"

    assert backends.with_retries(flaky, sleep=lambda s: None) == "ok"
    with pytest.raises(ValueError):
        backends.backend("none")


def test_concepts(spark, tmp_path):
    for f in ("people/holly.png", "odd/x.jpg", "people/notes.txt"):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_bytes(b"x")
    (tmp_path / "root.png").write_bytes(b"x")
    assert sorted((r.name, r.concept_type, r.folder_name) for r in listing.concepts(spark, str(tmp_path)).collect()) == [("holly", "character", "people"), ("x", None, "odd")]


def test_magic_bytes(spark):
    rows = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n0000",), (b"\0\0\0\x18ftypisom",), (b"hello there",)], "b binary")
    assert [r[0] for r in rows.select(listing.looks_like(F.col("b"), "reference")).collect()] == [True, False, None]


def test_embeddings_triage(spark):
    frames = spark.createDataFrame([("a", 0, "1.png"), ("b", 0, "2.png")], "clip string, frame_idx long, path string")
    rows = backends.embed(frames, backends.HashEmbeddings, "path")
    refs = spark.createDataFrame([("x", 0, "1.png")], "concept string, ref_order long, path string")
    refs = backends.embed(refs, backends.HashEmbeddings, "path").withColumnRenamed("embedding", "ref_embedding").drop("path")
    text = backends.embed(spark.createDataFrame([("titles",)], "prompt string"), backends.HashEmbeddings, "prompt", "texts").withColumnRenamed("embedding", "prompt_embedding")
    got = commands.triage_frames(rows, refs, text, ["clip"], 0.7, 0.9)
    assert {r.clip: r.folder for r in got.collect()} == {"a": "x", "b": "unmatched"}


def test_triage_of_a_folder(spark, folder, tmp_path):
    (tmp_path / "concepts" / "people").mkdir(parents=True)
    (tmp_path / "concepts" / "people" / "holly.png").write_bytes(b"x")

    def runner(command, seconds):
        if command[5].endswith("b.mp4"):
            raise OSError("broken")
        with open(command[-1], "w") as f:
            f.write("x")

    frames = commands.sampled_frames(spark, str(folder), str(tmp_path / "frames"), 2, lambda p: json.dumps(PROBED), runner)
    frames = frames.withColumn("path", F.when(F.col("path").contains("a_mp4_001"), F.lit(str(tmp_path / "concepts" / "people" / "holly.png"))).otherwise(F.col("path")))
    rows = commands.triage_folder(spark, str(folder), str(tmp_path / "concepts"), frames, backends.HashEmbeddings, overlay=0.99)
    got = {r.source.rsplit("/", 1)[-1]: r.dest for r in commands.routes(rows, "out").collect()}
    assert got == {"a.mp4": "out/holly/a.mp4", "b.mp4": "out/unmatched/b.mp4", "c.mp4": "out/unmatched/c.mp4"}
    from cinesift.operators import triage

    concepts = listing.concepts(spark, str(tmp_path / "concepts"))
    assert {tuple(r.concept_types) for r in triage.with_types(rows, concepts).collect()} == {("character",), ()}
    assert [tuple(r) for r in triage.concept_summary(concepts).collect()] == [("character", ["holly"])]


def test_selections(spark, folder, tmp_path):
    files = listing.clips(spark, str(folder))
    (tmp_path / "t.json").write_text(manifests.selection_template(files).first().template.replace('"b.mp4"', '"x.mp4"'))
    rows = {r.file: r for r in manifests.selected(files, manifests.selections(spark, str(tmp_path / "t.json"))).collect()}
    assert rows["a.mp4"].frame == 0 and rows["a.mp4"].error is None and rows["x.mp4"].error == "no such file"


def test_trainers():
    t = trainers.Totals([17, 81], True, 1280, 720)
    for name in trainers.TRAINERS:
        file, text = trainers.generate(name, "out\\set", "hierarchical", t, DataConfig(datasets=(Source("x", 4),)))
        assert "81" in text and "out/set/training/targets" in text and file


def test_cli(spark, folder, capsys, tmp_path):
    assert cli.main(["score", str(folder)]) == 0 and "Worst" in capsys.readouterr().out
    assert cli.main(["validate", str(folder)]) == 1
    assert cli.main(["organize", str(folder), "-o", str(tmp_path / "o"), "-t", "musubi"]) == 0 and (tmp_path / "o" / "musubi_dataset.toml").exists()
    assert cli.main(["scan", str(tmp_path / "none")]) == 1


def test_streaming(spark, folder, tmp_path):
    q = streaming.run(streaming.scored(spark, str(folder)), str(tmp_path / "o"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2  # files of no bytes have no line to stream


class Scores(backends.SceneDetector):
    """Changes at frames 4, 40, 45 and 60 of 16 a second; nothing of c.mp4."""

    def scores(self, path):
        if path.endswith("c.mp4"):
            raise OSError("broken")
        return 16.0, [(4, 99.0), (20, 5.0), (40, 27.0), (45, 90.0), (60, 30.0)]


def test_ingest_detects_cuts(spark, folder, capsys, monkeypatch):
    prober = lambda p: json.dumps(PROBED)
    rows, failed = commands.ingest_folder(spark, str(folder), "out", Scores, prober=prober)
    starts = {n: sorted(r.start for r in rows.collect() if r.name.startswith(n)) for n in ("a_", "b_", "c_")}
    assert starts == {"a_": [0.0, 2.5, 3.75], "b_": [0.0, 2.5, 3.75], "c_": []}  # 4 and 45 are within 8 frames of the one before
    assert [(r.path.rsplit("/", 1)[-1], r.error) for r in failed.collect()] == [("c.mp4", "broken")]
    # A video of the manifest isn't searched.
    scenes = spark.createDataFrame([("x/c.mp4", 0, 0.0, 5.0, False, True)], "video string, scene_index long, start double, end double, has_overlay boolean, include boolean")
    rows, failed = commands.ingest_folder(spark, str(folder), "out", Scores, included=manifests.included_scenes(manifests.scene_manifest(scenes)), prober=prober)
    assert failed.count() == 0 and sorted(r.name for r in rows.collect() if r.name.startswith("c_")) == ["c_scene000.mp4"]

    def missing():
        raise ImportError("scenedetect is not installed")

    made = []
    monkeypatch.setattr(commands.media, "execute", lambda plan: made.extend(r.name for r in plan.collect()) or plan.selectExpr("true as success"))
    monkeypatch.setattr(commands, "ingest_folder", functools.partial(commands.ingest_folder, prober=prober))
    monkeypatch.setitem(backends.DETECTORS, "pyscenedetect", missing)
    assert cli.main(["ingest", str(folder), "-o", "out"]) == 1 and made == []
    assert "scenedetect is not installed" in capsys.readouterr().out
    monkeypatch.setitem(backends.DETECTORS, "pyscenedetect", Scores)
    assert cli.main(["ingest", str(folder), "-o", "out"]) == 1 and len(made) == 6


def png_runner(command, seconds):
    with open(command[-1], "w") as f:
        f.write("x")


def test_triage_says_what_is_not_judged(spark, folder, tmp_path, monkeypatch, capsys):
    (tmp_path / "concepts" / "people").mkdir(parents=True)
    (tmp_path / "concepts" / "people" / "holly.png").write_bytes(b"x")

    def missing():
        raise ImportError("no model is installed")

    monkeypatch.setitem(backends.EMBEDDINGS, "clip", missing)
    short = dict(PROBED, format={"duration": "5.0"})
    monkeypatch.setattr(commands, "sampled_frames", functools.partial(commands.sampled_frames, prober=lambda p: json.dumps(short), runner=png_runner))
    args = ["triage", str(folder), "-o", str(tmp_path / "o"), "--concepts-dir", str(tmp_path / "concepts"), "--organize"]
    assert cli.main(args) == 1 and "no model is installed" in capsys.readouterr().out
    assert not (tmp_path / "o" / "manifest").exists() and not (tmp_path / "o" / "unmatched").exists()


def test_triage_of_scenes(spark, folder, tmp_path, monkeypatch, capsys):
    (tmp_path / "concepts" / "people").mkdir(parents=True)
    (tmp_path / "concepts" / "people" / "holly.png").write_bytes(b"x")

    class Named(backends.EmbeddingBackend):
        """Frames of scene 1 look like the reference, those of scene 0 of b.mp4 are broken."""

        def images(self, paths):
            if any("b_mp4_scene000" in p for p in paths):
                raise OSError("broken frame")
            return [[1.0, 0.0] if "scene001" in p or "holly" in p else [0.0, 1.0] for p in paths]

        def texts(self, texts):
            return [[0.0, 0.0]] * len(texts)

    monkeypatch.setitem(backends.EMBEDDINGS, "clip", Named)
    monkeypatch.setitem(backends.DETECTORS, "pyscenedetect", Scores)
    monkeypatch.setattr(commands, "triage_scenes", functools.partial(commands.triage_scenes, prober=lambda p: json.dumps(PROBED), runner=png_runner))
    args = ["triage", str(folder), "-o", str(tmp_path / "o"), "--concepts-dir", str(tmp_path / "concepts"), "--mode", "scene"]
    assert cli.main(args) == 1
    out = capsys.readouterr().out
    assert "broken frame" in out and "c.mp4, error: broken" in out
    kept = {(r.video.rsplit("/", 1)[-1], r.scene_index, r.start, r.end) for r in manifests.read_scene_manifest(spark, str(tmp_path / "o" / "manifest")).collect()}
    assert kept == {("a.mp4", 1, 2.5, 3.75), ("b.mp4", 1, 2.5, 3.75)}
    assert commands.triage_mode(spark.createDataFrame([(30.0,), (40.0,), (1.0,)], "duration double")) == "scene"


def test_best_frame_is_the_sharpest(spark, folder, tmp_path):
    flat, checks = [[9] * 32] * 32, [[(r + c) % 2 * 255 for c in range(32)] for r in range(32)]
    soft = [[c * 8 for c in range(32)]] * 32
    (folder / "d e+1.mp4").write_bytes(b"")
    make_png = png

    def runner(command, seconds):
        if command[3].endswith("b.mp4"):
            raise OSError("broken")
        pictures = [flat, soft, checks, checks] if command[3].endswith("a.mp4") else [soft, flat]
        assert command[command.index("-frames:v") + 1] == "10" and command[5] == "fps=2.0"
        for i, rows in enumerate(pictures):
            make_png(pathlib.Path(command[-1] % (i + 1)), rows)

    out = tmp_path / "refs"
    plan = commands.extract(spark, str(folder), str(out), "best_frame").where("source_type = 'video'")
    done = {r.output.rsplit("/", 1)[-1]: r for r in commands.best_references(spark, plan, str(out), prober=lambda p: json.dumps(PROBED), runner=runner).collect()}
    assert {k: (r.success, r.frame_number, r.error) for k, r in done.items()} == {"a.png": (True, 16, None), "b.png": (False, None, "broken"), "c.png": (True, 0, None), "d e+1.png": (True, 0, None)}
    png(tmp_path / "checks.png", checks)
    assert (out / "a.png").read_bytes() == (tmp_path / "checks.png").read_bytes()
    assert sorted(os.listdir(out)) == ["a.png", "c.png", "d e+1.png"]
    bad = commands.best_references(spark, plan, str(out), prober=lambda p: "{}", runner=runner).collect()
    assert {r.error for r in bad} == {"no video stream"}


def test_validate_checks_files_by_default(spark, folder, capsys, monkeypatch):
    checks = [[(r + c) % 2 * 255 for c in range(32)] for r in range(32)]
    for stem in ("e f+1", "g", "h"):
        (folder / f"{stem}.mp4").write_bytes(b"\0\0\0\x18ftypisom")
        (folder / f"{stem}.txt").write_text("She walks slowly")
        png(folder / f"{stem}.png", checks)
    (folder / "g.mp4").write_bytes((folder / "a.png").read_bytes())
    (folder / "h.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (folder / "i.mp4").write_bytes(b"")
    (folder / "i.txt").write_text("She walks slowly")
    (folder / "i.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8 ")
    config = DataConfig(datasets=(Source(str(folder)),), quality=QualityConfig(motion_min=1.0, motion_max=50.0))

    def meter(path):
        if path.endswith("b.mp4"):
            raise OSError("broken")
        return {"a.mp4": 0.5, "g.mp4": 60.0}.get(path.rsplit("/", 1)[-1], 5.0)

    probed = probe.parse(probe.run(commands.targets(spark, config), lambda p: json.dumps(PROBED)))
    samples, _ = commands.validate(spark, config, probed, meter)
    rows = {r.stem: r for r in samples.collect()}
    assert {k: [i.code for i in r.issues] for k, r in rows.items()} == {
        "a": ["MOTION_BELOW_MIN"], "b": ["CAPTION_EMPTY"], "c": ["CAPTION_MISSING", "REFERENCE_BLANK"], "e f+1": [], "g": ["FILE_TYPE_INVALID", "MOTION_ABOVE_MAX"], "h": ["FILE_CORRUPTED"], "i": [],
    }
    assert rows["b"].motion_error == "broken" and (rows["a"].width, rows["a"].frame_count) == (1280, 120)
    found = commands.duplicate_issues(samples).collect()
    assert [(r.n, r.crosses, r.issues[0].code) for r in found] == [(5, False, "DUPLICATE_DETECTED")]  # the blank one has the hash of the others
    assert commands.bucket_preview(samples, config)[0].first().n == 7

    monkeypatch.setattr(commands.probe, "run", functools.partial(probe.run, prober=lambda p: json.dumps(PROBED)))
    cli.main(["organize", str(folder), "-o", str(folder.parent / "o"), "--duplicates", "-t", "musubi", "--layout", "hierarchical"])
    out = capsys.readouterr().out
    assert "code: DUPLICATE_DETECTED, n: 1" in out and "1280x720x120" in out
    assert "target_frames = [120]" in (folder.parent / "o" / "musubi_dataset.toml").read_text()
    again, _ = commands.validate(spark, DataConfig(datasets=(Source(str(folder.parent / "o")),)))
    assert {r.stem: [i.code for i in r.issues] for r in again.collect()} == {"a": [], "b": ["CAPTION_EMPTY"], "e f+1": [], "i": []}


def test_layout_is_of_the_folder_itself(spark, tmp_path):
    flat = tmp_path / "x" / "training" / "targets"
    flat.mkdir(parents=True)
    for f in ("a.mp4", "a.txt", "a.png"):
        (flat / f).write_text("x")
    assert {r.name: r.role for r in listing.dataset(spark, str(flat)).collect()} == {"a.mp4": "target", "a.txt": "caption", "a.png": "reference"}
    assert {r.name: r.role for r in listing.dataset(spark, str(tmp_path / "x")).collect()} == {"a.mp4": "target", "a.txt": "other", "a.png": "other"}


def test_dataset_issues(spark, folder, tmp_path, capsys):
    (tmp_path / "none").mkdir()
    config = DataConfig(datasets=(Source(str(folder)), Source(str(tmp_path / "none"))))
    samples, orphans = commands.validate(spark, config)
    few = spark.createDataFrame([("1280x720x81", 1)], "bucket_key string, n long")
    rows = commands.dataset_issues(spark, samples, orphans, config, few).collect()
    assert {(r.subject.rsplit("/", 1)[-1], r.issues[0].code, r.issues[0].severity) for r in rows} == {("lost.txt", "ORPHANED_FILE", "warning"), ("none", "DATASET_EMPTY", "error"), ("1280x720x81", "BUCKET_UNDERSIZED", "warning")}
    from cinesift import reports

    text = reports.each("Issues", samples, "stem", 1)
    assert "WARNING CAPTION_EMPTY" in text and text.endswith("and more")
    plan = commands.organize_plan(samples, "out")
    text = reports.organized(plan, "out", "flat", True)
    assert "a.mp4 + a.txt + a.png" in text and "2 organized, 1 left out" in text and "c: left out, 2 errors" in text
    from cinesift.operators import buckets

    groups = buckets.groups(spark.createDataFrame([("k", f"s{i}") for i in range(7)], "bucket_key string, stem string"), "stem")
    assert "k: 7 (s0, s1, s2, s3, s4, ...)" in reports.buckets(groups, 16)
    manifests.dataset_manifest(samples).select("manifest").write.text(str(tmp_path / "m"))
    back = manifests.read_dataset_manifest(spark, str(tmp_path / "m")).first()
    assert (back.total_samples, back.suffixes.target, [s.stem for s in back.samples]) == (3, [".mp4"], ["b", "c"])


def test_sidecars_and_suffixes(spark, folder, tmp_path):
    plan = commands.normalize(spark, str(folder), str(tmp_path / "out"), prober=lambda p: json.dumps(PROBED), suffix=".mov")
    assert sorted(r.output.rsplit("/", 1)[-1] for r in plan.collect()) == ["a.mov", "b.mov", "c.mov"]
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "b.txt").write_text("older")
    side = commands.sidecars(spark, str(folder), str(tmp_path / "out"), plan.where("path not like '%c.mp4'"))
    assert [r.dest.rsplit("/", 1)[-1] for r in side.collect()] == ["a.txt"]


def test_selections_become_a_plan(spark, folder, tmp_path):
    files = listing.files(spark, str(folder))
    template = json.loads(manifests.selection_template(files).first().template)
    assert template == {"a.mp4": {"frame": 0}, "a.png": {"auto": True}, "b.mp4": {"frame": 0}, "b.png": {"auto": True}, "c.mp4": {"frame": 0}, "c.png": {"auto": True}}
    (tmp_path / "t.json").write_text(json.dumps({"a.mp4": {"frame": 48}, "b.png": {"auto": True}, "x.mp4": {"frame": 1}, "lost.txt": {"frame": 1}}))
    plan = commands.extract_selected(spark, str(folder), "refs", manifests.selections(spark, str(tmp_path / "t.json")), lambda p: json.dumps(PROBED))
    got = {r.path.rsplit("/", 1)[-1]: r for r in plan.collect()}
    assert got["a.mp4"].command[2:4] == ["-ss", "2.002"] and got["b.png"].command[2] == "-i"
    assert got["x.mp4"].error == "no such file" and got["lost.txt"].error == "not a clip or picture"


def test_names_stand_for_the_first_entry(spark):
    videos = spark.createDataFrame([("in/a.mp4", 20.0)], "path string, duration double")
    text = json.dumps({"triage_mode": "scene", "videos": [{"path": p, "scenes": [{"scene_index": 0, "start_time": 0.0, "end_time": e, "include": True}]} for p, e in (("z/a.mp4", 5.0), ("b/a.mp4", 9.0))]})
    included = manifests.included_scenes(spark.createDataFrame([(text,)], "manifest string"))
    assert [r.entry for r in commands.entries(videos, included).collect()] == ["z/a.mp4"]
