"""Operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinesift.config import ConfigError, DataConfig, VideoConfig, build, load
from cinesift.operators import buckets, captions, duplicates, images, media, organize, pairing, segments, triage, video_spec
from cinesift.operators.connected import components


def clip(**changes):
    return {"path": "a.mp4", "width": 1280, "height": 720, "fps": 16.0, "frame_count": 81, "sar": "1:1", "duration": 5.0625} | changes


def codes(spark, config=VideoConfig(), **changes):
    r = video_spec.validate(spark.createDataFrame([clip(**changes)]), config).first()
    return [(i.code, i.severity) for i in r.issues], r.needs_reencode, r.recommended_frame_count, r.is_valid


def test_clip_rules(spark):
    assert codes(spark) == ([], False, None, True)
    assert codes(spark, height=480) == ([("RESOLUTION_BELOW_TARGET", "error")], False, None, False)
    assert codes(spark, VideoConfig(upscale_policy="warn"), height=480) == ([("RESOLUTION_BELOW_TARGET", "warning")], True, None, True)
    assert codes(spark, height=1080) == ([("RESOLUTION_ABOVE_TARGET", "info")], True, None, True)
    assert codes(spark, sar="4:3") == ([("NON_SQUARE_SAR", "warning")], True, None, True)
    assert codes(spark, VideoConfig(sar_policy="reject"), sar="4:3") == ([("NON_SQUARE_SAR", "error")], False, None, False)
    assert codes(spark, fps=16.5) == ([], False, None, True)
    assert codes(spark, fps=16.51) == ([("FPS_MISMATCH", "warning")], True, None, True)
    assert codes(spark, frame_count=84) == ([("INVALID_FRAME_COUNT", "warning")], True, 81, True)
    assert codes(spark, frame_count=165) == ([("INVALID_FRAME_COUNT", "warning")], True, 165, True)
    assert codes(spark, frame_count=4) == ([("INVALID_FRAME_COUNT", "warning"), ("FRAME_COUNT_TOO_SHORT", "error")], True, 1, False)


def test_scan_totals(spark):
    rows = video_spec.validate(spark.createDataFrame([clip(), clip(height=480, path="b"), clip(height=1080, path="c"), clip(height=2160, path="d")]))
    assert video_spec.scan_counts(rows).first().asDict() == {"total": 4, "valid": 3, "invalid": 1, "needs_reencode": 2, "ready": 1, "fixable": 1}
    by = {r.pattern: r for r in video_spec.issue_patterns(rows, "path").collect()}
    assert (by["RESOLUTION_ABOVE_TARGET:info"].n, by["RESOLUTION_ABOVE_TARGET:info"].height_high) == (2, 2160)
    plan = video_spec.normalize_plan(video_spec.validate(spark.createDataFrame([clip(fps=30.0, frame_count=150, duration=5.0), clip()]))).collect()
    assert [(r.target_frames, r.action) for r in plan] == [(77, "encode"), (81, "copy")]


@pytest.mark.parametrize(("start", "end", "most", "pieces"), [(0.0, 15.0, 81, 3), (0.0, 5.0625, 81, -1), (0.0, 5.1, 81, 1), (0.0, 5.2, 81, 2)])
def test_subdivide(spark, start, end, most, pieces):
    rows = segments.subdivide(spark.createDataFrame([(start, end)], "start double, end double"), VideoConfig(max_frames=most)).orderBy("start").collect()
    assert len(rows) == abs(pieces) and rows[0].sub_index == (-1 if pieces < 0 else 0)
    assert rows[0].start == start and all(a.end == b.start for a, b in zip(rows, rows[1:], strict=False)) and end - rows[-1].end <= 0.05


def test_scenes(spark):
    cuts = spark.createDataFrame([("v", 2.0), ("v", 2.3), ("v", 2.6), ("v", 9.0)], "video string, t double")
    kept = segments.spaced_cuts(cuts)
    assert sorted(r.t for r in kept.collect()) == [2.0, 2.6, 9.0]
    lasts = spark.createDataFrame([("v", 10.0), ("w", 3.0)], "video string, duration double")
    assert sorted(map(tuple, segments.scenes(kept, lasts).collect())) == [("v", 0, 0.0, 2.0), ("v", 1, 2.0, 2.6), ("v", 2, 2.6, 9.0), ("v", 3, 9.0, 10.0), ("w", 0, 0.0, 3.0)]
    assert [r.video for r in segments.without_cuts(lasts, cuts).collect()] == ["w"]
    made = segments.clips(spark.createDataFrame([("v", 3, 0.0, 160.0), ("v", 4, 160.0, 160.2)], "video string, scene_index long, start double, end double"), F.col("video"), F.lit(".mov"))
    names = [r.name for r in made.orderBy("start").collect()]
    assert (names[0], names[25], names[26], len(names)) == ("v_scene003a.mov", "v_scene003z.mov", "v_scene003_26.mov", 32)


def test_buckets(spark):
    rows = spark.createDataFrame([("a", 333, 245, 17), ("b", 335, 250, 17), ("c", 100, 100, 1), ("d", None, 1, 1)], "stem string, width int, height int, frame_count int")
    got = buckets.groups(buckets.assign(rows), "stem").collect()
    assert [(r.bucket_key, r.n, r.samples) for r in got] == [("320x240x17", 2, ["a", "b"]), ("96x96x1", 1, ["c"])]
    assert [r.bucket_key for r in buckets.undersized(buckets.assign(rows)).collect()] == ["96x96x1"]


def test_pairing(spark):
    t = spark.createDataFrame([("a", "a.mp4"), ("a", "a.mov"), ("b", "b.mp4")], "stem string, target string")
    c = spark.createDataFrame([("a", "1/a.txt"), ("a", "2/a.txt"), ("z", "z.txt")], "stem string, caption string")
    r = spark.createDataFrame([("b", "b.png")], "stem string, reference string")
    got = {x.target: x for x in pairing.pair(t, c, r, config=DataConfig(reference_required=True)).collect()}
    assert got["a.mp4"].caption == got["a.mov"].caption == "2/a.txt"
    assert [i.code for i in got["b.mp4"].issues] == ["CAPTION_MISSING"] and [i.code for i in got["a.mov"].issues] == ["REFERENCE_MISSING"]
    assert [x.stem for x in pairing.orphans(t, c).collect()] == ["z"]
    texts = spark.createDataFrame([("c1", b"fine"), ("c2", b" \n"), ("c3", b"\xff\xfe"), ("c4", b"w " * 400), ("c5", None)], "caption string, content binary").withColumn("issues", F.expr("cast(array() as array<struct<code:string,severity:string,message:string,field:string,actual:string,expected:string>>)"))
    found = {x.caption: [i.code for i in x.issues] for x in pairing.check_captions(texts).collect()}
    assert found == {"c1": [], "c2": ["CAPTION_EMPTY"], "c3": ["FILE_CORRUPTED", "CAPTION_EMPTY"], "c4": ["CAPTION_TOO_LONG"], "c5": ["CAPTION_EMPTY"]}


def test_triage(spark):
    frames = spark.createDataFrame([("c", 0, [1.0, 0.0]), ("c", 1, [0.5, 0.5]), ("d", 0, [-1.0, 0.0]), ("e", 0, [0.0, 1.0])], "clip string, frame_idx long, embedding array<float>")
    refs = spark.createDataFrame([("x", 0, [1.0, 0.0]), ("y", 1, [0.75, 0.0])], "concept string, ref_order long, ref_embedding array<float>")
    prompts = spark.createDataFrame([("p", [0.0, 1.0])], "prompt string, prompt_embedding array<float>")
    best = triage.best_frames(triage.similarities(frames, refs), "clip")
    assert {(r.clip, r.concept): (round(r.similarity, 3), r.best_frame) for r in best.collect()}[("d", "x")] == (0.0, 0)
    rows = triage.triage(frames.select("clip").distinct(), triage.matches(best, "clip"), triage.overlay_scores(frames, prompts, "clip", least=0.9), "clip")
    got = {r.clip: r for r in rows.collect()}
    assert [m.concept for m in got["c"].matches] == ["x", "y"] and got["c"].folder == "x" and got["c"].include
    assert (got["d"].folder, got["e"].folder, got["e"].include) == ("unmatched", "text_overlay", False)
    assert triage.report(rows).first().asDict() == {"total": 3, "matched": 1, "unmatched": 2, "text_overlays": 1}
    assert triage.mode_vote(spark.createDataFrame([(30.0,), (31.0,), (None,)], "duration double")).first().mode == "scene"


def test_components_are_the_closure(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: x for n, x in label.items() if any(n in e and e[0] != e[1] for e in links)}


def test_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**62, 5)]
    hashes = [b ^ sum(1 << int(k) for k in rng.choice(62, int(rng.integers(0, 9)), replace=False)) for b in base for _ in range(6)] + [base[0]]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)] + [(99, None)], "id long, hash long")
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= 6}
    assert {tuple(r) for r in duplicates.pairs(df).collect()} == want
    groups = {r.id: r.group_id for r in duplicates.groups(df).collect()}
    assert all(groups[a] == groups[b] for a, b, _ in want) and set(groups) == {x for a, b, _ in want for x in (a, b)}


def test_organize(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a_2"), (3, "a"), (4, "b"), (5, "b"), (6, "c")], "n long, stem string")
    assert {r.n: r.final_stem for r in organize.unique_stems(rows, "stem", "n").collect()} == {0: "a", 1: "a_2", 2: "a_2_2", 3: "a_3", 4: "b", 5: "b_2", 6: "c"}


def test_pictures():
    g = np.tile(np.arange(9.0) * 20, (8, 1))
    assert images.difference_hash(g) == -1 and images.laplacian_variance(np.full((6, 6), 7.0)) == 0.0
    assert images.motion_intensity([np.zeros((2, 2)), np.full((2, 2), 255.0)]) == 100.0 and images.motion_intensity([g]) is None
    noise = np.random.default_rng(0).integers(0, 255, (40, 50)).astype(float)
    assert images.resize(noise, 50, 40).tolist() == noise.tolist()


def test_reference_plan(spark):
    files = spark.createDataFrame([("in/a.mp4", "a", ".mp4"), ("in/b.png", "b", ".png"), ("in/c.doc", "c", ".doc")], "path string, stem string, suffix string")
    got = {r.stem: r for r in media.reference_plan(files, "out", existing=spark.createDataFrame([("out/a.png",)], "path string")).collect()}
    assert (got["a"].skipped, got["a"].strategy, got["b"].source_type, got["b"].skipped) == (True, "first_frame", "image", False) and got["c"].error


def test_failed_commands_are_rows(spark, tmp_path):
    def runner(command, seconds):
        if "bad" in command[0]:
            raise OSError("no")
        with open(command[-1], "w") as f:
            f.write("x")

    plan = spark.createDataFrame([(f"{tmp_path}/{n}.mp4", [n, f"{tmp_path}/{n}.mp4"]) for n in ("good", "bad")], "output string, command array<string>")
    assert sorted((r.success, r.error) for r in media.execute(plan, runner).collect()) == [(False, "no"), (True, None)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["good.mp4"]


def test_config(tmp_path):
    out = build({"datasets": [{"path": "d", "repeats": 3}], "video": {"fps": 24, "frame_count": "auto"}, "controls": {"text": {"required": False}}}, "/base")
    assert (out.datasets[0].path, out.video.fps, out.caption_required) == ("/base/d", 24, False)
    with pytest.raises(ConfigError) as e:
        build({"datasets": [{"repeats": 1}], "video": {"resolution": 100, "speed": 1, "frame_count": 82}})
    assert len(e.value.problems) == 5
    assert load(str(tmp_path)).datasets[0].path == str(tmp_path)
    with pytest.raises(ConfigError, match="no such file"):
        load(str(tmp_path / "none"))


def test_audit_and_overflow(spark):
    rows = spark.createDataFrame([("a cat walks", "a cat runs"), ("a", "b"), (None, "x")], "old string, fresh string")
    assert [r.recommendation for r in captions.audit(rows, "old", "fresh").collect()] == ["keep", "review", "review"]
    assert [r.too_long for r in captions.token_overflow(spark.createDataFrame([("w " * 394,), ("w " * 393,)], "text string")).collect()] == [False, False]


def test_masks_miss_no_pair():
    import random

    rng = random.Random(3)
    for n, distance, bits in ((100, 6, 64), (10**6, 6, 64), (10**9, 6, 64), (500, 14, 56), (10, 0, 8)):
        found = duplicates.masks(n, distance, bits)
        for _ in range(100):
            a = rng.getrandbits(bits)
            b = a ^ sum(1 << k for k in rng.sample(range(bits), distance))
            assert any(a & m == b & m for m in found)
    assert len(duplicates.masks(100, 6, 64)) == 7 < len(duplicates.masks(10**9, 6, 64))
