"""Blocked products, listing with pushed filters, reading captions alone."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from cinesift.operators import captions, products, triage
from cinesift.plans import commands
from cinesift.sources import listing

FRAMES = "clip string, source long, frame_idx long, embedding array<float>"
REFS = "concept string, ref_order long, ref_embedding array<float>"


def some(seed=1, clips=30, refs=7, d=4):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(d)]
    frames = [(f"c{i}", i % 2, j, vector()) for i in range(clips) for j in range(rng.randint(1, 4))]
    frames += [("nulls", 0, 0, None), ("nulls", 0, 1, [1.0, None, 0.0, 0.0]), ("short", 1, 0, [1.0]), (None, 1, 0, vector()), (None, 1, 3, vector())]
    references = [(f"r{i}", i, vector()) for i in range(refs)]
    references += [("twin", 100, references[0][2]), ("null", 101, None), ("short", 102, [2.0])]
    return frames, references


def dot(a, b):
    return None if a is None or b is None or None in a or None in b or len(a) != len(b) else sum(x * y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("shard", "cells"), [(64 << 20, 1 << 21), (200, 3)])
def test_products_equal_all_pairs(spark, monkeypatch, shard, cells):
    monkeypatch.setattr(products, "CELLS", cells)
    frames, references = some()
    f, r = spark.createDataFrame(frames, FRAMES).repartition(3), spark.createDataFrame(references, REFS)
    want = {(c, s, j, name): dot(v, w) for c, s, j, v in frames for name, _, w in references}
    got = {(x.clip, x.source, x.frame_idx, x.concept): x.similarity for x in products.each(f, r, "embedding", "ref_embedding", "similarity", shard).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, abs_tol=1e-9)) for k, v in want.items())

    best = {}
    for (c, s, j, name), v in want.items():
        if v is not None and (v, -j) > best.get((c, s, name), (-math.inf, 0)):
            best[c, s, name] = (v, -j)
    got = {(x.clip, x.source, x.concept): (x.similarity, -x.at) for x in products.best(f, r, ("clip", "source"), "embedding", "ref_embedding", "frame_idx", None, shard).collect()}
    assert got == {k: (pytest.approx(v), j) for k, (v, j) in best.items()}
    got = {(x.clip, x.source, x.concept) for x in products.best(f, r, ("clip", "source"), "embedding", "ref_embedding", "frame_idx", 0.5, shard).collect()}
    assert got == {k for k, (v, _) in best.items() if v >= 0.5}

    top = {(c, s): 0.0 for c, s, _, _ in frames}
    for (c, s, _, _), v in want.items():
        top[c, s] = max(top[c, s], v or 0.0)
    got = {(x.clip, x.source): x.score for x in products.largest(f, r, ("clip", "source"), "embedding", "ref_embedding", "score", shard).collect()}
    assert got == {k: pytest.approx(v) for k, v in top.items()}


def test_best_matches_equal_those_of_all_rows(spark):
    frames, references = some(2)
    f, r = spark.createDataFrame(frames, FRAMES), spark.createDataFrame(references, REFS)
    row = lambda x: (x.clip, x.concept, round(x.similarity, 9), x.best_frame, x.rank)
    for least in (0.5, 0.0):
        plain = triage.matches(triage.best_frames(triage.similarities(f, r).where("similarity is not null"), "clip"), "clip", least=least)
        assert sorted(map(row, triage.best_matches(f, r, "clip", least=least).collect()), key=str) == sorted(map(row, plain.collect()), key=str)
    none = r.limit(0)
    assert triage.best_matches(f, none, "clip").count() == triage.overlay_scores(f, none.toDF("prompt", "x", "prompt_embedding").drop("x"), "clip").count() == triage.similarities(f, none).count() == 0


def test_many_references_make_no_nested_loop(spark):
    r = spark.range(10_000).select(F.concat(F.lit("r"), "id").alias("concept"), F.col("id").alias("ref_order"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 9)]).alias("ref_embedding"))
    f = spark.range(400).select((F.col("id") % 50).alias("clip"), F.col("id").alias("frame_idx"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 9)]).alias("embedding"))
    rows = triage.best_matches(f, r, "clip", least=2.0)
    plan = rows._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastExchange" not in plan
    assert rows.where("ref_order < 400 and ref_order % 50 = clip and best_frame = ref_order").count() > 300  # each frame is a reference itself


def folder(tmp_path, n=40):
    for i in range(n):
        (tmp_path / f"v{i:02}.{'MP4' if i % 4 else 'txt'}").write_bytes(b"x" * i)
    (tmp_path / "sub").mkdir()
    return str(tmp_path)


def test_listing_is_dealt_and_filters_are_pushed(spark, tmp_path):
    path = folder(tmp_path)
    rows = listing.files(spark, path)
    assert rows.rdd.getNumPartitions() == listing.PARTS
    assert sorted(r.name for r in rows.collect()) == sorted(x for x in os.listdir(path) if x != "sub")
    assert listing.files(spark, path, parts=3).rdd.getNumPartitions() == 3
    for condition, kept in (("suffix = '.txt'", 10), ("suffix in ('.txt', '.mp4')", 40), ("stem = 'v03'", 1), ("name in ('v03.MP4', 'v04.txt', 'none')", 2), ("suffix = '.txt' and length > 8", 7), ("suffix = '.txt' and suffix = '.mp4'", 0)):
        found = rows.where(condition)
        assert found.count() == kept, condition
        plan = found._jdf.queryExecution().executedPlan().toString()
        left = plan.split("Filter", 1)[1].split("\n", 1)[0] if "Filter" in plan.split("BatchScan")[0] else ""
        assert "suffix" not in left.replace("isnotnull(suffix", "") and "stem" not in left.replace("isnotnull(stem", ""), plan


def test_unwanted_names_cost_no_stat(tmp_path):
    path = folder(tmp_path)
    os.symlink("nowhere", tmp_path / "broken.txt")
    names = [x[2] for i in range(5) for x in listing.entries(path, i, 5, listing.Wanted(suffixes=frozenset([".txt"])))]
    assert sorted(names) == [f"v{i:02}.txt" for i in range(0, 40, 4)]
    wanted = listing.Wanted().narrowed("stems", frozenset("ab")).narrowed("stems", frozenset("bc"))
    assert wanted.has("b.txt") and not wanted.has("a.txt")


def test_only_captions_are_read(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a caption")
    (tmp_path / "b.TXT").write_text("B")
    (tmp_path / "c.txt").write_text("")
    (tmp_path / "a.mp4").write_bytes(b"v" * 5000)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("not in the folder itself")
    held = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # larger files fail if they are read
    try:
        found = {os.path.basename(r.path): bytes(r.content) for r in listing.captions(spark, str(tmp_path)).collect()}
        assert found == {"a.txt": b"a caption", "b.TXT": b"B", "c.txt": b""}
        assert commands.score(spark, str(tmp_path)).count() == 3
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", held)


def test_scores_lower_and_strip_once(spark):
    rows = captions.score(spark.createDataFrame([("A man walks. Something blue.",)], "text string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.split("\n") if "lower(" in x]
    assert plan.count("lower(") <= 2 and plan.count("regexp_replace(") == 1 and lines
