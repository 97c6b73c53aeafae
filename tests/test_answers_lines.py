"""Answers that are paid for once, calls in turns, and manifests in lines."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from cinesift import backends, manifests
from cinesift.lineage import materialize


class Counting(backends.CaptionBackend):
    """Writes each call to a file; calls for clips that are named in `broken` fail."""

    def __init__(self, calls, broken=()):
        self.calls, self.broken = calls, broken

    def caption_video(self, path, prompt):
        with open(self.calls, "a") as f:
            f.write(f"{path}\n")
        if os.path.basename(path) in self.broken:
            raise ValueError("no such clip")
        return f"{os.path.basename(path)}: {prompt}"

    caption_image = caption_video


def clips(spark, folder, n):
    for i in range(n):
        (folder / f"{i}.mp4").write_bytes(b"x" * (i + 1))
    return spark.createDataFrame([(str(folder / f"{i}.mp4"), "p", True) for i in range(n)], "path string, prompt string, is_video boolean")


def calls(path):
    return sorted(os.path.basename(x) for x in path.read_text().split()) if path.exists() else []


def test_answers_are_asked_for_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows, seen, log = clips(spark, tmp_path / "in", 12), tmp_path / "calls", str(tmp_path / "log")
    path = str(seen)
    first = backends.caption(rows, lambda: Counting(path, ("3.mp4",)), log=log)
    got = {os.path.basename(r.path): r for r in first.collect()}
    assert len(got) == 12 and got["3.mp4"].error == "no such clip" and got["4.mp4"].caption == "4.mp4: p"
    # The same result, read again, asks only for what failed, as does another plan of it.
    assert first.where("success").groupBy("success").count().first()["count"] == 11
    assert calls(seen) == sorted([f"{i}.mp4" for i in range(12)] + ["3.mp4"])
    seen.unlink()
    # Another run asks for what failed and what has changed, and with another prompt for all.
    (tmp_path / "in" / "7.mp4").write_bytes(b"another clip")
    again = backends.caption(rows, lambda: Counting(path), log=log).collect()
    assert len(again) == 12 and all(r.success for r in again) and calls(seen) == ["3.mp4", "7.mp4"]
    seen.unlink()
    backends.caption(rows.withColumn("prompt", F.lit("q")), lambda: Counting(path), log=log).collect()
    assert len(calls(seen)) == 12
    seen.unlink()
    assert len(backends.caption(rows, lambda: Counting(path), log=log, again=True).collect()) == 12 == len(calls(seen))


def test_repeated_gone_and_null_paths(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows, seen, log = clips(spark, tmp_path / "in", 1), tmp_path / "calls", str(tmp_path / "log")
    path = str(seen)
    rows = rows.union(rows).union(spark.createDataFrame([("gone.mp4", "p", True), (None, "p", False)], rows.schema))

    class Plain(Counting):
        def caption_image(self, p, q):
            return "none"

    for n in (2, 2):
        got = backends.caption(rows, lambda: Plain(path), log=log).collect()
        assert sorted((r.path or "-").rsplit("/", 1)[-1] for r in got) == ["-", "0.mp4", "0.mp4", "gone.mp4"] and all(r.success for r in got)
        assert len(calls(seen)) == n
    assert backends.caption(rows.limit(0), lambda: Plain(path), log=log).count() == 0


def test_torn_lines_do_not_count(spark, tmp_path):
    run = tmp_path / "run-a"
    run.mkdir()
    whole = json.dumps({"key": "k", "caption": "c", "seconds": 1.0, "whole": True})
    (run / "part-000001-x.jsonl").write_text(whole + "\n" + whole.replace('"k"', '"l"')[:-8])
    assert set(backends.Answers(str(tmp_path), "run-a", 1).held) == {"k"} and not backends.Answers(str(tmp_path), "run-a", 2).held
    assert [tuple(r) for r in backends.answered(spark, str(tmp_path)).collect()] == [("k", "c", 1.0)]


def test_a_lost_task_does_not_pay_again(tmp_path):
    """A worker process ends in the middle of its clips; Spark runs the task again."""
    script = textwrap.dedent("""
        import os, sys
        from pyspark.sql import SparkSession
        from cinesift import backends

        folder = sys.argv[1]
        spark = SparkSession.builder.master("local[1,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()

        class Dying(backends.CaptionBackend):
            def caption_video(self, path, prompt):
                with open(folder + "/calls", "a") as f:
                    f.write(path + "\\n")
                n = sum(1 for _ in open(folder + "/calls"))
                if n == 6:
                    os._exit(1)
                return "c"

            caption_image = caption_video

        rows = spark.createDataFrame([(f"{i}.mp4", "p", True) for i in range(10)], "path string, prompt string, is_video boolean").coalesce(1)
        print(backends.caption(rows, Dying, log=folder + "/log").where("success").count())
    """)
    (tmp_path / "job.py").write_text(script)
    root = os.path.dirname(os.path.dirname(os.path.abspath(backends.__file__)))
    done = subprocess.run([sys.executable, str(tmp_path / "job.py"), str(tmp_path)], cwd=tmp_path, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=180)
    assert done.stdout.split()[-1:] == ["10"], done.stderr[-2000:]
    asked = calls(tmp_path / "calls")
    # Ten clips, and the one that was asked for when the worker ended.
    assert len(asked) == 11 and len(set(asked)) == 10


def test_turns_keep_the_rate():
    """Three tasks with calls of uneven length: over any minute no more calls than the rate."""
    now, made = [0.0], []
    tasks = [backends.Turns(10.0, 3, k, clock=lambda: now[0], sleep=lambda s: None) for k in range(3)]
    ready = [0.0, 0.0, 0.0]
    for _ in range(60):
        k = min(range(3), key=lambda i: max(ready[i], tasks[i].next))
        now[0] = max(ready[k], tasks[k].next)
        tasks[k].wait()
        made.append(now[0])
        ready[k] = now[0] + (47.0 if len(made) % 7 == 0 else 1.0)
    for t in made:
        assert sum(t <= u < t + 60 for u in made) <= 6 + 2  # a late task may meet another's turn
    assert (len(made) - 1) / (made[-1] - made[0]) <= 1 / 10


def test_scene_lines_say_what_one_object_says(spark, tmp_path):
    rows = [("x/a.mp4", 0, 0.0, 5.00049, False, True), ("x/a.mp4", 1, 5.0, 9.0, True, False), ("y/a.mp4", 0, 0.0, 1.0, False, True), ("b.mp4", 0, 0.0, 2.0, False, None)]
    scenes = spark.createDataFrame(rows, "video string, scene_index long, start double, end double, has_overlay boolean, include boolean").repartition(3)
    whole = json.loads(manifests.scene_manifest(scenes).first().manifest)["videos"]
    lines = [json.loads(r.line) for r in manifests.scene_lines(scenes).collect()]
    assert sorted(({k: v for k, v in x.items() if k != "triage_mode"} for x in lines), key=lambda x: x["path"]) == sorted(whole, key=lambda x: x["path"])
    manifests.publish(manifests.scene_lines(scenes), str(tmp_path / "m"))
    (tmp_path / "one.json").write_text(json.dumps({"triage_mode": "scene", "videos": whole}, indent=1))
    columns = ["video", "scene_index", "start", "end"]
    of = [sorted(tuple(r) for r in manifests.read_scene_manifest(spark, str(tmp_path / p)).select(*columns).collect()) for p in ("m", "one.json")]
    assert of[0] == of[1] == [("x/a.mp4", 0, 0.0, 5.0), ("y/a.mp4", 0, 0.0, 1.0)]
    other = spark.createDataFrame([('{"triage_mode": "clip", "path": "a", "scenes": []}',)], "value string")
    with pytest.raises(Exception, match="not a manifest of scenes"):
        manifests.included_of_lines(other).collect()


def test_a_manifest_is_replaced_whole_or_not_at_all(spark, tmp_path):
    lines = lambda *xs: spark.createDataFrame([(x,) for x in xs], "line string")
    at = str(tmp_path / "manifest")
    manifests.publish(lines("a", "b"), at)
    read = lambda: sorted(r.value for r in spark.read.text(at).collect())
    assert read() == ["a", "b"]
    with pytest.raises(Exception, match="broken"):
        manifests.publish(lines("c").unionByName(spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("line"))), at)
    assert read() == ["a", "b"] and os.listdir(tmp_path) == ["manifest"]
    manifests.publish(lines("c"), at)
    manifests.publish(lines(*[r.value for r in materialize(spark.read.text(at), "lines").collect()], "d"), at + "/")
    assert read() == ["c", "d"] and os.listdir(tmp_path) == ["manifest"]
    manifests.publish(lines("x").where("false"), at)
    assert read() == []


def test_dataset_lines_say_what_one_object_says(spark, tmp_path):
    issue = "array<struct<code:string,severity:string,message:string>>"
    rows = [("s", f"n{i}", f"n{i}.mp4", f"n{i}.txt" if i % 2 else None, None, [("C", sev, f"m{i}")] if sev else []) for i, sev in enumerate(["error", "warning", None, "info", "error"])]
    samples = spark.createDataFrame([*rows, ("t", "z", "z.mov", None, "z.png", [])], f"source string, stem string, target string, caption string, reference string, issues {issue}")
    manifests.publish(manifests.dataset_lines(samples), str(tmp_path / "m"))
    sources, found = manifests.read_dataset_lines(spark, str(tmp_path / "m"))
    named = {s: sorted((r.stem, r.target, [tuple(i) for i in r.issues]) for r in found.where(F.col("source") == s).collect()) for s in ("s", "t")}
    for r in manifests.dataset_manifest(samples).collect():
        one = json.loads(r.manifest)
        line = sources.where(F.col("source") == r.source).first().asDict(recursive=True)
        assert {k: one[k] for k in line} == line
        assert [(x["stem"], x["target"], [tuple(i.values()) for i in x["issues"]]) for x in one["samples"]] == named[r.source]
