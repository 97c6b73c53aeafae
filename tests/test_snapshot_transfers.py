"""Runs that measure only what changed, transfers that run twice, bounded previews."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from cinesift import cli, reports
from cinesift.operators import buckets, images, organize, video_spec
from cinesift.plans import commands
from cinesift.sources import probe, snapshot

PROBED = {"streams": [{"codec_type": "video", "codec_name": "h264", "width": 1280, "height": 720, "avg_frame_rate": "16/1", "nb_frames": "81"}], "format": {"duration": "5.0"}}


@pytest.fixture
def clips(tmp_path):
    folder = tmp_path / "clips"
    folder.mkdir()
    for name in ("a", "b", "c"):
        (folder / f"{name}.mp4").write_bytes(name.encode() * 10)
    return folder


@pytest.fixture
def counting(tmp_path):
    """A prober that leaves a file for each call, and fails for names in `broken`."""
    calls = tmp_path / "calls"
    calls.mkdir()
    log, broken = str(calls), str(tmp_path / "broken")

    def prober(path):
        name = os.path.basename(path)
        with open(f"{log}/{name}-{time.time_ns()}", "w"):
            pass
        if os.path.exists(broken) and name in open(broken).read():
            raise OSError("broken")
        return json.dumps(PROBED)

    def called():
        names = sorted(x.split("-")[0] for x in os.listdir(log))
        for x in os.listdir(log):
            os.remove(f"{log}/{x}")
        return names

    return prober, called, broken


def test_unchanged_files_are_not_probed_again(spark, clips, counting, tmp_path):
    prober, called, broken = counting
    with open(broken, "w") as f:
        f.write("c.mp4")
    at = str(tmp_path / "snapshot")
    scan = lambda: {os.path.basename(r.path): (r.width, r.error) for r in commands.scan(spark, str(clips), prober=prober, snapshot=at).collect()}
    first = scan()
    assert first == {"a.mp4": (1280, None), "b.mp4": (1280, None), "c.mp4": (None, "broken")} and called() == ["a.mp4", "b.mp4", "c.mp4"]
    assert scan() == first and called() == ["c.mp4"]  # what failed is tried again
    os.remove(broken)
    assert scan()["c.mp4"] == (1280, None) and called() == ["c.mp4"]
    assert scan() == dict.fromkeys(first, (1280, None)) and called() == []
    (clips / "b.mp4").write_bytes(b"other")
    (clips / "d.mp4").write_bytes(b"new")
    os.remove(clips / "a.mp4")
    assert set(scan()) == {"b.mp4", "c.mp4", "d.mp4"} and called() == ["b.mp4", "d.mp4"]
    shutil.copy2(clips / "b.mp4", clips / "b2.mp4")  # the same bytes and time under another name
    os.utime(clips / "c.mp4", ns=(1, 1))
    assert len(scan()) == 4 and called() == ["b2.mp4", "c.mp4"]
    kept = snapshot.compact(spark, at, "probed").collect()
    assert len(kept) == len({r.path for r in kept}) == 5  # a is held still


def test_a_snapshot_of_nothing_and_of_files_that_are_gone(spark, tmp_path, counting):
    prober, called, _ = counting
    none = spark.createDataFrame([], "path string")
    at = str(tmp_path / "s")
    assert probe.run(none, prober, at).count() == 0
    gone = spark.createDataFrame([("/nowhere/x.mp4",), (None,)], "path string")
    for _ in range(2):
        assert probe.run(gone, prober, at).count() == 1 and called() == ["x.mp4"]


def test_motion_is_measured_once(spark, clips, counting, tmp_path):
    prober, called, _ = counting
    rows = spark.createDataFrame([(str(clips / "a.mp4"),), (str(clips / "b.mp4"),)], "target string")
    for want in (["a.mp4", "b.mp4"], []):
        found = images.motion(rows, "target", lambda p: float(len(prober(p))), str(tmp_path / "s")).collect()
        assert {r.motion for r in found} == {float(len(json.dumps(PROBED)))} and called() == want


def test_validate_takes_a_snapshot(spark, clips, counting, tmp_path, monkeypatch, capsys):
    prober, called, _ = counting
    whole = probe.run
    monkeypatch.setattr(commands.probe, "run", lambda files, snapshot=None: whole(files, prober, snapshot))
    for want in (["a.mp4", "b.mp4", "c.mp4"], []):
        cli.main(["validate", str(clips), "--snapshot", str(tmp_path / "s")])
        assert called() == want and "1280x720x81: 3" in capsys.readouterr().out


# transfers


def plan(spark, folder, out):
    return spark.createDataFrame([(f"{folder}/{x}.mp4", f"{out}/deep/{x}.mp4") for x in "abcz"], "source string, dest string").repartition(2)


@pytest.mark.parametrize("copy", [True, False])
def test_transfers_may_run_twice(spark, clips, tmp_path, copy):
    out = tmp_path / "out"
    done = organize.transfer(plan(spark, clips, out), copy)
    for _ in range(3):  # each reads the journal again and carries all files again
        rows = {r.source[-5]: (r.success, r.error) for r in done.collect()}
        assert {x: rows[x] for x in "abc"} == dict.fromkeys("abc", (True, None))
        assert not rows["z"][0] and "z.mp4" in rows["z"][1]
    assert sorted(os.listdir(out / "deep")) == ["a.mp4", "b.mp4", "c.mp4"] and (out / "deep" / "b.mp4").read_bytes() == b"b" * 10
    assert sorted(os.listdir(clips)) == (["a.mp4", "b.mp4", "c.mp4"] if copy else [])


def test_a_move_goes_on_after_each_of_its_steps(clips, tmp_path):
    source, dest = str(clips / "a.mp4"), str(tmp_path / "out" / "a.mp4")
    s = os.stat(source)
    carry = lambda: organize.carry(source, dest, s.st_size, s.st_mtime_ns, None, False)
    os.makedirs(tmp_path / "out")
    (tmp_path / "out" / ".a.mp4.unfinished").write_bytes(b"half")  # stopped while it copied
    carry()
    assert os.listdir(tmp_path / "out") == ["a.mp4"]
    shutil.copy2(dest, source)  # stopped before the source went
    carry()
    assert not os.path.exists(source) and os.path.exists(dest)
    carry()
    (tmp_path / "out" / "a.mp4").write_bytes(b"another")  # the source is gone, but not to there
    with pytest.raises(OSError, match="another file"):
        carry()
    os.remove(dest)
    with pytest.raises(OSError):
        carry()


def test_a_failed_task_moves_the_rest_when_it_runs_again(spark, clips, tmp_path):
    """The first run ends after one file, as a task whose executor is lost."""
    rows = organize.journal(plan(spark, clips, tmp_path / "out").where("source not like '%z.mp4'")).collect()
    first = rows[0]
    organize.carry(first.source, first.dest, first.length, first.modified, first.missing, False)
    for r in rows:
        organize.carry(r.source, r.dest, r.length, r.modified, r.missing, False)
    assert sorted(os.listdir(tmp_path / "out" / "deep")) == ["a.mp4", "b.mp4", "c.mp4"] and not os.listdir(clips)


# previews


def test_previews_keep_first_names_in_the_tasks(spark):
    rows = spark.range(20_000).selectExpr("if(id % 100 = 0, concat('k', id % 300), 'hot') bucket_key", "concat('s', lpad(20000 - id, 6, '0')) stem", "id at")
    found = buckets.previews(rows, "stem", shown=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")
    got = {r.bucket_key: (r.n, r.samples, r.more) for r in found.collect()}
    names = lambda key: sorted(r.stem for r in rows.where(F.col("bucket_key") == key).collect())
    assert got["hot"] == (19_800, names("hot")[:3], 19_797)
    assert got["k100"] == (len(names("k100")), names("k100")[:3], len(names("k100")) - 3)
    by_order = {r.bucket_key: r.samples for r in buckets.previews(rows, "stem", "at", 2).collect()}
    assert by_order["hot"] == ["s019999", "s019998"]
    few = buckets.previews(rows.limit(2).coalesce(1), "stem").collect()
    assert sum(r.n for r in few) == 2 and all(r.more == 0 for r in few)


def test_issue_groups_name_small_groups(spark):
    clip = lambda i, h, fps: (f"c{i:02}", 1280, h, fps, 81, "1:1")
    rows = [clip(i, 480 + i % 2, 16.0) for i in range(4)] + [clip(10 + i, 720, 24.0 + i) for i in range(9)] + [clip(30, 1080, 16.0), clip(40, 720, 16.0)]
    df = spark.createDataFrame(rows, "path string, width int, height int, fps double, frame_count long, sar string").withColumns({"duration": F.lit(5.0), "error": F.lit(None).cast("string")})
    checked = video_spec.validate(df)
    got = {r.n: r for r in video_spec.issue_groups(checked, "path").collect()}
    assert got[4].files == "c00, c01, c02, c03" and got[4].spec == "480-481p, 16.0fps, 81 frames" and got[4].first == "c00"
    assert got[9].files is None and got[9].spec == "720p, 24.0-32.0fps, 81 frames" and got[1].files is None
    one = next(r for r in checked.where("path = 'c10'").collect())
    assert [m.message for m in got[9].messages] == [i.message for i in one.issues]
    text = reports.scan(video_spec.scan_counts(checked), video_spec.issue_groups(checked, "path"))
    assert "9 clips (720p" in text and "files: c00, c01, c02, c03" in text and "c30 (1080p" in text
