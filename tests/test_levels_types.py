"""Counts at all levels in one pass, and the types of matched concepts."""

import json

from pyspark.sql import functions as F

from cinesift import manifests
from cinesift.operators import pairing, triage

ISSUES = "array<struct<code:string,severity:string,message:string,field:string,actual:string,expected:string>>"


def issue(severity):
    return ("X", severity, "m", "f", "a", "e")


def test_levels_count_cross_issues_once(spark):
    rows = [("a", "s1", [issue("error"), issue("warning")]), ("a", "s2", []), ("b", "s1", [issue("warning")] * 2), (None, None, [issue("error")])]
    samples = spark.createDataFrame(rows, f"source string, stem string, issues {ISSUES}")
    cross = spark.createDataFrame([("a+b", [issue("error")]), ("a", [issue("warning")])], f"subject string, issues {ISSUES}")
    got = {(r.level, r.source, r.stem): tuple(r)[3:] for r in pairing.levels(samples, cross).collect()}
    assert got == {
        ("sample", "a", "s1"): (1, 0, 1, 1), ("sample", "a", "s2"): (1, 1, 0, 0), ("sample", "b", "s1"): (1, 1, 0, 2), ("sample", None, None): (1, 0, 1, 0),
        ("dataset", "a", None): (2, 1, 1, 1), ("dataset", "b", None): (1, 1, 0, 2), ("dataset", None, None): (1, 0, 1, 0), ("report", None, None): (4, 2, 3, 4),
    }
    plain = {(r.level, r.source, r.stem): tuple(r)[3:] for r in pairing.levels(samples).collect()}
    assert plain == got | {("report", None, None): (4, 2, 2, 3)}
    assert [tuple(r)[3:] for r in pairing.levels(samples.limit(0), cross).collect()] == [(0, 0, 1, 1)]


def test_types_of_matches_go_to_the_manifest(spark):
    kind = "array<struct<rank:bigint,concept:string,similarity:double,best_frame:bigint>>"
    rows = [("a", [(1, "holly", 0.91236, 2), (2, "barn", 0.8, 0)]), ("b", [(1, "barn", 0.9, 1), (2, "holly", 0.8, 1)]), ("c", [])]
    triaged = spark.createDataFrame(rows, f"clip string, matches {kind}").withColumns({"has_overlay": F.lit(False), "include": F.lit(True), "folder": F.lit("x")})
    concepts = spark.createDataFrame([("holly", "character"), ("barn", None), ("holly", "character")], "name string, concept_type string")
    got = {m["clip"]: m for m in (json.loads(r.line) for r in manifests.triage_manifest(triage.typed(triaged, concepts), "clip").collect())}
    assert (got["a"]["use_case"], got["a"]["anchor_word"]) == ("character", "holly")
    assert got["a"]["matches"] == [{"concept": "holly", "type": "character", "similarity": 0.912, "best_frame": 2}, {"concept": "barn", "similarity": 0.8, "best_frame": 0}]
    assert not {"use_case", "anchor_word"} & set(got["b"]) and got["c"]["matches"] == []
    plain = json.loads(manifests.triage_manifest(triaged, "clip").where("line like '%\"a\"%'").first().line)
    assert set(plain) == {"clip", "text_overlay", "include", "folder", "matches"}
