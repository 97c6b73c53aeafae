"""Destinations for the samples of a dataset."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import ERROR, WARNING
from ..functions.media import file_suffix
from ..lineage import materialize


def skip_reason(issues: str = "issues", strict: bool = False) -> Column:
    """Why a sample is left out, null if it isn't."""
    of = lambda s: F.filter(issues, lambda x: x["severity"] == s)
    errors, warnings = of(ERROR), of(WARNING)
    many = F.when(F.size(errors) == 1, F.get(errors, F.lit(0))["message"]).otherwise(F.format_string("%d errors", F.size(errors)))
    some = F.when(F.size(warnings) == 1, F.get(warnings, F.lit(0))["message"]).otherwise(F.format_string("strict mode: %d warnings", F.size(warnings)))
    return F.when(F.size(errors) > 0, many).when(F.lit(strict) & (F.size(warnings) > 0), some)


#: A number that is given to a repeated stem: 2 or more, without leading zeros.
NUMBERED = r"^(.*)_([2-9]|[1-9][0-9]{1,17})$"


def running(rows: DataFrame, key: str, order: list[str], flag: str, name: str) -> DataFrame:
    """rows with `name`: the sum of flag over earlier rows of the same key, by order.

    Rows are dealt by ranges of key and order, so a key of very many rows lies in many tasks:
    each part is summed by itself, and a key's parts, of which there are as many as tasks at
    most, give what is before each."""
    dealt = materialize(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(key, "_part").agg(F.sum(flag).alias("_of")).withColumn("_before", F.sum("_of").over(earlier(Window.partitionBy(key).orderBy("_part"))))
    inside = F.sum(flag).over(earlier(Window.partitionBy(key, "_part").orderBy(*order)))
    rows = dealt.withColumn("_inside", inside).join(parts.drop("_of"), [key, "_part"])
    return rows.withColumn(name, F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))).drop("_part", "_inside", "_before")


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which numbers of a stem are left out, and which stems lose their own name to one, from
    rows (stem, number, seen, taken, most, child) by stem and number."""
    stem, skipped = None, 0
    for batch in batches:
        out = []
        for s, number, seen, taken, most, child in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != stem:
                stem, skipped = s, 0
            base = number - skipped
            there = base <= most
            blocked = there and skipped < number - taken - seen
            out.append((s, base, child, blocked, there and not blocked))
            skipped += blocked
        if out:
            stems, bases, children, blocked, lost = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(bases, pa.int64()), pa.array(children, pa.string()), pa.array(blocked), pa.array(lost)], names=["stem", "base", "child", "blocked", "lost"])


def unique_stems(samples: DataFrame, stem: str, *order: str) -> DataFrame:
    """samples with final_stem: in the order given, each takes its stem if that is free, else
    stem_2, stem_3 and so on, the first that is free. Null stems stay null.

    Only stem itself makes stem_n, so stems meet only where a stem_n is a stem of its own. A
    sample's number is its place among equal stems plus how many numbers before it are
    left out. A number is left out if the stem of that name came first; if it came later, it loses
    its name and begins at _2 itself. Each such stem is one row (number, and how many of the samples it
    might meet came earlier), and a stem's rows are decided in one pass by number that
    holds two numbers; stems that end in more numbers are decided after those they extend.
    Places and left out numbers are running sums over ranges, so no stem needs a task of its own.
    """
    own = list(order)
    none = samples.where(F.col(stem).isNull()).withColumn("final_stem", F.lit(None).cast("string"))
    rows = samples.where(F.col(stem).isNotNull()).withColumn("_one", F.lit(1).cast("long"))
    rows = materialize(running(rows, stem, own, "_one", "_place").withColumn("_place", F.col("_place") + 1).drop("_one"), "places")
    stems = materialize(rows.groupBy(stem).agg(F.max("_place").alias("many"), F.min(F.struct(*own)).alias("first")).withColumnRenamed(stem, "child"), "stems")
    level = F.length(F.regexp_extract("child", r"((?:_(?:[2-9]|[1-9][0-9]{1,17}))*)$", 1)) - F.length(F.replace(F.regexp_extract("child", r"((?:_(?:[2-9]|[1-9][0-9]{1,17}))*)$", 1), F.lit("_"), F.lit("")))
    edges = stems.select("child", "first", level.alias("level"), F.regexp_extract("child", NUMBERED, 1).alias("stem"), F.regexp_extract("child", NUMBERED, 2).alias("number")).where("number <> ''")
    edges = materialize(edges.withColumn("number", F.col("number").cast("long")).join(stems.select(F.col("child").alias("stem"), "many"), "stem"), "edges")
    lost = rows.sparkSession.createDataFrame([], "stem string, taken long")
    shifts = rows.sparkSession.createDataFrame([], "stem string, _place long, shift long")
    # As many levels as the longest name ends in numbers.
    for n in sorted(r["level"] for r in edges.select("level").distinct().collect()):
        some = edges.where(F.col("level") == n).join(lost, "stem", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        some = some.withColumn("most", F.col("many") + F.col("taken")).where("most > 1")
        mine = rows.withColumnRenamed(stem, "stem") if stem != "stem" else rows
        mine = mine.join(some.select("stem", "taken").distinct(), "stem").select("stem", *own, "_place", "taken")
        met = some.select("stem", *[F.col(f"first.{c}").alias(c) for c in own], "number", "taken", "most", "child", F.lit(0).cast("long").alias("one"))
        both = met.unionByName(mine.select("stem", *own, F.lit(1).cast("long").alias("one")), allowMissingColumns=True)
        seen = running(both, "stem", own, "one", "seen").where("one = 0").select("stem", "number", "seen", "taken", "most", "child")
        decided = materialize(seen.repartition("stem").sortWithinPartitions("stem", "number").mapInArrow(_decide, "stem string, base long, child string, blocked boolean, lost boolean"), "decided")
        lost = materialize(lost.unionByName(decided.where("lost").select(F.col("child").alias("stem"), F.lit(1).cast("long").alias("taken"))), "lost")
        marks = decided.where("blocked").select("stem", "base", F.lit(0).cast("long").alias("_place"), F.lit(1).cast("long").alias("one"))
        places = mine.select("stem", (F.col("_place") + F.col("taken")).alias("base"), "_place", F.lit(0).cast("long").alias("one"))
        shift = running(marks.unionByName(places), "stem", ["base", "_place"], "one", "shift").where("one = 0 and shift > 0")
        shifts = materialize(shifts.unionByName(shift.select("stem", "_place", "shift")), "shifts")
    lost, shifts = lost.withColumnRenamed("stem", stem), shifts.withColumnRenamed("stem", stem)
    rows = rows.join(lost, stem, "left").join(shifts, [stem, "_place"], "left")
    base = F.col("_place") + F.coalesce("taken", F.lit(0))
    number = (base + F.coalesce("shift", F.lit(0))).cast("string")
    rows = rows.withColumn("final_stem", F.when(base == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("_"), number)))
    return rows.select(*samples.columns, "final_stem").unionByName(none)


def destinations(samples: DataFrame, out: str, layout: str = "flat") -> DataFrame:
    """samples (final_stem, target, caption, reference) with the path of each file."""
    under = {"target": "", "caption": "", "reference": ""} if layout == "flat" else {"target": "training/targets/", "caption": "training/signals/captions/", "reference": "training/signals/references/"}
    path = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{out.rstrip('/')}/{under[c]}"), F.col("final_stem"), file_suffix(F.col(c))))
    return samples.withColumns({f"{c}_dest": path(c) for c in under})


#: What a file was when its transfer was planned, and the name that a copy has until it's whole.
JOURNAL, UNFINISHED = "source string, dest string, length long, modified long, missing string", ".{}.unfinished"


def journal(planned: DataFrame) -> DataFrame:
    """The transfers of a plan (source, dest) as a written table, with size and time of each source
    as they are before any file is touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source in batch.column(0).to_pylist():
                try:
                    s = os.stat(source)
                    out.append((s.st_size, s.st_mtime_ns, None))
                except OSError as e:
                    out.append((None, None, str(e)))
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["source", "dest", "length", "modified", "missing"])

    return materialize(planned.select("source", "dest").mapInArrow(run, JOURNAL), "transfers")


def carry(source: str, dest: str, length: int | None, modified: int | None, missing: str | None, copy: bool) -> None:
    """One transfer of a journal. It may be done again after any of its steps, by a task that runs
    twice: a copy gets its name only when it's whole, a source goes only after that, and
    a source that is gone is right where its destination is the file that was planned."""
    if missing is not None:
        raise OSError(missing)
    if os.path.abspath(source) == os.path.abspath(dest):
        return
    if not copy and not os.path.exists(source):
        s = os.stat(dest)
        if (s.st_size, s.st_mtime_ns) != (length, modified):
            raise OSError(f"{source} is gone, and {dest} is another file")
        return
    folder, name = os.path.split(dest)
    os.makedirs(folder or ".", exist_ok=True)
    unfinished = os.path.join(folder, UNFINISHED.format(name))
    shutil.copy2(source, unfinished)
    os.replace(unfinished, dest)
    if not copy:
        os.remove(source)


def transfer(planned: DataFrame, copy: bool = True) -> DataFrame:
    """Copy or move files of a plan (source, dest): a row for each with success and
    error. Overwrites; a file that is its own destination stays. The plan is written first
    (journal()), so tasks that run again, and a table that is read again, find each file where it
    belongs and say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, dests, errors = batch.column(0), batch.column(1), []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    carry(*row, copy)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([sources, dests, pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string())], names=["source", "dest", "success", "error"])

    return journal(planned).mapInArrow(run, "source string, dest string, success boolean, error string")
