"""What was measured of files, kept by path, size and time, so that unchanged files are not
measured again."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import materialize

STAMP = ["length", "modified"]


def stamped(files: DataFrame, column: str = "path") -> DataFrame:
    """column, length, modified (nanoseconds) of each distinct path; null for those that are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                try:
                    s = os.stat(path)
                    out.append((s.st_size, s.st_mtime_ns))
                except OSError:
                    out.append((None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], pa.int64()) for i in range(2))], names=[column, *STAMP])

    return files.select(column).dropna().distinct().mapInArrow(run, f"`{column}` string, length long, modified long")


def held(spark: SparkSession, folder: str, kinds: str) -> DataFrame:
    """What a snapshot holds; nothing if there's none yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(folder)


def incremental(files: DataFrame, folder: str, name: str, measure: Callable[[DataFrame], DataFrame], good: Column, column: str = "path") -> DataFrame:
    """measure(files), of which only files are measured that the snapshot `name` in folder
    doesn't hold with their size and time.

    measure: gives a row for each distinct file (column). Rows that are good are appended; the others are
    measured again next time, as are files that are gone. Tasks that run again append
    nothing twice, as Spark commits the files of one attempt. A snapshot is for one way of
    measuring: another way takes another name. The result is a written table.
    """
    spark, at = files.sparkSession, os.path.join(folder, name)
    now = materialize(stamped(files, column), "stamped")
    kinds = measure(now.select(column)).dtypes
    own = ", ".join(f"`{c}` {k}" for c, k in [*kinds, *((c, "long") for c in STAMP)])
    before = held(spark, at, own).dropDuplicates([column, *STAMP])
    keys = [column, *STAMP]
    known = materialize(before.join(now, keys, "left_semi"), "known")
    todo = now.join(known, keys, "left_anti")
    fresh = materialize(measure(todo.select(column)).join(now, column), "measured")
    fresh.where(good & F.col("modified").isNotNull()).write.mode("append").parquet(at)
    return known.unionByName(fresh).drop(*STAMP)


def compact(spark: SparkSession, folder: str, name: str, column: str = "path") -> DataFrame:
    """The snapshot's newest row of each path, as a written table; give it a new name by
    writing it there. Older rows do no harm but take space."""
    rows = spark.read.parquet(os.path.join(folder, name))
    others = [c for c in rows.columns if c != column]
    newest = rows.groupBy(column).agg(F.max_by(F.struct(*others), "modified").alias("newest"))
    return materialize(newest.select(column, "newest.*"), "compacted")
