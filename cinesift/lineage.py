"""Cut lineage in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's checkpoint folder.

    Where neither is set, a session on a local master gets a temporary folder of this
    machine; on a cluster, executors would each write to their own, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cinesift-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cinesift-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it's there."""
    hadoop = hadoop_path(spark, path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Later stages then depend on files that all executors reach, not on shuffle
    files of an executor that may be lost. The files go with tidy(), or when the
    session's Python process ends.
    """
    out, path = _write(df, name)
    _written.append((df.sparkSession, path))
    return out


def written(spark: SparkSession, path: str) -> str:
    """Notes a folder that an operator writes by itself, so that it goes like the others."""
    _written.append((spark, path))
    return path


def mark() -> int:
    return len(_written)


def tidy(since: int) -> None:
    """Deletes the tables that were written since mark() gave `since`, but for the last one."""
    for spark, path in _written[since:-1]:
        discard(spark, path)
    del _written[since:-1]


class Scratch:
    """Tables of one operator's steps: deleted when the block ends, which must be
    after the last step that reads them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths.append(path)
        return out

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """Written for good, as materialize() does."""
        return materialize(df, name)

    def drop(self, n: int) -> None:
        """Deletes all but the last n tables."""
        for path in self.paths[: len(self.paths) - n]:
            discard(self.spark, path)
        self.paths = self.paths[len(self.paths) - n :]

    def __exit__(self, *_) -> None:
        self.drop(0)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; so has whoever could use the files
            return
