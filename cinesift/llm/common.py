"""Helpers that the operators share: cut lineage, words, Arrow batches, samples."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What bytes.split() splits at, which is the complement of WORD.
SPACE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def code_points(data: bytes, without: bytes = b"") -> int:
    return len(data.translate(None, _CONTINUATION + without))


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
    schema: str,
    rows: int = 256,
) -> DataFrame:
    """mapInArrow with batches of at most `rows` rows; make() builds, once in each
    task, the function from a batch to batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from f(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels no model may learn from. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, label: one row for each id that may be learned from; repeated rows
    of an id give their largest label, null ids and labels none."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).dropna()
    return rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded_sample(rows: DataFrame, bound: int, order: str = "doc_id"):
    """At most about `bound` rows as pandas, chosen by a hash of their id, sorted by it."""
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64(order), F.lit(1 << 60)) < F.lit(bound * (1 << 60) // n))
    return rows.toPandas().sort_values(order, kind="stable").reset_index(drop=True)


def chosen_labels(labels: DataFrame, label: str, bound: int, folds: int = 1) -> DataFrame:
    """doc_id, label, fold of at most about `bound` rows that may be learned from. The
    bound makes it safe to broadcast. fold: 0 to folds - 1, by another hash of the id."""
    rows = bounded_sample(one_label(labels, label), bound)
    out = labels.sparkSession.createDataFrame(rows.astype("int64"), "doc_id long, label long")
    return out.withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(folds)))


def known_rows(rows: DataFrame, *columns: str):
    """doc_id, label, fold and columns as pandas, one row for each id (the smallest, where
    an id is repeated), so no more than there are chosen labels."""
    least = F.min(F.struct("label", "fold", *columns)).alias("least")
    return rows.groupBy("doc_id").agg(least).select("doc_id", "least.*").toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


def with_arrays(df: DataFrame, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], added: str, rows: int = 256) -> DataFrame:
    """df with columns made from its column text; columns of the same names are replaced."""
    names = [x.split()[0] for x in added.split(", ")]
    df = df.drop(*names)
    at = df.columns.index("text")

    def build():
        inner = make()

        def f(batch):
            yield pa.RecordBatch.from_arrays([*batch.columns, *inner(utf8(batch.column(at)))], names=[*batch.schema.names, *names])

        return f

    return map_batches(df, build, ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", {added}", rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
#: An odd base, its inverse modulo 2 ** 64, and a value for each byte.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_BLOCK = 1 << 18


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text and where it begins, without a dictionary
    of words: differences of prefix sums of a polynomial in the bytes, block by block."""
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[0], (~_IS_SPACE[b]).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")), at + 1)
        s, e = starts[at:end] - starts[at], ends[at:end] - starts[at]
        size = int(e[-1])
        up, down = _powers(max(_BLOCK, size) + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[b[starts[at] : starts[at] + size]] * up[:size], out=sums[1:])
        out[at:end] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    return out, starts


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the len(h) - k + 1 runs of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, width, at = None, 0, h, 1, 0
    while True:
        if k & width:  # runs of `width` words, put after the `have` words that are done
            if out is None:
                out = power[at : at + n]
            else:
                out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + power[have : have + n])
            have += width
        if have == k:
            return out
        power = mix64(power[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) + power[width:])
        width *= 2
