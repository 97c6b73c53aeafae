"""Dot products of many vectors with a set of references, as products of matrices."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of references that one pass over the vectors holds, and products that are made at once.
SHARD_BYTES, CELLS = 64 << 20, 1 << 21
#: Digits that products are rounded to, so equal vectors tie wherever they stand.
DIGITS = 12


class Block:
    """Some references: their other columns, and their vectors as a matrix for each length."""

    def __init__(self, rows: pa.Table, vector: str):
        rows = rows.combine_chunks()
        self.rows, self.matrices = rows.drop_columns([vector]), {}
        lists = rows[vector].to_pylist()
        sizes = np.array([-1 if v is None or None in v else len(v) for v in lists], np.int64)
        for d in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == d)
            self.matrices[int(d)] = at, np.array([lists[i] for i in at], np.float64).reshape(len(at), int(d))

    def __len__(self) -> int:
        return self.rows.num_rows

    def products(self, vectors: list) -> np.ndarray:
        """A row for each vector, a column for each reference; nan where either is null, holds
        a null, or their lengths differ."""
        out = np.full((len(vectors), len(self)), np.nan)
        sizes = np.array([-1 if v is None or None in v else len(v) for v in vectors], np.int64)
        for d, (at, matrix) in self.matrices.items():
            of = np.flatnonzero(sizes == d)
            if len(of):
                out[np.ix_(of, at)] = np.round(np.array([vectors[i] for i in of], np.float64).reshape(len(of), d) @ matrix.T, DIGITS)
        return out


def blocks(references: DataFrame, vector: str, shard: int = SHARD_BYTES) -> list[Block]:
    """The references in blocks of about `shard` bytes, counted first, so that each may be
    broadcast; usually one."""
    rows = references.withColumn("_size", F.coalesce(F.size(vector), F.lit(0)))
    n = rows.agg(F.ceil(F.sum(F.col("_size") * 8 + 64) / shard).alias("n")).first()["n"] or 1
    if n == 1:
        return [Block(references.toArrow(), vector)]
    keys = [c for c in references.columns if c != vector]
    dealt = F.pmod(F.xxhash64(*keys), F.lit(n))
    return [Block(references.where(dealt == i).toArrow(), vector) for i in range(n)]


def _schema(df: DataFrame, without: str) -> list[str]:
    return [f"`{c}` {k}" for c, k in df.dtypes if c != without]


def _rows_at_once(block: Block) -> int:
    return max(CELLS // max(len(block), 1), 1)


def each(vectors: DataFrame, references: DataFrame, vector: str, reference: str, name: str, shard: int = SHARD_BYTES) -> DataFrame:
    """vectors x references with their product, for callers who want all of these rows."""
    schema = [*_schema(vectors, vector), *_schema(references, reference), f"`{name}` double"]

    def of(block: Block) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            m, step = len(block), _rows_at_once(block)
            for whole in batches:
                for a in range(0, whole.num_rows if m else 0, step):
                    batch = whole.slice(a, step)
                    s = block.products(batch[vector].to_pylist()).ravel()
                    left, right = np.repeat(np.arange(batch.num_rows), m), np.tile(np.arange(m), batch.num_rows)
                    own = batch.drop_columns([vector]).take(pa.array(left))
                    other = block.rows.take(pa.array(right)).combine_chunks()
                    columns = [*own.columns, *(c.combine_chunks() for c in other.columns), pa.array(s, mask=np.isnan(s))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*own.schema.names, *other.schema.names, name])

        return vectors.mapInArrow(run, ", ".join(schema))

    return reduce(DataFrame.unionByName, map(of, blocks(references, reference, shard)))


def best(vectors: DataFrame, references: DataFrame, by: tuple[str, ...], vector: str, reference: str, order: str, least: float | None = None, shard: int = SHARD_BYTES) -> DataFrame:
    """by, the references' other columns, similarity and at: for each of `by` and reference the
    largest product of the vectors, and the smallest `order` that has it; only those of
    `least` or more, if given.

    A task reduces each batch to the best of its groups, in numpy, before any row is made;
    what is shuffled are groups x references that pass, never vectors x references.
    """
    own = {c: k for c, k in vectors.dtypes if c in by}
    schema = [*(f"`{c}` {own[c]}" for c in by), *_schema(references, reference), "similarity double", "at long"]

    def of(block: Block) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            step = _rows_at_once(block)
            for whole in batches:
                for a in range(0, whole.num_rows if len(block) else 0, step):
                    yield from reduced(whole.slice(a, step), block)

        def reduced(batch: pa.RecordBatch, block: Block) -> Iterator[pa.RecordBatch]:
            s, at = block.products(batch[vector].to_pylist()), batch[order].to_numpy(zero_copy_only=False).astype(np.int64)
            group = pd.DataFrame({c: batch[c].to_pandas() for c in by}).groupby(list(by), dropna=False, sort=False).ngroup().to_numpy()
            rank = np.lexsort((at, group))  # group by group, in order
            s, at, group = np.where(np.isnan(s), -np.inf, s)[rank], at[rank], group[rank]
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            top = np.maximum.reduceat(s, starts, axis=0)
            which, ref = np.nonzero(np.isfinite(top) if least is None else top >= least)
            if not len(which):
                return
            ends = np.append(starts[1:], len(s))
            first = np.array([starts[g] + int(np.argmax(s[starts[g] : ends[g], r])) for g, r in zip(which, ref, strict=True)])
            keys = batch.select(list(by)).take(pa.array(rank[starts[which]]))
            other = block.rows.take(pa.array(ref)).combine_chunks()
            columns = [*keys.columns, *(c.combine_chunks() for c in other.columns), pa.array(top[which, ref]), pa.array(at[first])]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, *other.schema.names, "similarity", "at"])

        return vectors.select(*by, order, vector).mapInArrow(run, ", ".join(schema))

    rows = reduce(DataFrame.unionByName, map(of, blocks(references, reference, shard)))
    keys = [*by, *(c for c in references.columns if c != reference)]
    found = F.max(F.struct("similarity", (-F.col("at")).alias("at"))).alias("found")
    return rows.groupBy(*keys).agg(found).select(*keys, "found.similarity", (-F.col("found.at")).alias("at"))


def largest(vectors: DataFrame, references: DataFrame, by: tuple[str, ...], vector: str, reference: str, name: str, shard: int = SHARD_BYTES) -> DataFrame:
    """by and the largest product of any of its vectors with any reference, 0 at least; no rows
    without references."""
    own = {c: k for c, k in vectors.dtypes if c in by}
    schema = ", ".join([*(f"`{c}` {own[c]}" for c in by), f"`{name}` double"])

    def of(block: Block) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            step = _rows_at_once(block)
            for whole in batches:
                for a in range(0, whole.num_rows if len(block) else 0, step):
                    batch = whole.slice(a, step)
                    s = block.products(batch[vector].to_pylist())
                    top = np.where(np.isnan(s), 0.0, s).max(axis=1)
                    yield pa.RecordBatch.from_arrays([*(batch[c] for c in by), pa.array(top)], names=[*by, name])

        return vectors.select(*by, vector).mapInArrow(run, schema)

    rows = reduce(DataFrame.unionByName, map(of, blocks(references, reference, shard)))
    return rows.groupBy(*by).agg(F.greatest(F.max(name), F.lit(0.0)).alias(name))


def kept(score: Column, at: Column) -> tuple[Column, Column]:
    """A best product, 0 at least, and where it is; 0 where it isn't above 0."""
    return F.greatest(score, F.lit(0.0)), F.when(score <= 0, 0).otherwise(at).cast("long")
