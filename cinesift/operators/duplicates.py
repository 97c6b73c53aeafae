"""Near-duplicate images by hash distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import HASH_DISTANCE
from ..functions.vectors import hamming
from ..lineage import materialize
from .connected import components


def masks(n: int, distance: int, n_bits: int, most: int = 1_000) -> list[int]:
    """Bit masks of which any two hashes up to the distance apart agree on at least one: the
    bits are cut in bands, and a mask holds all but `distance` of them. Of the numbers of
    bands, that under which n random hashes give the fewest rows and candidates."""
    cost = lambda b: comb(b, distance) * (1 + n / 2 ** (n_bits * (b - distance) // b))
    able = [b for b in range(distance + 1, n_bits + 1) if b == distance + 1 or comb(b, distance) <= most]
    best = min(able, key=cost)
    cuts = [n_bits * k // best for k in range(best + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, best - distance)]


#: Hashes with one value under a mask that are compared with all others of it in one key.
PART = 4_096
#: Values dealt in parts that are broadcast; more are joined by a shuffle.
HOT = 100_000
#: Hashes in a part and in a tile of it; parts, of which each pair is a key, unless hashes are few or very many.
LARGE, TILE, PARTS, SMALL = 1 << 15, 512, 32, 256


def tiles(a: np.ndarray, b: np.ndarray | None, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in a and b (None: a itself, each pair once) of all pairs up to the distance, and how far apart they are."""
    other = a if b is None else b
    for i in range(0, len(a), TILE):
        for j in range(i if b is None else 0, len(other), TILE):
            apart = np.bitwise_count(a[i : i + TILE, None] ^ other[None, j : j + TILE])
            at = np.flatnonzero(apart <= distance)
            x, y = np.divmod(at, apart.shape[1])
            if b is None and i == j:
                at, x, y = (v[x < y] for v in (at, x, y))
            if len(at):
                yield x + i, y + j, apart.ravel()[at]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of range(n) with the components of all pairs, one for each that isn't the first of its component."""
    root = np.arange(n)
    for x, y in pairs:
        while len(x):
            x, y = root[x], root[y]
            x, y = x[differ := x != y], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def compared(once: DataFrame, n: int, distance: int, only_links: bool) -> DataFrame:
    """a, b, distance of n different hashes, all compared with all: dealt in parts, and each
    pair of parts is a key, so a task holds two parts at a time. only_links: of the pairs of a key
    just so many that their components are those of all (distance null)."""
    parts = max(-(-n // LARGE), min(PARTS, -(-n // SMALL)), 1)
    mine, yours = F.col("part"), F.col("other")
    rows = once.select("hash", F.pmod(F.xxhash64("hash"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("other"))
    rows = rows.select((F.least(mine, yours) * parts + F.greatest(mine, yours)).alias("key"), "part", "hash")
    rows = rows.repartition(max(1, parts * (parts + 1) // 8), "key").sortWithinPartitions("key", "part", "hash")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int64())])

    def found(key: int, part: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = int(np.searchsorted(part, key // parts, side="right"))
        bits, both = hashes.view(np.uint64), key // parts != key % parts
        pairs = ((x, y + cut * both, d) for x, y, d in tiles(bits[:cut] if both else bits, bits[cut:] if both else None, distance))
        if only_links:
            x, y = spanning(len(hashes), ((x, y) for x, y, _ in pairs))
            pairs = [(x, y, None)] if len(x) else []
        for x, y, d in pairs:
            x, y = hashes[x], hashes[y]
            d = pa.nulls(len(x), pa.int64()) if d is None else pa.array(d.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), d], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; those of a key may go on in the next batch."""
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            starts = np.flatnonzero(np.diff(held[0], prepend=-1))
            for low, high in zip(starts, starts[1:], strict=False):
                yield from found(int(held[0][low]), held[1][low:high], held[2][low:high])
            held = [h[starts[-1] :] for h in held] if len(starts) else held
        if len(held[0]):
            yield from found(int(held[0][0]), held[1], held[2])

    return rows.mapInArrow(run, "a long, b long, distance long")


def distinct_pairs(hashes: DataFrame, distance: int = HASH_DISTANCE, n_bits: int = 64, part: int = PART, hot: int = HOT, only_links: bool = False) -> DataFrame:
    """a, b, distance: pairs of different hashes (column hash) up to a distance; only_links: of
    these at least so many that their components are those of all.

    Where masks would leave as many candidates as there are pairs (14 of 56 bits), all
    are compared (compared()), without a row for each mask or candidate. Else
    candidates come from joins on the bits under each of masks(); none is missed. Equal
    hashes are one from the start. Masks get wider with the number of hashes, so that a
    value is shared by few. Values that more than `part` hashes share are dealt in parts: one side's
    hashes go to a part each and the other side's to all of them, so no key holds all of a
    value's candidates. Spark takes rows under masks for as few as there are hashes, so it is
    told to sort and merge them: it would collect and broadcast a row for each hash and mask.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    once = materialize(hashes.select("hash").dropna().distinct(), "distinct-hashes")
    n = once.count()
    found = masks(n, distance, n_bits)
    if len(found) * (1 + n / 2 ** min(m.bit_count() for m in found)) >= n / 2:
        return compared(once, n, distance, only_links)
    each = F.array(*[F.lit(signed(m)).cast("long") for m in found])
    rows = once.select("hash", F.posexplode(each).alias("band", "mask"))
    rows = rows.select("hash", "band", F.col("hash").bitwiseAND(F.col("mask")).alias("bits"))
    shared = rows.groupBy("band", "bits").agg(F.count("*").alias("n")).where(F.col("n") > part)
    shared = materialize(shared.select("band", "bits", F.ceil(F.col("n") / part).cast("int").alias("parts")), "hot-values")
    many = shared.count()
    if many:
        shared = F.broadcast(shared) if many <= hot else shared.hint("merge")
        rows = rows.join(shared, ["band", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        rows = rows.withColumn("parts", F.lit(1))
    left = rows.select("band", "bits", F.col("hash").alias("a"), F.pmod(F.xxhash64("hash"), F.col("parts")).cast("int").alias("part"))
    right = rows.select("band", "bits", F.col("hash").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    near = left.join(right.hint("merge"), ["band", "bits", "part"]).where("a < b").withColumn("distance", hamming(F.col("a"), F.col("b")).cast("long"))
    return near.where(F.col("distance") <= distance).select("a", "b", "distance").distinct()


def pairs(hashes: DataFrame, distance: int = HASH_DISTANCE, n_bits: int = 64, key: str = "id") -> DataFrame:
    """left, right, distance: rows (key, hash) up to a distance apart, each pair once."""
    near = distinct_pairs(hashes, distance, n_bits)
    a, b = (hashes.select(F.col(key).alias(k), F.col("hash").alias(h)) for k, h in (("x", "a"), ("y", "b")))
    apart = near.join(a, "a").join(b, "b").select("x", "y", "distance")
    same = hashes.select(F.col(key).alias("x"), "hash").join(hashes.select(F.col(key).alias("y"), "hash"), "hash").where("x < y").select("x", "y", F.lit(0).cast("long").alias("distance"))
    return apart.unionByName(same).select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "distance")


def groups(hashes: DataFrame, distance: int = HASH_DISTANCE, n_bits: int = 64, key: str = "id") -> DataFrame:
    """key, group_id (smallest key) of rows in groups of two or more. Rows of equal hash
    are joined through it, never as pairs; rows without hash are in no group. Groups are
    counted by hashes, and written, so that Spark splits the rows of a large one in the joins."""
    known = hashes.select(key, "hash").dropna()
    first = materialize(known.groupBy("hash").agg(F.min(key).alias("first"), F.count("*").alias("copies")), "hashes")
    near = distinct_pairs(first, distance, n_bits, only_links=True)
    found = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")), merged=True)
    labelled = first.join(found.withColumnRenamed("node", "hash").hint("merge"), "hash", "left").withColumn("label", F.coalesce("label", "hash"))
    least = labelled.groupBy("label").agg(F.min("first").alias("group_id"), F.sum("copies").alias("n")).where("n > 1")
    least = materialize(least.select("label", "group_id"), "groups")
    return known.join(labelled.select("hash", "label").join(least.hint("merge"), "label").select("hash", "group_id").hint("merge"), "hash").select(key, "group_id")


def across_sources(grouped: DataFrame, source: str = "source") -> DataFrame:
    """Groups with members from more than one source: group_id, sources, members."""
    rows = grouped.groupBy("group_id").agg(F.count_distinct(source).alias("sources"), F.count("*").alias("members"))
    return rows.where("sources > 1")
