"""SimHash near-duplicates: exact comparison in tiles, and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialize
from ..operators.connected import components
from .common import map_batches, utf8

TILE = 1024


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of one text: bit k is set if it is in over half of the XXH64 of
    its word shingles, repeats included."""
    import xxhash

    words = text.lower().split()  # lower() and split() of bytes know ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns of keep for every row of docs."""

    def make():
        def f(batch):
            fps = np.array([fingerprint(t, shingle, seed) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *keep])

        return f

    kinds = "".join(f", `{c}` {k}" for c, k in docs.select(*keep).dtypes) if keep else ""
    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *keep), make, "doc_id long, fp long" + kinds)


def masks(bands: int, radius: int) -> list[int]:
    """Bit masks of which each pair within the radius agrees on at least one: the
    bits in `bands` bands, and of those every choice of all but `radius`."""
    cuts = [64 * k // bands for k in range(bands + 1)]
    band = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(band, bands - radius)]


def bands_for(n: int, radius: int, most: int = 4096) -> int:
    """So many bands that `most` of n random fingerprints share a masked value."""
    bands = radius + 1
    while n / 2 ** (64 * (bands - radius) // bands) > most and bands < 2 * radius + 4:
        bands += 1
    return bands


def tiled(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within the radius; both sorted by population
    count. Tile pairs whose counts differ by more than the radius are skipped."""
    cl, cr = np.bitwise_count(left).astype(int), np.bitwise_count(right).astype(int)
    for a in range(0, len(left), TILE):
        ta, ca = left[a : a + TILE], cl[a : a + TILE]
        for b in range(0, len(right), TILE):
            cb = cr[b : b + TILE]
            if cb[0] - ca[-1] > radius or ca[0] - cb[-1] > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(ta[:, None] ^ right[None, b : b + TILE]) <= radius)
            yield i + a, j + b


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs over range(n), those of a spanning forest: as many links as rows at
    most, with the same components."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def links(distinct: DataFrame, radius: int = 4, group: int = 4096) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) whose components are
    those of all pairs that differ in at most `radius` bits.

    Fingerprints are dealt by their value under each of masks(); within the rows of
    a value, tiles are compared exactly. Values with over `group` rows are split in
    parts by a hash, and each pair of parts is a task's key of its own, so that no
    task compares more than two parts.
    """
    bands = bands_for(distinct.count(), radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks(bands, radius)])).alias("band", "mask"))
    keyed = keyed.select("fp", F.xxhash64("band", F.col("fp").bitwiseAND(F.col("mask"))).alias("value"))
    # Values that one row has give no pair.
    sizes = keyed.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    parts = F.ceil(F.col("n") / group).cast("int")
    rows = keyed.join(sizes, "value").select("value", "fp", parts.alias("parts"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("value", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.select(key.alias("key"), "part", "fp")

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a key's rows may go on in the next batch."""
        keys, parts, fps = (np.zeros(0, np.int64) for _ in range(3))

        def pairs(part, fp):
            bits = fp.view(np.uint64)
            order = np.argsort(np.bitwise_count(bits), kind="stable")
            part, bits = part[order], bits[order]
            split = part != part[0]
            if split.any():  # two parts: between them; each by itself is another key's task
                a, b = np.flatnonzero(~split), np.flatnonzero(split)
                found = ((a[i], b[j]) for i, j in tiled(bits[a], bits[b], radius))
            else:
                found = tiled(bits, bits, radius)
            at, root = forest(len(bits), found)
            signed = bits.view(np.int64)
            return signed[at], signed[root]

        def done(keys, parts, fps):
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            out = [pairs(parts[a:b], fps[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
            u, v = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=schema)

        for batch in batches:
            k, p, f = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            keys, parts, fps = np.concatenate([keys, k]), np.concatenate([parts, p]), np.concatenate([fps, f])
            if len(keys) and keys[0] != keys[-1]:
                at = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield done(keys[:at], parts[:at], fps[:at])
                keys, parts, fps = keys[at:], parts[at:], fps[at:]
        if len(keys):
            yield done(keys, parts, fps)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id and the columns of keep for
    every row of docs.

    component_id is the smallest doc_id among the documents that links reach, a
    link being two fingerprints that differ in at most `radius` bits. Equal
    fingerprints are one row from the start, however many documents have them.

    Null and empty texts have fingerprint 0, linked like any other. Null ids count
    as no id: they get the smallest id reachable, null if there is none. Repeated
    rows each give a row. No rows: no rows. Other columns of docs are ignored.
    """
    fps = materialize(fingerprints(docs, shingle, seed, keep), "simhash")
    first = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = components(links(first.select("fp"), radius))
    by_fp = first.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = by_fp.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = by_fp.join(smallest, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *keep)
