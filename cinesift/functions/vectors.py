"""Vectors, hashes and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """a with length 1; the zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def grid_hash(grid: Column, side: int = 8) -> Column:
    """Bits, row by row and first bit highest, that say where the right neighbour is
    larger, of a flat side * side grid: side * (side - 1) bits."""
    at = [r * side + c for r in range(side) for c in range(side - 1)]
    pairs = F.array(*[F.when(F.get(grid, F.lit(i + 1)) > F.get(grid, F.lit(i)), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) for i in at])
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def laplacian_variance(grid: Column, width: int, height: int) -> Column:
    """Population variance of the 4-neighbour Laplacian; edges mirror without repeating the edge."""
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    cell = lambda r, c: F.get(grid, F.lit(mirror(r, height) * width + mirror(c, width))).cast("double")
    out = F.array(*[cell(r - 1, c) + cell(r + 1, c) + cell(r, c - 1) + cell(r, c + 1) - 4 * cell(r, c) for r in range(height) for c in range(width)])
    return moments(out, F.lit(width * height))["variance"]


def moments(values: Column, n: Column) -> Column:
    """Struct mean, variance (population) of an array, in one pass."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    step = lambda m, x: F.struct((m["s"] + x).alias("s"), (m["q"] + x * x).alias("q"))
    done = lambda m: F.struct((m["s"] / n).alias("mean"), F.greatest(m["q"] / n - (m["s"] / n) * (m["s"] / n), F.lit(0.0)).alias("variance"))
    return F.aggregate(values, zero, lambda m, x: step(m, x.cast("double")), done)


def exposure(grid: Column, full: float = 255.0) -> Column:
    """Struct mean, deviation (population) of a grid, as shares of the full value."""
    scaled = F.transform(F.array(moments(grid, F.size(grid))), lambda m: F.struct((m["mean"] / full).alias("mean"), (F.sqrt(m["variance"]) / full).alias("deviation")))
    return F.get(scaled, F.lit(0))
