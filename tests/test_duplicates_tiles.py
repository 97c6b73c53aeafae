"""Hashes of which masks leave all pairs as candidates are compared in tiles."""

import random

import numpy as np
import pytest

from cinesift.operators import duplicates


def near_hashes() -> list[int]:
    rng = random.Random(12)
    hashes = [rng.getrandbits(56) for _ in range(250)]
    # Hashes near another one, and hashes that are all near each other.
    return [*{*hashes, *(h ^ sum(1 << rng.randrange(56) for _ in range(9)) for h in hashes[:60]), *(hashes[0] ^ 1 << k for k in range(56))}]


def labels(links) -> dict[int, int]:
    """The smallest hash that each one reaches."""
    group: dict[int, set] = {}
    for a, b in links:
        both = group.get(a, {a}) | group.get(b, {b})
        group.update(dict.fromkeys(both, both))
    return {h: min(g) for h, g in group.items()}


@pytest.mark.parametrize("small, large, tile", [(256, 1 << 15, 512), (20, 1 << 15, 7), (20, 9, 512)])
def test_tiles_give_all_pairs(spark, monkeypatch, small, large, tile):
    for name, value in (("SMALL", small), ("LARGE", large), ("TILE", tile)):
        monkeypatch.setattr(duplicates, name, value)
    hashes = near_hashes()
    df = spark.createDataFrame([(h,) for h in [*hashes, hashes[0], None]], "hash long")
    want = {(a, b, (a ^ b).bit_count()) for a in hashes for b in hashes if a < b and (a ^ b).bit_count() <= 14}
    found = duplicates.distinct_pairs(df, 14, 56)
    # A join on masks would make 120 rows of each hash and, of 14 of 56 bits, nearly all pairs as rows.
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) > 1_000
    links = [(r.a, r.b) for r in duplicates.distinct_pairs(df, 14, 56, only_links=True).collect()]
    assert len(links) < len(want) and labels(links) == labels((a, b) for a, b, _ in want)


def test_hashes_with_all_64_bits(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(-(1 << 63), 1 << 63, 80).tolist()
    df = spark.createDataFrame([(h,) for h in hashes], "hash long")
    want = {(a, b, d) for a in hashes for b in hashes if a < b and (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= 26}
    assert {tuple(r) for r in duplicates.distinct_pairs(df, 26, 64).collect()} == want and len(want) > 100


def test_groups_broadcast_no_table_of_hashes(spark):
    df = spark.createDataFrame([*enumerate(near_hashes())], "id long, hash long")
    plan = duplicates.groups(df, 14, 56)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
