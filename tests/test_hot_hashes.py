"""Hashes that share a value under a mask with very many others."""

import random

import pytest
from pyspark.sql import functions as F

from cinesift.operators import duplicates


@pytest.mark.parametrize("part", [5, 1_000])
def test_hot_values_in_parts_give_all_pairs(spark, part):
    rng = random.Random(6)
    # All hashes agree on their upper 40 bits, so they share the values of several masks.
    hashes = {0x5A5A5A5A5A << 24 | sum(1 << rng.randrange(24) for _ in range(rng.randint(0, 5))) for _ in range(150)}
    df = spark.createDataFrame([(h,) for h in hashes] + [(next(iter(hashes)),), (None,)], "hash long")
    want = {(a, b, (a ^ b).bit_count()) for a in hashes for b in hashes if a < b and (a ^ b).bit_count() <= 3}
    found = duplicates.distinct_pairs(df, 3, 64, part)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) > 100


def test_no_key_holds_all_candidates(spark, monkeypatch):
    seen = []
    plain = duplicates.hamming
    monkeypatch.setattr(duplicates, "hamming", lambda a, b: seen.append(1) or plain(a, b))
    df = spark.range(2_000).select((F.lit(7 << 40) + F.col("id")).alias("hash"))
    rows = duplicates.distinct_pairs(df, 2, 64, 100)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert seen and "part" in plan
    assert rows.count() == sum(1 for a in range(2_000) for b in range(a + 1, 2_000) if (a ^ b).bit_count() <= 2)
