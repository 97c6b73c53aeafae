"""Joins of hashes that Spark takes for small, and groups of very many rows."""

import random

import pytest

from cinesift.operators import duplicates


def linked(hashes: dict[int, int], distance: int) -> dict[int, int]:
    """The smallest id that each id reaches, of those that reach another one."""
    label = {i: i for i in hashes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in hashes:
        for b in hashes:
            if a < b and (hashes[a] ^ hashes[b]).bit_count() <= distance and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    roots = [root(i) for i in hashes]
    return {i: r for i, r in zip(hashes, roots, strict=True) if roots.count(r) > 1}


@pytest.mark.parametrize("part, hot", [(4_096, 100_000), (3, 100_000), (3, 0)])
def test_no_row_of_hash_and_mask_is_broadcast(spark, part, hot):
    rng = random.Random(8)
    hashes = {rng.getrandbits(18) for _ in range(120)}
    df = spark.createDataFrame([(h,) for h in hashes], "hash long")
    found = duplicates.distinct_pairs(df, 4, 18, part, hot)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= (part == 3 and hot > 0) * 2 and "SortMergeJoin" in plan
    want = {(a, b, (a ^ b).bit_count()) for a in hashes for b in hashes if a < b and (a ^ b).bit_count() <= 4}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 20


def test_groups_of_copies_and_chains(spark):
    rng = random.Random(9)
    chain = [(1 << k) - 1 for k in range(0, 60, 2)]  # each two bits from the next one
    alone = [rng.getrandbits(62) for _ in range(40)]
    values = chain + alone[:5] * 30 + alone
    rng.shuffle(values)
    hashes = dict(enumerate(values, 100))
    df = spark.createDataFrame([*hashes.items(), (1, None), (None, 7)], "id long, hash long")
    got = duplicates.groups(df, 2, 64).collect()
    assert {r.id: r.group_id for r in got} == linked(hashes, 2) and len(got) == len({r.id for r in got}) > 150


def test_rows_of_a_group_are_not_counted_again(spark):
    df = spark.range(400).selectExpr("id", "id % 2 AS hash")
    rows = duplicates.groups(df, 1, 64)
    # Groups are counted by hashes before; an aggregate by group_id would take a large group's rows to one task.
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()
    found = duplicates.across_sources(rows.selectExpr("id", "group_id", "id % 3 AS source")).collect()
    assert [tuple(r) for r in found] == [(0, 3, 400)]


def test_cross_source_query_broadcasts_no_rows_of_hash_and_mask(spark, monkeypatch):
    from cinesift.catalog import QUERIES

    plans, plain = [], duplicates.distinct_pairs

    def seen(*a, **b):
        plans.append((out := plain(*a, **b))._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(duplicates, "distinct_pairs", seen)
    QUERIES["cross_source_duplicates"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "BroadcastHashJoin" not in plans[0]
