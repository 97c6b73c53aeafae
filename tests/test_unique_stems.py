"""Names for samples against the definition, one after the other."""

import random

import pytest

from cinesift.operators import organize


def one_by_one(rows):
    used, out = set(), {}
    for key, stem in sorted(rows):
        name, n = stem, 1
        while name in used:
            n += 1
            name = f"{stem}_{n}"
        used.add(name)
        out[key] = name
    return out


def families(seed):
    rng = random.Random(seed)
    stems = ["a", "a_2", "a_3", "a_4", "a_2_2", "a_2_3", "a_2_2_2", "a_02", "a_1", "a_10", "b", "b_2", "_2", "x_2"]
    return [(i, rng.choice(stems)) for i in rng.sample(range(500), rng.randint(5, 60))]


@pytest.mark.parametrize("seed", range(4))
def test_names_equal_those_given_one_by_one(spark, seed):
    # Several families at once: names of different prefixes can't meet.
    rows, want = [], {}
    for k in range(6):
        one = [(1000 * k + i, f"f{k}{s}") for i, s in families(100 * seed + k)]
        rows += one
        want |= one_by_one(one)
    df = spark.createDataFrame(rows, "id long, stem string").repartition(3)
    got = organize.unique_stems(df, "stem", "id").collect()
    assert {r.id: r.final_stem for r in got} == want and len(got) == len(rows)
    assert len({r.final_stem for r in got}) == len(rows)


def test_other_column_names_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("s", 2, "a", 1), ("s", 1, "a", 2), ("r", 9, "a_2", 3), ("t", 1, None, 4)], "source string, target long, name string, level long")
    got = {r.level: r.final_stem for r in organize.unique_stems(df, "name", "source", "target").collect()}
    assert got == {3: "a_2", 2: "a", 1: "a_3", 4: None}
    assert organize.unique_stems(df.limit(0), "name", "source", "target").columns == [*df.columns, "final_stem"]
    assert organize.unique_stems(df.limit(0), "name", "source", "target").count() == 0


def test_a_million_equal_stems(spark):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 1_000_000
        # Every hundredth sample is a stem of its own that is one of the made-up names.
        df = spark.range(n).selectExpr("id", "if(id % 100 = 99, concat('s_', id div 50), 's') stem")
        ranged = organize.running(df.selectExpr("*", "1L one"), "stem", ["id"], "one", "before")
        assert ranged.where("stem = 's'").agg({"before": "max"}).first()[0] == n * 99 // 100 - 1
        parts = df.repartitionByRange("stem", "id").where("stem = 's'").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
        assert sum(x > 0 for x in parts) > 4 and max(parts) < n // 4  # the hot stem is in many tasks
        got = organize.unique_stems(df, "stem", "id")
        assert got.select("final_stem").distinct().count() == n
        # A number is left out only where its stem came first.
        want = one_by_one([(i, f"s_{i // 50}" if i % 100 == 99 else "s") for i in range(20_000)])
        some = {r.id: r.final_stem for r in got.where("id < 20000").collect()}
        assert some == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
