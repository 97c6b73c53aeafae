"""op9 learns from all labelled rows, however many there are."""

from pyspark.sql import functions as F

from cinesift.llm import quality_rules
from cinesift.llm.common import held_out


def test_threshold_counts_every_labelled_row(spark, monkeypatch):
    counted = []
    plain = quality_rules.IsolationForest.calibrate

    def spy(self, *a):
        counted.append(len(a[0]) if len(a) == 2 else int(sum(n.sum() for n in a[1:])))
        plain(self, *a)

    monkeypatch.setattr(quality_rules.IsolationForest, "calibrate", spy)
    n = 26_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 21), x -> concat('w', id * x + x))) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 9 <> 0 AS INT) AS quality")
    rows = quality_rules.judge(docs, labels)
    fold = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3))
    assert counted == [labels.where(~held_out(F.col("doc_id")) & (fold == 0)).count()] and counted[0] > 6_700
    assert rows.count() == n


def test_each_tree_draws_its_own_rows_of_all(spark):
    zeros = [F.lit(0).cast("long").alias(c) for c in quality_rules.NAMES]
    rows = spark.range(5_000).select(F.col("id").alias("doc_id"), (F.col("id") < 40).alias("rare"), *zeros)
    found = quality_rules.drawn(rows, {False: 4_960, True: 40}, {False: 60, True: 5}, 50).toPandas()
    assert found.groupby(["tree", "rare"]).size().unstack().to_numpy().tolist() == [[60, 5]] * 50
    assert not found.duplicated(["tree", "doc_id"]).any() and found["doc_id"].nunique() > 2_000
    few = quality_rules.drawn(rows.where("doc_id < 43"), {False: 3, True: 40}, {False: 3, True: 5}, 4).toPandas()
    assert few.groupby(["tree", "rare"]).size().unstack().to_numpy().tolist() == [[3, 5]] * 4


def test_threshold_is_the_best_step(spark):
    import numpy as np

    forest = quality_rules.IsolationForest([], 1.0)
    forest.calibrate(np.array([10, 20, 30, 40]), np.array([997, 1, 1, 1]), np.array([5, 5, 0, 5]))
    assert forest.threshold == 20 / quality_rules.STEPS
    forest.calibrate(np.array([40_000, 60_000]), np.array([3, 1]), np.array([0, 0]))
    assert forest.threshold == 60_001 / quality_rules.STEPS
