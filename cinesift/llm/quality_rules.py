"""Quality rules: an isolation forest over rule statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import Scratch, materialize
from .common import SPACE, code_points, map_batches, one_label, with_arrays

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Trees, rows that each of them sees, and what draws them; steps of a score that are counted.
TREES, SAMPLE, SEED, STEPS = 200, 256, 11, 1 << 16
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_upper long, n_digits long, n_marks long, longest_word long, n_bytes long, n_ended long, n_symbol_words long"
#: Names of the columns of `rules()` that the forest sees.
RULES = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "words_a_line", "distinct", "upper", "digits", "marks", "longest", "unended", "symbol_words"]


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many positions lie in runs of `width` ids that are found twice or more.

    Runs are ranked exactly, by doubling: equal ranks mean equal runs.
    """
    n = len(ids) - width + 1
    if n < 2:
        return 0
    rank, have = ids.astype(np.int64), 1
    while have < width:
        step = min(have, width - have)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank, have = np.unique(pair, return_inverse=True)[1], have + step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    change = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    change[at] += 1
    np.subtract.at(change, at + width, 1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The columns of BASE for one text."""
    words = text.split()
    held: dict[bytes, int] = {}
    ids = [held.setdefault(w, len(held)) for w in words]
    repeats = repeated_words(np.array(ids, np.int64)) if len(held) < len(ids) else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda chars: len(text) - len(text.translate(None, chars))
    return (
        len(words), code_points(text, SPACE), count(SYMBOLS), len(lines) - len(set(lines)), repeats, len(lines), len(held),
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"0123456789"), count(b".,;:!?"), max(map(len, held), default=0), len(text),
        sum(x.rstrip()[-1:] in b".!?" for x in lines), sum(w[-1:] in SYMBOLS for w in words),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs and the columns of BASE, from whole texts; null is empty."""

    def make():
        return lambda texts: [pa.array(c, pa.int64()) for c in (zip(*map(measure, texts), strict=True) if texts else [[]] * 14)]

    return with_arrays(docs, make, BASE)


def failed(n_words, n_repeat_words):
    """The base rules, over columns of pandas or of Spark."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def rules(x) -> np.ndarray:
    """RULES of the rows of a pandas frame with the columns of BASE."""
    n, chars = np.maximum(x["n_words"].to_numpy(float), 1), np.maximum(x["word_chars"].to_numpy(float), 1)
    lines = np.maximum(x["n_lines"].to_numpy(float), 1)
    col = lambda c: x[c].to_numpy(float)
    return np.column_stack([
        np.log1p(col("n_words")), col("word_chars") / n, col("n_symbols") / chars, col("n_dup_lines") / lines, col("n_repeat_words") / n, np.log1p(col("n_words") / lines),
        np.log1p(col("n_distinct")) - np.log1p(col("n_words")), col("n_upper") / chars, col("n_digits") / chars, col("n_marks") / n, np.log1p(col("longest_word")),
        1 - col("n_ended") / lines, col("n_symbol_words") / n,
    ])


@dataclass
class IsolationForest:
    """Trees of random splits over subsamples; a row that few splits set apart is anomalous.

    Each tree is four arrays over its nodes: the feature (or -1 at a leaf), the
    threshold, the left child (the right one follows it) and at a leaf the path length.
    """

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    scale: float
    threshold: float = 0.5

    @staticmethod
    def average_path(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    @staticmethod
    def shares(n: int, n_rare: int, sample: int = SAMPLE, share: float = 0.02) -> tuple[int, int]:
        """How many of n rows and of n_rare rare ones a tree sees."""
        some = min(n_rare, max(1, round(share * sample)))
        return min(sample - some, n), some

    @classmethod
    def grow(cls, drawn: np.ndarray, sample: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A tree over the rows drawn for it. Splits are drawn between the values that a tree
        has seen, so a rule that no ordinary row breaks is split on only where some row that
        breaks it is seen."""
        limit = int(np.ceil(np.log2(max(sample, 2)))) + 2
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(0, drawn, 0)]
        while todo:
            at, rows, depth = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (0, 0)
            able = np.flatnonzero(high > low) if len(rows) > 1 else []
            if depth >= limit or len(able) == 0:
                nodes[at][3] = depth + cls.average_path(len(rows))
                continue
            f = int(rng.choice(able))
            t = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] <= t
            nodes[at][:3] = [f, t, len(nodes)]
            todo += [(len(nodes), rows[left], depth + 1), (len(nodes) + 1, rows[~left], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3]

    @classmethod
    def of(cls, trees: list, sample: int) -> IsolationForest:
        return cls(trees, max(cls.average_path(sample), 1e-9))

    @classmethod
    def fit(cls, x: np.ndarray, rare: np.ndarray | None = None, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> IsolationForest:
        """A forest over rows in memory. rare: rows of which each tree gets a share of its sample."""
        rng = np.random.default_rng(seed)
        rare = x[:0] if rare is None else rare
        own, some = cls.shares(len(x), len(rare), sample)
        draw = lambda rows, n: rows[rng.choice(len(rows), n, replace=False)] if n else rows[:0]
        return cls.of([cls.grow(np.vstack([draw(x, own), draw(rare, some)]), own + some, rng) for _ in range(trees)], own + some)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that are set apart at once."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, child, path in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, child[at] + (x[rows, f] > threshold[at]), at)
            total += path[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / self.scale)

    def calibrate(self, steps: np.ndarray, good: np.ndarray, bad: np.ndarray, most_lost: float = 0.003) -> None:
        """The threshold above which a row is anomalous: of those that lose at most `most_lost`
        of the good rows, the one with the best share of bad rows found less share of good rows
        lost. good, bad: how many rows score in each of the rising `steps` of 1 / STEPS."""
        self.threshold = float(steps.max(initial=STEPS // 2) + 1) / STEPS
        if not good.any() or not bad.any():
            return
        lost, found = (np.cumsum(n[::-1])[::-1] / n.sum() for n in (good, bad))
        gain = np.where(lost <= most_lost, found - lost, -1.0)
        if gain.max() > 0:
            self.threshold = float(steps[int(np.argmax(gain))]) / STEPS


NAMES = [x.split()[0] for x in BASE.split(", ")]
TREE = "tree int, feature array<int>, threshold array<double>, child array<int>, path array<double>"


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good, fold and the statistics of every row that may be learned from and passes the
    base rules; one of the rows of a repeated id."""
    rows = stats.join(one_label(labels, "quality"), "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", *NAMES)).alias("least"))
    rows = rows.select("doc_id", "least.*").where(~failed(F.col("n_words"), F.col("n_repeat_words")))
    fold = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("long")), F.lit(3))
    return rows.select("doc_id", (F.col("label") > 0).alias("good"), fold.alias("fold"), *NAMES)


def drawn(rows: DataFrame, n: dict[bool, int], wanted: dict[bool, int], trees: int = TREES, seed: int = SEED) -> DataFrame:
    """tree, rare, key, doc_id and the statistics: for each tree, of the n rows that are rare or not
    the wanted ones with the smallest hashes of tree and id, so any row may be in any tree. Only
    hashes low enough to be among these are ranked (8 deviations over the number that is wanted)."""
    low = {k: min(1.0, (wanted[k] + 8 * wanted[k] ** 0.5 + 16) / max(n[k], 1)) for k in n}
    below = F.when(F.col("rare"), F.lit(int(low[True] * (1 << 60)))).otherwise(F.lit(int(low[False] * (1 << 60))))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    each = each.withColumn("key", F.pmod(F.xxhash64(F.lit(seed), "tree", "doc_id"), F.lit(1 << 60))).where(F.col("key") < below)
    place = F.row_number().over(Window.partitionBy("tree", "rare").orderBy("key", "doc_id"))
    most = F.when(F.col("rare"), F.lit(wanted[True])).otherwise(F.lit(wanted[False]))
    return each.withColumn("place", place).where(F.col("place") <= most).select("tree", "rare", "key", "doc_id", *NAMES)


def grown(rows: DataFrame, sample: int, seed: int = SEED) -> list[tuple]:
    """The trees of drawn(), each grown from its own rows in a task."""

    def tree(key, x):
        x = x.sort_values(["rare", "key", "doc_id"], kind="stable")
        parts = IsolationForest.grow(rules(x), sample, np.random.default_rng([seed, int(key[0])]))
        return pd.DataFrame({"tree": [key[0]], **{c: [p] for c, p in zip(("feature", "threshold", "child", "path"), parts, strict=True)}})

    found = sorted(rows.groupBy("tree").applyInPandas(tree, TREE).collect())
    return [tuple(np.array(x) for x in r[1:]) for r in found]


def anomalies(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """rows and their score as anomaly."""

    def make():
        def f(batch):
            x = batch.to_pandas()
            anomaly = forest.score(rules(x)) if forest.trees else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly)], names=[*batch.schema.names, "anomaly"])

        return f

    return map_batches(rows, make, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", anomaly double", rows=20_000)


def fit(stats: DataFrame, labels: DataFrame) -> IsolationForest:
    """A forest over all labelled rows that the base rules pass, from their statistics. Trees are
    grown on two folds of three and see mostly rows labelled good, and a few others, as a
    forest expects of anomalies; each draws its own sample of these folds. The threshold is from
    the labels of all rows of the third fold, which no tree has seen: they are counted by
    steps of 1 / STEPS of their score, so no row of them is collected."""
    with Scratch(stats.sparkSession) as scratch:
        rows = scratch.keep(labelled(stats, labels), "labelled")
        n = {(r.unseen, r.good): r["n"] for r in rows.groupBy((F.col("fold") == 0).alias("unseen"), "good").agg(F.count("*").alias("n")).collect()}
        if not n:
            return IsolationForest([], 1.0, 2.0)
        seen = unseen = rows
        if len({k for k, _ in n}) == 2:  # else too few rows to keep some apart
            seen, unseen = rows.where("fold <> 0"), rows.where("fold = 0")
            own = {good: n.get((False, good), 0) for good in (True, False)}
        else:
            own = {good: sum(m for k, m in n.items() if k[1] == good) for good in (True, False)}
        rare = F.lit(False)
        if own[True] and own[False]:
            rare = ~F.col("good")
        else:
            own = {True: sum(own.values()), False: 0}
        wanted = dict(zip((False, True), IsolationForest.shares(own[True], own[False]), strict=True))
        sample = sum(wanted.values())
        trees = grown(drawn(seen.withColumn("rare", rare), {False: own[True], True: own[False]}, wanted), sample)
        forest = IsolationForest.of(trees, sample)
        step = F.floor(F.col("anomaly") * STEPS).alias("step")
        counts = anomalies(unseen, forest).groupBy(step).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("step")
        forest.calibrate(*(counts[c].to_numpy(np.int64) for c in ("step", "good", "bad")))
        return forest


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, anomaly, kept for every row of docs.

    kept is false if base_failed, else whether the forest finds no anomaly. Null
    and empty texts have no words, so they fail the base rules. Null ids, repeated
    rows and ties: each row is judged by its text alone. Without labelled rows
    nothing is an anomaly. No rows: no rows. Other columns of docs are ignored.
    Texts are read once: their statistics are written.
    """
    stats = materialize(with_statistics(docs.select("doc_id", "text")).drop("text"), "statistics")
    forest = fit(stats, labels)
    base = failed(F.col("n_words"), F.col("n_repeat_words"))
    out = anomalies(stats, forest).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < forest.threshold))
