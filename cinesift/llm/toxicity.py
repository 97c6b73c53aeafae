"""Toxicity: gradient-boosted trees over dense features, isotonically calibrated."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import Scratch
from .common import SPACE, chosen_labels, code_points, held_out, known_rows, map_batches, utf8, with_arrays

#: Insults to begin with; stems of others are learned from labelled rows.
INSULTS = frozenset(b"idiot moron clown worthless loser pathetic scum trash disgusting stupid dumb fool jerk ugly hate imbecile cretin vermin filth garbage freak creep coward liar".split())
SECOND_PERSON = frozenset(b"you your yours yourself u ur tu te toi vous votre du dich dir dein deine sie ihr usted tus ti".split())
_PLAIN = bytes.maketrans(b"0134578@$!|+", b"oieastbasilt")
_EDGE = b".,;:!?\"'()[]{}<>*#%&$|-_~`/\\"
_INSIDE = bytes(_EDGE) + b"@+"
NEAR = 3
STEMS = range(3, 9)
FEATURES = [
    "log_words", "insults", "insult_share", "stems", "stem_share", "stem_best", "stem_kinds", "near_second_person", "second_person", "hidden", "hidden_insults", "upper", "caps_words", "bangs", "marks", "symbols", "digits", "mean_word",
]


def plain(word: bytes) -> tuple[bytes, bool]:
    """A word in lower case without marks at its ends, its look-alike characters
    replaced by letters and marks inside removed; and whether any was inside."""
    core = word.strip(_EDGE).lower()
    clear = core.translate(_PLAIN, _INSIDE.replace(b"!", b"").replace(b"$", b"").replace(b"|", b"").replace(b"@", b"").replace(b"+", b""))
    has_letters = any(97 <= c <= 122 or c >= 128 for c in core)
    return (clear, clear != core) if has_letters else (core, False)


def stems_of(word: bytes) -> set[bytes]:
    """Prefixes that end between characters."""
    return {word[:k] for k in STEMS if len(word) >= k and (len(word) == k or word[k] & 0xC0 != 0x80)}


class Reader:
    """FEATURES of texts, given learned stems and their weights; of several sets of
    stems at once, as most of the work doesn't depend on them."""

    def __init__(self, *stems: dict[bytes, float]):
        self.stems, self.any, self.known = stems, set().union(*stems), {}

    def word(self, w: bytes) -> tuple[int, int, int, tuple[tuple[float, bytes], ...]]:
        if len(self.known) > 100_000:
            self.known.clear()
        clear, hidden = plain(w)
        insult = int(clear in INSULTS or (clear.endswith(b"s") and clear[:-1] in INSULTS))
        found = sorted(stems_of(clear) & self.any)
        best = tuple(max(((s_[x], x) for x in found if x in s_), default=(0.0, b"")) for s_ in self.stems)
        out = self.known[w] = (insult, int(hidden), int(clear in SECOND_PERSON), best)
        return out

    def describe(self, text: bytes) -> list[float]:
        return self.describe_all(text)[0]

    def describe_all(self, text: bytes) -> list[list[float]]:
        """FEATURES for each set of stems."""
        words = text.split()
        n, chars = max(len(words), 1), max(code_points(text, SPACE), 1)
        get, uses = self.known.get, Counter(words)
        insults = hidden = second = 0
        people, marked = set(), []
        for w, k in uses.items():
            insult, obscured, person, best = get(w) or self.word(w)
            insults += k * insult
            hidden += k * obscured
            second += k * person
            if person:
                people.add(w)
            if insult or any(weight for weight, _ in best):
                marked.append((w, k, insult, obscured, best))
        at, places = [], []
        if marked and people:
            wanted = {w for w, *_ in marked}
            at = [i for i, w in enumerate(words) if w in people]
            places = [(i, w) for i, w in enumerate(words) if w in wanted]
            close = [bool(any(abs(at[x] - i) <= NEAR for x in (j - 1, j) if 0 <= x < len(at))) for i, _ in places for j in [int(np.searchsorted(at, i))]]
        count = lambda c: len(text) - len(text.translate(None, c))
        caps = sum(k for w, k in uses.items() if len(w) > 1 and w.isupper())
        ends = [
            hidden / n, count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, caps / n, count(b"!") / n, count(b".,;:?") / n, count(b"#*$%&|<>") / chars, count(b"0123456789") / chars, chars / n,
        ]
        out = []
        for v in range(len(self.stems)):
            stem_hits, hidden_insults, best, kinds, hits = 0, 0, 0.0, set(), set()
            for w, k, insult, obscured, found in marked:
                weight, stem = found[v]
                if insult or weight:
                    hits.add(w)
                    stem_hits += k * (weight > 0)
                    hidden_insults += k * obscured
                    best = max(best, weight)
                    kinds.add(stem or w)
            near = sum(c for (_, w), c in zip(places, close, strict=True) if w in hits) if places else 0
            out.append([np.log1p(len(words)), np.log1p(insults), insults / n, np.log1p(stem_hits), stem_hits / n, best, len(kinds), np.log1p(near), second / n, ends[0], np.log1p(hidden_insults), *ends[1:]])
        return out


def learn_stems(docs: DataFrame, chosen: DataFrame, folds: int = 1, evidence: float = 20.0, most: int = 500) -> list[dict[bytes, float]]:
    """Word prefixes that mark label 1, with the log of how much likelier they make it:
    those of all rows, and of the rows outside of each fold.

    chosen: a bounded number of rows doc_id, label, fold, so it is broadcast. Counts are
    of documents, summed in each task first. A prefix must be found with label 1 far
    more often than chance allows: its documents times the divergence of their share
    of 1s from that of all must exceed `evidence`, which, of millions of prefixes that
    mean nothing, about none does. Of those, the `most` with the greatest weight stay.
    """
    cells = [f"c{label}_{k}" for label in (0, 1) for k in range(folds)]

    def make():
        memo: dict[bytes, frozenset] = {}

        def prefixes(w):
            if len(memo) > 20_000:
                memo.clear()
            out = memo[w] = frozenset(stems_of(plain(w)[0]))
            return out

        def f(batch):
            seen_in = [Counter() for _ in cells]
            for text, label, fold in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen_in[(label > 0) * folds + fold].update(set().union(*(memo.get(w) or prefixes(w) for w in set(text.split()))))
            every = list(set().union(*seen_in))
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), *(pa.array([c[s] for s in every], pa.int64()) for c in seen_in)], names=["stem", *cells])

        return f

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "fold")
    size = {(int(r["label"] > 0), r["fold"]): r["n"] for r in chosen.groupBy((F.col("label") > 0).alias("label"), "fold").agg(F.count("*").alias("n")).collect()}
    kinds = "stem binary, " + ", ".join(f"{c} long" for c in cells)
    counts = map_batches(rows, make, kinds, rows=1_000).groupBy("stem").agg(*[F.sum(c).alias(c) for c in cells])

    def judged(without: int | None):
        """Evidence and weight of a prefix, from the rows of all folds but one."""
        use = [k for k in range(folds) if k != without]
        n0, n1 = (sum(size.get((label, k), 0) for k in use) for label in (0, 1))
        zeros, ones = (sum((F.col(f"c{label}_{k}") for k in use), F.lit(0)) for label in (0, 1))
        if not n0 or not n1:
            return F.lit(False), F.lit(0.0)
        weight = F.log(((ones + 0.5) / (n1 + 1)) / ((zeros + 0.5) / (n0 + 1)))
        p, n = n1 / (n1 + n0), ones + zeros
        part = lambda c, q: F.when(c > 0, c * F.log(c / n / q)).otherwise(0.0)
        return (part(ones, p) + part(zeros, 1 - p) > evidence) & (weight > 2.0) & (zeros * 20 <= ones), weight

    variants = [judged(k) for k in [None, *range(folds)]] if folds > 1 else [judged(None)]
    good = variants[0][0]
    for on, _ in variants[1:]:
        good = good | on
    with Scratch(docs.sparkSession) as scratch:
        counts = scratch.keep(counts.where(good), "stems")
        tops = [counts.where(on).select("stem", weight.alias("weight")).orderBy(F.desc("weight"), F.length("stem"), "stem").limit(most).collect() for on, weight in variants]
    return [{bytes(r["stem"]): float(r["weight"]) for r in top} for top in tops]


@dataclass
class Boosted:
    """Boosted regression trees for the log odds, split at quantile bins."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  # by node in level order: feature, bin, value
    start: float = 0.0
    rate: float = 0.15
    depth: int = 3

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, ridge: float = 1.0) -> Boosted:
        out = cls(rate=rate, depth=depth)
        p = (y.sum() + 1) / (len(y) + 2)
        out.start = float(np.log(p / (1 - p)))
        out.edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1]), [0.0]])) if len(c) else np.zeros(1) for c in x.T]
        if len(y) == 0 or y.all() or not y.any():
            return out
        b, width = out.bins(x), bins + 2
        flat = b + np.arange(b.shape[1]) * width
        margin = np.full(len(y), out.start)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-margin))
            g, h = y - q, q * (1 - q)
            tree, at = [], np.zeros(len(y), int)
            for level in range(depth + 1):
                first, n = 2**level - 1, 2**level
                for node in range(first, first + n):
                    rows = np.flatnonzero(at == node)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    value, split = gs / (hs + ridge), (-1, 0)
                    if level < depth and len(rows) > 1:
                        cells = flat[rows].ravel()
                        size = b.shape[1] * width
                        gl = np.bincount(cells, np.repeat(g[rows], b.shape[1]), size).reshape(-1, width).cumsum(1)
                        hl = np.bincount(cells, np.repeat(h[rows], b.shape[1]), size).reshape(-1, width).cumsum(1)
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(hl < least / 4) | (hs - hl < least / 4)] = 0
                        best = int(gain.argmax())
                        if gain.flat[best] > 1e-6:
                            split = divmod(best, width)
                            at[rows] = 2 * node + 1 + (b[rows, split[0]] > split[1])
                    tree.append((split[0], split[1], float(value)))
            out.trees.append(tree)
            margin += rate * out.one(tree, b)
        return out

    def one(self, tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        at, rows = np.zeros(len(b), int), np.arange(len(b))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (b[rows, np.maximum(f, 0)] > cut[at]))
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.start + self.rate * sum((self.one(t, b) for t in self.trees), np.zeros(len(b)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing curve nearest to y over margin (adjacent violators
    pooled), one at each end of a block; between them it is linear."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first and last margin
    for m, v in zip(margin[order], y[order].astype(float), strict=True):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v2, w2, _, last = blocks.pop()
            v1, w1, first, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, first, last])
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    # Each block is pulled a little to the middle: small pure blocks aren't certain.
    ys = np.array([v for b in blocks for v in [(b[0] * b[1] + 0.5) / (b[1] + 1)] * 2])
    return xs, np.maximum.accumulate(ys)


@dataclass
class Model:
    stems: dict[bytes, float]
    trees: Boosted
    xs: np.ndarray
    ys: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated probability, with a hundredth of the uncalibrated one so
        that rows of one block keep their order."""
        m = self.trees.margin(x)
        raw = 1 / (1 + np.exp(-np.clip(m, -40, 40)))
        curve = np.interp(m, self.xs, self.ys) if len(self.xs) else raw
        return np.clip(0.99 * curve + 0.01 * raw, 0.0, 1.0)


def stack(column, width: int = len(FEATURES)) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def train(xs: list[np.ndarray], y: np.ndarray, fold: np.ndarray, stems: dict[bytes, float], least: int = 3) -> Model:
    """xs: features with the stems of all rows, and with those that each fold didn't give.
    Trees on all rows; the curve from margins of rows that neither the trees nor the
    stems of their fold's model have seen."""
    trees = Boosted.fit(xs[0], y)
    margin, seen = np.zeros(len(y)), np.zeros(len(y), bool)
    for k, x in enumerate(xs[1:]):
        here = fold == k
        if here.any() and y[here].sum() >= least and y[~here].sum() >= least:
            margin[here], seen[here] = Boosted.fit(x[~here], y[~here]).margin(x[here]), True
    return Model(stems, trees, *(isotonic(margin[seen], y[seen]) if seen.any() else (np.zeros(0), np.zeros(0))))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000, folds: int = 5) -> Model:
    """Stems, trees and curve from at most about `bound` labelled rows, chosen by a
    hash of their id; where an id is repeated, from one of its rows."""
    chosen = chosen_labels(labels, "toxic", bound, folds)
    stems = learn_stems(docs, chosen, folds)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    names = [f"x{k}" for k in range(len(stems))]

    def make():
        reader = Reader(*stems)

        def f(texts):
            found = [reader.describe_all(t) for t in texts]
            return [pa.array([x[v] for x in found], pa.list_(pa.float64())) for v in range(len(stems))]

        return f

    known = known_rows(with_arrays(rows, make, ", ".join(f"{n} array<double>" for n in names)), *names)
    return train([stack(known[n]) for n in names], (known["label"].to_numpy(float) > 0).astype(int), known["fold"].to_numpy(), stems[0])


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs and a column of scores."""

    def make():
        reader = Reader(model.stems)
        return lambda texts: [pa.array(model.score(np.array([reader.describe(t) for t in texts]).reshape(len(texts), -1)))]

    return with_arrays(docs, make, f"{name} double", rows=1024)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts have all features 0 and are scored like any other. Null
    ids: scored, not held out, and never learned from. Repeated rows and ties get
    equal scores. Without labels of both kinds every score is the smoothed share of
    1s. No rows: no rows. Other columns of docs are ignored.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, bound))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
