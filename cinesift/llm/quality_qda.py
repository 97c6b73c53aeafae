"""Quality classifier: regularised quadratic discriminant analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chosen_labels, code_points, held_out, known_rows, with_arrays
from .quality_rules import repeated_words

FEATURES = [
    "log_words", "log_mean_word", "symbols", "bars", "bangs", "upper", "caps_words", "digits", "marks", "repeats", "dup_lines", "distinct", "log_line", "first_caps", "common", "accents", "ended", "punct_words", "spread", "short_words",
]
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def describe(text: bytes) -> list[float]:
    """FEATURES of one text, each transformed to be near normal: logs of counts,
    arcsine roots of shares."""
    words = text.split()
    n, chars = max(len(words), 1), max(code_points(text, SPACE), 1)
    held: dict[bytes, int] = {}
    ids = [held.setdefault(w, len(held)) for w in words]
    uses = np.bincount(ids, minlength=1) if ids else np.zeros(1, int)
    repeats = repeated_words(np.array(ids, np.int64)) if len(held) < len(ids) else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda c: len(text) - len(text.translate(None, c))
    caps = sum(uses[i] for w, i in held.items() if len(w) > 1 and w.isupper())
    first = sum(uses[i] for w, i in held.items() if w[:1].isupper())
    ended = sum(1 for x in lines if x.rstrip()[-1:] in b".!?")
    marked = sum(uses[i] for w, i in held.items() if w[-1:] in b"#*$%&|<>!")
    short = sum(uses[i] for w, i in held.items() if len(w) < 4)
    per_line = [len(x) for x in lines] or [0]
    shares = [
        count(b"#*$%&<>") / chars, count(b"|") / chars, count(b"!") / chars, count(_LETTERS) / chars, caps / n, count(b"0123456789") / chars, count(b".,;:?") / n, repeats / n, (len(lines) - len(set(lines))) / max(len(lines), 1),
        len(held) / n, first / n, uses.max(initial=0) / n, (len(text) - code_points(text)) / chars, ended / max(len(lines), 1), marked / n, short / n,
    ]
    root = [float(np.arcsin(np.sqrt(min(max(x, 0.0), 1.0)))) for x in shares]
    symbols, bars, bangs, upper, caps_words, digits, marks, reps, dups, distinct, firsts, common, accents, end, punct, shorts = root
    return [
        float(np.log1p(len(words))), float(np.log1p(chars / n)), symbols, bars, bangs, upper, caps_words, digits, marks, reps, dups, distinct, float(np.log1p(np.mean(per_line))), firsts, common, accents, end, punct, float(np.log1p(np.std(per_line))), shorts,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """docs and the column x (array of FEATURES); null texts are empty."""
    return with_arrays(docs, lambda: lambda texts: [pa.array([describe(t) for t in texts], pa.list_(pa.float64()))], "x array<double>")


@dataclass
class Discriminant:
    """Two normal classes, each with a mean and a covariance shrunk towards the
    pooled one and towards its diagonal. The Cholesky factors are kept, so that the
    distance of a row from a class is one forward substitution."""

    centre: np.ndarray
    spread: np.ndarray
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    log_dets: list[float] = field(default_factory=list)
    log_prior: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, to_pooled: float = 0.3, to_diagonal: float = 0.1, floor: float = 0.02) -> Discriminant:
        width = x.shape[1] if x.ndim == 2 else len(FEATURES)
        if len(x) == 0 or y.all() or not y.any():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls(np.zeros(width), np.ones(width), log_prior=float(np.log(p / (1 - p))))
        centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - centre) / spread
        parts = [z[y == k] for k in (0, 1)]
        cov = [np.cov(p, rowvar=False, bias=True) if len(p) > 1 else np.eye(width) for p in parts]
        pooled = sum(len(p) * c for p, c in zip(parts, cov, strict=True)) / len(z)
        out = cls(centre, spread, log_prior=float(np.log(len(parts[1]) / len(parts[0]))))
        for p, c in zip(parts, cov, strict=True):
            c = (1 - to_pooled) * c + to_pooled * pooled
            c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + floor * np.eye(width)
            factor = np.linalg.cholesky(c)
            out.means.append(p.mean(0))
            out.factors.append(factor)
            out.log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
        return out

    @classmethod
    def calibrated(cls, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Discriminant:
        """Fitted on all rows; the scale is from margins of rows that the model of the other
        folds gives. Without rows of both classes outside of a fold, its own margins serve."""
        out, margin = cls.fit(x, y), np.zeros(len(y))
        if not out.means:
            return out
        for k in np.unique(fold):
            here = fold == k
            model = cls.fit(x[~here], y[~here]) if 0 < y[~here].sum() < (~here).sum() else out
            margin[here] = model.margin(x[here])
        out.scale(margin, y)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        """log p(x, 1) - log p(x, 0)."""
        if not self.means:
            return np.full(len(x), self.log_prior)
        z = (x - self.centre) / self.spread
        far = [forward(factor, (z - m).T) for m, factor in zip(self.means, self.factors, strict=True)]
        d = [0.5 * (np.einsum("ji,ji->i", f, f) + log) for f, log in zip(far, self.log_dets, strict=True)]
        return d[0] - d[1] + self.log_prior

    def scale(self, margin: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
        """slope and shift of a logistic curve over the margin, by Newton's method:
        quadratic margins are far from log odds when classes aren't normal."""
        m = np.clip(margin, -60, 60)
        a = np.column_stack([m, np.ones(len(m))])
        w = np.array([0.1, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
            w = w + np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = float(max(w[0], 1e-6)), float(w[1])

    def score(self, x: np.ndarray) -> np.ndarray:
        m = np.clip(self.margin(x), -60, 60)
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -40, 40)))


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x of factor @ x = b, factor being lower triangular."""
    x = np.empty_like(b)
    for i in range(len(b)):
        x[i] = (b[i] - factor[i, :i] @ x[:i]) / factor[i, i]
    return x


def stack(column, width: int = len(FEATURES)) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, width))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 30_000) -> Discriminant:
    """From at most about `bound` labelled rows, chosen by a hash of their id; where an id
    is repeated, from one of its rows."""
    chosen = chosen_labels(labels, "quality", bound, 3)
    known = known_rows(with_features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")), "x")
    return Discriminant.calibrated(stack(known["x"]), (known["label"].to_numpy(float) > 0).astype(int), known["fold"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = 30_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts have all counts 0 and are scored like any other. Null ids:
    scored, not held out, and never learned from. Repeated rows and ties get equal
    scores. Without labels of both kinds every score is the smoothed share of 1s.
    No rows: no rows. Other columns of docs are ignored.
    """
    model = fit(docs, labels, bound)
    make = lambda: lambda texts: [pa.array(model.score(np.array([describe(t) for t in texts]).reshape(len(texts), -1)))]
    out = with_arrays(docs.select("doc_id", "text"), make, "score double", rows=1024)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
