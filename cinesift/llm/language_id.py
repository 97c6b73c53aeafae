"""The language of a text: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches

#: Lengths of the n-grams, and buckets that they are hashed to.
LENGTHS, BUCKETS = (1, 2, 3, 4), 1 << 15
#: Cells of the matrix that is broadcast (8 bytes each). Above BUCKETS languages' worth of
#: them, n-grams share fewer buckets.
CELLS = 1 << 22
#: Added to each count, and n-grams that are scored at once.
SMOOTHING, BLOCK = 0.5, 1 << 18
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """The lower-cased letters of a text as code points, each run of anything else as one
    space; a space at either end. Empty if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[code]
    if not is_letter.any():
        return np.zeros(0, np.uint32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of each run of others the first, but for one at the beginning
    space = np.full(1, 32, np.uint32)
    return np.concatenate([space, np.where(is_letter, code, space)[keep], space[: int(is_letter[-1])]])


def buckets(code: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of each n-gram of a run of code points, one length after the other.
    n_buckets: a power of two."""
    out, h = [], np.zeros(len(code), np.uint32)
    for n, mix in zip(LENGTHS, _MIX, strict=True):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * mix
        h ^= h >> np.uint32(15)
        out.append(h & np.uint32(n_buckets - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """languages; weight: log probability of each bucket (rows) in each language
    (columns); prior: log share of each language's documents."""

    languages: list[str]
    weight: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability; und and 0 where there's no letter
        or nothing was learned. Texts are scored together, in blocks of their n-grams."""
        total, size = np.tile(self.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
        found, score = ["und"] * len(texts), np.zeros(len(texts))
        rows: list[int] = []
        held: list[np.ndarray] = []
        for i, text in enumerate(texts):
            grams = buckets(letters(text or ""), len(self.weight)) if self.languages else np.zeros(0, np.uint32)
            size[i] = len(grams)
            if len(grams) > BLOCK:  # a long text by itself, piece by piece
                for a in range(0, len(grams), BLOCK):
                    total[i] += self.weight[grams[a : a + BLOCK]].sum(axis=0)
            elif len(grams):
                rows.append(i)
                held.append(grams)
            if rows and (i + 1 == len(texts) or int(size[rows].sum()) > BLOCK):
                starts = np.cumsum(size[rows]) - size[rows]
                total[rows] += np.add.reduceat(self.weight[np.concatenate(held)], starts, axis=0)
                rows, held = [], []
        for i in np.flatnonzero(size):
            best = int(np.argmax(total[i]))
            found[i], score[i] = self.languages[best], 1 / np.exp(total[i] - total[i, best]).sum()
        return found, score


def counted(rows: DataFrame, n_buckets: int) -> DataFrame:
    """lang, bucket, n: how often each bucket is found in the texts of a language (lang,
    text). Tasks add up before anything is shuffled, so what is shuffled grows with
    tasks and not with texts."""

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def rows_of():
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in held:
                    if len(held) * n_buckets >= CELLS:
                        yield from rows_of()
                        held.clear()
                    held[lang] = np.zeros(n_buckets, np.int64)
                held[lang] += np.bincount(buckets(letters(text), n_buckets), minlength=n_buckets)
        yield from rows_of()

    return rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, n_buckets: int = BUCKETS) -> Model:
    """From text and non-null lang of all rows that are not held out; null texts count for
    the languages' shares only. What comes to the driver is one count for each language
    and bucket, CELLS at most."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    shares = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(shares)
    while n_buckets > 1 and n_buckets * len(languages) > CELLS:
        n_buckets //= 2
    n = np.zeros((n_buckets, len(languages)))
    if languages:
        rows = counted(known.where("text is not null"), n_buckets).toPandas()
        column = {x: i for i, x in enumerate(languages)}
        n[rows["bucket"].to_numpy(), rows["lang"].map(column).to_numpy(np.int64)] = rows["n"].to_numpy()
    n += SMOOTHING
    prior = np.log(np.array([shares[x] for x in languages], float) / max(sum(shares.values()), 1))
    return Model(languages, np.log(n / n.sum(axis=0)), prior)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs.

    score is the probability that the model gives to lang_pred. The matrix of log
    probabilities is broadcast; its size is bounded (CELLS). Null ids are not held out.
    Texts that are null or without a letter, and all if nothing can be learned, are und
    with score 0. Of equally likely languages the first by code point is given. Repeated
    rows each give a row and each count in learning. Very long texts are scored block by
    block. No rows: no rows. Other columns of docs are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def make():
        known = shared.value

        def f(batch):
            found, score = known.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

        return f

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), make, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
