"""Token counts with a digest cache."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import materialize, shared_dir, written
from .common import map_batches

CACHE = "version string, digest string, n_tokens long"


#: How byte-level vocabularies split texts before they merge bytes (fixed value: the pattern of their libraries).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters alone are split alike by every version of Unicode: ASCII
#: without rare control characters, Latin letters, dashes and quotation marks.
_SURE = re.compile("[\t-\r -~\u00a1-\u024f\u2010-\u2027]*")


class Pieces(dict):
    """piece of a text -> its number of tokens, as the library counts them."""

    #: Pieces that are held, and characters of the longest.
    MOST, LONGEST = 200_000, 64

    def __init__(self, library):
        super().__init__()
        self.library = library

    def __missing__(self, piece: str) -> int:
        n = len(self.library.encode_batch_fast([piece], add_special_tokens=False)[0])
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts tokens as the library of a vocabulary file does: tokenizers for
    .json, sentencepiece for .model; without begin, end or added tokens.

    A byte-level vocabulary merges bytes only within the pieces that its pattern splits
    a text into, so a text has the tokens of its pieces: each distinct piece is encoded
    by the library once. Texts whose split isn't certain (characters beyond _SURE, or an
    added token in them) and other vocabularies go to the library whole.
    """

    #: Bytes of text that are encoded at once, one text at least: what the library
    #: returns for a text takes many times its bytes.
    AT_ONCE = 1 << 18

    def __init__(self, vocabulary: str):
        # Spark runs a worker for each core; threads in each would only hold more memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind, self.pieces, self.added = vocabulary.rsplit(".", 1)[-1], None, []
        if self.kind == "json":
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(vocabulary)
            self.library.no_truncation()
            self.library.no_padding()
            with open(vocabulary, encoding="utf-8") as f:
                self.split(json.load(f))
        elif self.kind == "model":
            from sentencepiece import SentencePieceProcessor

            self.library = SentencePieceProcessor(model_file=vocabulary)
        else:
            raise ValueError(f"no library for a .{self.kind} vocabulary")

    def split(self, made: dict) -> None:
        """Counts by pieces if the vocabulary is a plain byte-level one."""
        before, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        if plain and made.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout"):
            import regex

            self.pieces, self.find = Pieces(self.library), regex.compile(BYTE_LEVEL).findall
            self.added = [t["content"] for t in made.get("added_tokens") or []]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int | None] = [None] * len(texts)
        if self.pieces is not None:
            for i, t in enumerate(texts):
                if _SURE.fullmatch(t) and not any(x in t for x in self.added):
                    out[i] = sum(map(self.pieces.__getitem__, self.find(t)))
        rest = [i for i, n in enumerate(out) if n is None]
        at = 0
        while at < len(rest):
            size, end = len(texts[rest[at]].encode()), at + 1
            while end < len(rest) and size + len(b := texts[rest[end]].encode()) <= self.AT_ONCE:
                size, end = size + len(b), end + 1
            for i, n in zip(rest[at:end], self._count([texts[i] for i in rest[at:end]]), strict=True):
                out[i] = n
            at = end
        return out

    def _count(self, texts: list[str]) -> list[int]:
        if self.kind == "json":
            return [len(x) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(x) for x in self.library.encode(texts, num_threads=1)]


def version(vocabulary: str) -> str:
    """Digest of the vocabulary file; counts of another one are never reused."""
    with open(vocabulary, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE).parquet(cache)
    return spark.createDataFrame([], CACHE)


def count_tokens(docs: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    Content is normalised (null becomes the empty text; nothing else may change, or
    counts would) and digested with SHA-256. Digests that the cache holds for this
    vocabulary are not encoded again; the distinct others are, each once, and are
    appended. cache: a folder, by default a new one in the shared folder, which goes
    with the session's other tables.

    Of the rows with one text only that with the smallest id is encoded. Ids are chosen
    from digests alone, and texts are dealt by digest and id, so copies of a text don't
    meet in one task. Repeated texts share one encoding. Null ids and repeated rows each
    give a row; copies of a text of which all ids are null, or equal, are one task's.
    No rows: no rows. Other columns of docs are ignored. A task that is run again
    appends nothing twice: files of a failed attempt are never committed.
    """
    spark = docs.sparkSession
    if cache is None:
        cache = written(spark, f"{shared_dir(spark)}/cinesift-tokens-{uuid.uuid4().hex}")
    known = version(vocabulary)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    rows = rows.withColumn("by", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    held = read_cache(spark, cache).where(F.col("version") == known).select("digest").distinct()
    chosen = rows.groupBy("digest").agg(F.min("by").alias("by")).join(held, "digest", "left_anti")
    misses = rows.select("digest", "by", "text").join(chosen, ["digest", "by"]).dropDuplicates(["digest", "by"]).select("digest", "text")

    def make():
        counter = Counter(vocabulary)

        def f(batch):
            counts = counter.count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([known] * batch.num_rows, pa.string()), batch.column(0), pa.array(counts, pa.int64())], names=["version", "digest", "n_tokens"])

        return f

    map_batches(misses, make, CACHE, rows=128).write.mode("append").parquet(cache)
    # Written, so that the join has a plain exchange on either side and Spark splits a hot digest's rows.
    counts = materialize(spark.read.schema(CACHE).parquet(cache).where(F.col("version") == known).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    narrow = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return narrow.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
