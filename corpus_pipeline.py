"""A corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesift.lineage import mark, materialize, tidy
from cinesift.llm import decontamination, mixing, simhash, substring_dedup, toxicity
from cinesift.llm.common import read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5; columns of docs. Null and empty texts are scored like
    any other, repeated rows alike; rows without id are judged, not learned from."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, "_toxicity").where("_toxicity < 0.5").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id; columns of docs.
    Documents without id stay, and so do repeated rows of the id that stays. Rows of one
    id with different texts are judged each by its own."""
    rows = docs.withColumn("_simhash_text", F.xxhash64("text"))
    found = simhash.near_duplicates(rows, keep=("_simhash_text",))
    gone = found.where("doc_id <> component_id").select("doc_id", "_simhash_text").distinct()
    return rows.join(gone, ["doc_id", "_simhash_text"], "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; those of which
    nothing is left go. Null and empty texts, and texts without id, stay as they are, and
    so do repeated rows of one id. Columns of docs."""
    rows = substring_dedup.dedup(docs, prefix="_dedup_").where("_dedup_n_removed = 0 or _dedup_n_removed < _dedup_n_words")
    less, kept = F.col("_dedup_n_removed") > 0, F.col("_dedup_kept_text")
    new = {"text": F.when(less, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(less, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(new).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; columns of docs. Null and empty texts
    hold none; repeated rows are judged alike."""
    rows = decontamination.flag(docs, read(spark, sf_dir, "benchmark"), prefix="_benchmark_")
    return rows.where("not _benchmark_contaminated").select(*docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, how often (copies) and with how many words
    (taken), beside their size and their source's target. Null and empty texts have size 0;
    a null source is a source of its own; repeated rows each count."""
    return mixing.mix(docs).where("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", one_of_each_group),
    ("substring", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", to_weights),
]
#: Trees over learned features and SimHash fingerprints are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each but the last is written; tables of what is done go."""
    docs, begin = read(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        tidy(begin)
    return STAGES[-1][1](spark, docs, sf_dir)
