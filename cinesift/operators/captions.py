"""Caption quality and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AUDIT_SIMILARITY, TOKEN_LIMIT
from ..functions import text as T


def score(captions: DataFrame, text: str = "text", config: T.ScoringConfig = T.ScoringConfig()) -> DataFrame:
    """captions with length, temporal, specificity, repetition and overall scores and
    the array of issues. Null captions are empty ones. The words are split once, and so are
    the stripped length and the lower-cased text made."""
    caption = F.coalesce(F.col(text), F.lit(""))
    rows = counted(captions.withColumns({"tokens": T.words(caption), "_low": F.lower(caption), "_n": T.stripped_length(caption)}))
    rows = rows.withColumns({
        "length_score": T.length_score(F.col("_n"), config), "temporal_score": T.temporal_score(F.col("tokens")),
        "specificity_score": T.specificity_score(F.col("_low"), config), "repetition_score": T.repetition_score(F.size("tokens"), F.col("repeated")),
    })
    parts = [F.col(f"{c}_score") for c in ("length", "temporal", "specificity", "repetition")]
    return rows.withColumn("overall", T.overall_score(*parts, config)).withColumn("issues", issues(F.col("_n"), F.col("_low"), config)).drop("tokens", "repeated", "_low", "_n")


def counted(captions: DataFrame) -> DataFrame:
    """captions (tokens) with repeated, made once in a step of its own."""
    return captions.withColumn("repeated", T.repeated_trigrams(F.col("tokens")))


def issues(n: Column, low: Column, c: T.ScoringConfig = T.ScoringConfig()) -> Column:
    """What is wrong with a scored caption (n: its stripped length; low: itself lower-cased),
    in the order of the scores."""
    length = (
        F.when(n == 0, "empty caption").when(n < c.shortest, F.format_string(f"very short: %d characters, {c.shortest} at least", n)).when(n < c.short, F.format_string(f"short: %d characters, better {c.short} or more", n))
        .when(n <= c.long, F.lit(None)).when(n <= c.longest, F.format_string(f"long: %d characters, better {c.long} or fewer", n)).otherwise(F.format_string(f"very long: %d characters, {c.longest} at most", n))
    )
    temporal = F.when(F.col("temporal_score") == 0, "no words of motion or change")
    vague = T.vague_found(low)
    vague = F.when(F.size(vague) > 0, F.concat(F.lit("vague: "), F.array_join(F.slice(vague, 1, 3), ", ")))
    repeats = F.when(F.col("repetition_score") == 0.2, "heavy repetition").when(F.col("repetition_score") == 0.5, "some repetition")
    return F.filter(F.array(length, temporal, vague, repeats), lambda x: x.isNotNull())


def each_issue(scored: DataFrame, *keys: str) -> DataFrame:
    """keys and a row for each issue. explode() would add a filter on the array's size, which is
    pushed below the scores and evaluates them all once more; explode_outer() doesn't."""
    return scored.select(*keys, F.explode_outer("issues").alias("issue")).where("issue is not null")


def worst_first(scored: DataFrame, *ties: str, limit: int | None = None) -> DataFrame:
    rows = scored.orderBy("overall", *ties)
    return rows if limit is None else rows.limit(limit)


def summary(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("n"), F.avg("overall").alias("average"), F.min("overall").alias("lowest"), F.max("overall").alias("highest"))


def token_overflow(captions: DataFrame, text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    n = T.token_estimate(T.words(F.coalesce(F.col(text), F.lit(""))))
    return captions.withColumn("n_tokens", n).withColumn("too_long", F.col("n_tokens") > limit)


def audit(pairs: DataFrame, existing: str, fresh: str, least: float = AUDIT_SIMILARITY) -> DataFrame:
    """pairs with the similarity of two captions and keep or review."""
    words = lambda c: F.array_distinct(T.words(F.coalesce(F.col(c), F.lit(""))))
    rows = pairs.withColumns({"_a": words(existing), "_b": words(fresh)}).withColumn("_both", F.array_intersect("_a", "_b"))
    rows = rows.withColumn("similarity", T.jaccard(F.col("_a"), F.col("_b"), F.col("_both"))).drop("_a", "_b", "_both")
    return rows.withColumn("recommendation", F.when(F.col("similarity") > least, "keep").otherwise("review"))
