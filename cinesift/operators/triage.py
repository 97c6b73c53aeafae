"""Clips and scenes against reference concepts and overlay prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CONCEPT_SIMILARITY, LONG_VIDEO_SECONDS, OVERLAY_SIMILARITY
from . import products

#: Concepts are tens of rows; beyond this many bytes Spark deals out both sides.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint, if the plan's own size estimate allows it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def similarities(frames: DataFrame, references: DataFrame) -> DataFrame:
    """Every frame (..., embedding) with every reference (concept, ref_order, ref_embedding)
    and their similarity: all of these rows. best_matches() makes none of them."""
    return products.each(frames, references, "embedding", "ref_embedding", "similarity")


def best_frames(scored: DataFrame, *by: str) -> DataFrame:
    """For each of `by` and concept of similarities() the best similarity (0 at least) and its
    frame; the first of equals."""
    best = F.max(F.struct(F.col("similarity"), (-F.col("frame_idx")).alias("at")))
    rows = scored.groupBy(*by, "concept", "ref_order").agg(best.alias("best"))
    similarity, at = products.kept(F.col("best.similarity"), -F.col("best.at"))
    return rows.select(*by, "concept", "ref_order", similarity.alias("similarity"), at.alias("best_frame"))


def matches(best: DataFrame, *by: str, least: float = CONCEPT_SIMILARITY) -> DataFrame:
    """Matches in order: rank 1 is the most similar; of equals the earlier reference."""
    w = Window.partitionBy(*by).orderBy(F.desc("similarity"), "ref_order")
    return best.where(F.col("similarity") >= least).withColumn("rank", F.row_number().over(w).cast("long"))


def best_matches(frames: DataFrame, references: DataFrame, *by: str, least: float = CONCEPT_SIMILARITY) -> DataFrame:
    """matches() of best_frames() of similarities(), from products of matrices: each batch of
    frames keeps the best frame of a clip and reference, if it's similar enough, so frames x
    references are never rows. References are read in blocks of a checked size."""
    # A best similarity is 0 at least, so a threshold of 0 or less lets all pass.
    found = products.best(frames, references, by, "embedding", "ref_embedding", "frame_idx", least if least > 0 else None)
    similarity, at = products.kept(F.col("similarity"), F.col("at"))
    return matches(found.select(*by, "concept", "ref_order", similarity.alias("similarity"), at.alias("best_frame")), *by, least=least)


def overlay_scores(frames: DataFrame, prompts: DataFrame, *by: str, least: float = OVERLAY_SIMILARITY) -> DataFrame:
    """The best similarity of any frame to any prompt (prompt, prompt_embedding), 0 at least."""
    rows = products.largest(frames, prompts, by, "embedding", "prompt_embedding", "overlay_score")
    return rows.withColumn("has_overlay", F.col("overlay_score") >= least)


def triage(items: DataFrame, matched: DataFrame, overlays: DataFrame, *by: str) -> DataFrame:
    """items with the matches as an array, best first, has_overlay, is_matched, include
    and the folder to route to."""
    row = F.struct("rank", "concept", "similarity", "best_frame")
    found = matched.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("matches"))
    rows = items.join(found, list(by), "left").join(overlays, list(by), "left")
    rows = rows.withColumns({"has_overlay": F.coalesce("has_overlay", F.lit(False)), "matches": F.coalesce("matches", F.expr("cast(array() as array<struct<rank:bigint,concept:string,similarity:double,best_frame:bigint>>)"))})
    rows = rows.withColumn("is_matched", F.size("matches") > 0).withColumn("include", F.col("is_matched") & ~F.col("has_overlay"))
    return rows.withColumn("folder", folder(F.col("has_overlay"), F.col("is_matched"), F.get("matches", F.lit(0))["concept"]))


def folder(overlay: Column, matched: Column, concept: Column) -> Column:
    return F.when(overlay, "text_overlay").when(matched, concept).otherwise("unmatched")


def report(triaged: DataFrame) -> DataFrame:
    """Totals; clips with overlay text that match count as matched as well. Scenes (with a
    column video) also give the number of their videos, and of those with an included scene."""
    more = [F.count_distinct("video").alias("videos"), F.count_distinct(F.when(F.col("include"), F.col("video"))).alias("videos_included")] if "video" in triaged.columns else []
    return triaged.agg(F.count("*").alias("total"), F.count_if("is_matched").alias("matched"), F.count_if(~F.col("is_matched")).alias("unmatched"), F.count_if("has_overlay").alias("text_overlays"), *more)


def mode_vote(durations: DataFrame, seconds: float = LONG_VIDEO_SECONDS) -> DataFrame:
    """scene if over half of the videos are long, else clip; a video that can't be
    probed lasts 0."""
    long = F.count_if(F.coalesce("duration", F.lit(0.0)) >= seconds)
    return durations.agg(F.count("*").alias("videos"), long.alias("long_videos"), F.when(long * 2 > F.count("*"), "scene").otherwise("clip").alias("mode"))


def with_types(triaged: DataFrame, concepts: DataFrame) -> DataFrame:
    """triaged with concept_types: the types of its matches, best first, each once. concepts:
    name, concept_type; a small table."""
    types = small(concepts.agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("concept_type", F.lit(""))))).alias("types")))
    found = F.transform("matches", lambda m: F.element_at(F.col("types"), m["concept"]))
    known = F.filter(found, lambda t: t.isNotNull() & (t != ""))
    return triaged.crossJoin(types).withColumn("concept_types", F.array_distinct(known)).drop("types")


def typed(triaged: DataFrame, concepts: DataFrame) -> DataFrame:
    """triaged whose matches have the type of their concept, with use_case and anchor_word: type and
    name of the best match if it has a type, else null. concepts: name, concept_type; a small table."""
    types = small(concepts.agg(F.map_from_entries(F.collect_set(F.struct("name", F.coalesce("concept_type", F.lit(""))))).alias("types")))
    kind = lambda m: F.nullif(F.element_at(F.col("types"), m["concept"]), F.lit(""))
    own = lambda m: F.struct(m["rank"].alias("rank"), m["concept"].alias("concept"), kind(m).alias("type"), m["similarity"].alias("similarity"), m["best_frame"].alias("best_frame"))
    rows = triaged.crossJoin(types).withColumn("matches", F.transform("matches", own)).drop("types")
    best = F.get("matches", F.lit(0))
    return rows.withColumns({"use_case": best["type"], "anchor_word": F.when(best["type"].isNotNull(), best["concept"])})


def concept_summary(concepts: DataFrame) -> DataFrame:
    """concept_type, names; concepts of no type come last."""
    return concepts.groupBy("concept_type").agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy(F.asc_nulls_last("concept_type"))
