"""Stand-ins for clips, scenes, frames and captions, derived from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.vectors import grid_hash
from .session import table

V_CLIPS = """v_clips AS (
  SELECT *, frame_count / fps AS duration FROM (
    SELECT p_partkey AS clip_id, [360, 480, 720, 1080][p_partkey % 4 + 1] AS height, ([360, 480, 720, 1080][p_partkey % 4 + 1] * 16) // 9 AS width,
      [16.0, 23.976, 24.0, 16.4, 30.0][p_partkey % 5 + 1]::DOUBLE AS fps, p_size * 4 + 1 - ((p_partkey // 4) % 4) AS frame_count,
      ['1:1', '4:3', 'N/A', '1/1', '0:0', '8:9', '1:1'][p_partkey % 7 + 1] AS sar FROM part))"""


def pick(values: list, at) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    height = pick([360, 480, 720, 1080], k % 4)
    rows = table(spark, d, "part").select(
        k.alias("clip_id"), height.alias("height"), F.floor(height * 16 / 9).cast("long").alias("width"), pick([16.0, 23.976, 24.0, 16.4, 30.0], k % 5).alias("fps"),
        (F.col("p_size") * 4 + 1 - F.floor(k / 4) % 4).cast("long").alias("frame_count"), pick(["1:1", "4:3", "N/A", "1/1", "0:0", "8:9", "1:1"], k % 7).alias("sar"),
    )
    return rows.withColumn("duration", F.col("frame_count") / F.col("fps"))


V_SCENES = """ev AS (
  SELECT user_id AS video, event_type, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0 / 10000, 3) AS t FROM events
), durations AS (
  SELECT video, max(t) AS duration FROM ev GROUP BY video
), bounds AS (
  SELECT DISTINCT video, t FROM (SELECT video, 0.0::DOUBLE AS t FROM durations UNION ALL SELECT video, t::DOUBLE FROM ev WHERE event_type = 'error')
), v_scenes AS (
  SELECT b.video, row_number() OVER w - 1 AS scene_index, b.t AS "start", coalesce(lead(b.t) OVER w, duration::DOUBLE) AS "end" FROM bounds b JOIN durations d USING (video) WINDOW w AS (PARTITION BY b.video ORDER BY b.t)
)"""


def _times(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros("ts")
    first = F.min(us).over(Window.partitionBy("user_id"))
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(F.col("user_id").alias("video"), "event_type", F.round((us - first) / 1000000.0 / 10000, 3).alias("t"))


def cuts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cuts (video, t) and durations (video, duration)."""
    rows = _times(spark, d)
    return rows.where("event_type = 'error'").select("video", "t"), rows.groupBy("video").agg(F.max("t").alias("duration"))


V_FRAMES = """v_frames AS (SELECT vec_id // 5 AS clip, vec_id % 5 AS frame_idx, embedding::DOUBLE[] AS embedding FROM embeddings),
v_refs AS (SELECT concat('ref', lpad(label::VARCHAR, 2, '0')) AS concept, label AS ref_order, arg_min(embedding, vec_id)::DOUBLE[] AS ref_embedding FROM embeddings GROUP BY label)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 5).cast("long").alias("clip"), (F.col("vec_id") % 5).cast("long").alias("frame_idx"), "embedding")


def references(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref_embedding"))
    return rows.select(F.concat(F.lit("ref"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("concept"), F.col("label").alias("ref_order"), "ref_embedding")


def grid_sql(cells: str = "embedding") -> str:
    bits = [f"({cells}[{r * 8 + c + 2}] > {cells}[{r * 8 + c + 1}])::BIGINT << {55 - (r * 7 + c)}" for r in range(8) for c in range(7)]
    return " + ".join(f"({b})" for b in bits)


V_HASH = f"v_hash AS (SELECT vec_id AS id, {grid_sql()} AS hash FROM embeddings)"


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), grid_hash(F.col("embedding")).alias("hash"))


V_PAIRS = """v_targets AS (SELECT doc_id AS stem, concat('targets/', doc_id, '.mp4') AS target, source FROM documents WHERE doc_id % 5 <> 0),
v_caps AS (SELECT doc_id AS stem, concat('captions/', doc_id, '.txt') AS caption FROM labels),
v_refs AS (SELECT vec_id AS stem, concat('references/', vec_id, '.png') AS reference FROM embeddings),
v_samples AS (
  SELECT t.stem, t.target, t.source, c.caption, r.reference, d.text FROM v_targets t LEFT JOIN (SELECT stem, max(caption) AS caption FROM v_caps GROUP BY stem) c USING (stem)
  LEFT JOIN (SELECT stem, max(reference) AS reference FROM v_refs GROUP BY stem) r USING (stem) JOIN documents d ON d.doc_id = t.stem)"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "documents").where("doc_id % 5 <> 0").select(k.alias("stem"), F.concat(F.lit("targets/"), k.cast("string"), F.lit(".mp4")).alias("target"), "source")


def caption_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, d, "labels").select(k.alias("stem"), F.concat(F.lit("captions/"), k.cast("string"), F.lit(".txt")).alias("caption"))


def reference_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    return table(spark, d, "embeddings").select(k.alias("stem"), F.concat(F.lit("references/"), k.cast("string"), F.lit(".png")).alias("reference"))
