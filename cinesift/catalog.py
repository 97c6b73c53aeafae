"""Every query by name: a function of (spark, folder), and the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constants as K
from . import manifests, prompts, views
from .config import DataConfig, VideoConfig
from .functions import media as M
from .functions import text as T
from .functions import vectors as V
from .lineage import shared_dir, written
from .operators import buckets, captions, duplicates, media, organize, pairing, segments, triage, video_spec
from .session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Of the similarity queries over the sample embeddings, where 0.70 finds only selves.
SIMILAR, HASH_APART, HASH_BITS = 0.30, 14, 56


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ---- captions

TOKENS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"
LENGTH = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::DOUBLE"
SCORES = f"""
scored AS (
  SELECT *, CASE WHEN n = 0 THEN 0.0 WHEN n < 50 THEN 0.2 WHEN n < 80 THEN 0.4 + 0.6 * (n - 50) / 30 WHEN n <= 400 THEN 1.0 WHEN n <= 600 THEN 1.0 - 0.4 * (n - 400) / 200 ELSE 0.4 END::DOUBLE AS length_score,
    CASE WHEN k = 0 THEN 0.0 WHEN k = 1 THEN 0.3 WHEN k = 2 THEN 0.5 WHEN k = 3 THEN 0.7 WHEN k <= 5 THEN 0.85 ELSE 1.0 END::DOUBLE AS temporal_score,
    greatest(0.0, least(1.0, 0.5::DOUBLE - 0.15::DOUBLE * vague + 0.1::DOUBLE * specific)) AS specificity_score,
    CASE WHEN words < 4 OR repeats = 0 THEN 1.0 WHEN repeats / (words - 2) > 0.3 THEN 0.2 WHEN repeats / (words - 2) > 0.15 THEN 0.5 WHEN repeats / (words - 2) > 0.05 THEN 0.8 ELSE 0.95 END::DOUBLE AS repetition_score
  FROM (
    SELECT *, {LENGTH} AS n, len(tokens) AS words, len(list_intersect(tokens, {quoted(K.TEMPORAL_WORDS)})) AS k,
      len(list_filter({quoted(K.VAGUE_PHRASES)}, lambda p: contains(lower(text), p))) AS vague, len(list_filter({quoted(K.SPECIFIC_TERMS)}, lambda p: contains(lower(text), p))) AS specific,
      CASE WHEN len(tokens) >= 3 THEN len(tokens) - 2 - len(list_distinct(list_transform(range(1, len(tokens) - 1), lambda i: concat_ws(' ', tokens[i], tokens[i + 1], tokens[i + 2])))) ELSE 0 END AS repeats
    FROM (SELECT *, {TOKENS} AS tokens FROM captions))
), overall AS (SELECT *, length_score * 0.25 + temporal_score * 0.3 + specificity_score * 0.25 + repetition_score * 0.2 AS overall FROM scored)"""
DOCS = f"WITH captions AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents), {SCORES}"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return captions.score(table(spark, d, "documents"))


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


@query(f"{DOCS} SELECT doc_id, round(length_score, 6) AS length_score FROM scored")
def caption_length_score(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.stripped_length(F.coalesce("text", F.lit(""))).alias("n"))
    return rows.select("doc_id", F.round(T.length_score(F.col("n")), 6).alias("length_score"))


@query(f"{DOCS} SELECT doc_id, temporal_score FROM scored")
def caption_temporal_score(spark, d):
    return table(spark, d, "documents").select("doc_id", T.temporal_score(T.words(F.coalesce("text", F.lit("")))).alias("temporal_score"))


@query(f"{DOCS} SELECT doc_id, round(specificity_score, 6) AS specificity_score FROM scored")
def caption_specificity_score(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return rows.select("doc_id", F.round(T.specificity_score(F.col("low")), 6).alias("specificity_score"))


@query(f"{DOCS} SELECT doc_id, repeats::BIGINT AS repeated, repetition_score FROM scored")
def caption_repetition_score(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("tokens"))
    return captions.counted(rows).select("doc_id", F.col("repeated").cast("long").alias("repeated"), T.repetition_score(F.size("tokens"), F.col("repeated")).alias("repetition_score"))


@query(f"""WITH captions AS (SELECT concat('d', doc_id) AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT concat('c', conv_id, '-', turn) AS id, coalesce(text, '') AS text FROM conversations), {SCORES}
SELECT id, round(length_score, 6) AS length_score, temporal_score, round(specificity_score, 6) AS specificity_score, repetition_score, round(overall, 6) AS overall FROM overall""")
def caption_overall_score(spark, d):
    a = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    b = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), "text")
    return captions.score(a.unionByName(b)).select("id", r6("length_score"), "temporal_score", r6("specificity_score"), "repetition_score", r6("overall"))


@query(f"{DOCS} SELECT doc_id, round(overall, 6) AS overall FROM overall ORDER BY round(overall, 6), doc_id")
def caption_worst_first(spark, d):
    """Every caption, worst first."""
    return captions.worst_first(_scored(spark, d).select("doc_id", r6("overall")), "doc_id")


@query(f"{DOCS} SELECT lang, source, count(*) AS n, round(avg(round(overall, 6)), 5) AS average, round(min(overall), 6) AS lowest, round(max(overall), 6) AS highest FROM overall GROUP BY lang, source")
def caption_score_summary(spark, d):
    rows = captions.summary(_scored(spark, d).select("lang", "source", r6("overall")), "lang", "source")
    return rows.select("lang", "source", "n", F.round("average", 5).alias("average"), "lowest", "highest")


@query(f"""{DOCS} SELECT issue, count(*) AS n FROM (
  SELECT unnest([CASE WHEN n = 0 THEN 'empty caption' WHEN n < 50 THEN 'very short' WHEN n < 80 THEN 'short' WHEN n > 600 THEN 'very long' WHEN n > 400 THEN 'long' END, CASE WHEN k = 0 THEN 'no words of motion or change' END,
    CASE WHEN vague > 0 THEN 'vague' END, CASE WHEN repetition_score = 0.2 THEN 'heavy repetition' WHEN repetition_score = 0.5 THEN 'some repetition' END]) AS issue FROM scored) WHERE issue IS NOT NULL GROUP BY issue""")
def caption_issue_summary(spark, d):
    kind = F.regexp_extract(F.col("issue"), "^[^:]+", 0)
    return captions.each_issue(_scored(spark, d)).groupBy(kind.alias("issue")).agg(F.count("*").alias("n"))


_VAGUE_TEXTS = "texts AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - s_suppkey AS id, concat_ws(' ', " + ", ".join(f"CASE WHEN s_suppkey % {k + 2} = 0 THEN '{p}' END" for k, p in enumerate(reversed(K.VAGUE_PHRASES))) + ") AS text FROM supplier)"


@query(f"""WITH {_VAGUE_TEXTS}, found AS (SELECT id, list_filter({quoted(K.VAGUE_PHRASES)}, lambda p: contains(lower(text), p)) AS vague FROM texts)
SELECT id, 'vague: ' || array_to_string(vague[1:3], ', ') AS issue FROM found WHERE len(vague) > 0""")
def caption_vague_preview(spark, d):
    """The first three vague phrases of a caption, in the order of the list, over documents
    and made-up captions that hold some phrases in the opposite order."""
    some = F.concat_ws(" ", *[F.when(F.col("s_suppkey") % (k + 2) == 0, p) for k, p in enumerate(reversed(K.VAGUE_PHRASES))])
    made = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).cast("long").alias("id"), some.alias("text"))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("id"), "text").unionByName(made)
    return captions.each_issue(captions.score(rows), "id").where("issue like 'vague%'")


@query(f"WITH captions AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) SELECT doc_id, floor(len({TOKENS}) * 1.3::DOUBLE)::BIGINT AS n_tokens, floor(len({TOKENS}) * 1.3::DOUBLE) > 512 AS too_long FROM captions")
def caption_token_overflow(spark, d):
    return captions.token_overflow(table(spark, d, "documents")).select("doc_id", "n_tokens", "too_long")


@query(f"SELECT doc_id, coalesce({LENGTH}, 0) = 0 AS is_empty FROM documents")
def caption_empty_check(spark, d):
    return table(spark, d, "documents").select("doc_id", (T.strip(F.coalesce("text", F.lit(""))) == "").alias("is_empty"))


def _token_sql(c: str) -> str:
    return TOKENS.replace("text", c)


JACCARD = f"""round(CASE WHEN len({_token_sql("old")}) > 0 AND len({_token_sql("fresh")}) > 0
  THEN len(list_intersect({_token_sql("old")}, {_token_sql("fresh")})) / len(list_distinct(list_concat({_token_sql("old")}, {_token_sql("fresh")}))) ELSE 0.0 END, 6)"""
TURNS = "turns AS (SELECT * FROM (SELECT conv_id, turn, coalesce(text, '') AS old, coalesce(lead(text) OVER w, '') AS fresh, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE next IS NOT NULL)"
NEIGHBOURS = "near AS (SELECT a.doc_id, coalesce(a.text, '') AS old, b.text AS fresh FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1 WHERE b.text IS NOT NULL)"


@query(f"WITH {TURNS} SELECT conv_id, turn, {JACCARD} AS similarity, CASE WHEN {JACCARD} > 0.4 THEN 'keep' ELSE 'review' END AS recommendation FROM turns")
def audit_similarity(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("fresh", F.lead("text").over(w)).withColumn("next", F.lead("turn").over(w)).where("next is not null")
    return captions.audit(rows, "text", "fresh").select("conv_id", "turn", r6("similarity"), "recommendation")


def _neighbours(spark, d):
    """Each document beside the one of the id before, joined by id: no group is ordered in one task."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    before = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("fresh")).where("fresh is not null")
    return captions.audit(rows.join(before, "doc_id"), "text", "fresh")


@query(f"WITH {NEIGHBOURS} SELECT doc_id, {JACCARD} AS similarity, CASE WHEN {JACCARD} > 0.4 THEN 'keep' ELSE 'review' END AS recommendation FROM near")
def audit_similarity_neighbours(spark, d):
    return _neighbours(spark, d).select("doc_id", r6("similarity"), "recommendation")


@query(f"WITH {NEIGHBOURS} SELECT recommendation, count(*) AS n FROM (SELECT CASE WHEN {JACCARD} > 0.4 THEN 'keep' ELSE 'review' END AS recommendation FROM near) GROUP BY recommendation")
def audit_recommendation_counts(spark, d):
    return _neighbours(spark, d).groupBy("recommendation").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN starts_with(lower(text), lower(split_part(text, ' ', 1 + (doc_id % 2)::INT))) AND split_part(text, ' ', 1 + (doc_id % 2)::INT) <> '' THEN text ELSE concat(split_part(text, ' ', 1 + (doc_id % 2)::INT), ', ', lower(substr(text, 1, 1)), substr(text, 2)) END AS caption FROM documents WHERE split_part(text, ' ', 1 + (doc_id % 2)::INT) <> ''")
def anchor_prepend(spark, d):
    anchor = F.split_part("text", F.lit(" "), (F.col("doc_id") % 2 + 1).cast("int"))
    rows = table(spark, d, "documents").withColumn("anchor", anchor).where("anchor <> ''")
    return rows.select("doc_id", T.prepend_anchor(F.col("text"), F.col("anchor")).alias("caption"))


@query("SELECT n_nationkey, use_case, replace(replace(template, '{anchor}', n_name), '{subject}', lower(n_name)) AS prompt FROM nation CROSS JOIN (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in prompts.VIDEO.items() if k) + ") AS t(use_case, template)")
def prompt_fill(spark, d):
    cases = F.explode(F.array(*[F.lit(k) for k in prompts.VIDEO if k])).alias("use_case")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", cases)
    return rows.select("n_nationkey", "use_case", T.fill(prompts.template(F.col("use_case"), "video"), anchor=F.col("n_name"), subject=F.lower("n_name")).alias("prompt"))


_ALIAS_SQL = " ".join(f"WHEN list_contains({quoted(v)}, plain) THEN '{k}'" for k, v in K.CONCEPT_ALIASES.items())
_NAMES = ["Characters", " Per-son ", "scene_s", "LOOKS", "motion", "props", "unknown", "hu mans", ""]


@query(f"SELECT name, CASE {_ALIAS_SQL} END AS concept_type FROM (SELECT name, regexp_replace(lower(trim(name)), '[-_ ]', '', 'g') AS plain FROM (SELECT DISTINCT p_type AS name FROM part UNION ALL SELECT unnest({quoted(_NAMES)})))")
def concept_type_resolution(spark, d):
    names = spark.createDataFrame([(n,) for n in _NAMES], "name string").unionByName(table(spark, d, "part").select(F.col("p_type").alias("name")).distinct())
    return names.select("name", T.concept_type(F.col("name")).alias("concept_type"))


# ---- clips

SNAP = "CASE WHEN {n} <= 0 THEN 1 ELSE 4 * ((({n}) - 1) // 4) + 1 END"
SQUARE = "sar IN ('1:1', '1/1', 'N/A', '0:0', '0/0')"
CHECKED = f"""{views.V_CLIPS}, base AS (
  SELECT *, NOT ((frame_count - 1) % 4 = 0 AND frame_count BETWEEN 1 AND 161) AS off, {SNAP.format(n="frame_count")} AS snapped, abs(fps - 16) > 0.5 AS fps_off, NOT ({SQUARE}) AS odd FROM v_clips
), checked AS (
  SELECT *, height > 720 OR odd OR fps_off OR off AS needs_reencode, CASE WHEN off THEN snapped END AS recommended, list_filter([CASE WHEN height < 720 THEN 'RESOLUTION_BELOW_TARGET:error' END, CASE WHEN height > 720 THEN 'RESOLUTION_ABOVE_TARGET:info' END,
    CASE WHEN odd THEN 'NON_SQUARE_SAR:warning' END, CASE WHEN fps_off THEN 'FPS_MISMATCH:warning' END, CASE WHEN off AND frame_count - snapped <= 3 THEN 'INVALID_FRAME_COUNT:warning' END,
    CASE WHEN off AND frame_count - snapped > 3 THEN 'FRAME_COUNT_LARGE_TRIM:warning' END, CASE WHEN (CASE WHEN off THEN snapped ELSE frame_count END) < 5 THEN 'FRAME_COUNT_TOO_SHORT:error' END], lambda x: x IS NOT NULL) AS issues FROM base
), judged AS (SELECT *, len(list_filter(issues, lambda x: x LIKE '%:error')) = 0 AS is_valid FROM checked)"""


def _validated(spark, d):
    return video_spec.validate(views.clips(spark, d))


@query(f"WITH {views.V_CLIPS} SELECT clip_id, ({SNAP.format(n='frame_count')})::BIGINT AS down, (CASE WHEN frame_count <= 0 THEN 1 ELSE 4 * ((frame_count + 2) // 4) + 1 END)::BIGINT AS up FROM v_clips")
def frame_count_snap(spark, d):
    return views.clips(spark, d).select("clip_id", M.snap_down(F.col("frame_count")).alias("down"), M.snap_up(F.col("frame_count")).alias("up"))


@query(f"WITH {CHECKED} SELECT clip_id, array_to_string(issues, '|') AS pattern, needs_reencode, recommended::BIGINT AS recommended_frame_count, is_valid FROM judged")
def clip_validation_flags(spark, d):
    return _validated(spark, d).select("clip_id", video_spec.pattern().alias("pattern"), "needs_reencode", "recommended_frame_count", "is_valid")


@query(f"WITH {CHECKED} SELECT split_part(issue, ':', 1) AS code, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM judged) GROUP BY 1")
def clip_issue_summary(spark, d):
    return video_spec.issue_summary(_validated(spark, d))


@query(f"""WITH {CHECKED} SELECT count(*) AS total, count_if(is_valid)::BIGINT AS valid, count_if(NOT is_valid)::BIGINT AS invalid, count_if(needs_reencode)::BIGINT AS needs_reencode, count_if(len(issues) = 0)::BIGINT AS ready,
  (count_if(needs_reencode) - count_if(NOT is_valid))::BIGINT AS fixable FROM judged""")
def scan_counts(spark, d):
    return video_spec.scan_counts(_validated(spark, d))


@query(f"""WITH {CHECKED} SELECT array_to_string(issues, '|') AS pattern, count(*) AS n, min(height) AS height_low, max(height) AS height_high, min(fps) AS fps_low, max(fps) AS fps_high, min(frame_count) AS frame_count_low,
  max(frame_count) AS frame_count_high, array_to_string(list_sort(list(DISTINCT height)), ', ') AS height_values, array_to_string(list_sort(list(DISTINCT fps)), ', ') AS fps_values, min(clip_id) AS first FROM judged WHERE len(issues) > 0 GROUP BY 1""")
def scan_issue_patterns(spark, d):
    return video_spec.issue_patterns(_validated(spark, d), "clip_id")


def _span_sql(c: str, unit: str) -> str:
    return f"CASE WHEN min({c}) = max({c}) THEN min({c})::VARCHAR ELSE min({c}) || '-' || max({c}) END || '{unit}'"


@query(f"""WITH {CHECKED} SELECT array_to_string(issues, '|') AS pattern, count(*) AS n, {_span_sql("height", "p")} || ', ' || {_span_sql("fps", "fps")} || ', ' || {_span_sql("frame_count", " frames")} AS spec,
  min(clip_id) AS first, CASE WHEN count(*) BETWEEN 2 AND 6 THEN string_agg(clip_id::VARCHAR, ', ' ORDER BY clip_id) END AS files FROM judged WHERE len(issues) > 0 GROUP BY 1""")
def scan_issue_groups(spark, d):
    return video_spec.issue_groups(_validated(spark, d), "clip_id").drop("messages")


@query(f"""WITH {views.V_CLIPS}, s AS (SELECT *, CASE WHEN sar IN ('N/A', '0:0', '0/0') THEN '1:1' ELSE replace(sar, '/', ':') END AS clean FROM v_clips)
SELECT clip_id, clean AS sar, clean = '1:1' AS is_square, concat(width, 'x', height) AS display_resolution, round((width * split_part(clean, ':', 1)::DOUBLE) / (height * split_part(clean, ':', 2)::DOUBLE), 6) AS aspect_ratio FROM s""")
def aspect_ratio_sar(spark, d):
    sar = M.sample_aspect(F.col("sar"))
    return views.clips(spark, d).select("clip_id", sar.alias("sar"), M.is_square(sar).alias("is_square"), F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")).alias("display_resolution"), F.round(M.aspect_ratio(F.col("width"), F.col("height"), F.col("sar")), 6).alias("aspect_ratio"))


_RATES = ["24000/1001", "30/1", "25", "0/0", "N/A", "30000/1001", "abc/2", ""]


@query(f"""WITH r AS (SELECT unnest({quoted(_RATES)}) AS rate UNION ALL SELECT concat(p_size * 1000, '/1001') FROM part), p AS (SELECT DISTINCT rate, try_cast(split_part(rate, '/', 1) AS DOUBLE) AS a, try_cast(split_part(rate, '/', 2) AS DOUBLE) AS b FROM r)
SELECT rate, coalesce(round_even(CASE WHEN contains(rate, '/') THEN CASE WHEN b <> 0 THEN a / b END ELSE a END, 3), 0.0) AS fps FROM p""")
def frame_rate_parse(spark, d):
    rates = spark.createDataFrame([(r,) for r in _RATES], "rate string").unionByName(table(spark, d, "part").select(F.concat((F.col("p_size") * 1000).cast("string"), F.lit("/1001")).alias("rate")))
    return rates.distinct().select("rate", M.frame_rate(F.col("rate")).alias("fps"))


@query(f"""WITH {CHECKED}, t AS (SELECT *, CASE WHEN fps_off THEN {SNAP.format(n="floor(duration * 16)::BIGINT")} ELSE {SNAP.format(n="coalesce(recommended, frame_count)")} END AS target FROM judged)
SELECT clip_id, target::BIGINT AS target_frames, (frame_count - target)::BIGINT AS trimmed, CASE WHEN needs_reencode THEN 'encode' ELSE 'copy' END AS action FROM t""")
def normalize_plan(spark, d):
    return video_spec.normalize_plan(_validated(spark, d)).select("clip_id", "target_frames", "trimmed", "action")


@query(f"""WITH {CHECKED} SELECT clip_id, concat('ffmpeg -y -i clip', clip_id, '.mp4 ', CASE WHEN needs_reencode THEN '-c:v libx264 -crf 18 -preset medium -pix_fmt yuv420p -r 16 -vf scale=-2:720:flags=lanczos -frames:v ' || snapped || ' -an -movflags +faststart'
  ELSE '-c:v copy -frames:v ' || snapped || ' -an' END, ' out', clip_id, '.mp4') AS command FROM judged""")
def encode_commands(spark, d):
    name = lambda p: F.concat(F.lit(p), F.col("clip_id").cast("string"), F.lit(".mp4"))
    frames = M.snap_down(F.col("frame_count"))
    command = F.when(F.col("needs_reencode"), video_spec.encode_command(name("clip"), name("out"), frames)).otherwise(video_spec.copy_command(name("clip"), name("out"), frames))
    return _validated(spark, d).select("clip_id", F.array_join(command, " ").alias("command"))


BUCKET = f"{views.V_CLIPS}, b AS (SELECT clip_id, concat(width // 16 * 16, 'x', height // 16 * 16, 'x', frame_count) AS bucket_key FROM v_clips)"


@query(f"WITH {BUCKET} SELECT * FROM b")
def bucket_assignment(spark, d):
    return buckets.assign(views.clips(spark, d)).select("clip_id", "bucket_key")


@query(f"WITH {BUCKET} SELECT bucket_key, count(*) AS n, array_to_string(list(clip_id ORDER BY clip_id)[1:6], ',') AS samples, greatest(count(*) - 6, 0)::BIGINT AS more FROM b GROUP BY bucket_key")
def bucket_previews(spark, d):
    rows = buckets.previews(buckets.assign(views.clips(spark, d)), "clip_id")
    return rows.select("bucket_key", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"), F.col("more").cast("long").alias("more"))


@query(f"WITH {BUCKET} SELECT bucket_key, count(*) AS n, string_agg(clip_id::VARCHAR, ',' ORDER BY clip_id) AS samples FROM b GROUP BY bucket_key")
def bucket_groups(spark, d):
    return buckets.groups(buckets.assign(views.clips(spark, d)), "clip_id").select("bucket_key", "n", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query(f"WITH {BUCKET} SELECT bucket_key, count(*) AS n FROM b GROUP BY bucket_key HAVING count(*) < 2")
def undersized_buckets(spark, d):
    return buckets.undersized(buckets.assign(views.clips(spark, d)))


# ---- scenes


def _scenes(spark, d):
    return segments.scenes(*views.cuts(spark, d))


@query(f'WITH {views.V_SCENES} SELECT video, scene_index, "start", "end", round("end" - "start", 6) AS duration FROM v_scenes')
def scene_segments(spark, d):
    return _scenes(spark, d).select("video", "scene_index", "start", "end", F.round(F.col("end") - F.col("start"), 6).alias("duration"))


_PIECES = """pieces AS (
  SELECT video, scene_index, s AS "start", e AS "end", -1 AS sub_index FROM (SELECT video, scene_index, "start" AS s, "end" AS e FROM v_scenes) WHERE e - s <= 5.0625
  UNION ALL
  SELECT video, scene_index, s + k * 5.0625::DOUBLE, least(e, s + (k + 1) * 5.0625::DOUBLE), k FROM (SELECT video, scene_index, "start" AS s, "end" AS e FROM v_scenes), unnest(range(0, ceil((e - s - 0.05::DOUBLE) / 5.0625::DOUBLE)::BIGINT)) AS t(k) WHERE e - s > 5.0625
), sized AS (SELECT *, floor(("end" - "start") * 16)::BIGINT AS estimated FROM pieces)"""


@query(f"""WITH {views.V_SCENES}, {_PIECES} SELECT video, scene_index, sub_index, round("start", 6) AS "start", round("end", 6) AS "end", 4 * ((estimated - 1) // 4) + 1 AS frames, estimated - (4 * ((estimated - 1) // 4) + 1) AS trimmed,
  concat('v', video, '_scene', lpad(scene_index::VARCHAR, greatest(3, length(scene_index::VARCHAR))::INTEGER, '0'), CASE WHEN sub_index < 0 THEN '' WHEN sub_index < 26 THEN chr((97 + sub_index)::INT) ELSE '_' || sub_index END, '.mp4') AS name FROM sized WHERE estimated >= 5""")
def scene_subdivision(spark, d):
    rows = segments.clips(_scenes(spark, d), F.concat(F.lit("v"), F.col("video").cast("string")), F.lit(".mp4"))
    return rows.select("video", "scene_index", "sub_index", r6("start"), r6("end"), "frames", "trimmed", "name")


@query(f'WITH {views.V_SCENES} SELECT video, scene_index, i - 1 AS frame_index, round("start" + ("end" - "start") * i / 3, 6) AS t FROM v_scenes, unnest([1, 2]) AS u(i) WHERE "end" > "start"')
def scene_sample_timestamps(spark, d):
    return segments.sample_times(_scenes(spark, d)).select("video", "scene_index", "frame_index", r6("t"))


@query(f"""WITH RECURSIVE {views.V_SCENES}, c AS (SELECT video, t::DOUBLE AS t FROM ev WHERE event_type = 'error'), kept AS (
  SELECT video, min(t) AS t FROM c WHERE t >= 0.5 GROUP BY video UNION ALL SELECT k.video, (SELECT min(c.t) FROM c WHERE c.video = k.video AND c.t - k.t >= 0.5) AS t FROM kept k WHERE k.t IS NOT NULL
) SELECT video, t FROM kept WHERE t IS NOT NULL""")
def scene_min_length_fold(spark, d):
    return segments.spaced_cuts(views.cuts(spark, d)[0])


@query(f"WITH {views.V_SCENES} SELECT video, duration::DOUBLE AS duration FROM durations WHERE video NOT IN (SELECT video FROM ev WHERE event_type = 'error')")
def videos_without_cuts(spark, d):
    cuts, durations = views.cuts(spark, d)
    return segments.without_cuts(durations, cuts)


# ---- pairing

REFS = DataConfig(reference_required=True)
SAMPLE_ISSUES = f"""{views.V_PAIRS}, issued AS (
  SELECT stem, target, source, caption, reference, list_filter([CASE WHEN caption IS NULL THEN 'CAPTION_MISSING:error' END, CASE WHEN reference IS NULL THEN 'REFERENCE_MISSING:error' END,
    CASE WHEN caption IS NOT NULL AND coalesce({LENGTH}, 0) = 0 THEN 'CAPTION_EMPTY:warning' END, CASE WHEN caption IS NOT NULL AND floor(len({TOKENS}) * 1.3::DOUBLE) > 512 THEN 'CAPTION_TOO_LONG:warning' END], lambda x: x IS NOT NULL) AS issues FROM v_samples
), counted AS (SELECT *, len(list_filter(issues, lambda x: x LIKE '%:error')) AS n_errors, len(list_filter(issues, lambda x: x LIKE '%:warning')) AS n_warnings FROM issued)"""


def _samples(spark, d):
    rows = pairing.pair(views.targets(spark, d), views.caption_files(spark, d), views.reference_files(spark, d), config=REFS)
    content = table(spark, d, "documents").select(F.col("doc_id").alias("stem"), F.col("text").cast("binary").alias("content"))
    return pairing.check_captions(rows.join(content, "stem"))


@query(f"WITH {views.V_PAIRS} SELECT stem, target, caption, reference, caption IS NOT NULL AS has_caption, reference IS NOT NULL AS has_reference FROM v_samples")
def pair_samples(spark, d):
    rows = pairing.pair(views.targets(spark, d), views.caption_files(spark, d), views.reference_files(spark, d))
    return rows.select("stem", "target", "caption", "reference", F.col("caption").isNotNull().alias("has_caption"), F.col("reference").isNotNull().alias("has_reference"))


@query(f"WITH {views.V_PAIRS} SELECT path FROM (SELECT stem, caption AS path FROM v_caps UNION ALL SELECT stem, reference FROM v_refs) WHERE stem NOT IN (SELECT stem FROM v_targets)")
def orphans(spark, d):
    signals = views.caption_files(spark, d).withColumnRenamed("caption", "path").unionByName(views.reference_files(spark, d).withColumnRenamed("reference", "path"))
    return pairing.orphans(views.targets(spark, d), signals).select("path")


@query(f"WITH {SAMPLE_ISSUES} SELECT stem, split_part(issue, ':', 1) AS code FROM (SELECT stem, unnest(issues) AS issue FROM issued) WHERE issue LIKE '%MISSING%'")
def missing_signals(spark, d):
    rows = pairing.pair(views.targets(spark, d), views.caption_files(spark, d), views.reference_files(spark, d), config=REFS)
    return rows.select("stem", F.explode("issues.code").alias("code"))


@query(f"""WITH {views.V_PAIRS}, {views.V_CLIPS}, b AS (SELECT concat(width // 16 * 16, 'x', height // 16 * 16, 'x', frame_count) AS bucket_key FROM v_clips)
SELECT 'ORPHANED_FILE' AS code, 'warning' AS severity, path AS subject FROM (SELECT stem, caption AS path FROM v_caps UNION ALL SELECT stem, reference FROM v_refs) WHERE stem NOT IN (SELECT stem FROM v_targets)
UNION ALL SELECT 'DATASET_EMPTY', 'error', s.source FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT 'none') s WHERE s.source NOT IN (SELECT source FROM v_targets)
UNION ALL SELECT 'BUCKET_UNDERSIZED', 'warning', bucket_key FROM b GROUP BY bucket_key HAVING count(*) < 2""")
def dataset_level_issues(spark, d):
    signals = views.caption_files(spark, d).withColumnRenamed("caption", "path").unionByName(views.reference_files(spark, d).withColumnRenamed("reference", "path"))
    sources = table(spark, d, "documents").select("source").distinct().unionByName(spark.createDataFrame([("none",)], "source string"))
    targets = views.targets(spark, d)
    found = [
        pairing.orphan_issues(pairing.orphans(targets, signals)).withColumnRenamed("path", "subject"),
        pairing.empty_issues(pairing.empty_sources(sources, targets)).withColumnRenamed("source", "subject"),
        buckets.undersized_issues(buckets.undersized(buckets.assign(views.clips(spark, d)))).withColumnRenamed("bucket_key", "subject"),
    ]
    rows = None
    for one in found:
        one = one.select(F.explode("issues").alias("i"), "subject").select("i.code", "i.severity", "subject")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(f"""WITH {views.V_CLIPS}, m AS (SELECT clip_id AS stem, CASE WHEN clip_id % 3 = 0 THEN NULL ELSE fps / 30 END AS motion, CASE WHEN clip_id % 4 = 0 THEN NULL ELSE clip_id % 2 = 0 END AS fits FROM v_clips)
SELECT stem, array_to_string(list_filter([CASE WHEN NOT fits THEN 'FILE_TYPE_INVALID:error' END, CASE WHEN motion < 0.6 THEN 'MOTION_BELOW_MIN:warning' END, CASE WHEN motion > 0.9 THEN 'MOTION_ABOVE_MAX:warning' END], lambda x: x IS NOT NULL), '|') AS pattern FROM m""")
def sample_type_and_motion_issues(spark, d):
    """First bytes that fit or not, or aren't known, and motion that may not be measured."""
    k = F.col("clip_id")
    rows = views.clips(spark, d).select(k.alias("stem"), F.lit("t").alias("target"), F.lit(None).cast("string").alias("reference"), F.when(k % 3 != 0, F.col("fps") / 30).alias("motion"), F.when(k % 4 != 0, k % 2 == 0).alias("fits"))
    rows = rows.withColumn("issues", video_spec.gathered(video_spec.issue(F.lit(False), "", "", "", F.lit(""), "", "")))
    rows = pairing.check_motion(pairing.check_types(rows, F.col("fits"), F.lit(None).cast("boolean")), 0.6, 0.9)
    return rows.select("stem", video_spec.pattern().alias("pattern"))


@query("SELECT s.source FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT 'none') s WHERE s.source NOT IN (SELECT source FROM documents WHERE doc_id % 5 <> 0)")
def empty_sources(spark, d):
    sources = table(spark, d, "documents").select("source").distinct().unionByName(spark.createDataFrame([("none",)], "source string"))
    return pairing.empty_sources(sources, views.targets(spark, d))


@query(f"WITH {SAMPLE_ISSUES} SELECT source, count(*) AS samples, count_if(n_errors = 0)::BIGINT AS valid, count_if(n_errors > 0)::BIGINT AS invalid, sum(n_errors)::BIGINT AS errors, sum(n_warnings)::BIGINT AS warnings FROM counted GROUP BY source")
def dataset_report_counts(spark, d):
    return pairing.counts(_samples(spark, d), "source")


@query(f"""WITH {SAMPLE_ISSUES}, {BUCKET}, few AS (SELECT count(*)::BIGINT AS n FROM (SELECT bucket_key FROM b GROUP BY bucket_key HAVING count(*) < {K.BUCKET_LEAST}))
SELECT CASE grouping_id(source, stem) WHEN 0 THEN 'sample' WHEN 1 THEN 'dataset' ELSE 'report' END AS level, source, stem, count(*) AS samples, count_if(n_errors = 0)::BIGINT AS valid, sum(n_errors)::BIGINT AS errors,
  (sum(n_warnings) + CASE grouping_id(source, stem) WHEN 3 THEN (SELECT n FROM few) ELSE 0 END)::BIGINT AS warnings FROM counted GROUP BY GROUPING SETS ((source, stem), (source), ())""")
def issue_levels(spark, d):
    few = buckets.undersized_issues(buckets.undersized(buckets.assign(views.clips(spark, d))))
    return pairing.levels(_samples(spark, d), few)


@query(f"WITH {SAMPLE_ISSUES} SELECT stem, n_errors = 0 AS is_valid, array_to_string(issues, '|') AS pattern FROM counted")
def sample_validity(spark, d):
    return _samples(spark, d).select("stem", (~video_spec.has_error()).alias("is_valid"), video_spec.pattern().alias("pattern"))


@query(f"WITH {SAMPLE_ISSUES} SELECT code, count(*) AS n FROM (SELECT split_part(unnest(issues), ':', 1) AS code FROM issued) GROUP BY code")
def dataset_issue_summary(spark, d):
    return video_spec.issue_summary(_samples(spark, d))


@query(f"""WITH {SAMPLE_ISSUES} SELECT stem, CASE WHEN n_errors = 1 THEN 'one error' WHEN n_errors > 1 THEN n_errors || ' errors' END AS lenient,
  CASE WHEN n_errors = 1 THEN 'one error' WHEN n_errors > 1 THEN n_errors || ' errors' WHEN n_warnings = 1 THEN 'one warning' WHEN n_warnings > 1 THEN 'strict mode: ' || n_warnings || ' warnings' END AS strict FROM counted""")
def organize_filter(spark, d):
    def short(c):
        one = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s)) == 1
        return F.when(c.isNotNull() & one(K.ERROR), "one error").when(c.isNotNull() & ~video_spec.has_error() & one(K.WARNING), "one warning").otherwise(c)

    return _samples(spark, d).select("stem", short(organize.skip_reason()).alias("lenient"), short(organize.skip_reason(strict=True)).alias("strict"))


#: Measures of reference pictures, stand-ins made of a vector's number.
PICTURES = "pictures AS (SELECT vec_id, vec_id % 11 <> 0 AS decoded, (vec_id % 100)::DOUBLE AS sharpness, (vec_id % 21)::DOUBLE / 20 AS brightness FROM embeddings)"
NO_ISSUES = "cast(array() as array<struct<code:string,severity:string,message:string,field:string,actual:string,expected:string>>)"


def _pictures(spark, d):
    k = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", (k % 11 != 0).alias("decoded"), (k % 100).cast("double").alias("sharpness"), ((k % 21).cast("double") / 20).alias("brightness"))


@query(f"""WITH {PICTURES} SELECT vec_id, array_to_string(list_filter([CASE WHEN NOT decoded THEN 'FILE_CORRUPTED:error' END, CASE WHEN sharpness < {K.BLANK_SHARPNESS} THEN 'REFERENCE_BLANK:error' END,
  CASE WHEN sharpness < 50 THEN 'BLUR_BELOW_THRESHOLD:warning' END, CASE WHEN brightness < 0.05::DOUBLE OR brightness > 0.95::DOUBLE THEN 'EXPOSURE_OUT_OF_RANGE:warning' END], lambda x: x IS NOT NULL), '|') AS pattern FROM pictures""")
def reference_issues(spark, d):
    rows = _pictures(spark, d).withColumns({"reference": F.concat(F.col("vec_id").cast("string"), F.lit(".png")), "issues": F.expr(NO_ISSUES)})
    return pairing.check_references(rows, 50.0, (0.05, 0.95)).select("vec_id", video_spec.pattern().alias("pattern"))


@query(f"""WITH {PICTURES}, frames AS (SELECT vec_id // 7 AS clip, vec_id % 7 AS i, CASE WHEN decoded THEN (vec_id * 37 % 5)::DOUBLE END AS sharpness FROM pictures),
picked AS (SELECT clip, arg_max(i, coalesce(sharpness, -1) * 100 - i)::BIGINT AS "index", max(sharpness) AS sharpness FROM frames GROUP BY clip)
SELECT clip, "index", sharpness, floor("index" * 0.5::DOUBLE * 16)::BIGINT AS frame_number FROM picked""")
def best_frames_of_clips(spark, d):
    k = F.col("vec_id")
    rows = _pictures(spark, d).select(F.floor(k / 7).cast("long").alias("clip"), (k % 7).alias("index"), F.when(F.col("decoded"), (k * 37 % 5).cast("double")).alias("sharpness"), ((k % 7) * 0.5).cast("double").alias("at"))
    return media.best_frame(rows, "clip").select("clip", "index", "sharpness", "frame_number")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'FILE_CORRUPTED:error|CAPTION_EMPTY:warning' ELSE array_to_string(list_filter([CASE WHEN coalesce({LENGTH}, 0) = 0 THEN 'CAPTION_EMPTY:warning' END,
  CASE WHEN floor(len({TOKENS}) * 1.3::DOUBLE) > 512 THEN 'CAPTION_TOO_LONG:warning' END], lambda x: x IS NOT NULL), '|') END AS pattern FROM (SELECT *, text AS caption FROM documents)""")
def caption_file_issues(spark, d):
    text = F.coalesce("text", F.lit("")).cast("binary")
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit(b"\xff"))).otherwise(text)
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("caption"), broken.alias("content"), F.expr(NO_ISSUES).alias("issues"))
    return pairing.check_captions(rows).select("doc_id", video_spec.pattern().alias("pattern"))


@query("""WITH done AS (SELECT doc_id % 3 <> 1 OR doc_id % 5 = 0 AS success, doc_id % 5 = 0 AS skipped FROM documents)
SELECT count_if(success AND NOT skipped)::BIGINT AS succeeded, count_if(NOT success)::BIGINT AS failed, count_if(skipped)::BIGINT AS skipped FROM done""")
def caption_run_summary(spark, d):
    from .plans.commands import caption_summary

    k = F.col("doc_id")
    return caption_summary(table(spark, d, "documents").select(((k % 3 != 1) | (k % 5 == 0)).alias("success"), (k % 5 == 0).alias("skipped")))


COLLIDING = "named AS (SELECT doc_id, source AS stem, source || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS final_stem FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents))"


def _named(spark, d):
    return organize.unique_stems(table(spark, d, "documents").select("doc_id", F.col("source").alias("stem")), "stem", "doc_id")


@query(f"WITH {COLLIDING} SELECT * FROM named")
def organize_collisions(spark, d):
    return _named(spark, d)


def _destinations(spark, d, layout):
    k = F.col("doc_id").cast("string")
    rows = _named(spark, d).withColumns({"target": F.concat(F.lit("in/"), k, F.lit(".MOV")), "caption": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("in/"), k, F.lit(".txt"))), "reference": F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("in/"), k, F.lit(".png")))})
    return organize.destinations(rows, "out/", layout).select("doc_id", "target_dest", "caption_dest", "reference_dest")


def _dest_sql(t: str, c: str, r: str) -> str:
    return f"WITH {COLLIDING} SELECT doc_id, 'out/{t}' || final_stem || '.mov' AS target_dest, CASE WHEN doc_id % 2 = 0 THEN 'out/{c}' || final_stem || '.txt' END AS caption_dest, CASE WHEN doc_id % 3 = 0 THEN 'out/{r}' || final_stem || '.png' END AS reference_dest FROM named"


@query(_dest_sql("", "", ""))
def organize_destinations_flat(spark, d):
    return _destinations(spark, d, "flat")


@query(_dest_sql("training/targets/", "training/signals/captions/", "training/signals/references/"))
def organize_destinations_hierarchical(spark, d):
    return _destinations(spark, d, "hierarchical")


@query(f"WITH {views.V_CLIPS} SELECT height, string_agg(frame_count::VARCHAR, ',' ORDER BY frame_count) AS frame_counts, CASE height WHEN 480 THEN 854 WHEN 720 THEN 1280 WHEN 1080 THEN 1920 ELSE height * 16 // 9 END::BIGINT AS width FROM (SELECT DISTINCT height, frame_count FROM v_clips) GROUP BY height")
def trainer_frame_counts(spark, d):
    rows = views.clips(spark, d).groupBy("height").agg(manifests.frame_counts().alias("frame_counts"))
    return rows.select("height", F.array_join(F.transform("frame_counts", lambda x: x.cast("string")), ",").alias("frame_counts"), F.get(M.trainer_size(F.col("height")), F.lit(0)).alias("width"))


# ---- triage

SCORED = f"{views.V_FRAMES}, scored AS (SELECT clip, frame_idx, concept, ref_order, list_dot_product(embedding, ref_embedding) AS similarity FROM v_frames, v_refs)"
BEST = f"{SCORED}, best AS (SELECT clip, concept, ref_order, greatest(max(similarity), 0.0) AS similarity, CASE WHEN max(similarity) <= 0 THEN 0 ELSE arg_max(frame_idx, similarity) END::BIGINT AS best_frame FROM scored GROUP BY ALL), matched AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY similarity DESC, ref_order) AS rank FROM best WHERE similarity >= {SIMILAR})"
OVERLAYS = "overlays AS (SELECT clip, greatest(max(list_dot_product(f.embedding, p.embedding::DOUBLE[])), 0.0) AS overlay_score FROM v_frames f, (SELECT embedding FROM embeddings WHERE vec_id BETWEEN 100 AND 108) p GROUP BY clip)"
TRIAGED = f"{BEST}, {OVERLAYS}, triaged AS (SELECT clip, overlay_score >= 0.27 AS has_overlay, m.concept, m.concept IS NOT NULL AS is_matched FROM overlays LEFT JOIN (SELECT * FROM matched WHERE rank = 1) m USING (clip))"


def _scored_frames(spark, d):
    return triage.similarities(views.frames(spark, d), views.references(spark, d))


def _matches(spark, d):
    return triage.best_matches(views.frames(spark, d), views.references(spark, d), "clip", least=SIMILAR)


def _overlays(spark, d):
    prompts_ = table(spark, d, "embeddings").where("vec_id between 100 and 108").select(F.col("vec_id").alias("prompt"), F.col("embedding").alias("prompt_embedding"))
    return triage.overlay_scores(views.frames(spark, d), prompts_, "clip")


def _triaged(spark, d):
    return triage.triage(views.frames(spark, d).select("clip").distinct(), _matches(spark, d), _overlays(spark, d), "clip")


@query(f"WITH {SCORED} SELECT clip, frame_idx, concept, round(similarity, 6) AS similarity FROM scored")
def frame_ref_similarity(spark, d):
    return _scored_frames(spark, d).select("clip", "frame_idx", "concept", r6("similarity"))


@query(f"WITH {BEST} SELECT clip, concept, round(similarity, 6) AS similarity, best_frame, rank FROM matched")
def clip_best_match(spark, d):
    return _matches(spark, d).select("clip", "concept", r6("similarity"), "best_frame", "rank")


@query(f"WITH {TRIAGED} SELECT clip, CASE WHEN has_overlay THEN 'text_overlay' WHEN is_matched THEN concept ELSE 'unmatched' END AS folder, is_matched AND NOT has_overlay AS include FROM triaged")
def clip_routing(spark, d):
    return _triaged(spark, d).select("clip", "folder", "include")


@query(f"""WITH {TRIAGED}, kinds AS (SELECT concept, CASE ref_order % 3 WHEN 0 THEN 'character' WHEN 1 THEN 'setting' END AS kind FROM v_refs)
SELECT clip, kind AS use_case, CASE WHEN kind IS NOT NULL THEN concept END AS anchor_word FROM triaged LEFT JOIN kinds USING (concept)""")
def clip_use_case(spark, d):
    kind = F.when(F.col("ref_order") % 3 == 0, "character").when(F.col("ref_order") % 3 == 1, "setting")
    concepts = views.references(spark, d).select(F.col("concept").alias("name"), kind.alias("concept_type"))
    return triage.typed(_triaged(spark, d), concepts).select("clip", "use_case", "anchor_word")


@query(f"WITH {views.V_FRAMES}, {OVERLAYS} SELECT clip, round(overlay_score, 6) AS overlay_score, overlay_score >= 0.27 AS has_overlay FROM overlays")
def text_overlay_flag(spark, d):
    return _overlays(spark, d).select("clip", r6("overlay_score"), "has_overlay")


@query(f"WITH {TRIAGED} SELECT count(*) AS total, count_if(is_matched)::BIGINT AS matched, count_if(NOT is_matched)::BIGINT AS unmatched, count_if(has_overlay)::BIGINT AS text_overlays FROM triaged")
def triage_report_counts(spark, d):
    return triage.report(_triaged(spark, d))


@query(f"WITH {views.V_SCENES} SELECT count(*) AS videos, count_if(duration >= 30)::BIGINT AS long_videos, CASE WHEN count_if(duration >= 30) * 2 > count(*) THEN 'scene' ELSE 'clip' END AS mode FROM durations")
def triage_mode_vote(spark, d):
    return triage.mode_vote(views.cuts(spark, d)[1])


@query(f"""WITH {TRIAGED}, {views.V_SCENES} SELECT video, scene_index, "start", "end" FROM v_scenes s JOIN (SELECT count(*) AS n FROM triaged) c ON true JOIN triaged t ON t.clip = (s.video * 7 + s.scene_index) % c.n WHERE t.is_matched AND NOT t.has_overlay""")
def scene_include_filter(spark, d):
    triaged = _triaged(spark, d).select("clip", "include", "is_matched", "has_overlay", "matches")
    n = triaged.agg(F.count("*")).scalar()
    scene = _scenes(spark, d).withColumn("clip", (F.col("video") * 7 + F.col("scene_index")) % n).join(triaged, "clip")
    written = manifests.scene_manifest(scene)
    return manifests.included_scenes(written).select(F.col("video").cast("long").alias("video"), "scene_index", "start", "end")


# ---- duplicates

NEAR = f"{views.V_HASH}, near AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::BIGINT AS distance FROM v_hash a JOIN v_hash b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= {HASH_APART})"
GROUPED = f"""{NEAR}, links AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other), grouped AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)"""


@query(f"WITH {views.V_HASH} SELECT id, hash FROM v_hash")
def dhash(spark, d):
    return views.hashes(spark, d)


@query(f'WITH {NEAR} SELECT a AS "left", b AS "right", distance FROM near')
def hamming_pairs(spark, d):
    return duplicates.pairs(views.hashes(spark, d), HASH_APART, HASH_BITS)


@query(f"WITH RECURSIVE {GROUPED} SELECT id, group_id FROM grouped")
def duplicate_groups(spark, d):
    return duplicates.groups(views.hashes(spark, d), HASH_APART, HASH_BITS)


@query(f"WITH RECURSIVE {GROUPED} SELECT group_id, count(DISTINCT id % 3) AS sources, count(*) AS members FROM grouped GROUP BY group_id HAVING count(DISTINCT id % 3) > 1")
def cross_source_duplicates(spark, d):
    grouped = duplicates.groups(views.hashes(spark, d), HASH_APART, HASH_BITS).withColumn("source", F.col("id") % 3)
    return duplicates.across_sources(grouped)


# ---- manifests, vectors, measurements


@query(f"""WITH {SAMPLE_ISSUES} SELECT source, count(*) AS total_samples, count_if(n_errors = 0)::BIGINT AS valid_samples, sum(n_errors)::BIGINT AS errors, sum(n_warnings)::BIGINT AS warnings, '.mp4' AS target_suffixes,
  CASE WHEN count(caption) > 0 THEN '.txt' ELSE '' END AS caption_suffixes, CASE WHEN count(reference) > 0 THEN '.png' ELSE '' END AS reference_suffixes, coalesce(string_agg(CASE WHEN len(issues) > 0 THEN stem || ':' || array_to_string(list_transform(issues, lambda x: split_part(x, ':', 1)), '+') END, ',' ORDER BY stem), '') AS problems
FROM counted GROUP BY source""")
def manifest_json(spark, d):
    """Manifests of sources as JSON, read again: their counts, suffixes and samples with problems."""
    m = F.from_json("manifest", manifests.DATASET_SCHEMA)
    rows = manifests.dataset_manifest(_samples(spark, d)).select(m.alias("m")).select("m.*")
    codes = F.transform("samples", lambda x: F.concat(x["stem"], F.lit(":"), F.array_join(x["issues"]["code"], "+")))
    suffixes = [F.array_join(F.col(f"suffixes.{c}"), ",").alias(f"{c}_suffixes") for c in ("target", "caption", "reference")]
    return rows.select("source", "total_samples", "valid_samples", "errors", "warnings", *suffixes, F.array_join(codes, ",").alias("problems"))


def _published(spark: SparkSession, lines) -> str:
    """The folder of published lines; deleted when the session's process ends."""
    at = written(spark, f"{shared_dir(spark)}/cinesift-lines-{uuid.uuid4().hex}")
    manifests.publish(lines, at)
    return at


@query(f"""WITH {SAMPLE_ISSUES} SELECT 'sample' AS kind, source, stem::VARCHAR AS stem, target::VARCHAR AS target, array_to_string(list_transform(issues, lambda x: split_part(x, ':', 1)), '+') AS says FROM counted WHERE len(issues) > 0
UNION ALL SELECT 'source', source, NULL, NULL, concat_ws('/', count(*), count_if(n_errors = 0), sum(n_errors), sum(n_warnings)) FROM counted GROUP BY source""")
def manifest_lines(spark, d):
    """Manifests of sources in lines, published and read again: a row for each source and each sample with problems."""
    sources, found = manifests.read_dataset_lines(spark, _published(spark, manifests.dataset_lines(_samples(spark, d))))
    found = found.select(F.lit("sample").alias("kind"), "source", "stem", "target", F.array_join("issues.code", "+").alias("says"))
    sources = sources.select(F.lit("source").alias("kind"), "source", F.concat_ws("/", "total_samples", "valid_samples", "errors", "warnings").alias("says"))
    return found.unionByName(sources, allowMissingColumns=True)


@query(f"""WITH {views.V_SCENES} SELECT video, scene_index, round("start", 3) AS "start", round("end", 3) AS "end" FROM v_scenes WHERE "end" - "start" >= 2""")
def scene_lines_included(spark, d):
    """Scenes of a manifest in lines, published and read again: those of two seconds or more."""
    rows = _scenes(spark, d).withColumns({"has_overlay": F.lit(False), "include": F.col("end") - F.col("start") >= 2})
    kept = manifests.read_scene_manifest(spark, _published(spark, manifests.scene_lines(rows)))
    return kept.select(F.col("video").cast("long").alias("video"), "scene_index", "start", "end")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round((embedding[1]::DOUBLE * 3) / sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) * (x::DOUBLE * 3)))), 6) AS first FROM embeddings")
def l2_normalize(spark, d):
    e = F.col("embedding")
    scaled = F.transform(e, lambda x: x.cast("double") * 3)
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(e), 5).alias("norm"), F.round(F.get(V.normalised(scaled), F.lit(0)), 6).alias("first"))


@query(f"WITH {views.V_CLIPS} SELECT clip_id, i AS pair, CASE WHEN frame_count - 1 <= 5 THEN i ELSE (i * (frame_count - 2)) // 5 END AS start_frame FROM v_clips, unnest(range(0, least(frame_count - 1, 5))) AS t(i) WHERE frame_count >= 2")
def motion_pair_indices(spark, d):
    rows = views.clips(spark, d).select("clip_id", F.posexplode(M.pair_starts(F.col("frame_count"))).alias("pair", "start_frame"))
    return rows.withColumn("pair", F.col("pair").cast("long"))


@query("SELECT count(*) AS total, count_if(p_partkey % 7 <> 0 AND p_partkey % 5 <> 0)::BIGINT AS succeeded, count_if(p_partkey % 7 = 0 AND p_partkey % 5 <> 0)::BIGINT AS failed, count_if(p_partkey % 5 = 0)::BIGINT AS skipped, count_if(p_size > 25)::BIGINT AS videos, count_if(p_size <= 25)::BIGINT AS images FROM part")
def extraction_report(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select((k % 5 == 0).alias("skipped"), ((k % 7 != 0) | (k % 5 == 0)).alias("success"), F.when(F.col("p_size") > 25, "video").otherwise("image").alias("source_type"))
    return manifests.extraction_report(rows)


_CELL = "g[{i}]"


def _laplace_sql() -> str:
    mirror = lambda i: 1 if i < 0 else 6 if i > 7 else i
    cell = lambda r, c: f"g[{mirror(r) * 8 + mirror(c) + 1}]"
    return "[" + ", ".join(f"{cell(r - 1, c)} + {cell(r + 1, c)} + {cell(r, c - 1)} + {cell(r, c + 1)} - 4 * {cell(r, c)}" for r in range(8) for c in range(8)) + "]"


GRID = "grids AS (SELECT vec_id, list_transform(embedding, lambda x: round(128 + 400 * x::DOUBLE, 3)) AS g FROM embeddings)"


def _grids(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(F.lit(128) + F.lit(400) * x.cast("double"), 3)).alias("g"))


@query(f"WITH {GRID}, l AS (SELECT vec_id, {_laplace_sql()} AS l FROM grids) SELECT vec_id, round(list_sum(list_transform(l, lambda x: (x - list_sum(l) / 64) * (x - list_sum(l) / 64))) / 64, 4) AS sharpness FROM l")
def sharpness_grid(spark, d):
    return _grids(spark, d).select("vec_id", F.round(V.laplacian_variance(F.col("g"), 8, 8), 4).alias("sharpness"))


@query(f"WITH {GRID} SELECT vec_id, round(list_sum(g) / 64 / 255, 6) AS mean, round(sqrt(list_sum(list_transform(g, lambda x: (x - list_sum(g) / 64) * (x - list_sum(g) / 64))) / 64) / 255, 6) AS deviation FROM grids")
def exposure_grid(spark, d):
    return _grids(spark, d).select("vec_id", V.exposure(F.col("g")).alias("e")).select("vec_id", F.round("e.mean", 6).alias("mean"), F.round("e.deviation", 6).alias("deviation"))
