"""The queries over the tables of a data folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import materialize
from . import alignment, decontamination, language_id, mixing, quality_qda, quality_rules, simhash, substring_dedup, token_counts, toxicity, url_rules, warc, whitening
from .common import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, coverage, kind of every document."""
    rows = decontamination.flag(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return rows.drop("text")


def damaged(page_id: Column, record: Column, every: int = 97) -> tuple[Column, Column]:
    """A replica as a bad disk leaves it: of records with the first 32 bits of
    md5(page_id) mod `every` = 5 the last byte is another, those with 6 are gone. Null ids
    stay as they are. The record there, and whether it's gone."""
    draw = F.coalesce(F.conv(F.substring(F.md5(page_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % every, F.lit(0))
    body = F.when(draw == 5, F.concat(F.substring(record, 1, F.octet_length(record) - 1), F.lit("X").cast("binary"))).otherwise(record)
    return body, draw == 6


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages as WARC records against a damaged replica: page_id, file,
    offset, length, digest, status. Records are digested where they are read; only
    digests are dealt to files."""
    records = warc.page_records(read(spark, sf_dir, "pages"))
    there, gone = damaged(F.col("page_id"), F.col("record"))
    rows = records.select("page_id", "file", "length", F.sha2("record", 256).alias("digest"), F.sha2(there, 256).alias("there"), gone.alias("gone"))
    rows = materialize(warc.placed(rows), "leaves")
    a, b = rows.drop("there", "gone"), rows.where("not gone").select("file", "offset", F.col("there").alias("digest"))
    return warc.fixity(a, b).select("page_id", "file", "offset", "length", "digest", "status")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")).drop("matched")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return alignment.align(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def whitening_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op11 holds before its eigen-solve: vec_id, n, deviation of each row that stays."""
    rows = whitening.whiten(read(spark, sf_dir, "embeddings"), components=1)
    return rows.select("vec_id", "n", "deviation")


def url_written_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8 decides without labels: page_id, host, path, rule, and its verdict or null."""
    host, path = url_rules.parts(F.col("url"))
    rule, verdict = url_rules.written_rule(F.col("host"), F.col("path"))
    rows = read(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    return rows.withColumns({"rule": rule, "verdict": verdict})


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 counts before its forest: the base columns and base_failed."""
    rows = quality_rules.with_statistics(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = quality_rules.failed(F.col("n_words"), F.col("n_repeat_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"))


QUERIES = {f.__name__: f for f in (url_written_rules, rule_statistics, whitening_deviation, op1_mixing, op2_substring_dedup, op3_simhash, op4_toxicity, op5_decontamination, op6_warc_fixity, op7_token_counts, op8_url_rules, op9_quality_rules, op10_quality_qda, op11_whitening, op12_alignment, op13_language_id)}

ORACLE_SQL = {
    "op1_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) || ':7'), 1, 13))::BIGINT + 1) / 4503599627370496.0)
      / (1.0 + least(coalesce(len(regexp_extract_all(text, '[.!?][\x20\x09\x0B-\x0D]*(\n|\z)'))::DOUBLE / nullif(len(regexp_extract_all(text, '[^\x20\x09-\x0D][^\n]*')), 0), 0.0), 1.0) * 3) AS key
  FROM docs
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM sizes
), ranked AS (
  SELECT *, row_number() OVER r AS pos, (sum(source_size) OVER ())::BIGINT AS total,
    ((sum(w) OVER ()) - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS w_left,
    (3 * coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS capped
  FROM weighed WINDOW r AS (ORDER BY source_size * 18 / w, source NULLS LAST)
), ending AS (
  SELECT pos AS first_at, total - capped AS first_left, w_left AS first_w FROM ranked
  WHERE (total - capped) * w <= 3 * source_size * w_left ORDER BY pos LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN pos < first_at THEN (3 * source_size)::DOUBLE ELSE (first_left * w)::DOUBLE / first_w END AS target FROM ranked, ending
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets
), summed AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (CASE WHEN upto - size / 2 <= budget THEN epochs + 1 ELSE epochs END * size)::BIGINT AS taken FROM summed
""",
    "op2_substring_dedup": r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS h FROM docs, unnest(range(1, len(words) - 48)) AS t(i)
), hits AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM windows) WHERE low < doc_id
), gone AS (
  SELECT DISTINCT doc_id, p FROM hits, unnest(range(i, i + 50)) AS t(p)
), taken AS (
  SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed,
    CASE WHEN g.gone IS NULL THEN words ELSE list_select(words, list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(g.gone, p))) END AS left_words
  FROM docs d LEFT JOIN taken g USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(left_words, ' '), '')) AS kept_sha256 FROM kept
""",
    "op6_warc_fixity": """
WITH records AS (
  SELECT page_id, page_id // 4096 AS file, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages
)
SELECT page_id, file, sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, sha256(record) ROWS UNBOUNDED PRECEDING)::BIGINT - strlen(record) AS "offset",
  strlen(record)::BIGINT AS length, sha256(record) AS digest,
  CASE coalesce(('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 97, 0) WHEN 5 THEN 'corrupt' WHEN 6 THEN 'missing' ELSE 'ok' END AS status FROM records
""",
    "url_written_rules": """
WITH cut AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages
), hosts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host || r.path) DESC) AS k
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, rule, verdict FROM fits WHERE k = 1
""",
    "rule_statistics": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, i, array_to_string(words[i : i + 7], ' ') AS w FROM docs, unnest(range(1, len(words) - 6)) AS t(i)
), twice AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 8)) AS t(p) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM docs, unnest(string_split(text, chr(10))) AS t(line) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN lines l USING (r) LEFT JOIN repeats p USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
""",
    "whitening_deviation": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT + 1000000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), fit AS (
  SELECT DISTINCT x FROM vectors
), entries AS (
  SELECT generate_subscripts(x, 1) AS i, unnest(x) AS v FROM fit
), sums AS (
  SELECT i, sum(v)::HUGEINT AS s FROM entries GROUP BY i
), placed AS (
  SELECT r, vec_id, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM (SELECT row_number() OVER () AS r, * FROM vectors)
)
SELECT vec_id, n, sum((n * v - s) * (n * v - s))::BIGINT AS deviation
FROM placed JOIN sums USING (i), (SELECT count(*)::BIGINT AS n FROM fit) GROUP BY r, vec_id, n
""",
}
