"""Registered queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import delivery, schema_drift
from tidewell.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.repeated_deliveries(table(spark, folder, "bookmark"))


def p2_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The kept copies with their content; of nested columns the parts that both engines write alike."""
    kept = delivery.drop_repeats(table(spark, folder, "bookmark"))
    return kept.select(
        "row_id", "batch_id", "pos", "id", "url", "text", F.col("note_tweet.text").alias("long_text"), "created_at", "lang", F.col("author.id").alias("author_id"), F.col("author.name").alias("author_name"),
        F.size(F.coalesce("media", F.array())).alias("n_media"), F.size(F.coalesce("referenced_tweets", F.array())).alias("n_refs"), F.try_element_at("public_metrics", F.lit("like_count")).alias("likes"), "source", F.unix_micros("fetched_at").alias("fetched_us"),
    )


def p2_new_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What was fetched from July on, screened against all rows stored before (rows without a time are stored ones)."""
    rows = table(spark, folder, "bookmark").select("row_id", "id", "source", "fetched_at")
    late = F.coalesce(F.col("fetched_at") >= F.lit("2026-07-01").cast("timestamp"), F.lit(False))
    return delivery.new_messages(rows.where(late), rows.where(~late))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    drift = schema_drift.schema_drift(table(spark, folder, "rollout_lines"))
    return drift.select("file_name", "change_kind", "json_path")


def p6_unified(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.unify_records(table(spark, folder, "rollout_lines"))


def p6_fields(spark: SparkSession, folder: str) -> DataFrame:
    return schema_drift.unified_fields(table(spark, folder, "rollout_lines"))


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept, "p2_new_batches": p2_new_batches, "p6_found": p6_found, "p6_unified": p6_unified, "p6_fields": p6_fields}

_BARE = r"regexp_extract(regexp_replace(regexp_replace(id, '(\S)[?#].*$', '\1'), '[/\s]+$', ''), '([0-9A-Za-z_\-]+)[^0-9A-Za-z_\-]*$', 1)"
_ROWS = f"""
keyed AS (
  SELECT row_id, batch_id, pos, id, source, coalesce(fetched_at >= TIMESTAMPTZ '2026-07-01 00:00:00+00', false) AS late, nullif({_BARE}, '') AS k, nullif(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))), '') AS s FROM bookmark
), ranked AS (
  SELECT *, CASE WHEN k IS NULL OR s IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k, s ORDER BY row_id) END AS rn FROM keyed
)"""
SQL = {
    "p2_found": f"WITH {_ROWS} SELECT row_id FROM ranked WHERE rn > 1",
    "p2_kept": f"""WITH {_ROWS} SELECT b.row_id, b.batch_id, b.pos, b.id, b.url, b.text, b.note_tweet.text AS long_text, b.created_at, b.lang, b.author.id AS author_id, b.author.name AS author_name,
      CAST(len(coalesce(b.media, [])) AS INT) AS n_media, CAST(len(coalesce(b.referenced_tweets, [])) AS INT) AS n_refs, b.public_metrics['like_count'] AS likes, b.source, epoch_us(b.fetched_at) AS fetched_us
      FROM ranked JOIN bookmark b USING (row_id) WHERE rn = 1""",
    "p2_new_batches": f"""WITH {_ROWS} SELECT min(row_id) AS row_id, k AS message_id, s AS message_source FROM keyed
      WHERE late AND k IS NOT NULL AND s IS NOT NULL AND (k, s) NOT IN
        (SELECT (k, s) FROM keyed WHERE NOT late AND k IS NOT NULL AND s IS NOT NULL) GROUP BY k, s""",
}
