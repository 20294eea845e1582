"""Event logs of JSON lines, environment files and folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import text


def read_event_files(spark: SparkSession, path: str, name_filter: str = "*.jsonl") -> DataFrame:
    """(file_name, mtime, raw) of all lines of the files below a folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name_filter).text(path)
    return files.select(F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("raw"))


def events(lines: DataFrame) -> DataFrame:
    """Adds event_type, event_time, payload_type and session_id read from each JSON object; other lines are left out."""
    is_object = F.ltrim(F.col("raw")).startswith("{")
    read = lines.where(is_object).withColumn("__v", F.try_parse_json("raw")).where("__v is not null")
    get = lambda p: F.try_variant_get("__v", p, "string")
    return read.withColumns({
        "event_type": get("$.type"), "event_time": get("$.timestamp"), "payload_type": get("$.payload.type"),
        "session_id": F.when(get("$.type") == "session_meta", get("$.payload.id")), "plan": get("$.payload.rate_limits.plan_type"),
        "has_limits": F.coalesce(F.schema_of_variant(F.try_variant_get("__v", "$.payload.rate_limits", "variant")).startswith("OBJECT"), F.lit(False)),
    }).drop("__v")


def read_env_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the first entry of each key that has a value."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), text.env_entry(F.col("value")).alias("e"))
    return lines.where("e is not null and e.value <> ''").groupBy(F.col("e.key").alias("key")).agg(F.min_by("e.value", "n").alias("value"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def newest_first(files: DataFrame, root: str, name: str, mtime: str) -> DataFrame:
    """Adds ``place``: files of each root by time of change, the newest first, unknown ones last, ties by name."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(root).orderBy(F.col(mtime).desc_nulls_last(), name)))
