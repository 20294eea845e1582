"""Landed API pages, media information and small sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fields kept of media information.
MEDIA_FIELDS = ("id", "title", "fulltitle", "uploader", "channel", "duration", "webpage_url", "extractor", "upload_date", "availability")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, raw) of landed page files; a page without an object gives no items later."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), F.col("value").alias("raw"))


def items_of_pages(pages: DataFrame, scope: str = "$.data") -> DataFrame:
    """(page, pos, item, next_token): the items of each page in order, as JSON text; pages that cannot be read give none."""
    v = F.try_parse_json("raw")
    items = F.try_variant_get(v, scope, "array<variant>")
    rows = pages.where(v.isNotNull()).select("page", F.try_variant_get(v, "$.meta.next_token", "string").alias("next_token"), F.posexplode(items).alias("pos", "x"))
    return rows.select("page", "pos", F.to_json("x").alias("item"), "next_token")


def compact_info(media: DataFrame) -> DataFrame:
    """(id, info): those of the kept fields that the table has, as JSON, nulls left out; the columns are pruned at the scan."""
    return media.select("id", F.to_json(F.struct(*[c for c in MEDIA_FIELDS if c in media.columns])).alias("info"))


def scan_pages(pages: DataFrame, feed: str, page_no: str, size: str, next_token: str, wanted: int | None = None, most_pages: int | None = None) -> DataFrame:
    """The pages of each feed a scan reads: until the wanted number of items is reached, a page has no follower, or the
    page cap is reached. A page is read whole, so more than the wanted items may come.

    Works on page headers only; the items of the pages are joined or filtered by the result.
    """
    before = Window.partitionBy(feed).orderBy(page_no).rowsBetween(Window.unboundedPreceding, -1)
    read = F.coalesce(F.max(F.col(next_token).isNull()).over(before), F.lit(False)) == F.lit(False)
    if wanted is not None:
        read &= F.coalesce(F.sum(size).over(before), F.lit(0)) < wanted
    if most_pages is not None:
        read &= F.coalesce(F.count("*").over(before), F.lit(0)) < most_pages
    return pages.withColumn("__read", read).where("__read").drop("__read")


def write_new(df: DataFrame, path: str) -> None:
    """A run's own folder: refuses one that exists."""
    df.write.mode("errorifexists").json(path)


def replace_state(df: DataFrame, path: str) -> None:
    """A small table replaced as a whole: a new version is written in full beside the old one, then a pointer moves.

    A crash leaves either the old version or the new one; what is read while it is replaced stays there until the next but
    one replacement.
    """
    files, root = _files(df.sparkSession, path)
    now = _version(files, root, df.sparkSession)
    child = lambda name: _path(df.sparkSession, f"{path.rstrip('/')}/{name}")
    df.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/v{now + 1}")
    files.rename(child(f"v{now + 1}/_SUCCESS"), child(f"v{now + 1}/_CURRENT"))
    if now > 1:
        files.delete(child(f"v{now - 1}"), True)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version of a table written by ``replace_state``; empty at first."""
    files, root = _files(spark, path)
    now = _version(files, root, spark)
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/v{now}") if now else spark.createDataFrame([], schema)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    root = _path(spark, path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _version(files, root, spark: SparkSession) -> int:
    """The highest version that was written to its end."""
    if not files.exists(root):
        return 0
    found = [s.getPath().getName() for s in files.listStatus(root)]
    whole = [int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and files.exists(_path(spark, f"{root}/{n}/_CURRENT"))]
    return max(whole, default=0)
