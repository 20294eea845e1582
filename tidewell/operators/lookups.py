"""Lookups beside plain equality: through arrays of keys, through references of references, by the nearest time before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.collections import last_written


def through_array(items: DataFrame, key: str, array: str, values: DataFrame, value_key: str, value: str, order: str) -> DataFrame:
    """(key, found): values of an array of keys, in the array's order, missing ones left out; items without any keep an empty list.

    The array is exploded to slim (key, place, element) rows before the join; a list is as long as its own array.
    """
    elements = items.select(key, F.posexplode(array).alias("place", "element")).where("element is not null")
    known = last_written(values.select(value_key, value, order), value_key, order).select(F.col(value_key).alias("element"), F.col(value).alias("v"))
    found = elements.join(known, "element").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("x"))
    return items.select(key).join(found, key, "left").select(key, F.coalesce(F.transform("x", lambda s: s["v"]), F.array().cast("array<string>")).alias("found"))


def through_reference(items: DataFrame, ref: str, targets: DataFrame, target_key: str, owner: str, owners: DataFrame, owner_key: str, name: str, order: tuple[str, str]) -> DataFrame:
    """Two left lookups: the referenced row, then the owner of that; what is missing stays null and the item stays.

    Of targets and owners that share a key the last written counts, by the two columns of ``order``.
    """
    first = last_written(targets.select(target_key, owner, order[0]), target_key, order[0]).select(F.col(target_key).alias(ref), F.col(owner).alias("__owner"))
    second = last_written(owners.select(owner_key, name, order[1]), owner_key, order[1]).select(F.col(owner_key).alias("__owner"), F.col(name).alias("owner_name"))
    return items.join(first, ref, "left").join(second, "__owner", "left").withColumnRenamed("__owner", "owner")


def latest_before(points: DataFrame, marks: DataFrame, key: str, at: str, value: str, block: float) -> DataFrame:
    """(key, at, value): the last mark at or before each point (an as-of join), null where there is none.

    Points and marks are one union, carried forward inside blocks of time of one key; what a block takes over from the
    blocks before is one row per block. So a key of any size is spread, and nothing is compared pairwise.
    """
    both = points.select(key, at, F.lit(None).cast(marks.schema[value].dataType).alias("v"), F.lit(1).alias("is_point")).unionByName(marks.select(key, at, F.col(value).alias("v"), F.lit(0).alias("is_point")))
    both = both.where(F.col(at).isNotNull()).withColumn("b", F.floor(F.col(at) / block))
    inside = Window.partitionBy(key, "b").orderBy(at, "is_point", F.col("v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    last = both.where("v is not null").groupBy(key, "b").agg(F.max_by("v", F.struct(at, "v")).alias("last"))
    blocks = both.select(key, "b").distinct().join(last, [key, "b"], "left").select(key, "b", F.last("last", ignorenulls=True).over(before).alias("carried"))
    carried = both.withColumn("own", F.last("v", ignorenulls=True).over(inside)).where("is_point = 1")
    return carried.join(blocks, [key, "b"]).select(key, at, F.coalesce("own", "carried").alias("value"))


def preview(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key with the number of rows left out (one aggregate, one limited ranking)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = df.withColumn("place", rank).where(F.col("place") <= most)
    rest = df.groupBy(key).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("left_out"))
    return first.join(rest, key)
