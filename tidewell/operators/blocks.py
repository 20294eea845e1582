"""Places and running values of keys of any size: a key's rows are worked on in blocks of its order.

A window over a key sorts all rows of it in one task, so a key with a third of all rows is one hot task. Where the first
column of the order has a monotone ``block`` (a day, a range of numbers), rows are ranked or carried inside their block, and
what a block takes over from those before is one slim row per block, computed over the blocks of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B, _OFFSET, _CARRIED = "__block", "__offset", "__carried"


def blocked(df: DataFrame, block: Column) -> DataFrame:
    """Adds the block as a number that is never null: unknown ones come last."""
    return df.withColumn(_B, F.coalesce(block.cast("bigint"), F.lit((1 << 63) - 1)))


def _joined(df: DataFrame, per_block: DataFrame, key: str) -> DataFrame:
    """Rows with what their block takes over; keys may be null."""
    other = per_block.select(F.col(key).alias("__k"), F.col(_B).alias("__b"), *[c for c in per_block.columns if c not in (key, _B)])
    return df.join(other, F.col(key).eqNullSafe(F.col("__k")) & (F.col(_B) == F.col("__b"))).drop("__k", "__b")


def with_place(df: DataFrame, key: str, order: list, block: Column, name: str) -> DataFrame:
    """Adds the row's number in its key by ``order``, from 1 on, and ``<name>_of``, the number of rows of the key."""
    rows = blocked(df, block)
    before = Window.partitionBy(key).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(key, _B).agg(F.count("*").alias("n"))
    offsets = counts.select(key, _B, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_OFFSET), F.sum("n").over(Window.partitionBy(key)).alias(f"{name}_of"))
    own = F.row_number().over(Window.partitionBy(key, _B).orderBy(*order))
    return _joined(rows.withColumn(name, own), offsets, key).withColumn(name, F.col(name) + F.col(_OFFSET)).drop(_B, _OFFSET)


def with_running(df: DataFrame, key: str, order: list, block: Column, value: Column, name: str, how: str, itself: bool) -> DataFrame:
    """Adds the largest (``how`` max) or last known (``last``) value of the rows before, and of the row ``itself`` if wanted."""
    rows = blocked(df, block).withColumn("__v", value)
    upto = Window.partitionBy(key, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    before = Window.partitionBy(key).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    if how == "max":
        per = rows.groupBy(key, _B).agg(F.max("__v").alias("__last")).withColumn(_CARRIED, F.max("__last").over(before))
        own = F.greatest(F.max("__v").over(upto), F.col(_CARRIED))
    else:
        place = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order])
        per = rows.groupBy(key, _B).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), place)).alias("__last")).withColumn(_CARRIED, F.last("__last", ignorenulls=True).over(before))
        own = F.coalesce(F.last("__v", ignorenulls=True).over(upto), F.col(_CARRIED))
    return _joined(rows, per.drop("__last"), key).withColumn(name, own).drop(_B, _CARRIED, "__v")
