"""Even samples with both ends, fallbacks for thin groups, and union with pinned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import blocks


def even_sample(df: DataFrame, key: str, order: list[str], most: int, block: Column) -> DataFrame:
    """Up to ``most`` rows per key, evenly spread over its order, first and last among them.

    A row's place is compared with the one place its slot asks for, so no list of places is built and no row is
    collected (``block`` as in ``blocks``): row i of n is slot round(i * (most-1) / (n-1)) if that slot's place rounds back to i.
    """
    numbered = blocks.with_place(df, key, order, block, "__i").withColumnRenamed("__i_of", "__n").withColumn("__i", F.col("__i") - 1)
    last, slots = F.col("__n") - 1, F.lit(most - 1)
    near = F.floor(F.col("__i") * slots / last).cast("bigint")
    wanted = [F.bround(slot * last / slots, 0) == F.col("__i") for slot in (near - 1, near, near + 1, near + 2)]
    valid = [(slot >= 0) & (slot <= slots) for slot in (near - 1, near, near + 1, near + 2)]
    hit = F.lit(False)
    for w, v in zip(wanted, valid):
        hit |= w & v
    keep = (F.col("__n") <= most) | (F.col("__i") == 0 if most <= 1 else hit)
    return numbered.where(keep).drop("__i", "__n")


def min_count_fallback(first: DataFrame, second: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of ``first`` for keys that have at least ``least`` of them, else the rows of ``second``; with ``fallback``."""
    counts = first.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(key)
    enough = first.join(counts, key, "left_semi").withColumn("fallback", F.lit(False))
    return enough.unionByName(second.join(counts, key, "left_anti").withColumn("fallback", F.lit(True)))


def merge_pinned(sampled: DataFrame, pinned: DataFrame, key: str, at: str, tie: str, block: Column) -> DataFrame:
    """Union ordered by time, sampled rows first on ties, numbered from 1 per key; pinned rows are never dropped."""
    both = sampled.withColumn("pinned", F.lit(0)).unionByName(pinned.withColumn("pinned", F.lit(1)))
    return blocks.with_place(both, key, [F.col(at).asc_nulls_last(), "pinned", tie], block, "index").drop("index_of")


def remaining_budget(most: Column, pinned: Column) -> Column:
    return F.greatest(F.lit(0), most - pinned)
