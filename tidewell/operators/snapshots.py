"""Latest snapshots in event logs, and lists ordered by expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import blocks
from tidewell.session import cut

#: Parts of a key in a join with its one row.
SALTS = 16


def latest_snapshot(events: DataFrame, key: str, order: str, is_snapshot: Column, value: Column, carried: Column) -> DataFrame:
    """(key, order, value, carried): the last snapshot event of each key with the last carried value seen up to it.

    No window: the snapshot's place is one aggregate, the carried value a second one over events up to that place, and
    both combine before the shuffle. Only events with a carried value meet the place in a join, spread by ``SALTS``, so a
    key with a third of all events is no hot task.
    """
    marked = events.select(F.col(key).alias("k"), F.col(order).alias("o"), is_snapshot.alias("is_snapshot"), value.alias("value"), carried.alias("carried"))
    # most events are neither: what is looked at twice is read and parsed once, and written slim
    marked = cut(marked.where("is_snapshot or carried is not null"), "snapshots")
    last = marked.where("is_snapshot").groupBy("k").agg(F.max_by(F.struct("o", "value"), "o").alias("s")).select("k", F.col("s.o").alias("at"), F.col("s.value").alias("value"))
    places = last.select("k", "at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    carrying = marked.where("carried is not null").withColumn("salt", F.pmod(F.xxhash64("o"), F.lit(SALTS)).cast("int"))
    carry = carrying.join(places, ["k", "salt"]).where("o <= at").groupBy("k").agg(F.max_by("carried", "o").alias("carried"))
    return last.join(carry, "k", "left").select(F.col("k").alias(key), F.col("at").alias(order), "value", "carried")


def latest_partition(snapshots: DataFrame, scope: Column, at: Column, value: Column) -> DataFrame:
    """(scope, value) of the newest partition that has a snapshot."""
    return snapshots.groupBy(scope.alias("scope")).agg(F.max_by(value, at).alias("value"))


def forward_fill(df: DataFrame, key: str, order: list[str], column: str, into: str, block: Column) -> DataFrame:
    """The last value that is neither null nor empty up to and with each row; ``block`` as in ``blocks``."""
    return blocks.with_running(df, key, order, block, F.nullif(F.col(column), F.lit("")), into, "last", itself=True)


def expiry_order(df: DataFrame, key: str, expires: str, index: str) -> DataFrame:
    """Numbers the rows of each key by expiry, unknown ones last, ties in the given order; days are the blocks."""
    placed = blocks.with_place(df, key, [F.col(expires).asc_nulls_last(), index], F.unix_date(F.col(expires).cast("date")), "expiry_no")
    return placed.drop("expiry_no_of")


def next_expiring(df: DataFrame, key: str, status: str, expires: str, index: str, wanted: str = "available") -> DataFrame:
    """(key, next_index, n_wanted, n_all): the wanted row that expires first, else the first row; two mergeable aggregates."""
    rank = F.struct((F.coalesce(F.col(status), F.lit("")) != wanted).alias("other"), F.col(expires).isNull().alias("unknown"), F.col(expires), F.col(index))
    return df.groupBy(key).agg(F.min_by(index, rank).alias("next_index"), F.count_if(F.col(status) == wanted).alias("n_wanted"), F.count("*").alias("n_all"))
