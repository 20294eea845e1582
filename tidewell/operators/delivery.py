"""At-least-once deliveries: keep one copy of each message, and screen new batches against stored ones.

Messages are partitioned by (bare identifier, source name), ranked by arrival and the first is kept.
Ranking keeps only rank 1, for which Spark plans a group limit before the exchange: of a hot identifier
one row per input partition is shuffled, so an identifier that holds a third of all rows is no hot task.
The rows that must go are found by an anti-join on the unique arrival number, whose keys are never skewed.

Defined results
- identifier or source null or blank: the row is never dropped and never counts as an earlier row;
- equal arrival numbers: rows that are equal in every key column count as one row (``drop_repeats``
  keeps all rows with the kept number);
- arrival number null: the row is never dropped, and counts as later than all others
- an empty table gives an empty result; other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY, _SRC, _RANK = "__message_key", "__message_source", "__message_rank"
#: Whatever wraps an identifier (blanks, a scheme, a path, a query string) is cut off; letter case stays.
_BARE = r"([0-9A-Za-z_\-]+)[^0-9A-Za-z_\-]*$"


def bare_identifier(raw: Column) -> Column:
    """The identifier without what is wrapped around it; null if there is none.

    ``id:7``, ``post/7``, ``https://host/i/web/status/7?s=20``, ``" 7\\n"`` and ``7`` all give ``7``.
    """
    without_query = F.regexp_replace(F.regexp_replace(raw, r"(?<=\S)[?#].*$", ""), r"[/\s]+$", "")
    bare = F.regexp_extract(without_query, _BARE, 1)
    return F.nullif(bare, F.lit(""))


def source_key(raw: Column) -> Column:
    """Source names compare without letter case and outer blanks; blank names are null."""
    return F.nullif(F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")), F.lit(""))


def _keyed(df: DataFrame, id_col: str, source_col: str, arrival_col: str) -> DataFrame:
    return df.select(
        bare_identifier(F.col(id_col)).alias(_KEY), source_key(F.col(source_col)).alias(_SRC), F.col(arrival_col)
    ).where(F.col(_KEY).isNotNull() & F.col(_SRC).isNotNull())


def first_deliveries(df: DataFrame, id_col: str = "id", source_col: str = "source", arrival_col: str = "row_id") -> DataFrame:
    """(key, source, arrival) of the one copy kept of each message."""
    order = Window.partitionBy(_KEY, _SRC).orderBy(F.col(arrival_col).asc_nulls_last())
    ranked = _keyed(df, id_col, source_col, arrival_col).withColumn(_RANK, F.row_number().over(order))
    return ranked.where(F.col(_RANK) == 1).drop(_RANK)


def repeated_deliveries(df: DataFrame, id_col: str = "id", source_col: str = "source", arrival_col: str = "row_id") -> DataFrame:
    """Arrival numbers of the rows that must go; rows without a number cannot be named and are never among them."""
    kept = first_deliveries(df, id_col, source_col, arrival_col).select(arrival_col)
    keyed = _keyed(df, id_col, source_col, arrival_col).select(arrival_col).where(F.col(arrival_col).isNotNull())
    return keyed.join(kept, arrival_col, "left_anti").distinct()


def drop_repeats(df: DataFrame, id_col: str = "id", source_col: str = "source", arrival_col: str = "row_id") -> DataFrame:
    """All columns of ``df``, without the repeated deliveries."""
    gone = repeated_deliveries(df, id_col, source_col, arrival_col)
    return df.join(gone, arrival_col, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def new_messages(batch: DataFrame, stored: DataFrame, id_col: str = "id", source_col: str = "source", arrival_col: str = "row_id") -> DataFrame:
    """First copies in ``batch`` whose identifier is not among the ``stored`` rows (an anti-join on the keys).

    The stored side is reduced to distinct keys before the join, with partial aggregation before the shuffle.
    """
    seen = _keyed(stored, id_col, source_col, arrival_col).select(_KEY, _SRC).distinct()
    fresh = first_deliveries(batch, id_col, source_col, arrival_col).join(seen, [_KEY, _SRC], "left_anti")
    return fresh.select(arrival_col, F.col(_KEY).alias("message_id"), F.col(_SRC).alias("message_source"))
