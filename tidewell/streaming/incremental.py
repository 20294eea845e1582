"""Incremental runs: new items since the saved cutoff of each scope, by micro-batches or single calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators import collections as C
from tidewell.sources import pages

STATE = "scope string, last_seen_id string, last_seen_created_at string"


def process_batch(batch: DataFrame, state_path: str, sink) -> None:
    """Hands the new items to ``sink``, then advances the state from the whole batch, before any later filter.

    The state is a versioned table: a crash before the pointer moves repeats the batch, it never loses the cutoff.
    """
    spark = batch.sparkSession
    state = pages.read_state(spark, state_path, STATE)
    advanced = C.advance_state(batch, state).collect()  # one row per scope
    sink(C.since_last(batch, state))
    pages.replace_state(spark.createDataFrame(advanced, STATE), state_path)


def start(stream: DataFrame, state_path: str, checkpoint: str, sink) -> StreamingQuery:
    """A streaming query over feed rows (scope, pos, id, created_at, ...), each micro-batch handled once."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: process_batch(df, state_path, sink)).trigger(availableNow=True).start()
