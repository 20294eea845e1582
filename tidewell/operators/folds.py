"""Folds whose next step depends on what was kept: rolling-caption collapse and last-kept deduplication.

``ordered_fold`` repartitions by key, sorts inside the partitions and streams the rows through one small state per
key: a key is never collected, the memory is that of its last kept row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def _arrow_types(schema: str) -> list[pa.DataType]:
    return [f.type for f in to_arrow_schema(_parse_datatype_string(schema))]


def ordered_fold(df: DataFrame, key: str, order: list[str], schema: str, new_state: Callable) -> DataFrame:
    """``new_state()`` gives an object with ``add(row) -> rows`` and ``end() -> rows``, rows as dicts in, as tuples without the key out."""
    fields = [c.strip().split() for c in schema.split(",")]
    names = [f[0] for f in fields]
    types = _arrow_types(schema)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                k = row[key]
                if state is None or k != current:
                    if state is not None:
                        out += [(current, *r) for r in state.end()]
                    current, state = k, new_state()
                out += [(k, *r) for r in state.add(row)]
            if len(out) > 10_000:
                yield as_batch(out)
                out = []
        if state is not None:
            out += [(current, *r) for r in state.end()]
        yield as_batch(out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


# ---------------------------------------------------------------- rolling captions

#: Words two neighbours must share before the overlap is trimmed (fewer if it is all of the new text).
LEAST_OVERLAP = 3


def border(kept: list[str], new: list[str]) -> int:
    """How many words end the kept text and start the new one, at most: the prefix function of new words, a stop, and kept
    words, in linear time."""
    joined: list[str | None] = [*new, None, *kept[-len(new) :]] if new else []
    reach = [0] * len(joined)
    for i in range(1, len(joined)):
        k = reach[i - 1]
        while k and joined[i] != joined[k]:
            k = reach[k - 1]
        reach[i] = k + (joined[i] == joined[k])
    return reach[-1] if reach else 0


def trim_overlap(kept: str, new: str) -> str:
    """The new text without the words that end the kept one and start it, if they are enough or all of it."""
    words = new.split()
    shared = border(kept.split(), words)
    return " ".join(words[shared:]) if shared >= LEAST_OVERLAP or shared == len(words) else new


class RollingCaptions:
    """One open caption as words. What the next cue shares with its end says whether it repeats, grows or follows it.

    A caption ends where its last cue ends, also if an earlier one ended later.
    """

    def __init__(self):
        self.start = self.end_s = 0.0
        self.words: list[str] = []
        self.cues = 0

    def _close(self) -> list[tuple]:
        return [(self.start, self.end_s, " ".join(self.words), self.cues)] if self.cues else []

    def add(self, row: dict) -> list[tuple]:
        new = (row["text"] or "").split()
        if not new:
            return []
        start, end = (round(row[c] or 0.0, 3) for c in ("start_s", "end_s"))
        shared = border(self.words, new)
        done: list[tuple] = []
        if self.cues and self.words == new[: len(self.words)]:
            self.words = new  # it grows, or is the same again
        elif self.cues and (shared == len(new) or self.words[: len(new)] == new):
            pass  # a part of what is there
        else:
            done = self._close()
            self.start, self.words, self.cues = start, new[shared:] if shared >= LEAST_OVERLAP else new, 0
        self.end_s, self.cues = end, self.cues + 1
        return done

    def end(self) -> list[tuple]:
        return self._close()


def rolling_collapse(cues: DataFrame) -> DataFrame:
    """(source_id, start_s, end_s, text, n_cues) of cues with source_id, pos, start_s, end_s, text."""
    slim = cues.select("source_id", "pos", "start_s", "end_s", "text").where("source_id is not null")
    return ordered_fold(slim, "source_id", ["pos", "start_s", "text"], "source_id string, start_s double, end_s double, text string, n_cues int", RollingCaptions)


# ---------------------------------------------------------------- near-equal vectors


class LastKept:
    """Drops a vector whose mean absolute difference from the last KEPT one is at most the threshold."""

    def __init__(self, threshold: float):
        self.threshold, self.kept = threshold, None

    def add(self, row) -> list[tuple]:
        vector = None if row["v"] is None else np.asarray(row["v"], dtype=np.float64)
        if self.kept is not None and vector is not None and len(vector) == len(self.kept) and len(vector) and float(np.mean(np.abs(vector - self.kept))) <= self.threshold:
            return []
        self.kept = vector if vector is not None else self.kept
        return [(row["pos"],)]

    def end(self) -> list[tuple]:
        return []


def last_kept(df: DataFrame, key: str, order: str, vector: str, threshold: float) -> DataFrame:
    """(key, order) of the rows that stay; vectors that cannot be compared stay."""
    slim = df.selectExpr(f"`{key}` as k", f"cast(`{order}` as bigint) as pos", f"`{vector}` as v")
    key_type = df.schema[key].dataType.simpleString()
    kept = ordered_fold(slim, "k", ["pos"], f"k {key_type}, pos bigint", lambda: LastKept(threshold))
    return kept.withColumnRenamed("k", key).withColumnRenamed("pos", order)
