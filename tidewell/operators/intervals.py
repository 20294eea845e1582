"""Intervals on one axis: overlap with a range, length of a union, flags, plans of equal chunks, shifts.

All operators are windows or aggregates over columns; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import blocks


def overlaps(start: Column, end: Column, low: float | None = None, high: float | None = None) -> Column:
    """Touching counts; an open side of the range is infinite; null ends count as 0."""
    met = F.lit(True)
    if low is not None:
        met &= F.coalesce(end, F.lit(0.0)) >= F.lit(float(low))
    if high is not None:
        met &= F.coalesce(start, F.lit(0.0)) <= F.lit(float(high))
    return met


#: Seconds of a block in which intervals are compared (results do not depend on it).
BLOCK_S = 6 * 3600.0


def union_length(df: DataFrame, key: str, start: str, end: str, block_s: float = BLOCK_S) -> DataFrame:
    """(key, covered, total): length of the union of each key's intervals and the sum of their lengths.

    The running maximum of the ends before an interval says how much of it is new. It runs inside blocks of start times and
    is carried from block to block, so a key of any size is spread.
    """
    real = df.select(F.col(key).alias("k"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")).where("e > s")
    seen = blocks.with_running(real, "k", ["s", "e"], F.floor(F.col("s") / block_s), F.col("e"), "before", "max", itself=False)
    fresh = F.greatest(F.lit(0.0), F.col("e") - F.greatest("s", F.coalesce("before", "s")))
    spans = seen.select("k", fresh.alias("new"), (F.col("e") - F.col("s")).alias("raw"))
    return spans.groupBy("k").agg(F.round(F.sum("new"), 3).alias("covered"), F.round(F.sum("raw"), 3).alias("total")).withColumnRenamed("k", key)


def coverage_ratio(covered: Column, duration: Column) -> Column:
    """At most 1; null without a positive duration."""
    return F.when(duration > 0, F.round(F.least(F.lit(1.0), covered / duration), 4))


def is_insufficient(n: Column, covered: Column, duration: Column, least: float = 0.5, short: float = 30.0) -> Column:
    """No rows always, unknown or short durations never, else a ratio under the least."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, True).when(duration.isNull() | (duration < short), False).otherwise(
        F.coalesce(coverage_ratio(F.coalesce(covered, F.lit(0.0)), duration), F.lit(0.0)) < least
    )


def chunk_plan(df: DataFrame, seconds: str, size: str, most: int) -> DataFrame:
    """One row per chunk (chunk_no, offset_s, length_s): as many equal parts as keep each at most ``most`` bytes; the last takes the rest."""
    n = F.when((F.col(size) <= most) | (F.col(seconds) <= 0), F.lit(1)).otherwise(F.ceil(F.col(size) / most)).cast("int")
    whole = F.col(seconds).cast("double")
    parts = df.withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    step = whole / F.col("n_chunks")
    offset = F.col("chunk_no") * step
    length = F.when(F.col("chunk_no") == F.col("n_chunks") - 1, whole - offset).otherwise(step)
    return parts.withColumn("offset_s", F.round(offset, 3)).withColumn("length_s", F.round(length, 3))


def shift(df: DataFrame, by: Column, start: str = "start_s", end: str = "end_s", text: str = "text") -> DataFrame:
    """Blank rows away, texts trimmed, times moved (null times count as 0)."""
    clean = F.trim(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    moved = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)) + by, 3)
    return df.withColumn(text, clean).where(F.col(text) != "").withColumn(start, moved(start)).withColumn(end, moved(end))


def in_window(df: DataFrame, key: str, at: str, low: float, high: float) -> DataFrame:
    """Per key: distinct points (2 decimals) in the closed window, in order, and how many fell outside."""
    points = df.select(key, F.round(F.col(at), 2).alias("p")).distinct()
    inside = F.col("p").between(low, high)
    return points.groupBy(key).agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"), F.min(F.when(inside, F.col("p"))).alias("first_kept"), F.max(F.when(inside, F.col("p"))).alias("last_kept"))


# ---------------------------------------------------------------- plans of sampling

#: The most frames, the highest rate, and the ladders (seconds up to -> frames).
MOST_FRAMES, MOST_FPS = 100, 2.0
WHOLE_LADDER = ((60, 40), (180, 60), (600, 80))
FOCUS_LADDER = ((30, 60), (60, 80))


def frame_cap(most: Column) -> Column:
    return F.greatest(F.lit(1), F.least(most.cast("int"), F.lit(MOST_FRAMES)))


def frame_target(duration: Column, cap: Column, focused: bool) -> Column:
    """Frames wanted for a duration: a ladder, denser for a focused range."""
    if focused:
        steps = F.when(duration <= 5, F.greatest(F.lit(8), F.ceil(duration * 2).cast("int"))).when(duration <= 15, F.greatest(F.lit(20), F.ceil(duration * 2).cast("int")))
        ladder = FOCUS_LADDER
    else:
        steps, ladder = F.when(duration <= 30, F.greatest(F.lit(12), F.bround(duration, 0).cast("int"))), WHOLE_LADDER
    for top, frames in ladder:
        steps = steps.when(duration <= top, F.lit(frames))
    return F.least(cap, steps.otherwise(cap))


def frame_plan(duration: Column, most: Column, focused: bool = False) -> Column:
    """struct<fps double, frames int>: the rate for the target, and how many frames it gives; without a duration the target alone."""
    cap = frame_cap(most)
    unknown = duration.isNull() | (duration <= 0)
    fps = F.least(F.lit(MOST_FPS), F.greatest(F.lit(0.001), frame_target(duration, cap, focused).cast("double") / duration))
    frames = F.greatest(F.lit(1), F.least(cap, F.ceil(fps * duration).cast("int")))
    alone = F.least(cap, F.lit(12)) if focused else cap
    return F.struct(F.when(unknown, F.lit(1.0)).otherwise(fps).alias("fps"), F.when(unknown, alone).otherwise(frames).alias("frames"))


#: The interval of regular samples, and the duration beyond which a whole range is sampled thinly.
INTERVAL_S, SPARSE_S = 5.0, 600.0


def expected_frames(duration: Column, interval: Column, most: Column) -> Column:
    """Samples of a regular interval, the one at 0 counted; the cap without a duration; null for an interval that is none."""
    cap = frame_cap(most)
    n = F.greatest(F.lit(1), F.least(cap, F.ceil(duration / interval).cast("int") + 1))
    return F.when(interval > 0, F.when(duration > 0, n).otherwise(cap))


def sampling_plan(duration: Column, most: Column, focused: bool, mode: Column, interval: Column, fps: Column) -> Column:
    """struct<mode, fps, interval_s, frames, warning, error>: a wished rate wins, then a regular interval, then the ladders.

    Wishes that make no sense give an error and no plan; a rate above the highest is lowered, with a warning.
    """
    cap = frame_cap(most)
    auto = frame_plan(duration, most, focused)
    rate = F.least(fps, F.lit(MOST_FPS))
    by_rate = F.when(duration > 0, F.greatest(F.lit(1), F.least(cap, F.ceil(rate * duration).cast("int")))).otherwise(cap)
    error = F.when(~mode.isin("auto", "interval"), "unknown mode").when(interval <= 0, "empty interval").when(fps <= 0, "empty rate")
    regular = mode == "interval"
    chosen = F.when(fps.isNotNull(), "fps").when(regular, "interval").otherwise("auto")
    used = F.when(fps.isNotNull(), rate).when(regular, 1.0 / interval).otherwise(auto["fps"])
    frames = F.when(fps.isNotNull(), by_rate).when(regular, expected_frames(duration, interval, most)).otherwise(auto["frames"])
    warning = F.when(fps > MOST_FPS, "rate lowered").when(fps.isNull() & ~regular & (duration > SPARSE_S) & F.lit(not focused), "sparse")
    ok = error.isNull()
    return F.struct(
        F.when(ok, chosen).alias("mode"), F.when(ok, used).alias("fps"), F.when(ok, F.when((fps.isNull()) & regular, interval).otherwise(1.0 / used)).alias("interval_s"),
        F.when(ok, frames).alias("frames"), F.when(ok, warning).alias("warning"), error.alias("error"),
    )
