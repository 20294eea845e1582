"""Lists, maps and small plans as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import clock


def clock_list(text: Column) -> Column:
    """Sorted distinct seconds of a comma-separated list of clock texts; parts that are none are left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: clock.parse_clock(p))
    return F.array_sort(F.array_distinct(F.array_compact(parts)))


def all_numbers_after(text: Column, label: str) -> Column:
    """Every number behind ``label:`` in a log text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"{label}:\s*(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double"))


def ordered_append(items: Column, extra: Column) -> Column:
    """The list with what it lacks at its end, without repeats."""
    return F.array_union(F.coalesce(items, F.array().cast("array<string>")), F.coalesce(extra, F.array().cast("array<string>")))


def has_repeats(items: Column) -> Column:
    return F.size(F.array_distinct(items)) != F.size(items)


def key_subset(values: Column, keys: Sequence[str]) -> Column:
    """Entries of the named keys whose values are neither null nor empty."""
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(values, lambda k, v: F.array_contains(wanted, k) & (F.coalesce(v, F.lit("")) != ""))


def first_map_with(key: Column, maps: dict[str, Column], otherwise: str = "unknown") -> Column:
    """The name of the first map that has the key."""
    out = None
    for name, m in maps.items():
        met = F.coalesce(F.map_contains_key(m, key), F.lit(False))
        out = F.when(met, F.lit(name)) if out is None else out.when(met, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def problem_summary(title: Column, detail: Column, kind: Column, otherwise: Column) -> Column:
    """The parts that are there, joined; else the other text."""
    parts = F.concat_ws(" - ", *[F.nullif(F.trim(c), F.lit("")) for c in (title, detail, kind)])
    return F.coalesce(F.nullif(parts, F.lit("")), otherwise)


def reset_time(header: Column) -> Column:
    """Local text of an epoch header; a header that is no number stays as it is."""
    seconds = F.trim(header).try_cast("bigint")
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), header)


def priority(name: Column, suffixes: Sequence[str]) -> Column:
    """Place of a file's suffix in a list of preferences; null if it is none of them."""
    place = F.array_position(F.array(*[F.lit(s) for s in suffixes]), F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)))
    return F.nullif(place, F.lit(0))


def sidecar_rank(name: Column) -> Column:
    """Order among sidecar captions: format before language, files without a language between, then the name."""
    from tidewell.functions.text import language_of_file, language_rank

    lang = language_of_file(name)
    return F.struct(priority(name, (".vtt", ".srt")).alias("format"), F.when(lang.isNull(), 50).otherwise(language_rank(lang)).alias("language"), name.alias("name"))


def clip_range(start: Column, end: Column, duration: Column, total: Column) -> Column:
    """struct<start_s, end_s, length_s, error>: a range from any two of its parts, within the total; errors are values."""
    low = F.coalesce(start, F.when(end.isNotNull() & duration.isNotNull(), end - duration), F.lit(0.0))
    high = F.coalesce(end, F.when(duration.isNotNull(), low + duration), total)
    error = (
        F.when(start < 0, "negative start").when(duration <= 0, "empty duration").when(end.isNotNull() & duration.isNotNull() & start.isNotNull(), "end and duration")
        .when(high <= low, "end before start").when(total.isNotNull() & (low >= total), "start behind the end")
    )
    inside = F.when(total.isNotNull(), F.least(high, total)).otherwise(high)
    return F.struct(low.alias("start_s"), inside.alias("end_s"), (inside - low).alias("length_s"), error.alias("error"))


def section(start: Column, end: Column) -> Column:
    """A range as ``from-to`` clock texts, for finite ends only."""
    def text(c):
        t = F.bround(c, 0).cast("bigint")
        return F.format_string("%02d:%02d:%02d", F.floor(t / 3600).cast("bigint"), F.floor(F.pmod(t, F.lit(3600)) / 60).cast("bigint"), F.pmod(t, F.lit(60)))

    return F.when(start.isNotNull() & end.isNotNull() & (end > start), F.concat(text(start), F.lit("-"), text(end)))
