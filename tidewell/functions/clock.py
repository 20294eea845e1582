"""Times and durations as Column expressions: clock texts, mixed timestamps, human durations, calendar versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE = "double"


def parse_clock(text: Column) -> Column:
    """Seconds from ``SS``, ``MM:SS`` or ``HH:MM:SS`` (parts may have decimals); null for anything else."""
    value = F.trim(text)
    parts = F.transform(F.split(value, ":"), lambda p: p.try_cast(DOUBLE))
    seconds = F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + p)
    return F.when(value.rlike(r"^\d+(\.\d+)?(:\d+(\.\d+)?){0,2}\z"), seconds)


def parse_cue_time(text: Column) -> Column:
    """Seconds of a cue time ``[HH:]MM:SS[.,]mmm``."""
    return parse_clock(F.regexp_replace(text, ",", "."))


def _whole(seconds: Column) -> Column:
    return F.bround(seconds, 0).cast("bigint")


def format_clock(seconds: Column) -> Column:
    """``MM:SS``, or ``H:MM:SS`` from one hour on; ``unknown`` for null."""
    t = _whole(seconds)
    hours, minutes, rest = F.floor(t / 3600).cast("bigint"), F.floor(F.pmod(t, F.lit(3600)) / 60).cast("bigint"), F.pmod(t, F.lit(60))
    text = F.when(t >= 3600, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%02d:%02d", minutes, rest))
    return F.when(seconds.isNull(), F.lit("unknown")).otherwise(text)


def clock_name(seconds: Column) -> Column:
    """``HHhMMmSSs`` for names of files, not below zero."""
    t = F.greatest(_whole(seconds), F.lit(0))
    return F.format_string("%02dh%02dm%02ds", F.floor(t / 3600).cast("bigint"), F.floor(F.pmod(t, F.lit(3600)) / 60).cast("bigint"), F.pmod(t, F.lit(60)))


def mixed_timestamp(text: Column) -> Column:
    """A timestamp from epoch seconds, epoch milliseconds (above 1e10) or ISO text without zone (UTC) or with one."""
    value = F.trim(text)
    number = value.try_cast(DOUBLE)
    iso = value.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?)?\z")
    micros = F.bround(F.when(number > 1e10, number * 1e3).otherwise(number * 1e6), 0).cast("bigint")
    return F.when(number.isNotNull(), F.timestamp_micros(micros)).when(iso, value.try_cast("timestamp"))


def human_duration(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` without zero parts; ``0s`` for nothing or less."""
    t = F.greatest(_whole(seconds), F.lit(0))
    d, h = F.floor(t / 86400).cast("bigint"), F.floor(F.pmod(t, F.lit(86400)) / 3600).cast("bigint")
    m, s = F.floor(F.pmod(t, F.lit(3600)) / 60).cast("bigint"), F.pmod(t, F.lit(60))
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    return F.when(seconds.isNull(), None).when(t == 0, F.lit("0s")).otherwise(F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"), part(s, "s")))


def window_label(minutes: Column) -> Column:
    """Whole days, else whole hours, else minutes; ``unknown`` for null."""
    text = minutes.cast("string")
    return (
        F.when(minutes.isNull(), F.lit("unknown"))
        .when(minutes % 1440 == 0, F.concat((minutes / 1440).cast("bigint").cast("string"), F.lit("d ("), text, F.lit(" minutes)")))
        .when(minutes % 60 == 0, F.concat((minutes / 60).cast("bigint").cast("string"), F.lit("h ("), text, F.lit(" minutes)")))
        .otherwise(F.concat(text, F.lit(" minutes")))
    )


def retry_after(text: Column, now: Column) -> Column:
    """Delay in seconds from a number or an HTTP date, not below zero; null if it is neither."""
    number = F.trim(text).try_cast(DOUBLE)
    date = F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    return F.greatest(F.coalesce(number, (F.unix_micros(date) - F.unix_micros(now)) / 1e6), F.lit(0.0))


def backoff(attempt: Column, after: Column | None = None, base: float = 1.0, most: float = 12.0) -> Column:
    """Exponential delay by attempt number from 1 on, or the server's wish, capped."""
    own = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    return F.least(F.lit(most), F.coalesce(after, own) if after is not None else own)


def calver_parts(version: Column) -> Column:
    """struct<d date, seq int, valid boolean> of ``YYYY.M.D[.N]`` without leading zeros, a real date, N from 1 on."""
    shape = version.rlike(r"^[0-9]{4}\.[1-9][0-9]?\.[1-9][0-9]?(\.[1-9][0-9]*)?\z")
    day = F.when(shape & (F.substring(version, 1, 4) >= "0001"), F.try_to_date(F.regexp_extract(version, r"^(\d{4}\.\d+\.\d+)", 1), "yyyy.M.d"))
    number = F.nullif(F.regexp_extract(version, r"^\d{4}\.\d+\.\d+\.(\d+)\z", 1), F.lit("")).try_cast("int")
    return F.struct(day.alias("d"), F.when(day.isNotNull(), number).alias("seq"), day.isNotNull().alias("valid"))


def calver_text(day: Column, seq: Column) -> Column:
    """``YYYY.M.D``, with the sequence number if there is one."""
    base = F.format_string("%04d.%d.%d", F.year(day), F.month(day), F.day(day))
    return F.when(seq.isNull(), base).otherwise(F.concat(base, F.lit("."), seq.cast("string")))


def next_calver(version: Column, today: Column) -> Column:
    """The day's first version after an older one, the next number on the same day; null if today lies before it."""
    now = calver_parts(version)
    later = calver_text(today, F.lit(None).cast("int"))
    return F.when(now["d"] < today, later).when(now["d"] == today, calver_text(today, F.coalesce(now["seq"], F.lit(0)) + 1))


def local_text(at: Column, zone: str) -> Column:
    """``YYYY-MM-DD HH:MM:SS +HH:MM`` in a zone: the clock there and its distance from UTC at that time."""
    there = F.from_utc_timestamp(at, zone)
    minutes = F.bround((F.unix_micros(there) - F.unix_micros(at)) / 6e7, 0).cast("bigint")
    apart = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("bigint"), F.abs(minutes) % 60)
    return F.concat(F.date_format(there, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), apart)


def remaining(at: Column, now: Column) -> Column:
    """Human duration from now to a time; ``0s`` if it has passed."""
    return human_duration((F.unix_micros(at) - F.unix_micros(now)) / 1e6)
