"""Caption files (VTT, SRT) and transcription responses as rows of cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import clock, text

#: A cue's time line with what follows it up to a blank line; hours may be missing.
CUE = r"(?m)^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})[^\n]*\n((?:(?!\s*\n)[^\n]+\n?)*)"


def read_caption_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, raw): whole files; the name of a file is its source."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source_id"), F.col("value").alias("raw"))


def _all(raw: Column, group: int) -> Column:
    return F.regexp_extract_all(F.regexp_replace(raw, "\r\n?", "\n"), F.lit(CUE), F.lit(group))


def parse_cues(files: DataFrame) -> DataFrame:
    """(source_id, pos, start_s, end_s, text): cues with text, markup taken off; files without cues give none."""
    zipped = F.arrays_zip(_all(F.col("raw"), 1).alias("a"), _all(F.col("raw"), 2).alias("b"), _all(F.col("raw"), 3).alias("t"))
    rows = files.select("source_id", F.posexplode(zipped).alias("pos", "c"))
    cues = rows.select("source_id", "pos", clock.parse_cue_time(F.col("c.a")).alias("start_s"), clock.parse_cue_time(F.col("c.b")).alias("end_s"), text.strip_markup(F.col("c.t")).alias("text"))
    return cues.where("text <> ''")


RESPONSE = "segments array<struct<start:double,end:double,text:string>>, text string"


def segments_of_responses(responses: DataFrame, offset: Column) -> DataFrame:
    """(source_id, pos, start_s, end_s, text) from JSON responses: segments moved by the offset, or the whole text as one."""
    read = responses.select("source_id", offset.alias("o"), F.from_json("raw", RESPONSE, {"mode": "PERMISSIVE"}).alias("r"))
    trimmed = F.filter(F.coalesce("r.segments", F.array().cast("array<struct<start:double,end:double,text:string>>")), lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    alone = F.when(F.trim(F.coalesce("r.text", F.lit(""))) != "", F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.col("r.text").alias("text"))))
    rows = read.select("source_id", "o", F.posexplode(F.when(F.size(trimmed) > 0, trimmed).otherwise(alone)).alias("pos", "s"))
    moved = lambda c: F.round(F.coalesce(F.col(f"s.{c}"), F.lit(0.0)) + F.col("o"), 3)
    return rows.select("source_id", "pos", moved("start").alias("start_s"), moved("end").alias("end_s"), F.trim("s.text").alias("text"))


#: Positions of a transcript that are written into one part.
PART = 5_000


def transcript_markdown(segments: DataFrame) -> DataFrame:
    """(source_id, part, markdown): ``[MM:SS] text`` lines in order; blank texts are left out. The parts of a transcript,
    one after the other, are its file: no value holds more than ``PART`` positions."""
    line = F.concat(F.lit("["), clock.format_clock(F.col("start_s")), F.lit("] "), F.trim("text"))
    part = F.floor(F.col("pos") / PART).alias("part")
    rows = segments.where("trim(text) <> ''").select("source_id", part, F.struct("pos", line.alias("line")).alias("x"))
    return rows.groupBy("source_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("markdown"))
