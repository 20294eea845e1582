"""Registered queries of the interval, sampling, collection, snapshot and rule operators, each with its SQL.

Every query runs over its whole tables. Floats are rounded to 3 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import clock, jsonx, lists, text
from tidewell.operators import collections as C
from tidewell.operators import blocks, folds, intervals, lookups, rules, sampling, snapshots
from tidewell.sources import cues, eventlog, pages
from tidewell.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOST = "x.com.example"


def query(sql: str | None = None, queries: dict = QUERIES, statements: dict[str, str] = SQL):
    def register(f):
        queries[f.__name__] = f
        if sql:
            statements[f.__name__] = sql
        return f

    return register


def _event_spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", "user_id", "event_type", start.alias("start_s"), (start + 60 * F.col("value")).alias("end_s"), "value")


_SPANS = "SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + 60 * value AS end_s, value FROM events"


# ---------------------------------------------------------------- intervals


@query(f"""WITH spans AS ({_SPANS}), marked AS (
  SELECT *, max(end_s) OVER (PARTITION BY user_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM spans WHERE end_s > start_s
), per AS (SELECT user_id, count(*) AS n, round(sum(greatest(0, end_s - greatest(start_s, coalesce(seen, start_s)))), 3) AS covered, round(sum(end_s - start_s), 3) AS total FROM marked GROUP BY user_id)
SELECT user_id, covered, total, round(least(1.0, covered / total), 4) AS ratio, CASE WHEN total < 30 THEN false ELSE covered / total < 0.5 END AS insufficient FROM per""")
def interval_coverage(spark, d):
    per = intervals.union_length(_event_spans(spark, d), "user_id", "start_s", "end_s")
    return per.select("user_id", "covered", "total", intervals.coverage_ratio(F.col("covered"), F.col("total")).alias("ratio"), intervals.is_insufficient(F.lit(1), F.col("covered"), F.col("total")).alias("insufficient"))


@query("""WITH spans AS (SELECT source_id, start_s, end_s FROM transcript_segments WHERE end_s > start_s AND source_id IS NOT NULL), marked AS (
  SELECT *, max(end_s) OVER (PARTITION BY source_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM spans
), per AS (SELECT source_id, round(sum(greatest(0, end_s - greatest(start_s, coalesce(seen, start_s)))), 3) AS covered FROM marked GROUP BY source_id),
dur AS (SELECT id AS source_id, max(duration) AS duration FROM media_info GROUP BY id)
SELECT t.source_id, coalesce(covered, 0) AS covered, duration, CASE WHEN duration > 0 THEN round(least(1.0, coalesce(covered, 0) / duration), 4) END AS ratio,
  CASE WHEN covered IS NULL THEN true WHEN duration IS NULL OR duration < 30 THEN false ELSE round(least(1.0, covered / duration), 4) < 0.5 END AS insufficient
FROM transcripts t LEFT JOIN per USING (source_id) LEFT JOIN dur USING (source_id)""")
def caption_coverage(spark, d):
    per = intervals.union_length(table(spark, d, "transcript_segments").where("source_id is not null"), "source_id", "start_s", "end_s").select("source_id", "covered")
    durations = table(spark, d, "media_info").groupBy(F.col("id").alias("source_id")).agg(F.max("duration").alias("duration"))
    joined = table(spark, d, "transcripts").select("source_id").join(per, "source_id", "left").join(durations, "source_id", "left")
    covered = F.coalesce("covered", F.lit(0.0))
    return joined.select("source_id", covered.alias("covered"), "duration", intervals.coverage_ratio(covered, F.col("duration")).alias("ratio"),
                         intervals.is_insufficient(F.when(F.col("covered").isNull(), 0).otherwise(1), covered, F.col("duration")).alias("insufficient"))


@query("SELECT source_id, pos, start_s, end_s FROM transcript_segments WHERE coalesce(end_s, 0) >= 30.0 AND coalesce(start_s, 0) <= 90.0")
def interval_overlap_filter(spark, d):
    s = table(spark, d, "transcript_segments")
    return s.where(intervals.overlaps(F.col("start_s"), F.col("end_s"), 30.0, 90.0)).select("source_id", "pos", "start_s", "end_s")


@query("SELECT source_id, pos, round(coalesce(start_s, 0) + 600.5, 3) AS start_s, round(coalesce(end_s, 0) + 600.5, 3) AS end_s, regexp_replace(text, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS text FROM transcript_segments WHERE regexp_replace(text, '[\\s\\x{A0}]+', '', 'g') <> ''")
def segment_shift(spark, d):
    return intervals.shift(table(spark, d, "transcript_segments"), F.lit(600.5)).select("source_id", "pos", "start_s", "end_s", "text")


@query("""WITH n AS (SELECT doc_id, n_chars, n_chars / 16.0 AS seconds, CASE WHEN n_chars <= 4096 OR n_chars <= 0 THEN 1 ELSE CAST(ceil(n_chars / 4096.0) AS INT) END AS n_chunks FROM documents WHERE n_chars IS NOT NULL),
c AS (SELECT *, unnest(range(n_chunks)) AS chunk_no FROM n)
SELECT doc_id, n_chunks, CAST(chunk_no AS INT) AS chunk_no, round(chunk_no * (seconds / n_chunks), 3) AS offset_s,
  round(CASE WHEN chunk_no = n_chunks - 1 THEN seconds - chunk_no * (seconds / n_chunks) ELSE seconds / n_chunks END, 3) AS length_s FROM c""")
def chunk_plan(spark, d):
    docs = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars", (F.col("n_chars") / 16.0).alias("seconds"))
    return intervals.chunk_plan(docs, "seconds", "n_chars", 4096).select("doc_id", "n_chunks", "chunk_no", "offset_s", "length_s")


@query("""WITH p AS (SELECT DISTINCT source_id, CAST(round(CAST(start_s AS DECIMAL(18, 6)), 2) AS DOUBLE) AS p FROM transcript_segments WHERE source_id IS NOT NULL)
SELECT source_id, count(*) FILTER (WHERE p BETWEEN 10 AND 60) AS kept, count(*) FILTER (WHERE NOT (p BETWEEN 10 AND 60)) AS dropped, min(p) FILTER (WHERE p BETWEEN 10 AND 60) AS first_kept, max(p) FILTER (WHERE p BETWEEN 10 AND 60) AS last_kept FROM p GROUP BY source_id""")
def cue_window(spark, d):
    return intervals.in_window(table(spark, d, "transcript_segments").where("source_id is not null"), "source_id", "start_s", 10.0, 60.0)


_LADDER = "CASE WHEN v <= 30 THEN greatest(12, CAST(round_even(v, 0) AS INT)) WHEN v <= 60 THEN 40 WHEN v <= 180 THEN 60 WHEN v <= 600 THEN 80 ELSE 80 END"
_FOCUS = "CASE WHEN v <= 5 THEN greatest(8, CAST(ceil(v * 2) AS INT)) WHEN v <= 15 THEN greatest(20, CAST(ceil(v * 2) AS INT)) WHEN v <= 30 THEN 60 ELSE 80 END"


@query(f"""WITH v AS (SELECT event_id, value AS v FROM events), t AS (SELECT event_id, v, least(80, {_LADDER}) AS a, least(80, {_FOCUS}) AS f FROM v),
r AS (SELECT *, least(2.0, greatest(0.001, a / v)) AS fa, least(2.0, greatest(0.001, f / v)) AS ff FROM t)
SELECT event_id, CASE WHEN v > 0 THEN round(fa, 3) ELSE 1.0 END AS fps, CASE WHEN v > 0 THEN CAST(greatest(1, least(80, ceil(fa * v))) AS INT) ELSE 80 END AS frames,
  CASE WHEN v > 0 THEN round(ff, 3) ELSE 1.0 END AS focus_fps, CASE WHEN v > 0 THEN CAST(greatest(1, least(80, ceil(ff * v))) AS INT) ELSE 12 END AS focus_frames FROM r""")
def frame_plan_ladder(spark, d):
    e = table(spark, d, "events").select("event_id", intervals.frame_plan(F.col("value"), F.lit(80)).alias("a"), intervals.frame_plan(F.col("value"), F.lit(80), focused=True).alias("f"))
    return e.select("event_id", F.round("a.fps", 3).alias("fps"), F.col("a.frames").alias("frames"), F.round("f.fps", 3).alias("focus_fps"), F.col("f.frames").alias("focus_frames"))


# ---------------------------------------------------------------- clocks


@query("""WITH t AS (SELECT event_id, CAST(round_even(epoch_us(ts) / 1e6 - epoch_us(date_trunc('day', ts)) / 1e6, 0) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock, CAST(s AS DOUBLE) AS seconds,
  printf('%02dh%02dm%02ds', s // 3600, (s % 3600) // 60, s % 60) AS name FROM t""")
def time_format_parse(spark, d):
    ts = F.col("ts").cast("timestamp")
    s = (F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts))) / 1e6
    out = table(spark, d, "events").select("event_id", clock.format_clock(s).alias("clock"), clock.clock_name(s).alias("name"))
    return out.withColumn("seconds", clock.parse_clock(F.col("clock")))


@query("""SELECT event_id, m % 4 AS form, CASE WHEN m % 4 = 3 THEN NULL WHEN m % 4 = 2 THEN epoch_us(ts) WHEN m % 4 = 1 THEN CAST(floor(epoch_us(ts) / 1000) * 1000 AS BIGINT) ELSE CAST(floor(epoch_us(ts) / 1000000) * 1000000 AS BIGINT) END AS micros FROM (SELECT *, event_id % 4 AS m FROM events)""")
def timestamp_polymorphic(spark, d):
    ts = F.col("ts").cast("timestamp")
    form = F.col("event_id") % 4
    rendered = F.when(form == 0, F.unix_seconds(ts).cast("string")).when(form == 1, F.unix_millis(ts).cast("string")).when(form == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format(ts, "HH:mm"))
    return table(spark, d, "events").select("event_id", form.alias("form"), F.unix_micros(clock.mixed_timestamp(rendered)).alias("micros"))


@query("""WITH t AS (SELECT event_id, CAST(round_even(value * 1800, 0) AS BIGINT) AS s, CAST(round_even(value, 0) AS BIGINT) AS m FROM events)
SELECT event_id, CASE WHEN s <= 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN (s % 86400) // 3600 > 0 THEN ((s % 86400) // 3600) || 'h' END,
  CASE WHEN (s % 3600) // 60 > 0 THEN ((s % 3600) // 60) || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END) END AS duration,
  CASE WHEN m % 1440 = 0 THEN (m // 1440) || 'd (' || m || ' minutes)' WHEN m % 60 = 0 THEN (m // 60) || 'h (' || m || ' minutes)' ELSE m || ' minutes' END AS window_text FROM t""")
def human_duration(spark, d):
    return table(spark, d, "events").select("event_id", clock.human_duration(F.col("value") * 1800).alias("duration"), clock.window_label(F.bround("value", 0).cast("bigint")).alias("window_text"))


@query("""SELECT o_orderkey, least(12.0, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 20 ELSE pow(2, o_orderkey % 6) END) AS delay,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 90 AS DOUBLE) ELSE 60.0 END AS wish FROM orders""")
def retry_delay(spark, d):
    k = F.col("o_orderkey")
    after = F.when(k % 3 == 0, (k % 20).cast("double"))
    now = F.lit("2026-01-05 10:00:00").cast("timestamp")
    header = F.when(k % 2 == 0, (k % 90).cast("string")).otherwise(F.lit("Mon, 5 Jan 2026 10:01:00 GMT"))
    return table(spark, d, "orders").select("o_orderkey", clock.backoff(k % 6 + 1, after).alias("delay"), clock.retry_after(header, now).alias("wish"))


@query("""WITH n AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders)
SELECT o_orderkey, year(day) || '.' || month(day) || '.' || day(day) || CASE WHEN n = 1 THEN '' ELSE '.' || (n - 1) END AS version FROM n""")
def calver_assign(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    numbered = blocks.with_place(o, "day", ["o_orderkey"], F.floor(F.col("o_orderkey") / 65536), "n")
    return numbered.select("o_orderkey", clock.calver_text(F.col("day"), F.when(F.col("n") > 1, F.col("n") - 1)).alias("version"))


@query("""WITH v AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS f FROM orders)
SELECT o_orderkey, CASE WHEN f < 2 THEN CAST(day AS VARCHAR) END AS d, CASE WHEN f = 1 THEN 7 END AS seq, f < 2 AS valid,
  CASE WHEN f = 0 THEN year(day) || '.' || month(day) || '.' || day(day) || '.1' WHEN f = 1 THEN year(day) || '.' || month(day) || '.' || day(day) || '.8' END AS next_same FROM v""")
def calver_parse(spark, d):
    day, f = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    plain = clock.calver_text(day, F.lit(None).cast("int"))
    raw = F.when(f == 0, plain).when(f == 1, F.concat(plain, F.lit(".7"))).when(f == 2, F.concat(plain, F.lit(".0"))).when(f == 3, F.date_format(day, "yyyy.MM.dd'.x'")).otherwise(F.concat(F.year(day).cast("string"), F.lit(".2.30")))
    out = table(spark, d, "orders").select("o_orderkey", clock.calver_parts(raw).alias("p"), clock.next_calver(raw, day).alias("next_same"))
    return out.select("o_orderkey", F.col("p.d").cast("string").alias("d"), F.col("p.seq").alias("seq"), F.col("p.valid").alias("valid"), "next_same")


# ---------------------------------------------------------------- collections

_BLOB = """lower(concat_ws(chr(10), coalesce(nullif(note_tweet.text, ''), text, ''), url, author.username, author.name, author.url,
  coalesce(array_to_string(list_transform(coalesce(referenced_tweets, []), lambda r: concat_ws(chr(10), r.text, r.url, r.author.username, r.author.name)), chr(10)), '')))"""


@query(f"SELECT row_id FROM (SELECT row_id, {_BLOB} AS b FROM bookmark) WHERE contains(b, 'folder') AND contains(b, 'weekly')")
def keyword_all_terms(spark, d):
    return C.keyword_search(table(spark, d, "bookmark"), "Folder  weekly").select("row_id")


@query(f"""SELECT row_id, id, coalesce(nullif(note_tweet.text, ''), text, '') AS full_text,
  coalesce(url, CASE WHEN coalesce(author.username, '') <> '' THEN 'https://{HOST}/' || author.username || '/status/' || id END, 'https://{HOST}/i/web/status/' || id) AS item_url,
  CASE WHEN coalesce(author.username, '') <> '' THEN 'https://{HOST}/' || author.username END AS author_url,
  coalesce(array_to_string(list_filter(list_transform(coalesce(media, []), lambda m: m.media_key), lambda k: k IS NOT NULL), ','), '') AS media_keys, CAST(len(coalesce(referenced_tweets, [])) AS INT) AS n_refs,
  coalesce(array_to_string(list_transform(coalesce(referenced_tweets, []), lambda r: concat_ws(':', r.ref_type, r.id, coalesce(r.author.username, '?'))), ','), '') AS refs,
  coalesce(public_metrics['like_count'], 0) AS likes FROM bookmark""")
def reference_normalize(spark, d):
    return C.normalise(table(spark, d, "bookmark"), HOST)


@query("""WITH u AS (SELECT c_custkey, max_by(c_name, c_custkey) AS c_name FROM customer WHERE c_custkey % 7 <> 0 GROUP BY c_custkey)
SELECT o_orderkey, c_name, CASE WHEN c_name IS NOT NULL THEN 'https://x.com.example/' || c_name END AS author_url FROM orders LEFT JOIN u ON o_custkey = c_custkey""")
def author_lookup(spark, d):
    """A lookup that misses: users of every seventh key were never fetched."""
    users = table(spark, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey", "c_name", F.col("c_custkey").alias("written"))
    items = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return C.join_reference(items, users, "key", "c_custkey", "written").select("o_orderkey", "c_name", C.user_url(HOST, F.col("c_name")).alias("author_url"))


@query("""WITH w AS (SELECT event_id AS pos, user_id * 3 AS k FROM events)
SELECT pos, k, o_orderstatus AS status, CAST(pos // 100 AS INT) AS batch_no FROM w JOIN orders ON o_orderkey = k""")
def hydrate_in_order(spark, d):
    wanted = table(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 3).alias("k"))
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("written"))
    return C.hydrate(wanted, items, "k", "written").select("pos", "k", "status", "batch_no")


def _feed(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("scope"), (-F.col("event_id")).alias("pos"), F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


def _state(spark, d, gone: bool):
    """The item a third down each feed; ``gone`` makes its id one that was removed."""
    e = table(spark, d, "events")
    cut = e.groupBy("event_type").agg(F.max("event_id").alias("top")).withColumn("at", F.floor(F.col("top") * 2 / 3))
    saved = e.join(cut, "event_type").where("event_id <= at").groupBy("event_type").agg(F.max_by(F.struct("event_id", "ts"), "event_id").alias("s"))
    return saved.select(F.col("event_type").alias("scope"), F.concat(F.lit("x" if gone else ""), F.col("s.event_id").cast("string")).alias("last_seen_id"), F.date_format("s.ts", "yyyy-MM-dd'T'HH:mm:ss").alias("last_seen_created_at"))


_CUT = """WITH cut AS (SELECT event_type, floor(max(event_id) * 2 / 3) AS upto FROM events GROUP BY event_type),
saved AS (SELECT e.event_type, max(event_id) AS event_id, max_by(ts, event_id) AS ts FROM events e JOIN cut USING (event_type) WHERE event_id <= upto GROUP BY e.event_type)"""


@query(f"{_CUT} SELECT e.event_type AS scope, CAST(e.event_id AS VARCHAR) AS id FROM events e JOIN saved s USING (event_type) WHERE e.event_id > s.event_id")
def since_last_by_id(spark, d):
    return C.since_last(_feed(spark, d), _state(spark, d, gone=False)).select("scope", "id")


@query(f"{_CUT} SELECT e.event_type AS scope, CAST(e.event_id AS VARCHAR) AS id FROM events e JOIN saved s USING (event_type) WHERE strftime(e.ts, '%Y-%m-%dT%H:%M:%S') > strftime(s.ts, '%Y-%m-%dT%H:%M:%S')")
def since_last_fallback(spark, d):
    return C.since_last(_feed(spark, d), _state(spark, d, gone=True)).select("scope", "id")


@query(f"""{_CUT} SELECT event_type AS scope, CAST(max(event_id) AS VARCHAR) AS last_seen_id, strftime(max_by(ts, event_id), '%Y-%m-%dT%H:%M:%S') AS last_seen_created_at FROM events GROUP BY event_type
UNION ALL SELECT 'folder:7', '42', NULL""")
def state_upsert(spark, d):
    other = spark.range(1).select(F.lit("folder:7").alias("scope"), F.lit("42").alias("last_seen_id"), F.lit(None).cast("string").alias("last_seen_created_at"))
    return C.advance_state(_feed(spark, d), _state(spark, d, gone=False).unionByName(other))


@query("""WITH c AS (SELECT source_id, caption_type, caption_lang, row_number() OVER (PARTITION BY coalesce(asr_model, '-') ORDER BY CASE WHEN lower(caption_lang) LIKE 'en%' THEN 0 ELSE 1 END, CASE caption_type WHEN 'manual' THEN 0 WHEN 'auto' THEN 1 ELSE 2 END,
  CASE lower(caption_lang) WHEN 'en' THEN 0 WHEN 'en-orig' THEN 1 WHEN 'en-us' THEN 2 WHEN 'en-gb' THEN 3 ELSE CASE WHEN lower(caption_lang) LIKE 'en%' THEN 4 ELSE 100 END END, source_id) AS n, coalesce(asr_model, '-') AS model FROM transcripts)
SELECT model, source_id, caption_type, caption_lang FROM c WHERE n = 1""")
def ranked_pick(spark, d):
    t = table(spark, d, "transcripts").withColumn("model", F.coalesce("asr_model", F.lit("-")))
    lang, kind = F.lower("caption_lang"), F.col("caption_type")
    order = [F.when(lang.startswith("en"), 0).otherwise(1), F.when(kind == "manual", 0).when(kind == "auto", 1).otherwise(2), text.language_rank(F.col("caption_lang")), F.col("source_id")]
    return C.ranked_pick(t, "model", order).select("model", "source_id", "caption_type", "caption_lang")


# ---------------------------------------------------------------- sampling and folds


@query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
slots AS (SELECT DISTINCT label, n, CAST(round_even(s * (n - 1) / 9.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT label, n FROM r), range(10) t(s) WHERE n > 10)
SELECT label, vec_id FROM r WHERE n <= 10 OR EXISTS (SELECT 1 FROM slots WHERE slots.label = r.label AND slots.i = r.i)""")
def even_sample(spark, d):
    return sampling.even_sample(table(spark, d, "embeddings").select("label", "vec_id"), "label", ["vec_id"], 10, F.floor(F.col("vec_id") / 4096))


@query("""WITH a AS (SELECT source_id, pos, start_s FROM (SELECT DISTINCT * FROM transcript_segments WHERE text LIKE '%[%')), n AS (SELECT source_id FROM a GROUP BY source_id HAVING count(*) >= 8)
SELECT source_id, pos, start_s, false AS fallback FROM a WHERE source_id IN (SELECT source_id FROM n)
UNION ALL SELECT source_id, pos, start_s, true FROM (SELECT DISTINCT * FROM transcript_segments WHERE pos % 5 = 0) WHERE source_id NOT IN (SELECT source_id FROM n)""")
def min_count_fallback(spark, d):
    s = table(spark, d, "transcript_segments").distinct()
    keep = ["source_id", "pos", "start_s"]
    return sampling.min_count_fallback(s.where(F.contains("text", F.lit("["))).select(*keep), s.where("pos % 5 = 0").select(*keep), "source_id", 8)


@query("""WITH s AS (SELECT event_type, event_id, ts, 0 AS pinned FROM events WHERE value >= 250 UNION ALL SELECT event_type, event_id, ts, 1 FROM events WHERE value < 25)
SELECT event_type, event_id, pinned, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, pinned, event_id) AS INT) AS index FROM s""")
def pinned_merge(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", "ts", "value")
    merged = sampling.merge_pinned(e.where("value >= 250").drop("value"), e.where("value < 25").drop("value"), "event_type", "ts", "event_id", F.unix_date(F.col("ts").cast("date")))
    return merged.select("event_type", "event_id", "pinned", F.col("index").cast("int").alias("index"))


@query("""WITH RECURSIVE r AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f AS (SELECT label, vec_id, n, embedding AS kept, true AS stays FROM r WHERE n = 1
  UNION ALL SELECT r.label, r.vec_id, r.n, CASE WHEN list_sum(list_transform(list_zip(r.embedding, f.kept), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(f.kept) <= 0.14 THEN f.kept ELSE r.embedding END,
    list_sum(list_transform(list_zip(r.embedding, f.kept), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(f.kept) > 0.14 FROM f JOIN r ON r.label = f.label AND r.n = f.n + 1)
SELECT label, vec_id FROM f WHERE stays""")
def last_kept_dedup(spark, d):
    return folds.last_kept(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.14)


_CLEAN = """trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(text, '<[^>]+>', '', 'g'), '&gt;', '>'), '&lt;', '<'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[\\s\\x{A0}]+', ' ', 'g'))"""


@query(f"""WITH RECURSIVE c AS (SELECT source_id, pos, start_s, end_s, {_CLEAN} AS t FROM (SELECT DISTINCT source_id, pos, start_s, end_s, text FROM transcript_segments WHERE source_id IS NOT NULL)),
r AS (SELECT source_id, string_split(t, ' ') AS w, round(coalesce(start_s, 0), 3) AS s, round(coalesce(end_s, 0), 3) AS e, row_number() OVER (PARTITION BY source_id ORDER BY pos NULLS FIRST, start_s NULLS FIRST, t) AS n FROM c WHERE t <> ''),
f AS (SELECT source_id, n, w, s, e, 1 AS seg, 1 AS cues FROM r WHERE n = 1 UNION ALL SELECT source_id, n, CASE WHEN grows THEN nw WHEN part THEN w WHEN k >= 3 THEN nw[k + 1:] ELSE nw END, CASE WHEN grows OR part THEN s ELSE ns END, ne, CASE WHEN grows OR part THEN seg ELSE seg + 1 END, CASE WHEN grows OR part THEN cues + 1 ELSE 1 END
  FROM (SELECT f.source_id, r.n, f.w, f.s, f.seg, f.cues, r.w AS nw, r.s AS ns, r.e AS ne, f.w = r.w[1:len(f.w)] AS grows, k, k = len(r.w) OR r.w = f.w[1:len(r.w)] AS part
    FROM f JOIN r ON r.source_id = f.source_id AND r.n = f.n + 1, LATERAL (SELECT coalesce(max(i), 0) AS k FROM range(1, least(len(f.w), len(r.w)) + 1) g(i) WHERE f.w[len(f.w) - i + 1:] = r.w[1:i]) x))
SELECT source_id, arg_max(s, n) AS start_s, arg_max(e, n) AS end_s, array_to_string(arg_max(w, n), ' ') AS text, CAST(max(cues) AS INT) AS n_cues FROM f GROUP BY source_id, seg""")
def rolling_collapse(spark, d):
    """An order-dependent fold with trimmed text; in SQL a recursion over the cues of each transcript."""
    clean = table(spark, d, "transcript_segments").select("source_id", "pos", "start_s", "end_s", "text").distinct().withColumn("text", text.strip_markup(F.col("text")))
    return folds.rolling_collapse(clean)


# ---------------------------------------------------------------- snapshots


@query("""WITH e AS (SELECT user_id, event_id, event_type, value FROM events), s AS (SELECT user_id, max(event_id) AS event_id, max_by(round(value, 3), event_id) AS value FROM e WHERE event_type = 'error' GROUP BY user_id)
SELECT s.user_id, s.event_id, s.value, (SELECT max(event_id) FROM e WHERE e.user_id = s.user_id AND e.event_type = 'signup' AND e.event_id <= s.event_id) AS carried FROM s""")
def latest_snapshot(spark, d):
    e = table(spark, d, "events")
    return snapshots.latest_snapshot(e, "user_id", "event_id", F.col("event_type") == "error", F.round("value", 3), F.when(F.col("event_type") == "signup", F.col("event_id")))


@query("""WITH j AS (SELECT *, try_cast(raw AS JSON) AS v FROM rollout_lines WHERE starts_with(ltrim(raw, ' ' || chr(9)), '{') AND json_valid(raw)),
e AS (SELECT origin, file_name, line_no, v->>'$.payload.rate_limits.plan_type' AS plan, v->>'$.type' AS t, v->>'$.payload.type' AS pt, json_type(v, '$.payload.rate_limits') AS rl, CASE WHEN v->>'$.type' = 'session_meta' THEN v->>'$.payload.id' END AS sid FROM j),
s AS (SELECT file_name, max(line_no) AS line_no, max_by(coalesce(plan, '?'), line_no) AS plan FROM e WHERE t = 'event_msg' AND pt = 'token_count' AND rl = 'OBJECT' GROUP BY file_name)
SELECT s.file_name, s.line_no, s.plan, max_by(e.sid, e.line_no) AS thread_id FROM s LEFT JOIN e ON e.file_name = s.file_name AND e.sid IS NOT NULL AND e.line_no <= s.line_no GROUP BY ALL""")
def rollout_snapshot(spark, d):
    """Per file the last token count with rate limits, and the session id seen up to it."""
    e = eventlog.events(table(spark, d, "rollout_lines"))
    is_snapshot = (F.col("event_type") == "event_msg") & (F.col("payload_type") == "token_count") & F.col("has_limits")
    out = snapshots.latest_snapshot(e, "file_name", "line_no", F.coalesce(is_snapshot, F.lit(False)), F.coalesce("plan", F.lit("?")), F.col("session_id"))
    return out.select("file_name", "line_no", F.col("value").alias("plan"), F.col("carried").alias("thread_id"))


@query("SELECT event_type AS scope, max_by(user_id, event_id) AS value FROM events WHERE value > 100 GROUP BY event_type")
def latest_partition(spark, d):
    return snapshots.latest_partition(table(spark, d, "events").where("value > 100"), F.col("event_type"), F.col("event_id"), F.col("user_id"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id::VARCHAR END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM events")
def forward_fill(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).alias("s"))
    return snapshots.forward_fill(e, "user_id", ["event_id"], "s", "session", F.floor(F.col("event_id") / 65536)).select("event_id", "user_id", "session")


_CREDITS = "SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'available' WHEN 'F' THEN 'used' ELSE 'expired' END AS status, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS expires FROM orders"


@query(f"""WITH c AS ({_CREDITS}), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY status <> 'available', expires NULLS LAST, o_orderkey) AS n FROM c)
SELECT o_custkey, max(o_orderkey) FILTER (WHERE n = 1) AS next_index, count(*) FILTER (WHERE status = 'available') AS n_wanted, count(*) AS n_all FROM r GROUP BY o_custkey""")
def expiry_order_next(spark, d):
    o = table(spark, d, "orders")
    c = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "available").when(F.col("o_orderstatus") == "F", "used").otherwise("expired").alias("status"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate") + F.expr("interval 30 days")).alias("expires"))
    return snapshots.next_expiring(c, "o_custkey", "status", "expires", "o_orderkey")


@query(f"WITH c AS ({_CREDITS}) SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY expires NULLS LAST, o_orderkey) AS INT) AS expiry_no FROM c")
def expiry_order(spark, d):
    c = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate") + F.expr("interval 30 days")).alias("expires"))
    return snapshots.expiry_order(c, "o_custkey", "expires", "o_orderkey").select("o_orderkey", F.col("expiry_no").cast("int").alias("expiry_no"))


@query("""WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 4 AS f FROM events)
SELECT event_id, CASE f WHEN 0 THEN CAST(k AS VARCHAR) WHEN 2 THEN 's' || k ELSE 'unknown' END AS shown,
  CASE f WHEN 0 THEN k || '%' WHEN 2 THEN 's' || k ELSE 'unknown' END AS percent, CASE f WHEN 0 THEN 'later' WHEN 2 THEN 's' || k WHEN 3 THEN 'deep' END AS string_value FROM k""")
def json_alias_typed(spark, d):
    """A number, a present null that stops the search, a text, and a nested text."""
    k, f = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    raw = (
        F.when(f == 0, F.concat(F.lit('{"count": '), k, F.lit(', "total": "later"}')))
        .when(f == 1, F.lit('{"count": null, "total": 5}'))
        .when(f == 2, F.concat(F.lit('{"total": " s'), k, F.lit(' "}')))
        .otherwise(F.lit('{"total": true, "inner": {"name": "deep"}}'))
    )
    found = jsonx.first_present(F.col("raw"), ["count", "total"])
    out = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return out.select("event_id", jsonx.display_count(found).alias("shown"), jsonx.display_percent(found).alias("percent"), F.trim(jsonx.first_string(F.col("raw"), ["count", "total", "inner.name"])).alias("string_value"))


# ---------------------------------------------------------------- rules

#: Some texts get an invented secret, since the tables hold none.
_PLANTED = ((7, ' OPENAI_API_KEY = sk-Zq8Lr2Vt5Xw9Bn3Mc6Kd'), (11, " ghp_Zq8Lr2Vt5Xw9Bn3Mc6KdZq8Lr2Vt"), (13, " xoxb-1234567890-abc"), (17, " gsk_short"))
_PLANTED_SQL = "coalesce(text, '')" + "".join(f" || CASE WHEN doc_id % {n} = 0 THEN '{t}' ELSE '' END" for n, t in _PLANTED)
_SHAPES_SQL = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS shape FROM t WHERE regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}')" for n, p in rules.SECRET_SHAPES.items())


@query(f"WITH t AS (SELECT doc_id, {_PLANTED_SQL} AS t FROM documents) {_SHAPES_SQL}")
def secret_scan(spark, d):
    planted = F.concat(F.coalesce("text", F.lit("")), *[F.when(F.col("doc_id") % n == 0, F.lit(t)).otherwise("") for n, t in _PLANTED])
    return rules.secret_scan(table(spark, d, "documents").select("doc_id", planted.alias("t")), "doc_id", "t")


@query("""WITH a AS (SELECT p_partkey, p_brand AS v FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_size > 40 THEN p_brand || '.1' ELSE p_brand END AS v FROM part WHERE p_partkey % 9 <> 0)
SELECT p_partkey, a.v AS before_version, b.v AS after_version FROM a JOIN b USING (p_partkey) WHERE a.v IS DISTINCT FROM b.v""")
def version_diff(spark, d):
    p = table(spark, d, "part")
    before = p.where("p_partkey % 10 <> 0").select("p_partkey", F.col("p_brand").alias("v"))
    after = p.where("p_partkey % 9 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 6 == 0, None).when(F.col("p_size") > 40, F.concat("p_brand", F.lit(".1"))).otherwise(F.col("p_brand")).alias("v"))
    return rules.version_changes(before, after, "p_partkey", "v")


@query("""WITH r AS (SELECT doc_id, unnest([CASE WHEN text IS NULL THEN 'text_missing' END, CASE WHEN text = '' THEN 'text_empty' END, CASE WHEN lang IS NULL THEN 'lang_missing' END, CASE WHEN lang <> lower(lang) THEN 'lang_case' END,
  CASE WHEN length(text) > 20000 THEN 'text_long' END, CASE WHEN source IS NULL THEN 'source_missing' END, CASE WHEN contains(source, '-') THEN 'source_hyphen' END]) AS rule FROM documents)
SELECT DISTINCT 'documents/' || doc_id AS path, rule FROM r WHERE rule IS NOT NULL""")
def rule_violations(spark, d):
    c = F.col
    broken = {
        "text_missing": c("text").isNull(), "text_empty": c("text") == "", "lang_missing": c("lang").isNull(), "lang_case": c("lang") != F.lower("lang"),
        "text_long": F.length("text") > 20000, "source_missing": c("source").isNull(), "source_hyphen": F.contains("source", F.lit("-")),
    }
    return rules.violations(table(spark, d, "documents"), F.concat(F.lit("documents/"), c("doc_id").cast("string")), broken)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def unexpected_rows(spark, d):
    expected = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return rules.unexpected(table(spark, d, "part"), expected, "p_partkey")


@query("""WITH s AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g')) || CASE p_partkey % 4 WHEN 1 THEN '-' WHEN 2 THEN '--x' WHEN 3 THEN '.y' ELSE '' END AS slug FROM part)
SELECT p_partkey, slug, regexp_matches(slug, '^[a-z0-9]([a-z0-9.-]{0,62}[a-z0-9])?$') AND NOT contains(slug, '--') AND NOT contains(slug, '..') AS valid FROM s""")
def name_regex(spark, d):
    slug = F.concat(F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "-")), F.when(F.col("p_partkey") % 4 == 1, "-").when(F.col("p_partkey") % 4 == 2, "--x").when(F.col("p_partkey") % 4 == 3, ".y").otherwise(""))
    return table(spark, d, "part").select("p_partkey", slug.alias("slug")).withColumn("valid", text.is_package_name(F.col("slug")))


@query("""WITH v AS (SELECT p_type || '/' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '/café' ELSE '/cafe' || chr(769) END AS name FROM part UNION ALL SELECT lower(p_type) || '/' || p_brand || '/CAFÉ' FROM part WHERE p_partkey % 5 = 0)
SELECT lower(nfc_normalize(name)) AS key, count(DISTINCT name) AS n_names, min(name) AS first_name FROM v GROUP BY 1 HAVING count(DISTINCT name) > 1""")
def portable_key_collisions(spark, d):
    p = table(spark, d, "part")
    one = p.select(F.concat("p_type", F.lit("/"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, F.lit("/café")).otherwise(F.lit("/café"))).alias("name"))
    two = p.where("p_partkey % 5 = 0").select(F.concat(F.lower("p_type"), F.lit("/"), "p_brand", F.lit("/CAFÉ")).alias("name"))
    names = one.unionByName(two).distinct()  # names repeat a lot: the UDF sees each once
    return rules.collisions(names, "name", text.portable_key(F.col("name")))


@query("""SELECT lower(trim(source)) AS source_name, count(*) AS n, sum(n_chars) AS size_sum, coalesce(sum(n_chars), 0) < 1000000 AS within,
  coalesce(bool_and(lang IS NOT NULL) FILTER (WHERE n_chars > 0), true) AS all_ok FROM documents GROUP BY 1""")
def status_rollup(spark, d):
    docs = table(spark, d, "documents").withColumn("source_name", F.lower(F.trim("source")))
    return rules.status_rollup(docs, "source_name", F.col("lang").isNotNull(), ~F.coalesce(F.col("n_chars") > 0, F.lit(False)), F.col("n_chars"), 1e6)


# ---------------------------------------------------------------- texts


@query("""WITH c AS (SELECT source_id, pos, text, regexp_replace(text, '<[^>]+>', '', 'g') AS t FROM transcript_segments WHERE text IS NOT NULL)
SELECT source_id, pos, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&gt;', '>'), '&lt;', '<'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[\\s\\x{A0}]+', ' ', 'g')) AS clean FROM c""")
def clean_markup(spark, d):
    s = table(spark, d, "transcript_segments").where("text is not null")
    return s.select("source_id", "pos", text.strip_markup(F.col("text")).alias("clean"))


@query("""SELECT row_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+', 'i') THEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) END AS host,
  coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 48), ''), 'item') AS slug, substr(sha1(url), 1, 8) AS seed FROM bookmark WHERE url IS NOT NULL""")
def url_slug(spark, d):
    b = table(spark, d, "bookmark").where("url is not null")
    url = F.col("url")
    return b.select("row_id", F.when(text.is_url(url), text.url_host(url)).alias("host"), text.slug(F.regexp_replace(url, "^https?://", "")).alias("slug"), text.short_hash(url).alias("seed"))


@query("""WITH s AS (SELECT DISTINCT source_id, pos, start_s, trim(text) AS t FROM transcript_segments WHERE trim(text) <> ''), r AS (SELECT source_id, pos, CAST(floor(pos / 5000) AS BIGINT) AS part, t, CAST(round_even(start_s, 0) AS BIGINT) AS x FROM s)
SELECT source_id, part, string_agg('[' || CASE WHEN x IS NULL THEN 'unknown' WHEN x >= 3600 THEN printf('%d:%02d:%02d', x // 3600, (x % 3600) // 60, x % 60) ELSE printf('%02d:%02d', x // 60, x % 60) END || '] ' || t, chr(10) ORDER BY pos) AS markdown FROM r GROUP BY source_id, part""")
def transcript_render(spark, d):
    return cues.transcript_markdown(table(spark, d, "transcript_segments").distinct())


@query("""WITH v AS (SELECT p_partkey, p_name, p_partkey % 8 AS f FROM part)
SELECT p_partkey, CASE WHEN f NOT IN (4, 7) THEN 'K' || p_partkey END AS key,
  CASE f WHEN 0 THEN trim(split_part(p_name, ' ', 1)) WHEN 1 THEN p_name WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN 'a=' || p_partkey WHEN 5 THEN '' WHEN 6 THEN p_name || ' # y' END AS value FROM v""")
def env_parse(spark, d):
    """KEY=VALUE lines in every form: plain, quoted, with comments, exported, empty, and lines that are none."""
    k, f = F.col("p_partkey"), F.col("p_partkey") % 8
    key, first = F.concat(F.lit("K"), k.cast("string")), F.split("p_name", " ")[0]
    line = (
        F.when(f == 0, F.concat(key, F.lit("= "), first)).when(f == 1, F.concat(key, F.lit('="'), F.col("p_name"), F.lit('" # note'))).when(f == 2, F.concat(key, F.lit("="), first, F.lit(" # note")))
        .when(f == 3, F.concat(F.lit("export "), key, F.lit(" = a="), k.cast("string"))).when(f == 4, F.concat(F.lit("# "), key, F.lit("=1"))).when(f == 5, F.concat(key, F.lit("=")))
        .when(f == 6, F.concat(key, F.lit("='"), F.col("p_name"), F.lit(" # y'"))).otherwise(F.lit("no entry"))
    )
    e = text.env_entry(F.col("line"))
    return table(spark, d, "part").select(k, line.alias("line")).select("p_partkey", e["key"].alias("key"), e["value"].alias("value"))


@query("""SELECT origin, file_name, line_no, v->>'$.type' AS event_type, v->>'$.payload.type' AS payload_type FROM (SELECT *, try_cast(raw AS JSON) AS v FROM rollout_lines WHERE starts_with(ltrim(raw, ' ' || chr(9)), '{') AND json_valid(raw))""")
def event_log(spark, d):
    return eventlog.events(table(spark, d, "rollout_lines")).select("origin", "file_name", "line_no", "event_type", "payload_type")


# ---------------------------------------------------------------- lookups, lists and plans


@query("""WITH m AS (SELECT 'm' || p_partkey AS k, p_brand AS v FROM part WHERE p_partkey % 3 <> 0), i AS (SELECT event_id, list_transform(range(event_id % 4), lambda x: 'm' || (event_id * 7 + x * 13) % 500) AS a FROM events),
e AS (SELECT event_id, unnest(a) AS k, unnest(range(len(a))) AS place FROM i), f AS (SELECT event_id, string_agg(v, ',' ORDER BY place) AS found FROM e JOIN m USING (k) GROUP BY event_id)
SELECT event_id, coalesce(found, '') AS found FROM i LEFT JOIN f USING (event_id)""")
def media_lookup(spark, d):
    """An array of keys resolved in order; every third key has no target."""
    media = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("k"), F.col("p_brand").alias("v"), F.col("p_partkey").alias("written"))
    e = table(spark, d, "events").select("event_id")
    keys = F.when(F.col("event_id") % 4 > 0, F.transform(F.sequence(F.lit(0), F.col("event_id") % 4 - 1), lambda x: F.concat(F.lit("m"), ((F.col("event_id") * 7 + x * 13) % 500).cast("string")))).otherwise(F.array().cast("array<string>"))
    found = lookups.through_array(e.withColumn("a", keys), "event_id", "a", media, "k", "v", "written")
    return found.select("event_id", F.array_join("found", ",").alias("found"))


@query("""SELECT event_id, user_id * 5 AS ref, o_custkey AS owner, c_name AS owner_name FROM events LEFT JOIN orders ON o_orderkey = user_id * 5 LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey""")
def reference_lookup(spark, d):
    """A referenced row and its owner; either may be missing, the item stays."""
    items = table(spark, d, "events").select("event_id", (F.col("user_id") * 5).alias("ref"))
    owners = table(spark, d, "customer").where("c_custkey % 4 <> 0")
    return lookups.through_reference(items, "ref", table(spark, d, "orders"), "o_orderkey", "o_custkey", owners, "c_custkey", "c_name", order=("o_orderdate", "c_custkey")).select("event_id", "ref", "owner", "owner_name")


@query("""WITH p AS (SELECT user_id, epoch_us(ts) / 1e6 AS at_s, event_id FROM events WHERE event_type = 'error'), m AS (SELECT user_id, epoch_us(ts) / 1e6 AS at_s, event_id FROM events WHERE event_type = 'signup')
SELECT p.user_id, p.at_s, (SELECT max_by(m.event_id, (m.at_s, m.event_id)) FROM m WHERE m.user_id = p.user_id AND m.at_s <= p.at_s) AS value FROM p""")
def asof_latest_before(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"))
    return lookups.latest_before(e.where("event_type = 'error'"), e.where("event_type = 'signup'"), "user_id", "at_s", "event_id", 6 * 3600.0)


@query("""WITH s AS (SELECT DISTINCT source_id, pos, text FROM transcript_segments WHERE source_id IS NOT NULL AND trim(text) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos, text) AS place, count(*) OVER (PARTITION BY source_id) AS n FROM s)
SELECT source_id, pos, CAST(place AS INT) AS place, greatest(n - 12, 0) AS left_out FROM r WHERE place <= 12""")
def segment_preview(spark, d):
    """The report's preview: the first twelve segments and how many follow."""
    s = table(spark, d, "transcript_segments").where("source_id is not null and trim(text) <> ''").select("source_id", "pos", "text").distinct()
    return lookups.preview(s, "source_id", ["pos", "text"], 12).select("source_id", "pos", "place", "left_out")


@query("""WITH t AS (SELECT event_id, event_id % 3000 AS a, event_id % 700 AS b FROM events), l AS (SELECT event_id, a, b, list_sort(list_distinct([CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST(b AS DOUBLE), 75.0])) AS x FROM t)
SELECT event_id, array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ' ') AS seconds, a + b AS logged FROM l""")
def clock_lists(spark, d):
    """Lists of clock texts to sorted distinct seconds, and all numbers of a log text."""
    a, b = F.col("event_id") % 3000, F.col("event_id") % 700
    listed = F.concat(clock.format_clock(a.cast("double")), F.lit(", "), b.cast("string"), F.lit(","), b.cast("string"), F.lit(", 1:15,bad"))
    logged = F.concat(F.lit("n: 0 pts_time:"), a.cast("string"), F.lit(" x pts_time: "), b.cast("string"))
    out = table(spark, d, "events").select("event_id", lists.clock_list(listed).alias("l"), lists.all_numbers_after(logged, "pts_time").alias("n"))
    return out.select("event_id", F.array_join(F.transform("l", lambda v: v.cast("bigint").cast("string")), " ").alias("seconds"), F.aggregate("n", F.lit(0.0), lambda x, v: x + v).cast("bigint").alias("logged"))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 100 END AS s, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 90 END AS l FROM events),
r AS (SELECT event_id, s, l, coalesce(s, 0.0) AS low, coalesce(coalesce(s, 0.0) + l, 95.0) AS high FROM v)
SELECT event_id, CAST(low AS DOUBLE) AS start_s, CAST(least(high, 95.0) AS DOUBLE) AS end_s, CASE WHEN l <= 0 THEN 'empty duration' WHEN high <= low THEN 'end before start' WHEN low >= 95 THEN 'start behind the end' END AS error,
  CASE WHEN least(high, 95.0) > low THEN printf('%02d:%02d:%02d', 0, CAST(low AS BIGINT) // 60, CAST(low AS BIGINT) % 60) || '-' || printf('%02d:%02d:%02d', 0, CAST(least(high, 95.0) AS BIGINT) // 60, CAST(least(high, 95.0) AS BIGINT) % 60) END AS section FROM r""")
def clip_ranges(spark, d):
    n = F.col("event_id")
    start, length = F.when(n % 4 != 0, (n % 100).cast("double")), F.when(n % 3 != 0, (n % 90).cast("double"))
    r = lists.clip_range(start, F.lit(None).cast("double"), length, F.lit(95.0))
    out = table(spark, d, "events").select("event_id", r.alias("r"))
    return out.select("event_id", "r.start_s", "r.end_s", "r.error", lists.section(F.col("r.start_s"), F.col("r.end_s")).alias("section"))


@query("""WITH f AS (SELECT source_id, unnest(['clip' || CASE WHEN caption_lang IS NULL THEN '' ELSE '.' || caption_lang END || '.srt', 'clip.fr.vtt', 'clip.vtt']) AS name FROM transcripts),
r AS (SELECT source_id, name, row_number() OVER (PARTITION BY source_id ORDER BY CASE WHEN name LIKE '%.vtt' THEN 1 ELSE 2 END, CASE WHEN len(string_split(name, '.')) < 3 THEN 50 WHEN lower(string_split(name, '.')[-2]) = 'en' THEN 0 WHEN lower(string_split(name, '.')[-2]) LIKE 'en%' THEN 4 ELSE 100 END, name) AS n FROM f)
SELECT source_id, name FROM r WHERE n = 1""")
def sidecar_pick(spark, d):
    names = F.array(F.concat(F.lit("clip"), F.coalesce(F.concat(F.lit("."), F.col("caption_lang")), F.lit("")), F.lit(".srt")), F.lit("clip.fr.vtt"), F.lit("clip.vtt"))
    files = table(spark, d, "transcripts").select("source_id", F.explode(names).alias("name"))
    return C.ranked_pick(files, "source_id", [lists.sidecar_rank(F.col("name"))]).select("source_id", "name")


@query("""WITH t AS (SELECT source_id, map(['en', 'de'], ['a', 'b']) AS manual, map(['fr', 'en'], ['c', 'd']) AS auto, coalesce(caption_lang, 'xx') AS lang FROM transcripts)
SELECT source_id, CASE WHEN lang IN ('en', 'de') THEN 'manual' WHEN lang IN ('fr', 'en') THEN 'auto' ELSE 'unknown' END AS kind, 'remaining=' || length(source_id) AS headers, CASE WHEN lang = 'de' THEN 'no title' ELSE lang || ' - broken' END AS summary FROM t""")
def map_lookups(spark, d):
    """Which map has the key, a subset of a header map, and a summary of an error."""
    lang = F.coalesce("caption_lang", F.lit("xx"))
    entry = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    headers = F.create_map(F.lit("remaining"), F.length("source_id").cast("string"), F.lit("limit"), F.lit(""), F.lit("cookie"), F.lit("x"))
    kept = lists.key_subset(headers, ["limit", "remaining"])
    title = F.when(lang != "de", lang)
    return table(spark, d, "transcripts").select(
        "source_id", lists.first_map_with(lang, {"manual": entry("en", "a", "de", "b"), "auto": entry("fr", "c", "en", "d")}).alias("kind"),
        F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"),
        lists.problem_summary(title, F.lit(" "), F.when(title.isNotNull(), F.lit("broken")), F.lit("no title")).alias("summary"),
    )


@query("""SELECT id, '{' || array_to_string(list_filter(['"id":' || to_json(id), '"title":' || to_json(title), '"fulltitle":' || to_json(title || ' (whole)'), '"uploader":' || to_json(uploader), '"channel":' || to_json(upper(uploader)), CASE WHEN duration IS NOT NULL THEN '"duration":' || to_json(duration) END, '"webpage_url":' || to_json(webpage_url),
  '"extractor":' || to_json('generic'), CASE WHEN duration > 100 THEN '"availability":' || to_json('public') END], lambda x: x IS NOT NULL), ',') || '}' AS info FROM media_info""")
def media_compact(spark, d):
    """Ten fields are kept of raw media information; fields that are null or not there are left out."""
    raw = table(spark, d, "media_info").withColumns({
        "fulltitle": F.concat("title", F.lit(" (whole)")), "channel": F.upper("uploader"), "extractor": F.lit("generic"), "upload_date": F.lit(None).cast("string"),
        "availability": F.when(F.col("duration") > 100, "public"), "formats": F.lit("dropped"),
    })
    return pages.compact_info(raw)


@query("""WITH p AS (SELECT DISTINCT origin || '/' || CASE line_no % 8 WHEN 0 THEN 'node_modules/' || file_name WHEN 1 THEN '.env' WHEN 2 THEN 'a' || line_no || '.SQLITE' WHEN 3 THEN 'ok.txt' WHEN 4 THEN 'frame_' || line_no || '.JPG' WHEN 5 THEN '.db' WHEN 6 THEN 'private/x.txt' ELSE file_name END AS path FROM rollout_lines),
n AS (SELECT path, list_slice(string_split(path, '/'), 1, -2) AS above, string_split(path, '/')[-1] AS name FROM p),
r AS (SELECT path, CASE WHEN list_has_any(above, ['node_modules', 'private', 'dist', 'frames']) THEN 'folder' WHEN name IN ('.env', 'auth.json', 'state.json') THEN 'name' WHEN regexp_matches(name, '[^.]\\.(sqlite|db|mp4)$', 'i') THEN 'suffix' WHEN regexp_matches(name, '^(frame_.*\\.(jpe?g|png|webp)|rollout-.*\\.jsonl)$', 'i') THEN 'pattern' END AS rule FROM n)
SELECT path, rule FROM r WHERE rule IS NOT NULL""")
def denied_files(spark, d):
    n = F.col("line_no") % 8
    name = (
        F.when(n == 0, F.concat(F.lit("node_modules/"), "file_name")).when(n == 1, F.lit(".env")).when(n == 2, F.concat(F.lit("a"), F.col("line_no").cast("string"), F.lit(".SQLITE"))).when(n == 3, F.lit("ok.txt"))
        .when(n == 4, F.concat(F.lit("frame_"), F.col("line_no").cast("string"), F.lit(".JPG"))).when(n == 5, F.lit(".db")).when(n == 6, F.lit("private/x.txt")).otherwise(F.col("file_name"))
    )
    paths = table(spark, d, "rollout_lines").select(F.concat("origin", F.lit("/"), name).alias("path")).distinct()
    return paths.withColumn("rule", rules.denied(F.col("path"), folders=("private",))).where("rule is not null")


@query("SELECT source_id, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS n_failed, count(*) AS n_all, bool_and(coalesce(trim(text), '') = '') AS all_failed FROM transcript_segments GROUP BY source_id")
def failed_parts(spark, d):
    return rules.all_failed(table(spark, d, "transcript_segments"), "source_id", F.coalesce(F.trim("text"), F.lit("")) == "")
