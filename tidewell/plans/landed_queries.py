"""Registered queries over landed files and payloads: pages, captions, responses, credits, manifests, plans of sampling.

Files and payloads that the tables do not hold are written out from their rows first, so each query reads whole tables and
its SQL states the expected result from the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import clock, jsonx, lists, text
from tidewell.operators import folds, intervals, lookups, rules, sampling
from tidewell.plans.core_queries import query as _query
from tidewell.sources import cues, eventlog, pages
from tidewell.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    return _query(sql, QUERIES, SQL)


# ---------------------------------------------------------------- pages


@query("""WITH p AS (SELECT lower(trim(source)) AS feed, batch_id, count(*) AS n, min(row_id) AS first FROM bookmark WHERE source IS NOT NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS page_no, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had, coalesce(bool_or(first % 97 = 0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM p WINDOW w AS (PARTITION BY feed ORDER BY first))
SELECT feed, batch_id, CAST(page_no AS INT) AS page_no, n FROM o WHERE had < 400 AND page_no <= 12 AND NOT over""")
def page_scan(spark, d):
    """Batches are the pages of their source's feed: read until 400 items, a page without follower, or 12 pages."""
    p = table(spark, d, "bookmark").where("source is not null").groupBy(F.lower(F.trim("source")).alias("feed"), "batch_id").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    p = p.withColumn("page_no", F.row_number().over(Window.partitionBy("feed").orderBy("first"))).withColumn("next_token", F.when(F.col("first") % 97 != 0, F.col("first").cast("string")))
    return pages.scan_pages(p, "feed", "page_no", "n", "next_token", wanted=400, most_pages=12).select("feed", "batch_id", "page_no", "n")


@query("""SELECT batch_id AS page, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY pos, row_id) - 1 AS INT) AS pos, row_id, id FROM bookmark WHERE batch_id IS NOT NULL""")
def page_items(spark, d):
    """Pages as JSON texts with their items in order; the items come back one row each."""
    b = table(spark, d, "bookmark").where("batch_id is not null")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "row_id", "id"))), lambda x: F.struct(x["row_id"].alias("row_id"), x["id"].alias("id")))  # as many as items of a page
    raw = b.groupBy(F.col("batch_id").alias("page")).agg(F.to_json(F.struct(listed.alias("data"), F.struct(F.lit("t").alias("next_token")).alias("meta"))).alias("raw"))
    items = pages.items_of_pages(raw)
    return items.select("page", "pos", F.get_json_object("item", "$.row_id").cast("bigint").alias("row_id"), F.get_json_object("item", "$.id").alias("id"))


# ---------------------------------------------------------------- captions and responses

_CUES = "SELECT DISTINCT source_id, pos, start_s, end_s, text FROM transcript_segments WHERE source_id IS NOT NULL AND start_s IS NOT NULL AND end_s IS NOT NULL AND regexp_matches(text, '^[A-Za-z][A-Za-z ,.]*$') AND start_s >= 0 AND end_s >= 0"


def _plain_cues(spark, d):
    s = table(spark, d, "transcript_segments").select("source_id", "pos", "start_s", "end_s", "text").distinct()
    return s.where("source_id is not null and start_s >= 0 and end_s >= 0").where(F.col("text").rlike(r"^[A-Za-z][A-Za-z ,.]*\z"))


@query(f"""WITH c AS ({_CUES}), r AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY pos, start_s, end_s, text) - 1 AS n, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM c)
SELECT source_id, CAST(n AS INT) AS pos, start_s, end_s, text FROM r""")
def caption_cues(spark, d):
    """Transcripts written as caption files (hours left out under one hour, dots or commas, carriage returns) and read back."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    def stamp(c, point):
        t = ms(c)
        rest = F.format_string(f"%02d:%02d{point}%03d", F.floor(t / 60000).cast("bigint") % 60, F.floor(t / 1000).cast("bigint") % 60, t % 1000)
        return F.when(t >= 3600000, F.concat(F.format_string("%02d:", F.floor(t / 3600000).cast("bigint")), rest)).otherwise(rest)

    dotted = F.concat(stamp("start_s", "."), F.lit(" --> "), stamp("end_s", "."), F.lit(" align:start"))
    comma = F.concat(stamp("start_s", ","), F.lit(" --> "), stamp("end_s", ","))
    block = F.concat(F.col("pos").cast("string"), F.lit("\r\n"), F.when(F.col("pos") % 2 == 0, dotted).otherwise(comma), F.lit("\r\n<c>"), F.col("text"), F.lit("</c>\r\n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "start_s", "end_s", "text", block.alias("block"))))  # a caption file is one value
    files = _plain_cues(spark, d).groupBy("source_id").agg(F.concat(F.lit("WEBVTT\r\n\r\n"), F.array_join(F.transform(ordered, lambda x: x["block"]), "\r\n")).alias("raw"))
    return cues.parse_cues(files)


@query("""WITH s AS (SELECT DISTINCT source_id, pos, start_s, end_s, text FROM transcript_segments WHERE source_id IS NOT NULL), t AS (SELECT *, floor(pos / 50) AS chunk, regexp_replace(text, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS tt FROM s)
SELECT source_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, round(sum(round(coalesce(start_s, 0) + 30 * chunk, 3)), 3) AS start_sum, round(sum(round(coalesce(end_s, 0) + 30 * chunk, 3)), 3) AS end_sum, sum(length(tt)) AS chars FROM t WHERE tt <> '' GROUP BY ALL""")
def response_segments(spark, d):
    """Transcription responses per chunk of a source, moved by the chunk's offset and put together again."""
    s = table(spark, d, "transcript_segments").select("source_id", "pos", "start_s", "end_s", "text").distinct().where("source_id is not null").withColumn("chunk", F.floor(F.col("pos") / 50))
    one = F.struct("pos", F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text").alias("s"))
    raw = s.groupBy("source_id", "chunk").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", one["s"]["start"].alias("start"), one["s"]["end"].alias("end"), one["s"]["text"].alias("text")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("segments"))).alias("raw"))
    keyed = raw.select(F.concat_ws("|", "source_id", "chunk").alias("source_id"), "raw")
    parts = cues.segments_of_responses(keyed, 30.0 * F.element_at(F.split("source_id", r"\|"), -1).cast("double"))
    key = F.split("source_id", r"\|")
    return parts.groupBy(key[0].alias("source_id"), F.element_at(key, -1).cast("bigint").alias("chunk")).agg(
        F.count("*").alias("n"), F.round(F.sum("start_s"), 3).alias("start_sum"), F.round(F.sum("end_s"), 3).alias("end_sum"), F.sum(F.length("text")).cast("decimal(38,0)").alias("chars")
    ).withColumn("chars", F.col("chars").cast("bigint"))


@query("""WITH c AS (SELECT DISTINCT source_id, pos, start_s FROM transcript_segments WHERE start_s IS NOT NULL AND source_id IS NOT NULL), m AS (SELECT DISTINCT source_id, start_s AS at_s, max(pos) OVER (PARTITION BY source_id, start_s) AS frame FROM c WHERE pos % 3 = 0),
p AS (SELECT DISTINCT source_id, greatest(0, start_s - 0.5) AS at_s FROM c)
SELECT p.source_id, p.at_s, (SELECT max_by(m.frame, (m.at_s, m.frame)) FROM m WHERE m.source_id = p.source_id AND m.at_s <= p.at_s) AS frame FROM p""")
def cue_frames(spark, d):
    """The frame shown half a second before each cue: every third cue's start is a landed frame."""
    c = table(spark, d, "transcript_segments").where("start_s is not null and source_id is not null").select("source_id", "pos", "start_s").distinct()
    frames = c.where("pos % 3 = 0").groupBy("source_id", F.col("start_s").alias("at_s")).agg(F.max("pos").alias("frame"))
    points = c.select("source_id", F.greatest(F.lit(0.0), F.col("start_s") - 0.5).alias("at_s")).distinct()
    return lookups.latest_before(points, frames, "source_id", "at_s", "frame", 600.0).withColumnRenamed("value", "frame")


# ---------------------------------------------------------------- plans of sampling

_V = "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value * 20 END AS v, CASE WHEN event_id % 4 = 0 THEN (event_id % 9 - 1) * 0.5 END AS f, CASE event_id % 5 WHEN 1 THEN 'interval' WHEN 2 THEN 'odd' ELSE 'auto' END AS m, CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE 5.0 END AS i FROM events"
_AUTO = "CASE WHEN v <= 30 THEN greatest(12, CAST(round_even(v, 0) AS INT)) WHEN v <= 60 THEN 40 WHEN v <= 180 THEN 60 ELSE 80 END"


@query(f"""WITH x AS ({_V}), a AS (SELECT *, CASE WHEN v > 0 THEN least(2.0, greatest(0.001, least(80, {_AUTO}) / v)) ELSE 1.0 END AS af FROM x),
b AS (SELECT *, CASE WHEN v > 0 THEN CAST(greatest(1, least(80, ceil(af * v))) AS INT) ELSE 80 END AS an, least(f, 2.0) AS rf, CASE WHEN m NOT IN ('auto', 'interval') THEN 'unknown mode' WHEN i <= 0 THEN 'empty interval' WHEN f <= 0 THEN 'empty rate' END AS error FROM a)
SELECT event_id, error, CASE WHEN error IS NULL THEN CASE WHEN f IS NOT NULL THEN 'fps' ELSE m END END AS mode,
  CASE WHEN error IS NULL THEN round(CASE WHEN f IS NOT NULL THEN rf WHEN m = 'interval' THEN 1 / i ELSE af END, 4) END AS fps,
  CASE WHEN error IS NULL THEN round(CASE WHEN f IS NOT NULL THEN 1 / rf WHEN m = 'interval' THEN i ELSE 1 / af END, 4) END AS interval_s,
  CASE WHEN error IS NULL THEN CAST(CASE WHEN f IS NOT NULL THEN CASE WHEN v > 0 THEN greatest(1, least(80, ceil(rf * v))) ELSE 80 END WHEN m = 'interval' THEN CASE WHEN v > 0 THEN greatest(1, least(80, ceil(v / i) + 1)) ELSE 80 END ELSE an END AS INT) END AS frames,
  CASE WHEN error IS NULL THEN CASE WHEN f > 2 THEN 'rate lowered' WHEN f IS NULL AND m = 'auto' AND v > 600 THEN 'sparse' END END AS warning FROM b""")
def sampling_plans(spark, d):
    """Plans by a wished rate, a regular interval or the ladders, with warnings and errors as values."""
    n = F.col("event_id")
    e = table(spark, d, "events").select(
        "event_id", F.when(n % 13 != 0, F.col("value") * 20).alias("v"), F.when(n % 4 == 0, (n % 9 - 1) * 0.5).cast("double").alias("f"),
        F.when(n % 5 == 1, "interval").when(n % 5 == 2, "odd").otherwise("auto").alias("m"), F.when(n % 11 == 0, 0.0).otherwise(5.0).alias("i"),
    )
    plan = intervals.sampling_plan(F.col("v"), F.lit(80), False, F.col("m"), F.col("i"), F.col("f"))
    out = e.select("event_id", plan.alias("p"))
    return out.select("event_id", "p.error", "p.mode", F.round("p.fps", 4).alias("fps"), F.round("p.interval_s", 4).alias("interval_s"), "p.frames", "p.warning")


@query("""WITH RECURSIVE r AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
f AS (SELECT label, vec_id, n, embedding AS kept, true AS stays FROM r WHERE n = 1
  UNION ALL SELECT label, vec_id, n, CASE WHEN gap <= 0.15 THEN kept ELSE embedding END, gap > 0.15 FROM (SELECT r.label, r.vec_id, r.n, f.kept, r.embedding, list_sum(list_transform(list_zip(r.embedding, f.kept), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(f.kept) AS gap FROM f JOIN r ON r.label = f.label AND r.n = f.n + 1))
SELECT label, count(*) AS candidates, count(*) FILTER (WHERE stays) AS kept, least(count(*) FILTER (WHERE stays), 10) AS selected, greatest(0, 10 - least(count(*) FILTER (WHERE stays), 4)) AS budget_left FROM f GROUP BY label""")
def sampling_counters(spark, d):
    """How many candidates there were, how many near-duplicates left, how many were selected, and what pinned rows leave of the budget."""
    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    kept = folds.last_kept(e, "label", "vec_id", "embedding", 0.15)
    selected = sampling.even_sample(kept, "label", ["vec_id"], 10, F.floor(F.col("vec_id") / 4096)).groupBy("label").agg(F.count("*").alias("selected"))
    counts = e.groupBy("label").agg(F.count("*").alias("candidates")).join(kept.groupBy("label").agg(F.count("*").alias("kept")), "label").join(selected, "label")
    return counts.select("label", "candidates", "kept", "selected", sampling.remaining_budget(F.lit(10), F.least("kept", F.lit(4))).cast("bigint").alias("budget_left"))


# ---------------------------------------------------------------- credits

def _payloads(spark, d):
    """One payload per customer: the list under one of its names, beside a name that holds no list, with strays among the items."""
    o = table(spark, d, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "O", "available").when(F.col("o_orderstatus") == "F", " used ").otherwise("")
    name = F.when(k % 3 == 0, "expiresAt").otherwise("expires_at")
    value = F.when(k % 4 == 0, "null").when(k % 4 == 1, F.unix_seconds(day).cast("string")).when(k % 4 == 2, F.unix_millis(day).cast("string")).otherwise(F.concat(F.lit('"'), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"')))
    item = F.concat(F.lit('{"status":"'), status, F.lit('","'), name, F.lit('":'), value, F.lit("}"))
    lists_ = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))), lambda x: x["item"]), ",").alias("items"))
    c = F.col("o_custkey")
    listed = F.when(c % 3 == 0, "resetCredits").when(c % 3 == 1, "credits").otherwise("items")
    explicit = F.when(c % 5 == 0, F.lit('"available_count":7,')).when(c % 5 == 1, F.lit('"availableCount":null,')).otherwise("")
    return lists_.select("o_custkey", F.concat(F.lit('{"reset_credits":"none",'), explicit, F.lit('"'), listed, F.lit('":[1,null,'), "items", F.lit("]}")).alias("raw"))


LISTS, EXPIRES, COUNTS = ("reset_credits", "resetCredits", "credits", "items"), ("expires_at", "expiresAt"), ("available_count", "availableCount")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'available' WHEN 'F' THEN 'used' ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS at_s FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY at_s NULLS LAST, o_orderkey) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS index FROM c)
SELECT o_custkey, CAST(index AS INT) AS index, CAST(place AS INT) AS place, status, at_s AS expires_s, CASE WHEN at_s IS NOT NULL THEN strftime(timezone('Asia/Kolkata', to_timestamp(at_s)), '%Y-%m-%d %H:%M:%S') || ' +05:30' END AS expires_local FROM r""")
def credit_list(spark, d):
    """Credits in the first of several names that holds a list, objects only, in order of expiry, with local times."""
    rows = _payloads(spark, d).select("o_custkey", F.posexplode(jsonx.first_list(F.col("raw"), LISTS)).alias("index", "v"))
    at = clock.mixed_timestamp(jsonx.field_of(F.col("v"), EXPIRES))
    rows = rows.select("o_custkey", (F.col("index") + 1).alias("index"), jsonx.display_string(F.try_variant_get("v", "$.status", "variant")).alias("status"), at.alias("at"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("at").asc_nulls_last(), "index"))
    return rows.select("o_custkey", "index", place.alias("place"), "status", F.unix_seconds("at").alias("expires_s"), clock.local_text(F.col("at"), "Asia/Kolkata").alias("expires_local"))


@query("""SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN '7' ELSE CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS VARCHAR) END AS available, count(*) AS n FROM orders GROUP BY o_custkey""")
def credit_counts(spark, d):
    """An explicit count wins; without one (or with null) the available ones are counted, if there are any credits."""
    p = _payloads(spark, d).select("o_custkey", F.col("raw"), jsonx.first_list(F.col("raw"), LISTS).alias("l"))
    explicit = jsonx.display_count(jsonx.first_present(F.col("raw"), COUNTS))
    counted = F.size(F.filter("l", lambda v: jsonx.display_string(F.try_variant_get(v, "$.status", "variant")) == "available"))
    return p.select("o_custkey", F.when(explicit != "unknown", explicit).when(F.size("l") > 0, counted.cast("string")).otherwise("unknown").alias("available"), F.size("l").cast("bigint").alias("n"))


@query("""WITH t AS (SELECT event_id, ts, epoch_us(ts) AS us, epoch_us(TIMESTAMP '2024-06-30 12:00:00') AS now FROM events), r AS (SELECT *, greatest(0, CAST(round_even((us - now) / 1e6, 0) AS BIGINT)) AS s FROM t)
SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS local_time, CASE WHEN s = 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN s // 86400 > 0 THEN (s // 86400) || 'd' END, CASE WHEN (s % 86400) // 3600 > 0 THEN ((s % 86400) // 3600) || 'h' END, CASE WHEN (s % 3600) // 60 > 0 THEN ((s % 3600) // 60) || 'm' END, CASE WHEN s % 60 > 0 THEN (s % 60) || 's' END) END AS left_over FROM r""")
def local_times(spark, d):
    """Times on the clock of a zone with summer time, and how long it is until they come."""
    at = F.col("ts").cast("timestamp")
    now = F.lit("2024-06-30 12:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.substring(clock.local_text(at, "America/New_York"), 1, 19).alias("local_time"), clock.remaining(at, now).alias("left_over"))


# ---------------------------------------------------------------- rules, order, files


def _manifests(spark, d):
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k / n) % len(values) + 1).cast("int"))
    fields = [
        pick(1, '"$schema":"https://agent-plugins.org/schemas/1.0.0/plugin.schema.json",', '"$schema":"other",', ""), pick(3, '"name":"a-b",', '"name":"a--b",', '"name":7,', ""),
        pick(2, '"version":"2026.2.28",', '"version":"2026.2.30",', '"version":"1.0",', '"version":"",'), pick(5, '"description":"x",', '"description":" ",'),
        pick(7, '"author":{"name":"n","url":"u"},', '"author":{"name":"","mail":"m"},', '"author":"me",'), pick(4, '"keywords":["x","y"],', '"keywords":["x","x"],', '"keywords":["x",1],', '"keywords":[],', ""),
        pick(6, '"extensions":{"com.example":{}},', '"extensions":{"example":{}},', '"extensions":{"com.example":1},'), pick(9, '"extra":1,', ""),
    ]
    raw = F.when(k % 19 == 0, '["no object"]').when(k % 23 == 0, "{broken").otherwise(F.concat(F.lit("{"), *fields, F.lit('"homepage":"h","repository":"r"}')))
    return table(spark, d, "part").select(F.concat(F.lit("packages/p"), k.cast("string"), F.lit("/plugin.json")).alias("path"), raw.alias("raw"))


_PICK = lambda n, *v: "[" + ", ".join("'" + x + "'" for x in v) + f"][CAST(floor(p_partkey / {n}) AS BIGINT) % {len(v)} + 1]"
_RAW = " || ".join((
    _PICK(1, '"$schema":"https://agent-plugins.org/schemas/1.0.0/plugin.schema.json",', '"$schema":"other",', ""), _PICK(3, '"name":"a-b",', '"name":"a--b",', '"name":7,', ""),
    _PICK(2, '"version":"2026.2.28",', '"version":"2026.2.30",', '"version":"1.0",', '"version":"",'), _PICK(5, '"description":"x",', '"description":" ",'),
    _PICK(7, '"author":{"name":"n","url":"u"},', '"author":{"name":"","mail":"m"},', '"author":"me",'), _PICK(4, '"keywords":["x","y"],', '"keywords":["x","x"],', '"keywords":["x",1],', '"keywords":[],', ""),
    _PICK(6, '"extensions":{"com.example":{}},', '"extensions":{"example":{}},', '"extensions":{"com.example":1},'), _PICK(9, '"extra":1,', ""),
))
_TEXT = lambda f: f"coalesce(json_type(j, '$.{f}') <> 'VARCHAR' OR trim(j->>'$.{f}') = '', true)"
_MANIFEST_RULES = {
    "unknown_field": "len(list_filter(json_keys(j), lambda x: x NOT IN ('$schema', 'name', 'version', 'description', 'author', 'homepage', 'repository', 'license', 'keywords', 'extensions'))) > 0",
    "missing_schema": "NOT list_contains(json_keys(j), '$schema')", "missing_name": "NOT list_contains(json_keys(j), 'name')",
    "schema_value": "list_contains(json_keys(j), '$schema') AND j->>'$.\"$schema\"' <> 'https://agent-plugins.org/schemas/1.0.0/plugin.schema.json'",
    "name_type": "json_type(j, '$.name') <> 'VARCHAR'", "name_form": "json_type(j, '$.name') = 'VARCHAR' AND (NOT regexp_matches(j->>'$.name', '^[a-z0-9]([a-z0-9.-]*[a-z0-9])?$') OR contains(j->>'$.name', '--'))",
    **{f"{f}_text": _TEXT(f) for f in ("version", "description", "homepage", "repository", "license")},
    "version_form": "j->>'$.version' <> '' AND (NOT regexp_matches(j->>'$.version', '^\\d{4}\\.\\d+\\.\\d+$') OR try_strptime(j->>'$.version', '%Y.%-m.%-d') IS NULL)",
    "author_type": "coalesce(json_type(j, '$.author') <> 'OBJECT', true)", "author_field": "json_type(j, '$.author') = 'OBJECT' AND json_type(j, '$.author.mail') IS NOT NULL",
    "author_name": f"json_type(j, '$.author') = 'OBJECT' AND {_TEXT('author.name')}", "author_url": f"json_type(j, '$.author') = 'OBJECT' AND {_TEXT('author.url')}",
    "keywords_type": "coalesce(json_type(j, '$.keywords') <> 'ARRAY' OR json_array_length(j, '$.keywords') = 0, true)",
    "keywords_entry": "json_type(j, '$.keywords[1]') <> 'VARCHAR'", "keywords_repeat": "json_type(j, '$.keywords[1]') = 'VARCHAR' AND j->>'$.keywords[0]' = j->>'$.keywords[1]'",
    "extension_name": "len(list_filter(json_keys(j, '$.extensions'), lambda x: NOT contains(x, '.'))) > 0", "extension_value": "json_type(j, '$.extensions.\"com.example\"') <> 'OBJECT'",
}


@query(f"""WITH m AS (SELECT 'packages/p' || p_partkey || '/plugin.json' AS path, CASE WHEN p_partkey % 19 = 0 OR p_partkey % 23 = 0 THEN NULL ELSE CAST('{{' || {_RAW} || '"homepage":"h","repository":"r"}}' AS JSON) END AS j FROM part)
SELECT path, 'unreadable' AS rule FROM m WHERE j IS NULL""" + "".join(f" UNION ALL SELECT path, '{k}' FROM m WHERE j IS NOT NULL AND ({v})" for k, v in _MANIFEST_RULES.items()))
def manifest_rules(spark, d):
    """Manifests with every kind of fault in every combination; the SQL states each rule once more over the same texts."""
    m = _manifests(spark, d)
    return rules.manifest_violations(m.where(rules.is_package_manifest(F.col("path"))), "path", "raw")


@query("""WITH v AS (SELECT p_partkey, lower(replace(p_type, ' ', '.')) || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '..x' WHEN 3 THEN '.x-y' ELSE '.X' END AS name FROM part)
SELECT p_partkey, name, regexp_matches(name, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$') AS valid FROM v""")
def reverse_domains(spark, d):
    k = F.col("p_partkey") % 5
    name = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("."))), F.when(k == 0, "").when(k == 1, "-").when(k == 2, "..x").when(k == 3, ".x-y").otherwise(".X"))
    return table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("valid", text.is_reverse_domain(F.col("name")))


@query("""SELECT user_id, min(event_id) AS first FROM events GROUP BY user_id""")
def first_seen(spark, d):
    return rules.first_seen(table(spark, d, "events"), "user_id", "event_id")


@query("""WITH e AS (SELECT DISTINCT coalesce(source, '?') || '/' || doc_id AS path, unnest(CASE WHEN text IS NULL THEN ['text_missing', 'lang_check'] ELSE ['lang_check'] END) AS rule FROM documents WHERE lang IS NULL OR text IS NULL)
SELECT path, rule, CAST(row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY string_split(path, '/'), rule) AS INT) AS place FROM e""")
def error_order(spark, d):
    """Errors of each folder by the parts of their paths, then by rule."""
    docs = table(spark, d, "documents").where("lang is null or text is null").select(F.concat_ws("/", F.coalesce("source", F.lit("?")), F.col("doc_id").cast("string")).alias("path"), "text")
    errors = rules.violations(docs, F.col("path"), {"text_missing": F.col("text").isNull(), "lang_check": F.lit(True)})
    return rules.error_places(errors, "path", "rule")


@query("""WITH f AS (SELECT origin, file_name, max(mtime) AS mtime FROM rollout_lines GROUP BY ALL)
SELECT origin, file_name, CAST(row_number() OVER (PARTITION BY origin ORDER BY mtime DESC NULLS LAST, file_name) AS INT) AS place FROM f""")
def newest_files(spark, d):
    files = table(spark, d, "rollout_lines").groupBy("origin", "file_name").agg(F.max("mtime").alias("mtime"))
    return eventlog.newest_first(files, "origin", "file_name", "mtime").select("origin", "file_name", "place")


@query("""WITH f AS (SELECT source_id, unnest(['video' || CASE length(source_id) % 3 WHEN 0 THEN '.webm' WHEN 1 THEN '.MKV' ELSE '.txt' END, 'video.m4a', 'video.' || coalesce(caption_lang, 'mov')]) AS name FROM transcripts),
r AS (SELECT source_id, name, list_position(['.mp4', '.mkv', '.webm', '.mov', '.m4v'], lower(regexp_extract(name, '\\.[^./]+$'))) AS place FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY place, name) AS n FROM r WHERE place > 0)
SELECT source_id, name FROM k WHERE n = 1""")
def media_pick(spark, d):
    """The video file of each source by preference of suffixes; sources without any have none."""
    n = F.length("source_id") % 3
    names = F.array(F.concat(F.lit("video"), F.when(n == 0, ".webm").when(n == 1, ".MKV").otherwise(".txt")), F.lit("video.m4a"), F.concat(F.lit("video."), F.coalesce("caption_lang", F.lit("mov"))))
    files = table(spark, d, "transcripts").select("source_id", F.explode(names).alias("name")).withColumn("place", lists.priority(F.col("name"), (".mp4", ".mkv", ".webm", ".mov", ".m4v")))
    rank = F.struct(F.col("place"), F.col("name"))
    return files.where("place is not null").groupBy("source_id").agg(F.min_by("name", rank).alias("name"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'sk-' || repeat('x', CAST(event_id % 40 AS INT)) WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE 'other' || event_id END AS k, epoch_us(ts) // 1000000 AS s FROM events)
SELECT event_id, CASE WHEN coalesce(trim(k), '') = '' THEN 'missing' WHEN starts_with(k, 'sk-') AND length(k) >= 20 THEN 'ok' ELSE 'malformed' END AS shape,
  CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') END AS reset_at,
  array_to_string(list_sort(list_distinct(['a', 'b' || event_id % 3, 'b1', 'c'])), ',') AS scopes, CAST(event_id % 3600 AS DOUBLE) + 0.25 AS cue_s FROM v""")
def small_functions(spark, d):
    """Shapes of keys without their values, reset headers, lists with what they lack, and cue times."""
    n = F.col("event_id")
    key = F.when(n % 4 == 0, F.concat(F.lit("sk-"), F.repeat(F.lit("x"), (n % 40).cast("int")))).when(n % 4 == 1, F.lit(" ")).when(n % 4 == 3, F.concat(F.lit("other"), n.cast("string")))
    header = F.when(n % 3 == 0, F.lit("soon")).otherwise(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    scopes = lists.ordered_append(F.array(F.lit("a"), F.concat(F.lit("b"), (n % 3).cast("string"))), F.array(F.lit("b1"), F.lit("c"), F.lit("a")))
    cue = F.format_string("%02d:%02d,250", F.floor(n % 3600 / 60).cast("bigint"), n % 60)
    return table(spark, d, "events").select("event_id", text.key_shape(key, "sk-").alias("shape"), lists.reset_time(header).alias("reset_at"), F.array_join(F.array_sort(scopes), ",").alias("scopes"), clock.parse_cue_time(cue).alias("cue_s"))
