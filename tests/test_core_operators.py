import random

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from tidewell.functions import clock, jsonx, text
from tidewell.operators import collections as C
from tidewell import session
from tidewell.operators import blocks, folds, intervals, lookups, rules, sampling, snapshots
from tidewell.sources import cues, eventlog, pages
from tidewell.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def values(spark, schema, rows, column):
    return [r["x"] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_clock_goldens(spark):
    assert values(spark, "t string", [("75",), ("01:15",), ("1:02:03",), ("x",), (None,), ("",), ("1:2:3:4",)], clock.parse_clock(F.col("t"))) == [75.0, 75.0, 3723.0, None, None, None, None]
    assert values(spark, "s double", [(75.0,), (3723.0,), (None,)], clock.format_clock(F.col("s"))) == ["01:15", "1:02:03", "unknown"]
    assert values(spark, "m bigint", [(1440,), (300,), (90,), (0,), (None,)], clock.window_label(F.col("m"))) == ["1d (1440 minutes)", "5h (300 minutes)", "90 minutes", "0d (0 minutes)", "unknown"]
    same = values(spark, "t string", [("1780000000000",), ("1780000000",), ("10:00",), ("2026-01-01T00:00:00Z",), ("junk",)], F.unix_seconds(clock.mixed_timestamp(F.col("t"))))
    assert same[0] == same[1] == 1780000000 and same[2] is None and same[3] == 1767225600 and same[4] is None
    assert values(spark, "s double", [(93784.0,), (0.0,), (-5.0,), (None,)], clock.human_duration(F.col("s"))) == ["1d 2h 3m 4s", "0s", "0s", None]


def test_calendar_versions(spark):
    day = F.lit("2026-08-10").cast("date")
    assert values(spark, "v string", [("2026.8.9.2",), ("2026.8.10",), ("2026.8.10.1",), ("2026.8.11",)], clock.next_calver(F.col("v"), day)) == ["2026.8.10", "2026.8.10.1", "2026.8.10.2", None]
    bad = ["2026.08.10", "2026.8.10.0", "2026.2.30", "0000.1.1", "2026.8", "2026.8.10\n", "v2026.8.10", "2026.8.10.01", None]
    assert not any(values(spark, "v string", [(b,) for b in bad], F.coalesce(clock.calver_parts(F.col("v"))["valid"], F.lit(False))))


def test_retry(spark):
    now = F.lit("2026-01-05 10:00:00").cast("timestamp")
    assert values(spark, "t string", [("5",), ("-3",), ("Mon, 5 Jan 2026 10:00:30 GMT",), ("soon",)], clock.retry_after(F.col("t"), now)) == [5.0, 0.0, 30.0, 0.0]
    assert values(spark, "a int", [(1,), (3,), (9,)], clock.backoff(F.col("a"))) == [1.0, 4.0, 12.0]


def test_text_helpers(spark):
    assert one(spark, text.strip_markup(F.lit("<i>a</i> &lt;b&gt;&amp;  c"))) == "a <b>& c"
    assert values(spark, "p string", [("Café/x",), ("CAFÉ/x",), ("a//b",), ("con.txt",), ("a ",), ("../x",), (None,)], text.portable_key(F.col("p"))) == ["café/x", "café/x", None, None, None, None, None]
    assert values(spark, "p string", [("--",), ("a b/c",), (None,)], text.slug(F.col("p"))) == ["item", "a-b-c", "item"]
    assert values(spark, "p string", [("gsk_" + "x" * 20,), ("gsk_x",), ("",), (None,)], text.key_shape(F.col("p"), "gsk_")) == ["ok", "malformed", "missing", "missing"]
    assert values(spark, "p string", [("a.en.vtt",), ("a.vtt",)], text.language_of_file(F.col("p"))) == ["en", None]


def test_json_aliases_stop_at_present_null(spark):
    raws = [('{"b": 3}',), ('{"a": null, "b": 3}',), ('{"a": " x "}',), ('{"a": true}',), ("bad",), (None,)]
    assert values(spark, "j string", raws, jsonx.display_count(jsonx.first_present(F.col("j"), ["a", "b"]))) == ["3", "unknown", "x", "unknown", "unknown", "unknown"]
    assert values(spark, "j string", [('{"p": {"q": ""}, "r": "z"}',), ('{"p": {"q": 1}}',)], jsonx.first_string(F.col("j"), ["p.q", "r"])) == ["z", None]
    assert values(spark, "j string", [('{"a": 42.50}',), ('{"a": 7}',)], jsonx.display_percent(jsonx.first_present(F.col("j"), ["a"]))) == ["42.5%", "7%"]


def test_union_length_against_naive(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), s := rng.uniform(0, 100), s + rng.uniform(-2, 9)) for _ in range(400)] + [("c", None, 3.0), ("c", 5.0, 5.0)]
    got = {r["k"]: r["covered"] for r in intervals.union_length(spark.createDataFrame(rows, "k string, s double, e double"), "k", "s", "e").collect()}
    for key in "ab":
        total, reach = 0.0, -1e9
        for s, e in sorted((s, e) for k, s, e in rows if k == key and s is not None and e > s):
            total += max(0.0, e - max(s, reach))
            reach = max(reach, e)
        assert abs(got[key] - total) < 2e-3
    assert "c" not in got


def test_chunks_and_plans(spark):
    df = spark.createDataFrame([(1, 600.0, 5 << 20), (2, 3600.0, 71 << 20), (3, 0.0, 99 << 20)], "id int, s double, b bigint")
    rows = intervals.chunk_plan(df, "s", "b", 24 << 20).orderBy("id", "chunk_no").collect()
    assert [(r["id"], r["offset_s"], r["length_s"]) for r in rows] == [(1, 0.0, 600.0), (2, 0.0, 1200.0), (2, 1200.0, 1200.0), (2, 2400.0, 1200.0), (3, 0.0, 0.0)]
    plan = intervals.frame_plan(F.col("s"), F.col("m"))
    got = spark.createDataFrame([(30.0, 80), (1200.0, 500), (None, 80)], "s double, m int").select(plan.alias("p")).collect()
    assert [(round(r["p"]["fps"], 4), r["p"]["frames"]) for r in got] == [(1.0, 30), (round(100 / 1200, 4), 100), (1.0, 80)]


def collapse(spark, texts):
    rows = [("s", i, float(i), i + 1.0, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "source_id string, pos int, start_s double, end_s double, text string")
    return [(r["start_s"], r["end_s"], r["text"]) for r in folds.rolling_collapse(df).orderBy("start_s").collect()]


def test_rolling_collapse_rules(spark):
    assert collapse(spark, ["a b", "a b", "a b c", "a b", "b c", None, " "]) == [(0.0, 5.0, "a b c")]
    assert collapse(spark, ["we ship the parser today", "the parser today is fast"]) == [(0.0, 1.0, "we ship the parser today"), (1.0, 2.0, "is fast")]
    assert collapse(spark, ["read the code", "code review is next"]) == [(0.0, 1.0, "read the code"), (1.0, 2.0, "code review is next")]
    assert folds.trim_overlap("x y", "x y") == ""


def test_last_kept_differs_from_previous(spark):
    rows = [("k", i, [float(v)]) for i, v in enumerate([0, 1, 2, 3, 4, 10])] + [("k", 6, None), ("k", 7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k string, pos bigint, v array<double>")
    assert sorted(r["pos"] for r in folds.last_kept(df, "k", "pos", "v", 2.0).collect()) == [0, 3, 5, 6, 7]


def test_even_sample_against_python(spark):
    for n, most in ((10, 4), (3, 8), (57, 9), (100, 100), (2, 2), (5, 1)):
        df = spark.createDataFrame([("g", i) for i in range(n)], "g string, i int")
        want = list(range(n)) if n <= most else [0] if most <= 1 else sorted({round(k * (n - 1) / (most - 1)) for k in range(most)})
        assert sorted(r["i"] for r in sampling.even_sample(df, "g", ["i"], most, F.floor(F.col("i") / 7)).collect()) == want


def test_pinned_rows_stay(spark):
    a = spark.createDataFrame([("g", 1.0, 1), ("g", 2.0, 2)], "g string, at double, id int")
    b = spark.createDataFrame([("g", 1.0, 9), ("g", None, 8)], "g string, at double, id int")
    assert [(r["id"], r["index"]) for r in sampling.merge_pinned(a, b, "g", "at", "id", F.floor("at")).orderBy("index").collect()] == [(1, 1), (9, 2), (2, 3), (8, 4)]
    assert sampling.min_count_fallback(a, b, "g", 3).where("fallback").count() == 2


def test_hydration_keeps_order_and_repeats(spark):
    items = spark.createDataFrame([("1", "old", 1), ("1", "new", 2), ("3", "c", 1)], "id string, v string, w int")
    wanted = spark.createDataFrame([(0, "3"), (1, "1"), (2, "9"), (103, "3"), (4, None)], "pos int, id string")
    assert [(r["pos"], r["v"], r["batch_no"]) for r in C.hydrate(wanted, items, "id", "w").orderBy("pos").collect()] == [(0, "c", 0), (1, "new", 0), (103, "c", 1)]


def feed(spark):
    return spark.createDataFrame([("s", i, str(5 - i), f"2026-07-0{5 - i}T00:00") for i in range(3)], "scope string, pos int, id string, created_at string")


def test_cutoffs(spark):
    state = lambda i, c: spark.createDataFrame([("s", i, c)], incremental.STATE)
    ids = lambda st: [r["id"] for r in C.since_last(feed(spark), st).orderBy("pos").collect()]
    assert ids(state("4", None)) == ["5"]
    assert ids(state("gone", "2026-07-03T00:00")) == ["5", "4"]
    assert ids(state("gone", None)) == ["5", "4", "3"] == ids(state(None, None)) == ids(state("4", None).limit(0))
    up = C.advance_state(feed(spark), spark.createDataFrame([("t", "1", "c")], incremental.STATE)).orderBy("scope").collect()
    assert [tuple(r) for r in up] == [("s", "5", "2026-07-05T00:00"), ("t", "1", "c")]


def test_streaming_batches(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    got = []
    sink = lambda df: got.append(sorted(r["id"] for r in df.collect()))
    for part in (["1", "2"], ["2", "3"]):
        rows = [("s", -int(i), i, f"2026-01-0{i}") for i in part]
        spark.createDataFrame(rows, "scope string, pos int, id string, created_at string").write.mode("append").json(source)
        stream = spark.readStream.schema("scope string, pos int, id string, created_at string").json(source)
        incremental.start(stream, state, str(tmp_path / "cp"), sink).awaitTermination()
    assert got == [["1", "2"], ["3"]]


def test_snapshots(spark):
    e = spark.createDataFrame([("f", 1, "m", "t1"), ("f", 2, "s", None), ("f", 3, "m", "t2"), ("f", 4, "s", None), ("f", 5, "m", "t3"), ("g", 1, "s", None), ("h", 1, "m", "x")], "f string, n int, k string, id string")
    got = snapshots.latest_snapshot(e, "f", "n", F.col("k") == "s", F.col("n"), F.col("id")).orderBy("f").collect()
    assert [tuple(r) for r in got] == [("f", 4, 4, "t2"), ("g", 1, 1, None)]
    c = spark.createDataFrame([("k", 1, "used", 1), ("k", 2, "available", None), ("k", 3, "available", 5), ("l", 4, "used", None)], "k string, i int, s string, e int")
    assert [tuple(r) for r in snapshots.next_expiring(c, "k", "s", "e", "i").orderBy("k").collect()] == [("k", 3, 2, 3), ("l", 4, 0, 1)]


def test_rules(spark):
    df = spark.createDataFrame([(1, "key: ghp_0123456789abcdef0123"), (2, "nothing"), (3, None)], "id int, t string")
    found = rules.secret_scan(df, "id", "t")
    assert found.columns == ["id", "shape"] and [tuple(r) for r in found.collect()] == [(1, "ghp")]
    a = spark.createDataFrame([("p", "1"), ("q", None), ("r", "1")], "k string, v string")
    b = spark.createDataFrame([("p", "2"), ("q", "1"), ("r", "1"), ("s", "1")], "k string, v string")
    assert {tuple(r) for r in rules.version_changes(a, b, "k", "v").collect()} == {("p", "1", "2"), ("q", None, "1")}
    assert rules.violations(df, F.col("id").cast("string"), {"x": F.col("t").isNull(), "y": F.lit(None).cast("boolean")}).collect() == [Row(path="3", rule="x")]


def test_cue_files_and_responses(spark):
    raw = "WEBVTT\r\n\r\n00:00:01.000 --> 00:00:02.000 align:start\r\n<c>hello</c> &amp;\r\nworld\r\n\r\n00:03.000 --> 00:04,500\nnext line\n\n00:05.000 --> 00:06.000\n\n"
    got = cues.parse_cues(spark.createDataFrame([("f", raw), ("g", None)], "source_id string, raw string")).orderBy("pos").collect()
    assert [(r["start_s"], r["end_s"], r["text"]) for r in got] == [(1.0, 2.0, "hello & world"), (3.0, 4.5, "next line")]
    df = spark.createDataFrame([("a", '{"segments": [{"start": 1, "end": 2.5, "text": " hello "}, {"text": " "}]}'), ("b", '{"text": "all"}'), ("c", "bad")], "source_id string, raw string")
    rows = cues.segments_of_responses(df, F.lit(10.0)).orderBy("source_id").collect()
    assert [(r["source_id"], r["start_s"], r["end_s"], r["text"]) for r in rows] == [("a", 11.0, 12.5, "hello"), ("b", 10.0, 10.0, "all")]


def test_event_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "rollout-1.jsonl").write_text('{"type": "session_meta", "payload": {"id": "t"}}\nbad\n[1]\n')
    (tmp_path / "x" / "other.txt").write_text("no")
    got = eventlog.events(eventlog.read_event_files(spark, str(tmp_path))).collect()
    assert [(r["event_type"], r["session_id"]) for r in got] == [("session_meta", "t")]
    (tmp_path / "env").write_text("# c\nA='x'\nA=y\nB=\n")
    assert [tuple(r) for r in eventlog.read_env_file(spark, str(tmp_path / "env")).collect()] == [("A", "x")]
    assert eventlog.list_files(spark, str(tmp_path / "x")).count() == 2


def test_border_against_all_lengths():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(0, 7))] for _ in range(2))
        want = max((k for k in range(1, min(len(a), len(b)) + 1) if a[-k:] == b[:k]), default=0)
        assert folds.border(a, b) == want
    assert folds.trim_overlap("a b c d", "b c d e") == "e" and folds.trim_overlap("a b c", "b c d") == "b c d" and folds.trim_overlap("a b", "b") == ""


def test_a_caption_ends_with_its_last_cue(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 9.0, "we go on"), ("v", 1, 1.0, 5.0, "we go on"), ("v", 2, 2.0, 6.0, "we go on and on"), ("v", 3, 6.0, 8.0, "on and on we stop"), ("v", 4, None, None, None)], "source_id string, pos int, start_s double, end_s double, text string")
    assert [tuple(r) for r in folds.rolling_collapse(df).orderBy("start_s").collect()] == [("v", 0.0, 6.0, "we go on and on", 3), ("v", 6.0, 8.0, "we stop", 1)]


def test_state_is_replaced_as_a_whole(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "k string, v int"
    assert pages.read_state(spark, path, schema).count() == 0
    for n in range(4):
        pages.replace_state(spark.createDataFrame([("a", n), ("b", n)], schema), path)
        assert {r["v"] for r in pages.read_state(spark, path, schema).collect()} == {n}
    (tmp_path / "state" / "v9").mkdir()  # a version that was never finished
    assert {r["v"] for r in pages.read_state(spark, path, schema).collect()} == {3}


def test_last_written_of_ties_and_unknown_orders(spark):
    items = spark.createDataFrame([(1, "r"), (2, "gone"), (3, None)], "i int, ref string")
    targets = spark.createDataFrame([("r", "old", 1), ("r", "new", 2), ("r", "x", None), ("lost", "y", 1)], "k string, o string, at int")
    owners = spark.createDataFrame([("new", "N", 1), ("new", "N2", 3), ("x", "X", 1)], "o string, name string, at int")
    got = lookups.through_reference(items, "ref", targets, "k", "o", owners, "o", "name", order=("at", "at")).orderBy("i").collect()
    assert [(r["i"], r["owner"], r["owner_name"]) for r in got] == [(1, "new", "N2"), (2, None, None), (3, None, None)]
    assert C.last_written(spark.createDataFrame([("a", 1, None)], "k string, v int, at int"), "k", "at").first()["v"] == 1


def test_a_page_scan_stops(spark):
    p = spark.createDataFrame([("f", i, 2, None if i == 4 else "t") for i in range(1, 7)] + [("g", 1, None, "t"), ("g", 2, 5, "t")], "feed string, page int, n int, token string")
    read = lambda **k: sorted(tuple(r)[:2] for r in pages.scan_pages(p, "feed", "page", "n", "token", **k).collect())
    assert read() == [("f", 1), ("f", 2), ("f", 3), ("f", 4), ("g", 1), ("g", 2)]
    assert read(wanted=3) == [("f", 1), ("f", 2), ("g", 1), ("g", 2)] and read(most_pages=1) == [("f", 1), ("g", 1)] and read(wanted=0) == []


def test_values_of_mixed_payloads(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": [1, {"s": "k"}, null, [2]]}'), (2, '{"a": []}'), (3, "broken"), (4, None)], "i int, raw string")
    got = df.select("i", F.size(jsonx.first_list(F.col("raw"), ("a", "b"))).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [1, 0, 0, 0]


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session)


def test_blocks_give_what_one_window_gives(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["hot", "hot", "hot", "k", None]), rng.choice([None, rng.random() * 100]), rng.choice([None, "", "a", "b"]), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, at double, v string, i int")
    order = [F.col("at").asc_nulls_last(), "i"]
    plain = Window.partitionBy("k").orderBy(*order)
    for width in (1.0, 7.0, 1000.0):
        got = blocks.with_place(df, "k", order, F.floor(F.col("at") / width), "n")
        want = df.withColumn("n", F.row_number().over(plain)).withColumn("n_of", F.count("*").over(Window.partitionBy("k")))
        assert got.exceptAll(want).count() == 0 and got.count() == len(rows)
        known = df.where("at is not null")
        filled = snapshots.forward_fill(known, "k", ["at", "i"], "v", "f", F.floor(F.col("at") / width))
        one = known.withColumn("f", F.last(F.nullif("v", F.lit("")), ignorenulls=True).over(Window.partitionBy("k").orderBy("at", "i").rowsBetween(Window.unboundedPreceding, 0)))
        assert filled.exceptAll(one).count() == 0 and filled.count() == known.count()
        spans = known.withColumn("e", F.col("at") + F.col("i") % 5)
        assert intervals.union_length(spans, "k", "at", "e", width).exceptAll(intervals.union_length(spans, "k", "at", "e", 1e9)).count() == 0
    assert blocks.with_place(df.limit(0), "k", order, F.floor("at"), "n").count() == 0


def test_landed_pages_of_every_form(spark, tmp_path):
    """API pages, one object, a saved-session export as a bare list, and files that are no JSON."""
    for name, raw in {"a": '{"data": [{"id": "1"}, {"id": "2"}], "meta": {"next_token": "t"}}', "b": '[{"id": "3"}]', "c": "broken", "d": '{"data": "none"}', "e": ""}.items():
        (tmp_path / name).write_text(raw)
    landed = pages.read_pages(spark, str(tmp_path))
    assert [(r["pos"], r["item"], r["next_token"]) for r in pages.items_of_pages(landed).orderBy("pos").collect()] == [(0, '{"id":"1"}', "t"), (1, '{"id":"2"}', "t")]
    assert [r["item"] for r in pages.items_of_pages(landed, scope="$").collect()] == ['{"id":"3"}']
    out = str(tmp_path / "run" / "one")
    pages.write_new(landed.select("page"), out)
    with pytest.raises(Exception, match="(?i)exists"):
        pages.write_new(landed.select("page"), out)


def test_small_tables_are_spread_and_keep_their_rows(spark, tmp_path):
    one = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(one)
    df = spark.read.parquet(one)
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and session.spread(df).count() == 100
    many = str(tmp_path / "many")
    spark.range(100).repartition(8).write.parquet(many)
    kept = spark.read.parquet(many)
    assert session.spread(kept) is kept
