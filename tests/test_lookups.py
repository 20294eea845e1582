import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import lists
from tidewell.operators import lookups, rules
from tidewell.sources import pages


@pytest.mark.parametrize("block", [3.0, 50.0, 1e6])
def test_asof_against_brute_force(spark, block):
    rng = random.Random(6)
    points = [(rng.choice("ab"), float(rng.randrange(60))) for _ in range(80)] + [("c", 1.0)]
    marks = [(rng.choice("ab"), float(rng.randrange(60)), rng.randrange(1000)) for _ in range(25)] + [("d", 0.0, 1)]
    got = lookups.latest_before(spark.createDataFrame(points, "k string, t double"), spark.createDataFrame(marks, "k string, t double, v int"), "k", "t", "v", block)
    want = [(k, t, max(((mt, mv) for mk, mt, mv in marks if mk == k and mt <= t), default=(0, None))[1]) for k, t in points]
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(want, key=str)


def test_lookup_through_arrays(spark):
    items = spark.createDataFrame([(1, ["b", "x", "a", "b", None]), (2, []), (3, None)], "id int, keys array<string>")
    values = spark.createDataFrame([("a", "A", 1), ("b", "old", 1), ("b", "B", 2)], "k string, v string, w int")
    got = {r["id"]: r["found"] for r in lookups.through_array(items, "id", "keys", values, "k", "v", "w").collect()}
    assert got == {1: ["B", "A", "B"], 2: [], 3: []}


def test_pages(spark):
    raw = [("p1", '{"data": [{"id": "1"}, {"id": "2"}], "meta": {"next_token": "n"}}'), ("p2", "bad"), ("p3", '{"errors": []}'), ("p4", None)]
    got = pages.items_of_pages(spark.createDataFrame(raw, "page string, raw string")).orderBy("pos").collect()
    assert [(r["page"], r["pos"], r["item"], r["next_token"]) for r in got] == [("p1", 0, '{"id":"1"}', "n"), ("p1", 1, '{"id":"2"}', "n")]


def test_small_expressions(spark):
    row = spark.range(1).select(
        lists.clock_list(F.lit("1:00, 30,1:00,x")).alias("a"), lists.ordered_append(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit("a"))).alias("b"),
        lists.has_repeats(F.array(F.lit("x"), F.lit("x"))).alias("c"), lists.reset_time(F.lit("0")).alias("d"), lists.reset_time(F.lit("soon")).alias("e"),
        rules.is_package_manifest(F.lit("packages/a/plugin.json")).alias("f"), rules.is_package_manifest(F.lit("packages/a/b/plugin.json")).alias("g"), lists.priority(F.lit("x.MP4"), (".mkv", ".mp4")).alias("h"),
    ).collect()[0]
    assert tuple(row) == ([30.0, 60.0], ["b", "a", "c"], True, "1970-01-01 00:00:00", "soon", True, False, 2)
    assert lookups.preview(spark.createDataFrame([("k", i) for i in range(5)], "k string, i int"), "k", ["i"], 2).select("i", "left_out").orderBy("i").collect() == [(0, 3), (1, 3)]
