import random

import pytest

from tidewell.operators import delivery as D

SCHEMA = "row_id bigint, id string, source string, key string, rank int"


def brute(rows):
    import re

    seen, out = set(), set()
    for row_id, raw, source in sorted(rows, key=lambda r: r[0]):
        bare = re.search(r"([0-9A-Za-z_-]+)[^0-9A-Za-z_-]*$", re.sub(r"(?<=\S)[?#].*$", "", raw or "", flags=re.S))
        name = (source or "").strip().lower()
        if not bare or not name:
            continue
        key = (bare.group(1), name)
        if key in seen:
            out.add(row_id)
        seen.add(key)
    return out


def found(spark, rows):
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], SCHEMA)
    return {r[0] for r in D.repeated_deliveries(df).collect()}


@pytest.mark.parametrize("raw", ["77a", " 77a", "77a\n", "\t77a", "id:77a", "post/77a", "https://h.example/i/web/status/77a", "https://h.example/u/status/77a?s=20", "https://h.example/u/status/77a/"])
def test_wrapped_ids_are_the_same(spark, raw):
    assert found(spark, [(1, "77a", "s"), (2, raw, " S ")]) == {2}


def test_case_source_null_and_blank(spark):
    rows = [(1, "aB", "s"), (2, "ab", "s"), (3, "aB", "t"), (4, None, "s"), (5, None, "s"), (6, " ", "s"), (7, "", "s"), (8, "aB", None), (9, "aB", " "), (10, "aB", "S")]
    assert found(spark, rows) == {10} == brute(rows)


def test_hot_identifier_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(300)}", rng.choice(["a", "A ", "b"])) for i in range(3000)]
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_kept_rows_keep_all_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", "s", "k", 5), (2, "a", "s", "k", 6)], SCHEMA)
    kept = D.drop_repeats(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a", "s", "k", 5)]
    assert D.repeated_deliveries(df.limit(0)).count() == 0 and D.drop_repeats(df.limit(0)).count() == 0


def test_new_batches_against_stored(spark):
    stored = spark.createDataFrame([(1, "a", "s", "", 0), (2, "b", "s", "", 0)], SCHEMA)
    batch = spark.createDataFrame([(9, "id:a", "S", "", 0), (10, "c", "s", "", 0), (11, "c", "s", "", 0), (12, "b", "t", "", 0), (13, None, "s", "", 0)], SCHEMA)
    assert {(r["row_id"], r["message_id"], r["message_source"]) for r in D.new_messages(batch, stored).collect()} == {(10, "c", "s"), (12, "b", "t")}


def test_rows_without_arrival_number_stay(spark):
    df = spark.createDataFrame([(1, "a", "s", "x", 1), (None, "a", "s", "y", 1), (None, "b", "s", "z", 1), (2, "a", "s", "w", 1)], SCHEMA)
    assert [r[0] for r in D.repeated_deliveries(df).collect()] == [2]
    assert sorted(r["key"] for r in D.drop_repeats(df).collect()) == ["x", "y", "z"]
