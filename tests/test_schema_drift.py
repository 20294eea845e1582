import itertools
import json
import random

from tidewell.operators import schema_drift as S

SCHEMA = "origin string, file_name string, mtime timestamp, line_no bigint, raw string"


def lines(spark, files):
    rows = [(o, f, None, i, r if isinstance(r, str) or r is None else json.dumps(r)) for (o, f), raws in files.items() for i, r in enumerate(raws)]
    return spark.createDataFrame(rows, SCHEMA)


def drift(spark, files):
    return {(r["file_name"], r["change_kind"], r["json_path"]) for r in S.schema_drift(lines(spark, files)).collect()}


def name(day):
    return f"o/rollout-2026-01-0{day}T00-00-00-ab.jsonl"


def test_each_kind_of_change(spark):
    old = [{"type": "a", "n": 1, "who": "user", "gone": True, "deep": {"x": 1, "y": "s"}}] * 3
    new = [{"kind": "a", "n": "1", "who": "user", "deep": {"x": 1, "y": "s"}, "fresh": {"inner": 1}}] * 3
    assert drift(spark, {("o", name(1)): old, ("o", name(2)): new}) == {(name(2), "renamed", "kind"), (name(2), "retyped", "n"), (name(2), "removed", "gone"), (name(2), "added", "fresh")}


def test_nulls_other_lines_order_and_origins(spark):
    files = {
        ("o", name(2)): [{"a": 1}, "not json", None, "", "[1]", "null", "﻿{]"], ("o", name(1)): [{"a": 2}, {"a": None}, {"a": 2}],
        ("p", name(3)): [{"b": None}], ("p", name(4)): [{"b": "x"}], (None, name(5)): [{"c": 1}],
    }
    assert drift(spark, files) == set()


def test_file_without_objects_and_empty_table(spark):
    assert drift(spark, {("o", name(1)): [{"a": 1}], ("o", name(2)): ["nope"]}) == {(name(2), "removed", "a")}
    assert S.schema_drift(lines(spark, {("o", name(1)): [{"a": 1}]}).limit(0)).count() == 0


def test_nothing_below_a_case(spark):
    old = [{"box": {"a": 1, "b": {"c": 1}}, "keep": 1}]
    new = [{"box": "flat", "keep": 1}]
    assert drift(spark, {("o", name(1)): old, ("o", name(2)): new}) == {(name(2), "retyped", "box")}


def test_renamed_container_is_compared_by_its_fields(spark):
    old, new = [{"info": {"total": 1, "used": 2}}] * 2, [{"usage": {"total": 1, "used": 2}}] * 2
    assert drift(spark, {("o", name(1)): old, ("o", name(2)): new}) == {(name(2), "renamed", "usage")}


def test_names_with_dots_are_fields_of_their_own(spark):
    assert drift(spark, {("o", name(1)): [{"type": "x"}], ("o", name(2)): [{"type": "x", "a.b": 1}]}) == {(name(2), "added", "a.b")}
    assert drift(spark, {("o", name(1)): [{"t": 1, "a": {"b": 1}}], ("o", name(2)): [{"t": 1, "a": {"b": 1}, "a.b": "s"}]}) == {(name(2), "added", "a.b")}


def test_pieces_of_a_file_change_nothing(spark, monkeypatch):
    files = {("o", name(d)): [{"type": "a", ("n" if d < 3 else "count"): i, "who": f"u{i}"} for i in range(40)] for d in range(1, 5)}
    whole = drift(spark, files)
    monkeypatch.setattr(S, "PIECE_LINES", 3)
    monkeypatch.setattr(S, "FLUSH_AT", 2)
    assert drift(spark, files) == whole == {(name(3), "renamed", "count")}


def test_the_schema_of_the_consistent_table(spark):
    files = {("o", name(1)): [{"type": "a", "n": 1, "box": {"x": 1}}] * 3, ("o", name(2)): [{"kind": "a", "n": "1", "box": {"x": True}}] * 2 + [{"n": None, "void": None}]}
    got = {r["json_path"]: tuple(r)[1:] for r in S.unified_fields(lines(spark, files)).collect()}
    assert got == {"type": ("string", "string", 2, 5), "n": ("string", "string,number", 1, 6), "box": ("object", "object", 1, 5), "box.x": ("string", "number,boolean", 1, 5), "void": ("null", "", 1, 1)}
    assert S.unified_fields(lines(spark, files).limit(0)).count() == 0


def test_assignment_is_optimal():
    rng = random.Random(1)
    for n, m in ((1, 1), (2, 3), (4, 4), (3, 2)):
        score = [[rng.random() for _ in range(m)] for _ in range(n)]
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        get = (lambda i, j: score[i][j]) if n <= m else (lambda i, j: score[j][i])
        best = max(sum(get(i, p[i]) for i in small) for p in itertools.permutations(large, len(small)))
        assert abs(sum(score[i][j] for i, j in S.best_assignment(score)) - best) < 1e-9
    assert S.best_assignment([]) == [] and S.best_assignment([[]]) == []


def test_hot_file_profiles_do_not_depend_on_partitions(spark):
    df = lines(spark, {("o", name(1)): [{"a": i, "b": str(i)} for i in range(400)], ("o", name(2)): [{"a": 1.5, "b": "x"}]})
    one = {tuple(r) for r in S.file_profiles(df.coalesce(1)).collect()}
    many = {tuple(r) for r in S.file_profiles(df.repartition(7)).collect()}
    assert one == many


def test_unified_records(spark):
    df = lines(spark, {("o", name(1)): [{"type": "a", "x": {"y": 1}}] * 4, ("o", name(2)): [{"kind": "a", "x": {"y": 2}, "l": [1]}, "junk"]})
    got = {r["file_name"]: r["fields"] for r in S.unify_records(df).collect()}
    assert got[name(1)] == {"type": "a", "x.y": "1"} and got[name(2)] == {"type": "a", "x.y": "2", "l": "[1]"}
    assert S.unify_records(df).count() == 5


def test_child_rename_below_a_renamed_container(spark):
    """A rename below a container holds under every name of the container, at any depth and in any origin."""
    window = lambda box, limits, used: {"body": {box: {limits: {used: 7, "minutes": 300}, "plan": "pro"}}}
    df = lines(spark, {
        ("o", name(1)): [window("rate_limits", "primary", "used_percent")] * 2, ("o", name(2)): [window("rateLimits", "primary", "used_percent")] * 5,
        ("p", name(1)): [window("rate_limits", "primary", "used_percent")] * 2, ("p", name(2)): [window("rate_limits", "primary", "usedPercent")] * 2,
        ("q", name(1)): [window("rate_limits", "primary", "usedPercent")] * 4, ("q", name(2)): [window("rate_limits", "primary_window", "usedPercent")] * 2,
        ("r", name(1)): [window("rateLimits", "primary_window", "used_percent")], ("s", name(1)): [window("rateLimits", "primary", "usedPercent")] * 8,
    })
    assert drift(spark, {("o", name(1)): [window("rate_limits", "primary", "used_percent")], ("o", name(2)): [window("rateLimits", "primary", "used_percent")]}) == {(name(2), "renamed", "body.rateLimits")}
    rows = S.unify_records(df).collect()
    assert len(rows) == 26 and {tuple(sorted(r["fields"].items())) for r in rows} == {(("body.rateLimits.plan", "pro"), ("body.rateLimits.primary.minutes", "300"), ("body.rateLimits.primary.usedPercent", "7"))}


def test_fields_of_one_class_side_by_side_are_all_kept(spark):
    df = lines(spark, {
        ("o", name(1)): [{"used_by": "a", "n": 1}] * 4, ("o", name(2)): [{"usedBy": "a", "n": 1}] * 2,
        ("p", name(3)): [{"used_by": "b", "usedBy": "c"}, {"usedBy": "c", "used_by": "b"}, {"used_by": "b", "usedBy": "b"}, {"usedBy": "c", "used_by": None}, {"usedBy": None, "used_by": "b"}],
    })
    fields = lambda day: [r["fields"] for r in S.unify_records(df).where(f"file_name = '{name(day)}'").orderBy("line_no").collect()]
    assert fields(2) == [{"used_by": "a", "n": "1"}] * 2
    assert fields(3) == [{"used_by": "b", "usedBy": "c"}, {"used_by": "b", "usedBy": "c"}, {"used_by": "b", "usedBy": "b"}, {"used_by": "c"}, {"used_by": "b"}]


def test_values_of_the_file_pair_count(spark):
    """A rename is seen by the values of its two files, whatever else other origins put under the new name."""
    files = {("o", name(1)): [{"type": f"a{i}-x", "n": 1} for i in range(3)], ("o", name(2)): [{"kind": f"a{i}-x", "n": 1} for i in range(3)]}
    others = {("p", name(3)): [{"kind": f"{i * i} of b {i}" + "/" * (i % 7), "n": 1} for i in range(200)]}
    assert drift(spark, files | others) == drift(spark, files) == {(name(2), "renamed", "kind")}
