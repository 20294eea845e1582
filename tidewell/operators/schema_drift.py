"""Schema drift over files of JSON lines: profiles, changes from file to file, and one consistent table.

1. Lines are brought together by file (pieces of ``PIECE_LINES`` lines of a file, so a hot file is spread) and parsed
   once. A task reduces them to one profile row per (origin, file, path): which types occur, how often, and a value sketch
   (one-permutation min-hash of the values and of their shapes); and to one sketch per path. Profiles and sketches are
   written once and merged by aggregates that combine map-side.
2. Files of an origin are ordered by the time in the file name on a slim (origin, file) table, day by day. Each profile is
   handed to its own file and to the file after it, and every pair of neighbours is compared in a task of its
   own, so an origin with a third of all files is spread as well.
3. Fields that go and fields that come under the same parent are matched one to one (Hungarian method on name
   similarity, value sketches of the file pair and of the path in the whole corpus, and child names).
4. ``unify_records`` maps every path to the most frequent name of its rename class; where that name is taken in
   the same record, to its own.

Inside, names are joined by ``SEP``, which no name holds (it is dropped from names), so a name with a dot is one field; results join
names by dots.

Defined results
- lines that are no JSON object (null, blank, cut off, ``null``, arrays) carry no fields;
- a file without any object has the empty schema; a file name without a time sorts after those with one;
- null values tell nothing about a type: a field is retyped only if both files have typed values;
- repeated rows change nothing; null origins form one origin; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut

VALUE_SLOTS, SHAPE_SLOTS = 16, 8
STRING, NUMBER, BOOLEAN, ARRAY, OBJECT = 1, 2, 4, 8, 16
#: A pair of a lost and a new field counts as a rename from this score on.
RENAME_SCORE = 0.45
#: Profiles held by one task before they are handed on (memory bound, results do not depend on it).
FLUSH_AT = 40_000
#: Lines of a file that are parsed in one task, by their numbers (results do not depend on it).
PIECE_LINES = 50_000
#: Joins names inside, dots join them in results.
SEP = "\x1f"
#: Distinct paths whose sketches are shipped to every task (about 200 bytes each).
MAX_SHIPPED_PATHS = 50_000
SLOTS = VALUE_SLOTS + SHAPE_SLOTS
_PARSED = "origin string, file_name string, json_path string, types int, n bigint, slots array<int>, own binary"


# ---------------------------------------------------------------- profiles


def parse_object(line: str | None) -> dict | None:
    """The JSON object on a line, or None."""
    if not line:
        return None
    text = line.strip().lstrip("﻿")
    if not text.startswith("{"):
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


_BITS = {bool: BOOLEAN, str: STRING, int: NUMBER, float: NUMBER, list: ARRAY, dict: OBJECT}


_RUNS = re.compile(r"[A-Za-z]+|\d+")


def value_shape(value: object) -> str:
    """Letters and digits as runs; texts of five words or more are one shape; numbers by magnitude."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return f"num{int(math.log10(abs(value) + 1))}" if math.isfinite(value) else "num"
    if isinstance(value, list):
        return "list"
    text = str(value)
    if text.count(" ") >= 4:  # words, not a code: their runs say nothing
        return "prose"
    return _RUNS.sub(lambda m: "9" if m.group()[0].isdigit() else "a", text)


_paths: dict[str, dict[str, str]] = {}


def walk(record: dict):
    """(path, value) of all fields; arrays are not entered."""
    stack = [("", record)]
    while stack:
        at, node = stack.pop()
        known = _paths.get(at)
        if known is None:
            if len(_paths) > 50_000:
                _paths.clear()
            known = _paths[at] = {}
        for name, value in node.items():
            path = known.get(name)
            if path is None:
                if len(known) > 50_000:
                    known.clear()
                bare = name.replace(SEP, "")
                path = known[name] = f"{at}{SEP}{bare}" if at else bare
            yield path, value
            if value.__class__ is dict:
                stack.append((path, value))


def _places(text: str, shape: str | None) -> tuple[int, int, int, int]:
    digest = zlib.crc32(text.encode("utf-8", "replace"))
    if shape is None:
        return digest % VALUE_SLOTS, digest // VALUE_SLOTS, -1, 0
    second = zlib.crc32(shape.encode("utf-8", "replace"))
    return digest % VALUE_SLOTS, digest // VALUE_SLOTS, VALUE_SLOTS + second % SHAPE_SLOTS, second // SHAPE_SLOTS


#: Where values go in a sketch, by class: most values come again and again.
_placed: dict[type, dict] = {}


def sketch_into(slots: list, value: object) -> None:
    """Adds a value to a sketch: the least rank per slot, of values and of shapes; an object counts by the names of its fields."""
    kind = value.__class__
    if kind is dict:
        known, keys = _placed.setdefault(dict, {}), value
    elif kind is list:
        known, keys = _placed.setdefault(list, {}), (repr(value),)
    else:
        known, keys = _placed.setdefault(kind, {}), (value,)
    for key in keys:
        places = known.get(key)
        if places is None:
            if len(known) > 100_000:
                known.clear()
            places = _places(key if isinstance(key, str) else repr(key), None if kind is dict else value_shape(value))
            if not isinstance(key, str) or len(key) < 200:
                known[key] = places
        at, rank, second, other = places
        if slots[at] is None or rank < slots[at]:
            slots[at] = rank
        if second >= 0 and (slots[second] is None or other < slots[second]):
            slots[second] = other


def least_slots(a: list, b: list) -> list:
    return [y if x is None else x if y is None or x < y else y for x, y in zip(a, b)]


_FILLED = struct.Struct("<Bi")


def pack_sketch(slots: list) -> bytes:
    """The filled slots only: most fields of a file have few values."""
    return b"".join(_FILLED.pack(at, rank) for at, rank in enumerate(slots) if rank is not None)


def unpack_sketches(parts: list[bytes]) -> list:
    """One sketch from the partial ones of several tasks."""
    slots: list = [None] * SLOTS
    for part in parts:
        for at, rank in _FILLED.iter_unpack(part):
            if slots[at] is None or rank < slots[at]:
                slots[at] = rank
    return slots


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files: dict[tuple, dict[str, list]] = {}
    held = 0
    names = [c.split()[0] for c in _PARSED.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary()]

    def flush() -> pa.RecordBatch:
        sketches: dict[str, list] = {}
        rows = []
        for key, cells in files.items():
            rows.append((*key, None, 0, 0, None, None))  # the file itself, also without any object
            for path, (kinds, n, own) in cells.items():
                rows.append((*key, path, kinds, n, None, pack_sketch(own)))
                if kinds:
                    slots = sketches.get(path)
                    sketches[path] = own if slots is None else least_slots(slots, own)
        rows += [(None, None, path, 0, 0, slots, None) for path, slots in sketches.items()]
        files.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for origin, file_name, raw in zip(*(c.to_pylist() for c in batch.columns)):
            cells = files.get((origin, file_name))
            if cells is None:
                cells = files[origin, file_name] = {}
                held += 1
            record = parse_object(raw)
            if record is None:
                continue
            for path, value in walk(record):
                cell = cells.get(path)
                if cell is None:
                    cell = cells[path] = [0, 0, [None] * SLOTS]
                    held += 1
                cell[1] += 1
                if value is not None:
                    cell[0] |= _BITS.get(value.__class__, 0)
                    sketch_into(cell[2], value)
        if held > FLUSH_AT:
            yield flush()
            held = 0
    if files:
        yield flush()


def parse_lines(lines: DataFrame) -> DataFrame:
    """Profiles (own sketch, no slots) and partial sketches of paths (slots, no file) of all tasks, written once.

    Each piece of a file is parsed in one task, so a file gives few partial rows instead of one per task that meets it.
    """
    piece = F.floor(F.coalesce("line_no", F.lit(0)) / PIECE_LINES)
    together = lines.select("origin", "file_name", "raw", piece.alias("piece")).repartition("origin", "file_name", "piece").sortWithinPartitions("origin", "file_name").drop("piece")
    return cut(together.mapInArrow(_parse, _PARSED), "profiles")


def merge_profiles(parsed: DataFrame) -> DataFrame:
    """One row per (origin, file_name, json_path) with types and count."""
    return parsed.where("slots is null and json_path is not null").groupBy("origin", "file_name", "json_path").agg(F.bit_or("types").alias("types"), F.sum("n").alias("n"))


def merge_sketches(parsed: DataFrame) -> DataFrame:
    """One row per json_path with the slots of the whole corpus."""
    each = parsed.where("slots is not null").select("json_path", F.posexplode("slots").alias("at", "rank")).where("rank is not null")
    least = each.groupBy("json_path", "at").agg(F.min("rank").alias("rank"))
    full = least.groupBy("json_path").agg(F.map_from_entries(F.collect_list(F.struct("at", "rank"))).alias("m"))  # as many entries as slots
    return full.select("json_path", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.try_element_at("m", i)).alias("slots"))


def file_profiles(lines: DataFrame) -> DataFrame:
    return merge_profiles(parse_lines(lines))


# ---------------------------------------------------------------- comparison of two schemas

_TOKEN = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_tokens(name: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(name)]


def name_similarity(a: str, b: str) -> float:
    """Shared name parts (one may start the other, as in win/window) and similarity of the whole names."""
    left, right = name_tokens(a), name_tokens(b)
    if left == right and left:
        return 1.0
    shared = sum(any(x == y or len(min(x, y, key=len)) >= 3 and (x.startswith(y) or y.startswith(x)) for y in right) for x in left)
    part = shared / max(len(left), len(right), 1)
    cover = 0.8 * shared / max(1, min(len(left), len(right)))
    return max(part, cover, 0.9 * SequenceMatcher(None, "".join(left), "".join(right)).ratio())


def sketch_similarity(a: list, b: list) -> float | None:
    """Share of equal slots among those filled on either side; None if a side holds no value."""
    filled = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
    if not any(x is not None for x, _ in filled) or not any(y is not None for _, y in filled):
        return None
    return sum(x == y for x, y in filled) / len(filled)


def best_assignment(score: list[list[float]]) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the largest total score (Hungarian method, O(n^3))."""
    if not score or not score[0]:
        return []
    n, m = len(score), len(score[0])
    if n > m:
        return [(j, i) for i, j in best_assignment([list(c) for c in zip(*score)])]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        low, used = [math.inf] * (m + 1), [False] * (m + 1)
        while True:
            used[at] = True
            row, delta, step = match[at], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -score[row - 1][j - 1] - u[row] - v[j]
                    if cost < low[j]:
                        low[j], way[j] = cost, at
                    if low[j] < delta:
                        delta, step = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            at = step
            if match[at] == 0:
                break
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


class Field:
    __slots__ = ("types", "slots", "parts", "children")

    def __init__(self, types: int, slots: list | None, parts: list[bytes] | None = None):
        self.types, self.slots, self.parts, self.children = types, slots or [None] * SLOTS, parts or [], set()


def rename_score(old_name: str, old: Field, new_name: str, new: Field) -> float:
    """How likely the new field carries on the old one, 0 to 1."""
    if old.types and new.types and not old.types & new.types:
        return 0.0
    names = name_similarity(old_name, new_name)
    is_object = (old.types | new.types) & OBJECT
    values = []
    # the values of the two files, and those of both names in the whole corpus
    for a, b in ((unpack_sketches(old.parts), unpack_sketches(new.parts)), (old.slots, new.slots)):
        exact = sketch_similarity(a[:VALUE_SLOTS], b[:VALUE_SLOTS])
        shape = sketch_similarity(a[VALUE_SLOTS:], b[VALUE_SLOTS:])
        if exact is None:
            continue
        if is_object:
            # corpus-wide an object holds all names its fields ever had: how far the smaller set lies in the larger, and what the two files share
            filled = list(zip(a[:VALUE_SLOTS], b[:VALUE_SLOTS]))
            least = min(sum(x is not None for x, _ in filled), sum(y is not None for _, y in filled))
            inside = sum(x is not None and x == y for x, y in filled) / least
            shared = len(old.children & new.children) / max(1, min(len(old.children), len(new.children)))
            exact = max(exact, 0.9 * inside, shared)
        values.append(max(exact, 0.85 * shape) if shape is not None else exact)
    if not values:
        return 0.8 * names
    weight = 0.6 if is_object else 0.5
    return (1 - weight) * names + weight * max(values)


def schema_changes(old: dict[str, Field], new: dict[str, Field]) -> list[tuple[str, str, str | None]]:
    """(kind, path, path before) from one schema to the next; nothing below a reported field."""
    out: list[tuple[str, str, str | None]] = []

    def level(fields: dict[str, Field], parent: str) -> dict[str, str]:
        if parent:
            return {n: f"{parent}{SEP}{n}" for n in fields[parent].children if f"{parent}{SEP}{n}" in fields}
        return {p: p for p in fields if SEP not in p}

    stack = [("", "")]
    while stack:
        was, now = stack.pop()
        before, after = level(old, was), level(new, now)
        for name in sorted(before.keys() & after.keys()):
            a, b = old[before[name]], new[after[name]]
            if a.types and b.types and a.types != b.types:
                out.append(("retyped", after[name], before[name]))
            else:
                stack.append((before[name], after[name]))
        gone, come = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
        score = [[rename_score(g, old[before[g]], c, new[after[c]]) for c in come] for g in gone]
        pairs = [(i, j) for i, j in best_assignment(score) if score[i][j] >= RENAME_SCORE]
        out += [("renamed", after[come[j]], before[gone[i]]) for i, j in pairs]
        out += [("removed", before[g], before[g]) for i, g in enumerate(gone) if i not in {p[0] for p in pairs}]
        out += [("added", after[c], None) for j, c in enumerate(come) if j not in {p[1] for p in pairs}]
    return out


_CHANGES = "origin string, file_name string, change_kind string, json_path string, path_before string"


def _fields(at: dict[str, int], types: list[int], own: pa.Array, slots: pa.Array, sketches: dict[str, list] | None) -> dict[str, Field]:
    """Fields of one file from the places of its paths in the columns."""
    fields = {p: Field(types[i], slots[i].as_py() if sketches is None else sketches.get(p), own[i].as_py()) for p, i in at.items()}
    for path in fields:
        parent, _, name = path.rpartition(SEP)
        if parent in fields:
            fields[parent].children.add(name)
    return fields


def _differ(shipped):
    """Most files have the schema of the file before: only of the others are sketches and children read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = None if shipped is None else shipped.value
        for batch in batches:
            rows = []
            origins, names, column = batch.column(0), batch.column(1), batch.column(2)
            ends, values = column.offsets.to_pylist(), column.values
            paths, types, is_new = (values.field(n).to_pylist() for n in ("json_path", "types", "is_new"))
            own, slots = values.field("own"), values.field("slots")
            for k in range(batch.num_rows):
                old, new = {}, {}
                for i in range(ends[k], ends[k + 1]):
                    (new if is_new[i] else old)[paths[i]] = i
                if old.keys() == new.keys() and all(types[i] == types[new[p]] for p, i in old.items()):
                    continue
                changes = schema_changes(_fields(old, types, own, slots, sketches), _fields(new, types, own, slots, sketches))
                origin, file_name = origins[k].as_py(), names[k].as_py()
                rows += [(origin, file_name, *c) for c in changes]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], [c.split()[0] for c in _CHANGES.split(", ")])

    return run


# ---------------------------------------------------------------- operators


def file_order(files: DataFrame) -> DataFrame:
    """(origin, file_name, next_file, is_first) by the time in the file name.

    Files are ordered within their day; a day's last file is followed by the first one of the next day that has any, so
    an origin with a third of all files is spread over its days.
    """
    clock = F.nullif(F.regexp_extract("file_name", r"(\d{4}-\d\d-\d\dT\d\d-\d\d-\d\d)[^/]*$", 1), F.lit(""))
    known = files.select("origin", "file_name").where("file_name is not null").distinct().withColumn("clock", F.coalesce(clock, F.lit("~")))
    known = known.withColumn("day", F.substring("clock", 1, 10)).withColumn("o", F.coalesce(F.concat(F.lit("="), "origin"), F.lit("")))  # a key that is never null
    inside = Window.partitionBy("o", "day").orderBy("clock", "file_name")
    days = known.groupBy("o", "day").agg(F.min_by("file_name", F.struct("clock", "file_name")).alias("first"))
    over_days = Window.partitionBy("o").orderBy("day")
    days = days.select("o", "day", F.lead("first").over(over_days).alias("first_after"), (F.row_number().over(over_days) == 1).alias("first_day"))
    placed = known.withColumn("next_inside", F.lead("file_name").over(inside)).withColumn("place", F.row_number().over(inside))
    return placed.join(days, ["o", "day"]).select(
        "origin", "file_name", F.coalesce("next_inside", "first_after").alias("next_file"), (F.col("first_day") & (F.col("place") == 1)).alias("is_first")
    )


def schema_drift(lines: DataFrame) -> DataFrame:
    """(origin, file_name, change_kind, json_path, path_before): every change against the file before."""
    found = _drift(parse_lines(lines))
    return found.withColumns({c: F.translate(c, SEP, ".") for c in ("json_path", "path_before")})


def _drift(parsed: DataFrame) -> DataFrame:
    spark = parsed.sparkSession
    own = F.collect_list("own").alias("own")  # as many as tasks that read the file
    profiles = parsed.where("slots is null and json_path is not null").groupBy("origin", "file_name", "json_path").agg(F.bit_or("types").alias("types"), own)
    sketches, shipped = merge_sketches(parsed), None
    known = sketches.limit(MAX_SHIPPED_PATHS + 1).collect()
    if len(known) <= MAX_SHIPPED_PATHS:
        shipped = spark.sparkContext.broadcast({r["json_path"]: r["slots"] for r in known})
        packed = profiles.withColumn("slots", F.lit(None).cast("array<int>"))
    else:
        packed = profiles.join(sketches, "json_path", "left")
    field = F.struct("json_path", "types", "slots", "own")
    per_file = packed.groupBy("origin", "file_name").agg(F.collect_list(field).alias("fields"))  # as many as fields in a file
    order = file_order(parsed.where("slots is null and json_path is null")).alias("o")
    joined = order.join(per_file.alias("p"), F.col("o.origin").eqNullSafe(F.col("p.origin")) & (F.col("o.file_name") == F.col("p.file_name")), "left")
    tagged = lambda new: F.transform(F.coalesce("p.fields", F.array().cast("array<struct<json_path:string,types:int,slots:array<int>,own:array<binary>>>")), lambda x: x.withField("is_new", F.lit(new)))
    both = joined.select(
        F.col("o.origin").alias("origin"),
        F.explode(F.array(
            F.struct(F.col("o.file_name").alias("file_name"), tagged(True).alias("fields"), F.col("o.is_first").alias("skip")),
            F.struct(F.col("o.next_file").alias("file_name"), tagged(False).alias("fields"), F.lit(False).alias("skip")),
        )).alias("x"),
    ).select("origin", "x.*").where("file_name is not null")
    pairs = both.groupBy("origin", "file_name").agg(F.flatten(F.collect_list("fields")).alias("fields"), F.max("skip").alias("skip"))
    return pairs.where("not skip").select("origin", "file_name", "fields").mapInArrow(_differ(shipped), _CHANGES)


#: Distinct renames the driver accepts when it builds the name classes (a schema, not data).
MAX_RENAMES = 100_000


def rename_classes(drift: DataFrame, profiles: DataFrame) -> dict[str, str]:
    """path -> canonical path, for paths whose prefixes are canonical already; only paths that change are listed.

    Both sides of a rename lie under one parent. The classes are built from the root down, on paths whose prefixes are
    replaced by the first path of their class, so a rename seen under one name of a container holds under all of them.
    The canonical name is the most frequent of the class, counted under all names of its containers.
    """
    names = drift.where("change_kind = 'renamed'").select("json_path", "path_before").distinct().limit(MAX_RENAMES + 1).collect()
    if len(names) > MAX_RENAMES:
        raise ValueError(f"more than {MAX_RENAMES} distinct renames: these files have no common schema")
    if not names:
        return {}
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[str, str] = {}
    by_depth: dict[int, list[tuple[str, str]]] = {}
    for r in names:
        by_depth.setdefault(r["json_path"].count(SEP), []).append((r["path_before"], r["json_path"]))
    for depth in sorted(by_depth):
        level = [tuple(under_prefix(p, first) for p in pair) for pair in by_depth[depth]]
        for old, new in level:
            parent[find(new)] = find(old)
        heads: dict[str, str] = {}
        members = sorted({p for pair in level for p in pair})
        for path in members:
            heads.setdefault(find(path), path)
        first |= {p: heads[find(p)] for p in members if heads[find(p)] != p}
    involved = set(parent)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = [under_prefix(p, first) for p in frame["json_path"]]
            yield pd.DataFrame({"json_path": keys, "n": frame["n"]})[[k in involved for k in keys]]

    counts = profiles.groupBy("json_path").agg(F.sum("n").alias("n")).mapInPandas(count, "json_path string, n bigint").groupBy("json_path").agg(F.sum("n").alias("n"))
    weight = {r["json_path"]: r["n"] for r in counts.collect()}
    best: dict[str, str] = {}
    for path in sorted(involved, key=lambda p: (-weight.get(p, 0), p)):
        best.setdefault(find(path), path)
    # from class heads as prefixes to canonical prefixes
    chosen = {p: best[find(p)] for p in involved}
    canonical: dict[str, str] = {}

    def settle(head: str) -> str:
        """The canonical form of a path of class heads."""
        done = at = ""
        for name in head.split(SEP):
            at = f"{at}{SEP}{name}" if at else name
            name = chosen.get(at, at).rpartition(SEP)[2]
            done = f"{done}{SEP}{name}" if done else name
        return done

    for path in involved:
        prefix, _, name = path.rpartition(SEP)
        prefix = f"{settle(prefix)}{SEP}" if prefix else ""
        to = chosen[path].rpartition(SEP)[2]
        if to != name:
            canonical[prefix + name] = prefix + to
    return canonical


def canonical_path(path: str, classes: dict[str, str]) -> str:
    """Renames every prefix of a path, and then the path, from the root down."""
    done = ""
    for name in path.split(SEP):
        done = f"{done}{SEP}{name}" if done else name
        done = classes.get(done, done)
    return done


def under_prefix(path: str, classes: dict[str, str]) -> str:
    """The path with its last name as it is, under its canonical prefix."""
    prefix, _, name = path.rpartition(SEP)
    return f"{canonical_path(prefix, classes)}{SEP}{name}" if prefix else name


def named_fields(leaves: list[tuple[str, str, str | None]]) -> dict[str, str | None]:
    """Fields of one record from (canonical path, path, text); no value is dropped.

    If fields of one class stand side by side, the one that bears the canonical name keeps it (else the first by path),
    and the others stay under their own paths, which are no canonical path of any field.
    """
    fields: dict[str, str | None] = {to: text for to, _, text in leaves}
    if len(fields) == len(leaves):
        return fields
    fields = {}
    for to, path, text in sorted(leaves, key=lambda x: (x[0] != x[1], x[1])):
        if fields.get(to) is None:
            fields[to] = text
        elif text is not None and fields.get(path) is None:
            fields[path] = text
    return fields


_TYPE_NAMES = ((STRING, "string"), (NUMBER, "number"), (BOOLEAN, "boolean"), (ARRAY, "array"), (OBJECT, "object"))


def _classes(lines: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    parsed = parse_lines(lines)
    profiles = merge_profiles(parsed)
    return profiles, rename_classes(_drift(parsed), profiles)


def _shown(path: Column) -> Column:
    """Names joined by dots, dots in names written as ``\\.``."""
    return F.translate(F.replace(path, F.lit("."), F.lit("\\.")), SEP, ".")


def unified_fields(lines: DataFrame) -> DataFrame:
    """(json_path, value_type, types_seen, names_seen, n_records): the schema of the consistent table, one row per field.

    A field that came with several types is read as the one all of them have a text form of: string. ``names_seen``
    counts the paths under which it came.
    """
    profiles, classes = _classes(lines)

    def unify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([canonical_path(p, classes) for p in paths], pa.string()), *batch.columns], ["to", "path", "types", "n"])

    per_path = profiles.groupBy("json_path").agg(F.bit_or("types").alias("types"), F.sum("n").alias("n"))
    named = per_path.mapInArrow(unify, "to string, path string, types int, n bigint")
    fields = named.groupBy("to").agg(F.bit_or("types").alias("types"), F.count("*").cast("int").alias("names_seen"), F.sum("n").alias("n_records"))
    names = F.array_compact(F.array(*[F.when(F.col("types").bitwiseAND(bit) > 0, F.lit(name)) for bit, name in _TYPE_NAMES]))
    kind = F.when(F.size(names) == 1, names[0]).when(F.size(names) == 0, F.lit("null")).otherwise(F.lit("string"))
    return fields.select(_shown(F.col("to")).alias("json_path"), kind.alias("value_type"), F.array_join(names, ",").alias("types_seen"), "names_seen", "n_records")


def unify_records(lines: DataFrame) -> DataFrame:
    """(origin, file_name, line_no, fields): each JSON object as canonical path -> value, values as text.

    Containers are not listed, only leaves and arrays (as JSON); dots in names are written as ``\\.``; equal rows stay equal rows. Fields of one class that
    stand side by side in a record are all kept, see ``named_fields``.
    """
    _, classes = _classes(lines)

    def unify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for frame in frames:
            rows = []
            for origin, file_name, line_no, raw in zip(frame["origin"], frame["file_name"], frame["line_no"], frame["raw"]):
                record = parse_object(raw)
                if record is None:
                    continue
                leaves = []
                for path, value in walk(record):
                    if isinstance(value, dict):
                        continue
                    if path not in known:
                        known[path] = canonical_path(path, classes)
                    leaves.append((known[path], path, None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)))
                rows.append((origin, file_name, line_no, {k.replace(".", "\\.").replace(SEP, "."): v for k, v in named_fields(leaves).items()}))
            yield pd.DataFrame(rows, columns=["origin", "file_name", "line_no", "fields"])

    return lines.select("origin", "file_name", "line_no", "raw").mapInPandas(
        unify, "origin string, file_name string, line_no bigint, fields map<string,string>"
    )
