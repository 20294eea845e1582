"""JSON of mixed shape: aliases, typed reads and display forms over JSON text, by the VARIANT type.

A key that is present with null counts as present: the search among aliases stops there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """VARIANT of a JSON text; null if it is none."""
    return F.try_parse_json(text)


def first_present(text: Column, names: Sequence[str]) -> Column:
    """The value, as VARIANT, of the first of the names that is a key of the object."""
    keys, value = F.json_object_keys(text), parsed(text)
    out = None
    for name in names:
        met = F.array_contains(keys, name)
        got = F.try_variant_get(value, f"$.{name}", "variant")
        out = F.when(met, got) if out is None else out.when(met, got)
    return out


def first_string(text: Column, paths: Sequence[str]) -> Column:
    """The first path whose value is a string that is not empty."""
    value = parsed(text)
    picks = []
    for path in paths:
        node = F.try_variant_get(value, f"$.{path}", "variant")
        picks.append(F.when(F.schema_of_variant(node) == "STRING", F.nullif(F.try_variant_get(value, f"$.{path}", "string"), F.lit(""))))
    return F.coalesce(*picks)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def display_count(value: Column) -> Column:
    """Whole numbers and texts as text; ``unknown`` otherwise."""
    whole = F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "string"))
    text = F.when(_kind(value) == "STRING", F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit("")))
    return F.coalesce(whole, text, F.lit("unknown"))


def display_string(value: Column) -> Column:
    return F.coalesce(F.when(_kind(value) == "STRING", F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit(""))), F.lit("unknown"))


def display_percent(value: Column) -> Column:
    """A number with a percent sign, without trailing zeros; a text as it is; ``unknown`` otherwise."""
    number = F.when(_kind(value).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))
    plain = F.regexp_replace(F.regexp_replace(F.call_function("format_number", number, F.lit("0.######")), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.concat(plain, F.lit("%")), F.nullif(display_string(value), F.lit("unknown")), F.lit("unknown"))


def whole_number(value: Column) -> Column:
    """A whole number, or null for any other kind."""
    return F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def first_list(text: Column, names: Sequence[str]) -> Column:
    """The objects in the first of the names that holds a list, as array of VARIANT; empty if none does."""
    value = parsed(text)
    out = None
    for name in names:
        node = F.try_variant_get(value, f"$.{name}", "variant")
        met = _kind(node).startswith("ARRAY")
        items = F.try_variant_get(value, f"$.{name}", "array<variant>")
        out = F.when(met, items) if out is None else out.when(met, items)
    listed = F.coalesce(out, F.array().cast("array<variant>"))
    return F.filter(listed, lambda v: F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)))


def field_of(value: Column, names: Sequence[str], cast: str = "string") -> Column:
    """The first of the names that has a value in a VARIANT object."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", cast) for n in names])
