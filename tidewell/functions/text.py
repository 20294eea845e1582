"""Text helpers as Column expressions; the two that Spark has no function for are Arrow UDFs."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SPACE = r"(?U)\s+"


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


@pandas_udf(StringType())
def unescape_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def strip_markup(text: Column) -> Column:
    """Tags away, then entities resolved, then white space collapsed, in that order."""
    return collapse_space(unescape_entities(F.regexp_replace(text, r"<[^>]+>", "")))


def slug(text: Column, most: int = 48, default: str = "item") -> Column:
    """Runs of other characters than letters, digits, dot, underscore and hyphen become one hyphen."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, most), F.lit("")), F.lit(default))


def short_hash(text: Column, digits: int = 8) -> Column:
    return F.substring(F.sha1(text), 1, digits)


def is_url(text: Column) -> Column:
    """Scheme http or https and a host; a leading hyphen is refused."""
    return F.coalesce(text.rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False))


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def first_text(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def key_shape(value: Column, prefix: str, least: int = 20) -> Column:
    """missing, malformed or ok; the value itself is never returned."""
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit("missing")).when(
        value.startswith(prefix) & (F.length(value) >= least), F.lit("ok")
    ).otherwise(F.lit("malformed"))


def env_entry(line: Column) -> Column:
    """struct<key, value> of a KEY=VALUE line: quotes taken off, comments behind unquoted values cut; null otherwise."""
    text = F.trim(F.regexp_replace(F.trim(line), r"^export\s+", ""))
    key = F.trim(F.regexp_extract(text, r"^([^=#]+)=", 1))
    raw = F.trim(F.regexp_extract(text, r"^[^=#]+=(.*)$", 1))
    quoted = raw.rlike(r"""^"[^"]*"|^'[^']*'""")
    value = F.when(quoted, F.regexp_extract(raw, r"""^["']([^"']*)["']""", 1)).otherwise(F.trim(F.regexp_replace(raw, r"\s#.*$", "")))
    return F.when((text != "") & ~text.startswith("#") & (key != ""), F.struct(key.alias("key"), value.alias("value")))


def language_of_file(name: Column) -> Column:
    """The part before the suffix of ``name.<lang>.ext``, if there are three parts or more."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -2))


def language_rank(lang: Column) -> Column:
    low = F.lower(lang)
    return F.when(low == "en", 0).when(low == "en-orig", 1).when(low == "en-us", 2).when(low == "en-gb", 3).when(low.startswith("en"), 4).otherwise(100)


def all_terms(blob: Column, query: str) -> Column:
    """Every white-space separated term occurs in the text, without letter case; an empty query is always met."""
    met = F.lit(True)
    for term in query.lower().split():
        met &= F.contains(F.lower(blob), F.lit(term))
    return F.coalesce(met, F.lit(False))


@pandas_udf(StringType())
def portable_key(paths: pd.Series) -> pd.Series:
    """NFC and case-folded path; null for names that some file system refuses.

    Fixed values: reserved device names and characters.
    """
    reserved = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}

    def key(path):
        if not isinstance(path, str) or not path or any(unicodedata.category(c) in ("Cc", "Cf") for c in path):
            return None
        for part in path.split("/"):
            if part in ("", ".", "..") or part[-1] in " ." or any(c in '<>:"\\|?*' for c in part) or part.split(".")[0].casefold() in reserved:
                return None
        return unicodedata.normalize("NFC", path).casefold()

    return paths.map(key)


def is_package_name(name: Column) -> Column:
    """1 to 64 of a-z, 0-9, dot and hyphen, a letter or digit at both ends, no two hyphens or dots in a row."""
    return F.coalesce(name.rlike(r"^(?=.{1,64}\z)(?!.*(?:--|\.\.))[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\z"), F.lit(False))


def is_reverse_domain(name: Column) -> Column:
    """Two or more labels joined by dots, each of a-z, 0-9 and inner hyphens."""
    label = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    return F.coalesce(name.rlike(rf"^{label}(?:\.{label})+\z"), F.lit(False))
