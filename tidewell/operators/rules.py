"""Rules over rows: violations, scans for secrets, differences of versions, collisions of keys, status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import clock, text

#: Shapes of secrets. Only the name of a shape is ever reported, never what matched.
SECRET_SHAPES = {
    "gsk": r"gsk_[A-Za-z0-9_-]{12,}",
    "sk": r"sk-[A-Za-z0-9_-]{12,}",
    "ghp": r"ghp_[A-Za-z0-9]{20,}",
    "github_pat": r"github_pat_[A-Za-z0-9_]{20,}",
    "xox": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "assigned_sk": r"OPENAI_API_KEY\s*=\s*sk-[A-Za-z0-9_-]{12,}",
    "assigned_gsk": r"GROQ_API_KEY\s*=\s*gsk_[A-Za-z0-9_-]{12,}",
}


def violations(df: DataFrame, path: Column, rules: dict[str, Column]) -> DataFrame:
    """(path, rule) of every rule that holds for a row, each once: one scan whatever the number of rules."""
    named = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return df.select(path.alias("path"), F.explode(named).alias("rule")).distinct()


def secret_scan(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, shape): which shapes of secrets occur in a text."""
    shapes = F.array_compact(F.array(*[F.when(F.col(column).rlike(p), F.lit(name)) for name, p in SECRET_SHAPES.items()]))
    return df.select(key, F.explode(shapes).alias("shape"))


def version_changes(before: DataFrame, after: DataFrame, key: str, version: str) -> DataFrame:
    """(key, before, after) of keys on both sides whose versions differ; nulls are a value."""
    a = before.select(key, F.col(version).alias("before_version"))
    b = after.select(key, F.col(version).alias("after_version"))
    return a.join(b, key).where(~F.col("before_version").eqNullSafe(F.col("after_version")))


def unexpected(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys found but not expected; the expected side is reduced to distinct keys first."""
    return found.select(key).join(expected.select(key).distinct(), key, "left_anti")


def collisions(df: DataFrame, name: str, key: Column) -> DataFrame:
    """(key, n_names, first_name) of keys that several names share."""
    return df.select(F.col(name).alias("name"), key.alias("key")).where("key is not null").groupBy("key").agg(F.count_distinct("name").alias("n_names"), F.min("name").alias("first_name")).where("n_names > 1")


def status_rollup(df: DataFrame, key: str, ok: Column, advisory: Column, size: Column, most: float) -> DataFrame:
    """(key, n, size_sum, within, all_ok): all_ok is the AND over rows that are not advisory, true if there are none."""
    return df.groupBy(key).agg(
        F.count("*").alias("n"), F.sum(size).alias("size_sum"), (F.coalesce(F.sum(size), F.lit(0)) < most).alias("within"),
        F.coalesce(F.bool_and(F.when(~advisory, ok)), F.lit(True)).alias("all_ok"),
    )


#: Folders, names, suffixes and name patterns that no package may hold; a project adds its own.
DENIED_FOLDERS = (".codex", ".dist", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "__pycache__", "dist", "frames", "node_modules")
DENIED_NAMES = (
    ".env", ".env.local", "auth.json", "bookmarks.json", "bookmarks.jsonl", "bookmarks.ndjson", "groq_transcript.raw.json", "metadata.json",
    "report.md", "search-index.json", "state.json", "tokens.json", "transcript.json", "transcript.md",
)
DENIED_SUFFIXES = (".aac", ".avi", ".db", ".flv", ".m4a", ".mkv", ".mov", ".mp3", ".mp4", ".sqlite", ".sqlite3", ".wav", ".webm", ".wmv")
DENIED_PATTERNS = (r"(?i)^frame_.*\.(?:jpe?g|png|webp)\z", r"(?i)^rollout-.*\.jsonl\z")


def denied(path: Column, folders: tuple[str, ...] = ()) -> Column:
    """Which rule a path breaks: folder (of the fixed or the given ones), name, suffix, pattern; null if none."""
    parts = F.split(path, "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    matches = F.lit(False)
    for p in DENIED_PATTERNS:
        matches |= name.rlike(p)
    return (
        F.when(F.arrays_overlap(above, F.array(*[F.lit(x) for x in (*DENIED_FOLDERS, *folders)])), "folder")
        .when(name.isin(*DENIED_NAMES), "name")
        .when(F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)).isin(*DENIED_SUFFIXES), "suffix")
        .when(matches, "pattern")
    )


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): distinct values in the order in which they come first; nulls are a value.

    One aggregate that combines before the shuffle, and a range sort over the distinct values.
    """
    return df.groupBy(key).agg(F.min(order).alias("first")).orderBy(F.col("first").asc_nulls_last())


def error_places(errors: DataFrame, path: str, message: str) -> DataFrame:
    """Adds ``place``: errors of each file by the parts of their path, compared one by one, then by message."""
    parts = F.split(path, "/")
    return errors.withColumn("place", F.row_number().over(Window.partitionBy(parts[0]).orderBy(parts, message)))


def is_package_manifest(path: Column) -> Column:
    return F.coalesce(path.rlike(r"^packages/[^/]+/plugin\.json\z"), F.lit(False))


#: The fields of a manifest, and those it must have.
MANIFEST_FIELDS = ("$schema", "name", "version", "description", "author", "homepage", "repository", "license", "keywords", "extensions")
MANIFEST_REQUIRED = ("$schema", "name")


#: Fields of an author, the texts a release must have, and the identifier of the schema.
AUTHOR_FIELDS = ("name", "email", "url")
RELEASE_TEXTS = ("version", "description", "homepage", "repository", "license")
MANIFEST_SCHEMA = "https://agent-plugins.org/schemas/1.0.0/plugin.schema.json"


def manifest_violations(df: DataFrame, path: str, raw: str) -> DataFrame:
    """(path, rule) of manifests as JSON text: what the closed schema forbids, and what a release needs beyond it.

    One projection over the parsed text; every rule is a column, so the number of rules costs no further pass.
    """
    v, keys = F.try_parse_json(raw), F.json_object_keys(raw)
    kind = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    has = lambda k: F.array_contains(keys, k)
    listed = lambda names: F.array(*[F.lit(k) for k in names])
    blank = lambda p: (kind(p) != "STRING") | (F.trim(get(p)) == "") | kind(p).isNull()
    readable = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    words, spaces = get("$.keywords", "array<variant>"), F.json_object_keys(F.get_json_object(raw, "$.extensions"))
    is_list = F.coalesce(kind("$.keywords").startswith("ARRAY"), F.lit(False))
    author_is = F.coalesce(kind("$.author").startswith("OBJECT"), F.lit(False))
    texts = F.transform(words, lambda w: F.try_variant_get(w, "$", "string"))
    words_ok = ~F.exists(words, lambda w: F.schema_of_variant(w) != "STRING") & ~F.exists(texts, lambda t: F.trim(t) == "")
    version = clock.calver_parts(get("$.version"))
    ext_values = F.map_values(F.coalesce(get("$.extensions", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    broken = {
        "unreadable": ~readable,
        "unknown_field": F.size(F.array_except(keys, listed(MANIFEST_FIELDS))) > 0,
        "missing_schema": ~has("$schema"), "missing_name": ~has("name"),
        "schema_value": has("$schema") & (F.coalesce(F.get_json_object(raw, "$['$schema']"), F.lit("")) != MANIFEST_SCHEMA),
        "name_type": has("name") & (kind("$.name") != "STRING"),
        "name_form": (kind("$.name") == "STRING") & ~text.is_package_name(get("$.name")),
        **{f"{f}_text": blank(f"$.{f}") for f in RELEASE_TEXTS},
        "version_form": (kind("$.version") == "STRING") & (get("$.version") != "") & ~version["valid"],
        "author_type": ~author_is,
        "author_field": author_is & (F.size(F.array_except(F.json_object_keys(F.get_json_object(raw, "$.author")), listed(AUTHOR_FIELDS))) > 0),
        "author_name": author_is & blank("$.author.name"), "author_url": author_is & blank("$.author.url"),
        "keywords_type": ~is_list | (F.size(words) == 0),
        "keywords_entry": is_list & ~words_ok,
        "keywords_repeat": is_list & words_ok & (F.size(F.array_distinct(texts)) != F.size(texts)),
        "extension_name": F.exists(spaces, lambda n: ~text.is_reverse_domain(n)),
        "extension_value": F.exists(ext_values, lambda x: ~F.schema_of_variant(x).startswith("OBJECT")),
    }
    rows = {k: F.coalesce(b, F.lit(k == "unreadable")) & (F.lit(True) if k == "unreadable" else readable) for k, b in broken.items()}
    return violations(df, F.col(path), rows)


def all_failed(df: DataFrame, key: str, failed: Column) -> DataFrame:
    """(key, n_failed, n_all, all_failed): one failed part is skipped, only all failed parts fail the whole."""
    return df.groupBy(key).agg(F.count_if(failed).alias("n_failed"), F.count("*").alias("n_all"), F.bool_and(failed).alias("all_failed"))
