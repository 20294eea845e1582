"""Collections of items: nested normalisation, ordered hydration, keyword search, incremental cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import text as T

BATCH = 100


def user_url(host: str, username: Column) -> Column:
    return F.when(F.coalesce(username, F.lit("")) != "", F.concat(F.lit(f"https://{host}/"), username))


def item_url(host: str, username: Column, item_id: Column) -> Column:
    """The user's path, or a path without user."""
    return F.coalesce(F.concat(user_url(host, username), F.lit("/status/"), item_id), F.concat(F.lit(f"https://{host}/i/web/status/"), item_id))


def long_text(long: Column, short: Column) -> Column:
    return F.coalesce(F.nullif(long, F.lit("")), short, F.lit(""))


def last_written(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row written last of each key: a maximum by the order, combined before the shuffle; rows of unknown order come first."""
    rest = [c for c in df.columns if c != key]
    struct = F.struct(*[F.col(f"`{c}`") for c in rest])
    row = F.max_by(struct, F.coalesce(F.struct(F.col(order)), F.struct(F.lit(None).cast(df.schema[order].dataType).alias(order)))).alias("row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, "row.*")


def normalise(items: DataFrame, host: str) -> DataFrame:
    """Flat view of nested items: long text, URLs, media keys in order, referenced ids with their authors; nothing is dropped.

    Everything needed lies in the row, so the plan is one projection without a shuffle.
    """
    refs = F.coalesce(F.col("referenced_tweets"), F.array())
    return items.select(
        "row_id", "id",
        long_text(F.col("note_tweet.text"), F.col("text")).alias("full_text"),
        F.coalesce("url", item_url(host, F.col("author.username"), F.col("id"))).alias("item_url"),
        user_url(host, F.col("author.username")).alias("author_url"),
        F.array_join(F.transform(F.coalesce(F.col("media"), F.array()), lambda m: m["media_key"]), ",").alias("media_keys"),
        F.size(refs).alias("n_refs"),
        F.array_join(F.transform(refs, lambda r: F.concat_ws(":", r["ref_type"], r["id"], F.coalesce(r["author"]["username"], F.lit("?")))), ",").alias("refs"),
        F.coalesce(F.element_at("public_metrics", "like_count"), F.lit(0)).alias("likes"),
    )


def join_reference(items: DataFrame, users: DataFrame, key: str, user_key: str, order: str) -> DataFrame:
    """LEFT lookup of the last written row of a key; items without one keep nulls."""
    latest = last_written(users, user_key, order).withColumnRenamed(user_key, key)
    return items.join(latest, key, "left")


def hydrate(wanted: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """Items for a list of ids, in its order, repeats kept, unknown ids left out; with the number of the request batch.

    ``wanted`` has ``pos`` and the key; the last written item of a key counts. The wanted ids prune the items by a
    semi-join before the last one is picked.
    """
    asked = wanted.select("pos", key)
    found = last_written(items.join(asked.select(key).distinct(), key, "left_semi"), key, order)
    return asked.join(found, key).withColumn("batch_no", F.floor(F.col("pos") / BATCH).cast("int"))


def search_blob(items: DataFrame) -> Column:
    """Lower-case text in which keywords are looked for; nulls add nothing."""
    refs = F.transform(F.coalesce(F.col("referenced_tweets"), F.array()), lambda r: F.concat_ws("\n", r["text"], r["url"], r["author"]["username"], r["author"]["name"]))
    return F.lower(F.concat_ws("\n", long_text(F.col("note_tweet.text"), F.col("text")), F.col("url"), F.col("author.username"), F.col("author.name"), F.col("author.url"), F.array_join(refs, "\n")))


def keyword_search(items: DataFrame, query: str) -> DataFrame:
    return items.where(T.all_terms(search_blob(items), query))


def since_last(items: DataFrame, state: DataFrame, scope: str = "scope", pos: str = "pos", key: str = "id", created: str = "created_at") -> DataFrame:
    """Items in front of the saved one of their scope, in feed order; if it is gone, those created later (as text); without a state all.

    One aggregate finds the saved item's place per scope; scopes are joined back, never windowed, so a hot scope is spread.
    """
    saved = state.select(F.col(scope), F.col("last_seen_id").alias("__id"), F.col("last_seen_created_at").alias("__at"))
    with_state = items.join(saved, scope, "left")
    places = with_state.where(F.col(key) == F.col("__id")).groupBy(scope).agg(F.min(pos).alias("__pos"))
    joined = with_state.join(places, scope, "left")
    keep = (
        F.when(F.col("__id").isNull() | (F.col("__id") == ""), True)
        .when(F.col("__pos").isNotNull(), F.col(pos) < F.col("__pos"))
        .when(F.coalesce(F.col("__at"), F.lit("")) != "", F.coalesce(F.col(created), F.lit("")) > F.col("__at"))
        .otherwise(True)
    )
    return joined.where(keep).drop("__id", "__at", "__pos")


def advance_state(items: DataFrame, state: DataFrame, scope: str = "scope", pos: str = "pos", key: str = "id", created: str = "created_at") -> DataFrame:
    """State after the whole feed was seen: the first item of each scope replaces what was saved; other scopes stay."""
    newest = items.groupBy(scope).agg(F.min_by(F.struct(F.col(key).alias("last_seen_id"), F.col(created).alias("last_seen_created_at")), F.col(pos)).alias("new"))
    both = state.select(scope, "last_seen_id", "last_seen_created_at").join(newest, scope, "full")
    return both.select(scope, F.coalesce("new.last_seen_id", "last_seen_id").alias("last_seen_id"), F.when(F.col("new").isNotNull(), F.coalesce("new.last_seen_created_at", "last_seen_created_at")).otherwise(F.col("last_seen_created_at")).alias("last_seen_created_at"))


def ranked_pick(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order; rank 1 is limited per partition before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
