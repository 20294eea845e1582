"""Mixing of sources to target shares of all tokens, with a cap on repeats.

Token counts are made once per document. Each source's tokens are summed by hash bucket (a partial
aggregation that leaves ``sources x BUCKETS`` rows); the bucket in which the cumulative sum crosses the
source's budget is the boundary bucket, and only its documents are summed again by the next digits of the
hash. After ``LEVELS`` levels the threshold is a single hash value, and a document is used once more if its
hash lies below the threshold: a filter, without a sort, a rank or a hot task, whatever the size of a source.

Budgets are nested: a source that must give more than it has is used ``floor(budget / size)`` times whole and
once more below the threshold, so a larger mix always contains a smaller one.

Defined results
- the total is the largest one that no source's cap forbids, unless ``total_tokens`` names a smaller one;
- a target without documents cannot contribute: the other targets share the total in proportion;
- documents without tokens, of null sources, or of sources without a target are not used;
- source names compare without letter case and outer blanks and with hyphens as underscores;
- null target shares and caps count as 0 and 1; ties of the hash (equal ids) are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import bpe
from tidewell.session import cut

#: Buckets per level and levels: 4 x 10 bits of the hash.
BUCKET_BITS, LEVELS = 10, 4
#: Targets accepted (refused above): they and one row of each per level come to the driver and go to the tasks.
MAX_TARGETS = 10_000


def source_name(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")), "-", "_"), F.lit(""))


def _digits(level: int) -> Column:
    """The level's digits of the 40-bit hash, most significant first."""
    return F.shiftright("h", BUCKET_BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BUCKET_BITS) - 1)


def tokens_by_document(documents: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, h): h is a 40-bit hash of the id."""
    slim = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("source is not null")
    hashed = F.xxhash64("doc_id").bitwiseAND((1 << (BUCKET_BITS * LEVELS)) - 1).alias("h")
    return bpe.count_tokens(slim, vocabulary=vocabulary).select("doc_id", "source", "n_tokens", hashed)


_STATE = "source string, rest double, prefix bigint, depth int"


def _boundaries(used: DataFrame, open_plans: list[dict], level: int) -> dict[str, tuple[int | None, int]]:
    """Per source: the bucket at which its tokens exceed what is left (None if they do not), and the tokens before it.

    Sums by bucket stay in the cluster (at most ``2 ** BUCKET_BITS`` per source); one row per source comes back.
    """
    spark = used.sparkSession
    state = F.broadcast(spark.createDataFrame([(p["source"], float(p["rest"]), p["prefix"], p["depth"]) for p in open_plans], _STATE))
    inside = used.join(state, "source")
    if level:
        inside = inside.where(F.shiftright("h", BUCKET_BITS * (LEVELS - level)) == F.col("prefix"))
    sums = inside.groupBy("source", "rest", _digits(level).alias("b")).agg(F.sum("n_tokens").alias("t"))
    so_far = F.sum("t").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    crossed = sums.withColumn("c", so_far).groupBy("source").agg(
        F.min(F.when(F.col("c") > F.col("rest"), F.col("b"))).alias("bucket"), F.coalesce(F.max(F.when(F.col("c") <= F.col("rest"), F.col("c"))), F.lit(0)).alias("done")
    )
    return {r["source"]: (r["bucket"], r["done"]) for r in crossed.collect()}


def plan_mix(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Per target: repeats of the whole source and the hash threshold below which a document is used once more.

    Only one row per target (bounded by ``MAX_TARGETS``) comes to the driver, per level.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("cap"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap")).limit(MAX_TARGETS + 1).collect()
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    if not wanted:
        return []
    names = F.broadcast(counted.sparkSession.createDataFrame([(r["source"],) for r in wanted], "source string"))
    used = counted.where("n_tokens > 0").join(names, "source", "left_semi")
    size = {r["source"]: r["t"] for r in used.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    able = [r for r in wanted if size.get(r["source"]) and r["share"] > 0 and r["cap"] > 0]
    shares = sum(r["share"] for r in able)
    total = min((size[r["source"]] * r["cap"] * shares / r["share"] for r in able), default=0)
    total = min(total, total_tokens) if total_tokens is not None else total
    plan = []
    for r in wanted:
        budget = r["share"] / shares * total if r in able else 0.0
        have = size.get(r["source"], 0)
        whole = min(int(budget // have), r["cap"]) if have else 0
        rest = budget - whole * have if whole < r["cap"] else 0.0
        plan.append({"source": r["source"], "target_share": r["share"], "max_repeats": r["cap"], "whole": whole, "rest": rest, "prefix": 0, "depth": 0, "open": have > 0 and rest >= 1})
    for level in range(LEVELS):
        refine = [p for p in plan if p["open"]]
        if not refine:
            break
        found = _boundaries(used, refine, level)
        for p in refine:
            bucket, done = found.get(p["source"], (None, 0))
            p["rest"] -= done
            p["open"] = bucket is not None
            p["prefix"] = (p["prefix"] << BUCKET_BITS) + (bucket if bucket is not None else 1 << BUCKET_BITS)
            p["depth"] = level + 1
    for p in plan:
        p["below"] = p["prefix"] << (BUCKET_BITS * (LEVELS - p["depth"])) if p["depth"] else 0
    return plan


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix and how often each is used."""
    counted = cut(tokens_by_document(documents, vocabulary), "counts")  # tokens are counted once, then read per level
    plan = [(p["source"], p["whole"], p["below"], p["max_repeats"]) for p in plan_mix(counted, targets, total_tokens)]
    planned = F.broadcast(documents.sparkSession.createDataFrame(plan, "source string, whole int, below bigint, most int"))  # at most MAX_TARGETS rows
    copies = F.least(F.col("whole") + (F.col("h") < F.col("below")).cast("int"), F.col("most")).cast("int")
    return counted.where("n_tokens > 0").join(planned, "source").withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, max_copies) of every target, also of empty ones."""
    mixed = mix(documents, targets, total_tokens, vocabulary)
    got = mixed.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("max_copies")
    )
    names = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").alias("target_share"))
    everything = Window.partitionBy(F.lit(1))  # over the targets, at most MAX_TARGETS rows
    return (
        names.groupBy("source").agg(F.sum("target_share").alias("target_share")).join(got, "source", "left").withColumn("all_tokens", F.sum("tokens").over(everything))
        .select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"),
                F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))
    )
