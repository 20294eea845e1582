import base64
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewell.llm import bpe, mixing

RAW = open(bpe.VOCABULARY, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=RANKS, special_tokens={})


def naive(data):
    """Plain merging: the leftmost pair of lowest rank, again and again."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS]
        if not ranked:
            return [RANKS[p] for p in parts]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_equals_naive_merging():
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 7, 40, 90):
        for _ in range(40):
            data = bytes(rng.choice(b"abcdeint the  \xe3\x81\x82\xf0\x9f\x98\x80") for _ in range(n))
            assert bpe.merge_piece(data, RANKS) == naive(data)


@pytest.mark.parametrize("text", ["Hello  world\n\n x", "<|endoftext|> is text", "日本語のテキスト。", "a" * 30_000, " " * 5000 + "x", "\x00\t\r", "don't we'll", "é😀"])
def test_encoder_equals_library(text):
    assert bpe.Encoder(RAW).encode(text) == LIBRARY.encode_ordinary(text)


def test_corpus_nulls_empty_repeats_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "x y", "k"), (2, None, "k"), (3, "", "k"), (4, " ", "k"), (1, "x y", "k"), (None, "z", "k")], "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(df)
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    rows = [(r["doc_id"], r["ids"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(1, LIBRARY.encode_ordinary("x y")), (2, []), (3, []), (4, LIBRARY.encode_ordinary(" ")), (1, LIBRARY.encode_ordinary("x y")), (None, LIBRARY.encode_ordinary("z"))], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df.where("doc_id < 5").select("doc_id", "text")).collect()}
    assert counts == {1: 2, 2: 0, 3: 0, 4: 1}


def test_too_large_vocabulary_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        bpe.encode_corpus(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))


def corpus(spark, seed=1, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choices(["big", "mid-size", "small", "Other", None], [70, 20, 3, 5, 2])[0]
        rows.append((i, "word " * rng.randrange(0, 40) or None, source if rng.random() < 0.9 or source is None else f" {source.upper()} ", "x"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, share string")


def test_shares_caps_and_nesting(spark):
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid_size", 0.4, 2), ("small", 0.1, 5), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    docs = corpus(spark).cache()
    report = {r["source"]: r for r in mixing.mix_report(docs, targets).collect()}
    assert report["absent"]["tokens"] == 0
    for name in ("big", "mid_size", "small"):
        assert abs(report[name]["actual_share"] - report[name]["target_share"] / 0.9) < 0.02
        assert report[name]["max_copies"] <= {"big": 1, "mid_size": 2, "small": 5}[name]
    whole = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, targets).collect()}
    less = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, targets, total_tokens=sum(r["tokens"] for r in report.values()) // 2).collect()}
    assert less and all(c <= whole.get(d, 0) for d, c in less.items())


def test_mixing_empty_tables(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(corpus(spark).limit(0), targets).count() == 0
    assert mixing.mix(corpus(spark), targets.limit(0)).count() == 0
    only = mixing.mix(corpus(spark), targets)
    assert only.where(F.col("source") != "big").count() == 0 and only.where("copies > 1").count() == 0
