"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is split by the vocabulary's public pattern; inside each piece the pair of neighbouring tokens with
the lowest rank merges first, leftmost on ties, until no pair is in the vocabulary. A segment tree over the
byte positions holds the leftmost minimum pair rank: the root names the next merge, and a merge updates the
leaves of the merged pair and of its left neighbour, so a piece of n bytes takes O(n log n) even if it is a
book without a blank. Encoded pieces are remembered per Python worker in a bounded table.

The vocabulary is a file named by a parameter; the driver reads it once and ships its bytes (under 1 MB,
refused above ``MAX_VOCABULARY_BYTES``), so executors need no copy. The plan is one narrow stage: no shuffle,
no skew, each document is encoded where it is read, whole.

Defined results: null and empty texts give an empty list of ids; blank texts are encoded as they are; the
strings of special tokens in a text are ordinary text; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewell.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public split pattern of this vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 32 << 20
#: Characters of pieces that a worker remembers before it starts over (memory bound only).
REMEMBERED_CHARS = 8_000_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge_piece(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by a segment tree of pair ranks."""
    n = len(data)
    if n == 0:
        return []
    if n == 1:
        return [ranks[data]]
    get = ranks.get
    size = 1
    while size < n:
        size *= 2
    none = 1 << 62
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = get(data[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i  # the smaller key is the lower rank, then the place further left
    for at in range(size - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        at = size + i
        tree[at] = key
        at >>= 1
        while at:
            left, right = tree[2 * at], tree[2 * at + 1]
            best = left if left < right else right
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1

    def key_at(i: int) -> int:
        j = after[i]
        if j >= n:
            return none
        rank = get(data[i : after[j]])
        return none if rank is None else rank * n + i

    while tree[1] != none:
        i = tree[1] % n
        j = after[i]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        put(j, none)
        put(i, key_at(i))
        if before[i] >= 0:
            put(before[i], key_at(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[data[i : after[i]]])
        i = after[i]
    return ids


class PieceTable(dict):
    """piece -> ids, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.chars = ranks, 0

    def __missing__(self, piece: str) -> list[int]:
        ids = merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
        self.chars += len(piece) + 8 * len(ids)
        self[piece] = ids
        return ids

    def trim(self) -> None:
        if self.chars > REMEMBERED_CHARS:
            self.clear()
            self.chars = 0


class Encoder:
    def __init__(self, raw: bytes):
        self.table = PieceTable(read_ranks(raw))
        self.split = regex.compile(SPLIT_PATTERN).findall

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        table = self.table
        ids = [i for piece in self.split(text) for i in table[piece]]
        table.trim()
        return ids

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        table = self.table
        total = sum([len(table[piece]) for piece in self.split(text)])
        table.trim()
        return total


_encoders: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def ship_vocabulary(df: DataFrame, path: str):
    raw = Path(path).read_bytes()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(raw)} bytes; a vocabulary of at most {MAX_VOCABULARY_BYTES} can be shipped")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode_corpus(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): each text as a list of token ids."""
    shipped, id_type = ship_vocabulary(df, vocabulary), df.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = encoder(shipped.value).encode
        for batch in batches:
            ids = pa.array([encode_one(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(encode, f"`{id_col}` {id_type}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", count_col: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """All columns but the text, with its number of tokens."""
    shipped = ship_vocabulary(df, vocabulary)
    kept = [c for c in df.columns if c != text_col]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", `{count_col}` bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_one = encoder(shipped.value).count
        for batch in batches:
            counts = pa.array([count_one(t) for t in batch.column(len(kept)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*kept, count_col])

    return spread(df.select(*[f"`{c}`" for c in kept], f"`{text_col}`")).mapInArrow(count, schema)
