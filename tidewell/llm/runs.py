"""Runs of cues that say the same again right after each other, collapsed with their count and duration.

The cues of a chain form a linked list; a heap holds the similarity of every pair of neighbours, and the most similar pair
merges first, until no pair meets the similarity and gap limits. A run is represented by the wording that most of its cues
use. Equal neighbours merge first in any case, so they are one from the start.

A chain is what merging can reach at all: neighbouring stretches belong to one chain if any cue of the one could merge with
any cue of the other. Chains are found block by block, and merging never crosses them, so a chain inside a block is
settled there. The chains at a block's edges (``EDGE_CHAINS`` on either side), and those beside the first label of a block (the speaker
before it is known only from the block before), are joined up per transcript. If joining reaches the outermost of the
chains handed on, more might join, and such a transcript is read again as one block. So the result does not depend on
``BLOCK``, and only edges of blocks meet in one task.

Two cues say the same if they are of one speaker, hold the same numbers, and differ by slips only: a few words
left out (``SLACK``), or words with a letter doubled, lost or swapped; a substituted word, a changed number or a
longer continuation is a different event. Annotated sounds are the same if they name the same sounds.

Defined results: rows equal in all columns count once, gaps in ``pos`` do not matter; cues of hesitations only,
null and blank ones form no run and end one; rows without source or position are left out; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import cues as C
from tidewell.session import cut

#: Words that may be missing on either side: this many, or this share of the longer text.
SLACK, SLACK_SHARE = 2.0, 0.2
#: Lowest similarity at which neighbouring runs merge.
MIN_SIMILARITY = 0.5
#: A word is a slip of another from this letter similarity on.
SLIP = 0.7
#: Chains handed on at either side of a block's edge.
EDGE_CHAINS = 3
_TOKEN = re.compile(r"\w+")


def _is_slip(a: str, b: str) -> bool:
    if a == b:
        return True
    if a.isdigit() or b.isdigit() or min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 2:
        return False
    if sorted(a) == sorted(b):
        return True
    return SequenceMatcher(None, a, b, autojunk=False).ratio() >= SLIP


def similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """1 for equal words, falling to 0.5 where the slack is used up; 0 for different events."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    slack = max(SLACK if n > 4 else 1.0, SLACK_SHARE * n)
    if abs(len(a) - len(b)) > slack:
        return 0.0
    # a word that the other side lacks costs half at least, as a slip, so this leaves out nothing that could merge
    left, right = (a, b) if n < 24 else (set(a), set(b))
    if len([w for w in a if w not in right]) > 2 * slack or len([w for w in b if w not in left]) > 2 * slack:
        return 0.0
    if [w for w in a if w.isdigit()] != [w for w in b if w.isdigit()]:
        return 0.0
    cost = 0.0
    for kind, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        left, right = a[i:j], b[k:m]
        if kind == "replace":
            short, long = (left, right) if len(left) <= len(right) else (right, left)
            at = 0
            for word in short:  # every word of the shorter side must be a slip of one on the longer side
                while at < len(long) and not _is_slip(word, long[at]):
                    at += 1
                if at == len(long):
                    return 0.0
                at += 1
            cost += 0.5 * len(short) + (len(long) - len(short))
        else:
            if n <= 4 and any(len(w) > 3 for w in left + right):
                return 0.0
            cost += len(left) + len(right)
    return max(0.0, 1 - 0.5 * cost / slack) if cost <= slack else 0.0


class Run:
    __slots__ = ("kind", "who", "words", "text", "first", "last", "n", "weight", "start", "end")

    def __init__(self, kind, who, words, text, first, last, n, start, end, weight=None):
        self.kind, self.who, self.words, self.text = kind, who, words, text
        self.first, self.last, self.n, self.start, self.end = first, last, n, start, end
        self.weight = weight or n

    def take(self, b: Run) -> None:
        """Becomes one run with the next one."""
        if b.weight > self.weight:
            self.words, self.text, self.weight = b.words, b.text, b.weight
        elif self.words == b.words:
            self.weight += b.weight
        self.last, self.n = b.last, self.n + b.n
        if b.start is not None:
            self.start = b.start if self.start is None else min(self.start, b.start)
        if b.end is not None:
            self.end = b.end if self.end is None else max(self.end, b.end)


def run_similarity(a: Run, b: Run, max_gap_s: float | None) -> float:
    if a.kind != b.kind or a.kind == "none":
        return 0.0
    if max_gap_s is not None and a.end is not None and b.start is not None and b.start - a.end > max_gap_s:
        return 0.0
    if a.kind == "sound":
        return 1.0 if a.words == b.words else 0.0
    return similarity(a.words, b.words) if a.who == b.who else 0.0


class Chain:
    """Neighbouring runs that merging can reach, with their distinct wordings."""

    __slots__ = ("runs", "wordings", "start", "end")

    def __init__(self, runs: list[Run]):
        self.runs = runs
        if len(runs) == 1:
            run = runs[0]
            self.wordings, self.start, self.end = {run.words: None}, run.start, run.end
            return
        self.wordings = dict.fromkeys(r.words for r in runs)
        self.start = min((r.start for r in runs if r.start is not None), default=None)
        self.end = max((r.end for r in runs if r.end is not None), default=None)

    def reaches(self, other: Chain, max_gap_s: float | None) -> bool:
        """Any wording of this chain could merge with any of the next one (kind and speaker are the same all over a chain)."""
        a, b = self.runs[0], other.runs[0]
        if a.kind != b.kind or a.kind == "none" or a.who != b.who:
            return False
        if max_gap_s is not None and self.end is not None and other.start is not None and other.start - self.end > max_gap_s:
            return False
        if a.kind == "sound":
            return a.words == b.words
        return any(similarity(x, y) >= MIN_SIMILARITY for x in reversed(self.wordings) for y in other.wordings)

    def join(self, other: Chain) -> None:
        self.runs += other.runs
        self.wordings |= other.wordings
        self.start = min((x for x in (self.start, other.start) if x is not None), default=None)
        self.end = max((x for x in (self.end, other.end) if x is not None), default=None)


def close(chains: Iterable[Chain], max_gap_s: float | None) -> list[tuple[Chain, int, int]]:
    """Joins neighbouring chains as far as merging could reach: (chain, first and last given chain it consists of)."""
    stack: list[tuple[Chain, int, int]] = []
    for i, chain in enumerate(chains):
        stack.append((chain, i, i))
        while len(stack) > 1 and stack[-2][0].reaches(stack[-1][0], max_gap_s):
            last = stack.pop()
            stack[-1][0].join(last[0])
            stack[-1] = (stack[-1][0], stack[-1][1], last[2])
    return stack


def equal_runs(items: Iterable[Run], max_gap_s: float | None) -> list[Run]:
    """Neighbours with equal words as one run: no other pair is more similar."""
    out: list[Run] = []
    for item in items:
        if out and item.kind != "none" and out[-1].words == item.words and run_similarity(out[-1], item, max_gap_s) == 1.0:
            out[-1].take(item)
        else:
            out.append(item)
    return out


def agglomerate(runs: list[Run], max_gap_s: float | None = None) -> list[Run]:
    """Merges the most similar neighbours first; ties go to the earlier pair."""
    n = len(runs)
    after, before, alive, version = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            s = run_similarity(runs[i], runs[j], max_gap_s)
            if s >= MIN_SIMILARITY:
                heapq.heappush(heap, (-s, i, j, version[i], version[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, vi, vj = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or version[i] != vi or version[j] != vj:
            continue
        runs[i].take(runs[j])
        alive[j] = False
        version[i] += 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [r for r, live in zip(runs, alive) if live]


def _as_run(pos: int, start, end, cue: C.Cue, who: int | None) -> tuple[Run, int | None]:
    """The cue as a run of its own, and the speaker after it."""
    if cue.kind == "speech":
        said, speakers, now = [], [], who
        for number, text in cue.spans:
            now = number if number is not None else now
            if text:
                said += _TOKEN.findall(text.lower())
                speakers.append(now)
        key = tuple(speakers) if len(speakers) > 1 else speakers[0]
        return Run("speech", key, tuple(said), " ".join(t for _, t in cue.spans if t), pos, pos, 1, start, end), now
    label = cue.last_label
    words = cue.sounds if cue.kind == "sound" else ()
    return Run(cue.kind, None, words, " ".join(words), pos, pos, 1, start, end), label if label is not None else who


_CARRY = -1
_OUT = "source_id string, block bigint, chain int, n_chains int, edge boolean, block_label int, kind string, who string, words array<string>, text string, first_pos int, last_pos int, n int, weight int, start_s double, end_s double"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
_TYPES = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())


def _batch(rows: list[tuple], names: list[str], types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)


def _pack(who) -> str:
    return ",".join(map(str, who if isinstance(who, tuple) else (who,))) if who is not None else ""


def _is_carried(who) -> bool:
    return _CARRY in who if isinstance(who, tuple) else who == _CARRY


def _blocks_to_runs(max_gap_s: float | None, least: int):
    """Runs of each block, those of inner chains settled; of a transcript's only block nothing is handed on.

    Settled runs of fewer than ``least`` cues are not written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for source, block, alone, cues in C.blocks(batches):
            items, who = [], 0 if alone else _CARRY
            for pos, start, end, cue in cues:
                item, who = _as_run(pos, start, end, cue, who)
                items.append(item)
            chains = [c for c, _, _ in close((Chain([r]) for r in equal_runs(items, max_gap_s)), max_gap_s)]
            n = len(chains)
            near: set[int] = set()
            if not alone:
                seams = [0, n]
                carried = max((i for i, c in enumerate(chains) if _is_carried(c.runs[0].who)), default=-1)
                if block and carried >= 0:
                    seams.append(carried + 1)
                near = {i for s in seams for i in range(s - EDGE_CHAINS, s + EDGE_CHAINS) if 0 <= i < n}
            label = None if who == _CARRY else who
            for i, chain in enumerate(chains):
                edge = i in near
                for r in chain.runs if edge or len(chain.runs) == 1 else agglomerate(chain.runs, max_gap_s):
                    if edge or r.kind != "none" and r.n >= least:
                        rows.append((source, block, i, n, edge, label, r.kind, _pack(r.who), r.words if edge else None, r.text, r.first, r.last, r.n, r.weight, r.start, r.end))
            if len(rows) > 10_000:
                yield _batch(rows, _NAMES, _TYPES)
                rows = []
        yield _batch(rows, _NAMES, _TYPES)

    return run


_FINAL = "source_id string, kind string, text string, first_pos int, last_pos int, n int, start_s double, end_s double"
_FINAL_NAMES = [c.split()[0] for c in _FINAL.split(", ")]
_FINAL_TYPES = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
#: Kind of the row that says a transcript must be read as one block.
_UNSETTLED = "unsettled"


def settle_edges(source: str, rows: list[dict], max_gap_s: float | None) -> list[tuple]:
    """Runs of the chains handed on by the blocks of a transcript, or the one row that says they do not suffice."""
    given: list[tuple[int, int, int, Chain]] = []  # (block, number, chains of its block, chain)
    who, at, last = 0, None, None
    for r in rows:
        if r["block"] != at:
            who = last["block_label"] if last is not None and last["block_label"] is not None else who
            at = r["block"]
        speakers = tuple(who if int(x) == _CARRY else int(x) for x in r["who"].split(",") if x)
        key = None if not speakers else speakers[0] if len(speakers) == 1 else speakers
        item = Run(r["kind"], key, tuple(r["words"]), r["text"], r["first_pos"], r["last_pos"], r["n"], r["start_s"], r["end_s"], r["weight"])
        if given and given[-1][:2] == (at, r["chain"]):
            given[-1][3].join(Chain([item]))
        else:
            given.append((at, r["chain"], r["n_chains"], Chain([item])))
        last = r
    out: list[tuple] = []
    begin = 0
    for i in range(1, len(given) + 1):
        if i < len(given):
            (b1, c1, n1, _), (b2, c2, _, _) = given[i - 1][:4], given[i][:4]
            if c2 == c1 + 1 if b1 == b2 else c1 + 1 == n1 and c2 == 0:
                continue
        part = given[begin:i]
        for chain, first, final in close((Chain(equal_runs(c.runs, max_gap_s)) for *_, c in part), max_gap_s):
            # an outermost chain that joined could reach what was not handed on; none lies before the first and behind the last block
            if final > first and (first == 0 and begin > 0 or final == len(part) - 1 and i < len(given)):
                return [(source, _UNSETTLED, None, None, None, None, None, None)]
            runs = equal_runs(chain.runs, max_gap_s)
            out += [(source, r.kind, r.text, r.first, r.last, r.n, r.start, r.end) for r in (agglomerate(runs, max_gap_s) if len(runs) > 1 else runs) if r.kind != "none"]
        begin = i
    return out


def _merge_edges(max_gap_s: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["source_id"] != source:
                    if held:
                        out += settle_edges(source, held, max_gap_s)
                    source, held = r["source_id"], []
                held.append(r)
            if len(out) > 10_000:
                yield _batch(out, _FINAL_NAMES, _FINAL_TYPES)
                out = []
        if held:
            out += settle_edges(source, held, max_gap_s)
        yield _batch(out, _FINAL_NAMES, _FINAL_TYPES)

    return run


def collapse_runs(segments: DataFrame, speakers: DataFrame, max_gap_s: float | None = None, least: int = 1) -> DataFrame:
    """(source_id, kind, first_pos, last_pos, n_cues, start_s, end_s, duration_s, text): each run of ``least`` cues or more as one event; by default single cues too."""
    runs = cut(C.block_rows(segments, speakers).mapInArrow(_blocks_to_runs(max_gap_s, least), _OUT), "runs")
    edges = runs.where("edge").repartition("source_id").sortWithinPartitions("source_id", "block", "chain", "first_pos")
    settled = cut(edges.mapInArrow(_merge_edges(max_gap_s), _FINAL), "settled")
    inner, outer = runs.where("not edge").select(*_FINAL_NAMES), settled.where(F.col("kind") != _UNSETTLED)
    again = settled.where(F.col("kind") == _UNSETTLED).select("source_id").distinct()
    both = inner.unionByName(outer)
    if again.take(1):  # chains that reach far over edges: those transcripts as one block each
        whole = C.block_rows(segments.join(again, "source_id", "left_semi"), speakers, block=None).mapInArrow(_blocks_to_runs(max_gap_s, least), _OUT)
        both = both.join(again, "source_id", "left_anti").unionByName(whole.select(*_FINAL_NAMES))
    both = both.where(F.col("n") >= least)
    return both.select("source_id", "kind", "first_pos", "last_pos", F.col("n").alias("n_cues"), "start_s", "end_s", F.round(F.col("end_s") - F.col("start_s"), 3).alias("duration_s"), "text")


def repeated_runs(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    return collapse_runs(segments, speakers, least=2).select("source_id", "first_pos", "last_pos")
