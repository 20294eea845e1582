"""Speech transcripts into clean, ordered speaker turns.

Every cue is parsed where its block lies (labels, fillers and annotations by Aho-Corasick automata, context rules,
interval subtraction); a block gives its turns, with the speaker of those before the first label open. The turns
at the edges of the blocks, without their texts, are then joined up per transcript: the open speaker is the one
of the block before, and a turn that goes on over an edge becomes one turn.

Defined results
- a cue without a label goes on with the speaker before; before the first label the speaker is 0;
- labels that are no speaker of the transcript, or that two of its speakers share, are words;
- cues without words (sounds, hesitations, null, blank) belong to no turn and end none; a label alone changes the
  speaker of what follows;
- rows equal in all columns count once; rows without source or position are left out; empty tables give an empty
  result; a transcript without a cast is one turn of speaker 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import cues as C
from tidewell.session import cut

_PIECES = "source_id string, block bigint, seq int, n_seq int, settled boolean, block_label int, speaker_no int, first_pos int, last_pos int, start_s double, end_s double, text string"
_TURNS = "source_id string, first_pos int, last_pos int, speaker_no int, start_s double, end_s double, pieces array<struct<block: bigint, seq: int>>"


def _bounds(pairs: list[tuple]) -> tuple:
    starts, ends = [s for s, _ in pairs if s is not None], [e for _, e in pairs if e is not None]
    return min(starts, default=None), max(ends, default=None)


def block_turns(cues: list[tuple], now: int | None = None) -> tuple[list[list], int | None]:
    """[speaker or None, first, last, times, texts] of each turn of a block, and its last label; ``now`` speaks before the first label."""
    turns: list[list] = []
    for pos, start, end, cue in cues:
        for number, text in cue.spans:
            now = number if number is not None else now
            if not text:
                continue
            if turns and turns[-1][0] == now:
                turns[-1][2] = pos
                turns[-1][3].append((start, end))
                turns[-1][4].append(text)
            else:
                turns.append([now, pos, pos, [(start, end)], [text]])
    return turns, now


_PIECE_NAMES, _PIECE_TYPES = [c.split()[0] for c in _PIECES.split(", ")], (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int32()] * 4, pa.float64(), pa.float64(), pa.string())


def _pieces(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_PIECE_NAMES), _PIECE_TYPES)], _PIECE_NAMES)
        rows: list[tuple] = []
        for source, block, alone, cues in C.blocks(batches):
            turns, label = block_turns(cues, 0 if alone else None)
            for i, (who, first, last, times, texts) in enumerate(turns):
                rows.append((source, block, i, len(turns), alone, label, who, first, last, *_bounds(times), " ".join(texts) if with_text else None))
            if not turns and label is not None and not alone:  # labels without words still change the speaker
                rows.append((source, block, 0, 0, False, label, None, None, None, None, None, None))
            if len(rows) > 5000:
                yield as_batch(rows)
                rows = []
        yield as_batch(rows)

    return run


def join_edges(rows: list) -> list[tuple]:
    """Edge turns of one transcript, in order of block and place, to final turns with the pieces they consist of."""
    out: list[list] = []
    now, at, label, before = 0, None, None, None
    whole = lambda x: None if x is None or x != x else int(x)
    real = lambda x: None if x is None or x != x else float(x)
    for r in rows:
        if r.block != at:
            now = label if label is not None else now
            at, label = r.block, whole(r.block_label)
        if not r.n_seq:
            continue
        who = whole(r.speaker_no)
        who = now if who is None else who
        # next to the row before: in one block, or from the end of a block to the start of the next
        touching = before is not None and (before.seq + 1 == r.seq if before.block == r.block else r.seq == 0 and before.seq + 1 == before.n_seq)
        if touching and out[-1][2] == who:
            turn = out[-1]
            turn[1] = int(r.last_pos)
            turn[3], turn[4] = _bounds([(turn[3], turn[4]), (real(r.start_s), real(r.end_s))])
            turn[5].append({"block": int(r.block), "seq": int(r.seq)})
        else:
            out.append([int(r.first_pos), int(r.last_pos), who, real(r.start_s), real(r.end_s), [{"block": int(r.block), "seq": int(r.seq)}]])
        before = r
    return [tuple(x) for x in out]


def _join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["source_id", "first_pos", "last_pos", "speaker_no", "start_s", "end_s", "pieces"]
    source, held, out = None, [], []
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.source_id != source:
                out += [(source, *t) for t in join_edges(held)]
                source, held = r.source_id, []
            held.append(r)
        if len(out) > 5000:
            yield pd.DataFrame(out, columns=names)
            out = []
    out += [(source, *t) for t in join_edges(held)]
    yield pd.DataFrame(out, columns=names)


def _turn_parts(segments: DataFrame, speakers: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = cut(C.block_rows(segments, speakers).mapInArrow(_pieces(with_text), _PIECES), "turns")
    edge = F.expr("not settled and (seq <= 1 or seq + 1 = n_seq)")  # a block's second turn may go on with the open one before it
    slim = parts.where(edge).drop("text").repartition("source_id").sortWithinPartitions("source_id", "block", "seq")
    joined = slim.mapInPandas(_join, _TURNS)
    return parts.where(~edge), joined, parts.where(edge & F.expr("n_seq > 0"))


def speaker_turns(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """(source_id, first_pos, last_pos, speaker_no, start_s, end_s) of every turn."""
    inner, joined, _ = _turn_parts(segments, speakers, with_text=False)
    names = ["source_id", "first_pos", "last_pos", "speaker_no", "start_s", "end_s"]
    return inner.select(*names).unionByName(joined.select(*names))


def turn_texts(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """(source_id, first_pos, last_pos, speaker_no, start_s, end_s, part, text): clean text of every turn.

    A turn that crosses blocks has one row per block (``part`` counts them), so no row outgrows a block.
    """
    inner, joined, edges = _turn_parts(segments, speakers, with_text=True)
    names = ["source_id", "first_pos", "last_pos", "speaker_no", "start_s", "end_s"]
    whole = inner.select(*names, F.lit(0).alias("part"), "text")
    # the texts of edge turns come back by their key (source, block, seq)
    parts = joined.select(*names, F.posexplode("pieces").alias("part", "piece")).select(*names, "part", "piece.block", "piece.seq")
    texts = edges.select("source_id", "block", "seq", "text")
    return whole.unionByName(parts.join(texts, ["source_id", "block", "seq"]).select(*names, "part", "text"))

