"""Texts that lost their end: structural completeness by a stack automaton, and missing terminators against the source's baseline.

1. Every value is read whole by a stack automaton over brackets, quotes, markup, emphasis and code marks. What is open at
   the end, a broken character, entity, escape or tag, and a link or tag that stops short, are noted; a mark that a cutting
   source sets (dots, or dots and its own short link) is taken off first. A value without a terminator is left open.
2. The corpus says which word sequences end sentences: in the same pass each sequence of three words (with the number of
   commas before it in its sentence and whether the sentence is still short) is counted as followed by an end or by more
   words. Counts are summed per task before the shuffle.
3. Each source and field has its baseline: how often its whole values lack a terminator, and how often it cuts. An open
   end is a cut if, under the baseline of its source, its last words are likelier to have gone on than to have ended there
   (a distributed join; nothing is collected), or if it stands at a length at which its source cuts. Where the long form of
   a post repeats an open text and goes on, that settles it.

Defined results: null and blank values are whole; repeated rows are judged alike; a whole text that lacks a full
stop, or that its author ends with dots, a tag, a link or a symbol, is whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import cut, spread

#: Share of ends under which a tail is a cut: where the baselines start, and the limits of what they may become.
END_SHARE, LEAST_SHARE, MOST_SHARE = 0.25, 0.1, 0.4
#: Fewest sightings at which a sequence of three words decides; below, the last word alone does.
SEEN = 2
#: Keys a task holds before it hands its counts on (memory bound only).
FLUSH_AT = 400_000

_TOKEN = re.compile(r"[぀-ヿ㐀-鿿々ー]|[^\W_぀-ヿ㐀-鿿々ー]+(?:['’.\-@_][^\W_぀-ヿ㐀-鿿々ー]+)*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿々ー]")
_DIGITS = re.compile(r"\d+")
_LINK_AT_END = re.compile(r"(?:https?://|www\.)\S*$|https?:?/?$", re.I)
_ENDS = ".!?。！？"
_CLOSERS = "\"'”’)]}»」』*_~`"
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "「": "」", "『": "』"}
_CLOSE = {v: k for k, v in _OPEN.items()}
#: Elements that are never closed.
_VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
_MARKS = re.compile(r"```|`|\*\*|__|</?[A-Za-z][^<>]*>|(?<!\w)['*_](?=\w)|(?<=[\w.!?,])['*_](?!\w)|[" + re.escape("".join(_OPEN) + "".join(_CLOSE) + '"') + "]")
_ELEMENT = re.compile(r"<(/?)([A-Za-z][\w:-]*)(?:\s+[\w:-]+\s*=[^<>]*?)?\s*(/?)>")
#: Marks that authors leave open at will: they tell something only where a terminator is missing too.
_SOFT = ("'", "*", "_", "__", "**", "`")
_LOOSE = _SOFT[:3]  # also apostrophes and list signs: they never decide
_ENTITY_CUT = re.compile(r"&(?:#x?[0-9a-fA-F]{0,6}|[a-zA-Z]{1,7})$")
_ESCAPE_CUT = re.compile(r"\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$")
_PERCENTS = re.compile(r"(?:%[0-9A-Fa-f]{2})*(?:%[0-9A-Fa-f]?)?$")
_TAG_CUT = re.compile(r"</?(?:[a-zA-Z][^<>]*)?$")

BREAK = "\x01"
#: What a gap between two tokens says: nothing, an end, more of the sentence, a comma.
NOTHING, END, MORE, COMMA = 0, 1, 2, 3
_MASK = np.uint64((1 << 61) - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]

class _Table(dict):
    """text -> number, filled by a rule on demand; starts over when it holds too much."""

    def __init__(self, rule, most: int):
        super().__init__()
        self.rule, self.most = rule, most

    def __missing__(self, text: str) -> int:
        got = self[text] = self.rule(text)
        return got

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, texts), np.int64, len(texts))


def _word(word: str) -> int:
    """A stable id of the word in lower case (of digits only their number counts), times 4, plus the shape of its writing."""
    lower = word.lower()
    form = lower if word.isalpha() else _DIGITS.sub(lambda m: "0" * min(3, len(m.group())), lower)
    shape = 3 if word[:1].isdigit() else 2 if len(word) > 1 and word.isupper() else 1 if word[:1].isupper() else 0
    return (zlib.crc32(form.encode("utf-8", "replace")) + 1) * 4 + shape


def _gap(gap: str) -> int:
    """Follow code, + 4 if a new sentence or text starts, + 8 if a comma is in it, + 16 if it is a dot and a blank, + 32 times the texts that end in it."""
    body = gap.lstrip(_CLOSERS)
    first, second = body[:1], body[1:2]
    code = NOTHING
    if first and first in _ENDS:
        if first in "。！？" or not second or second.isspace() or second in _CLOSERS or second == BREAK:
            code = END
    elif first == "\n":
        code = END
    elif first and first in ",;:、，":
        code = COMMA
    elif not gap or (body == gap and not gap.strip(" \t\xa0")):
        code = MORE
    new = any(c in gap for c in "\n\x01|/…") or (code == END) or any(c in _ENDS for c in body)
    comma = any(c in gap for c in ",;:、，")
    return code + 4 * new + 8 * comma + 16 * (gap == ". ") + 32 * gap.count(BREAK)


_words, _gaps = _Table(_word, 500_000), _Table(_gap, 200_000)
_SPLIT = re.compile(f"({_TOKEN.pattern})").split


#: Titles written with a dot; single capitals count as initials.
TITLES = ("dr", "mr", "mrs", "ms", "prof", "st", "sr", "sra", "srta", "mme", "mlle", "hr", "fr", "ing", "dott", *"abcdefghijklmnopqrstuvwxyz")
_TITLE_IDS = [zlib.crc32(t.encode()) + 1 for t in TITLES]
_LINK_WORDS = {zlib.crc32(w.encode()) + 1 for w in ("http", "https", "www")}


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (three words; shapes after a word; one word) and follow code of every token, and the index of each text's last token (-1: none)."""
    parts = _SPLIT(BREAK + BREAK.join([t.replace(BREAK, " ") if BREAK in t else t for t in texts]) + BREAK)
    n = len(parts) // 2
    word, code = _words.of(parts[1::2]), _gaps.of(parts[0::2])
    starts = np.cumsum(code // 32)  # texts begun before token i (and after the last one)
    last = np.full(len(texts), -1, dtype=np.int64)
    if n:
        last[starts[:n] - 1] = np.arange(n)
    if not n:
        empty = np.zeros(0, dtype=np.uint64)
        return empty, empty, empty, np.zeros(0, dtype=np.int64), last
    plain = word >> 2
    ids, shape = plain.astype(np.uint64), (word & 3).astype(np.uint64)
    index = np.arange(n)
    # a dot behind a title or an initial ends nothing
    titled = np.zeros(n + 1, dtype=bool)
    titled[1:] = (code[1:] & 16 > 0) & np.isin(plain, _TITLE_IDS)
    code = np.where(titled, MORE, code)
    new = (code[:n] & 4) > 0
    new[0] = True
    begin = np.maximum.accumulate(np.where(new, index, 0))
    place = index - begin
    seen = np.cumsum((code[:n] & 8) > 0)
    commas = np.minimum(seen - seen[begin], 2).astype(np.uint64)
    spot = np.minimum(place, 5).astype(np.uint64)
    one, two = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    one[1:] = np.where(place[1:] >= 1, ids[:-1], 0)
    two[2:] = np.where(place[2:] >= 2, ids[:-2], 0)
    one_shape = np.full(n, 5, dtype=np.uint64)
    one_shape[1:] = np.where(place[1:] >= 1, shape[:-1], 5)
    with np.errstate(over="ignore"):
        context = (commas * np.uint64(8) + spot) * _MIX[3]
        k3 = (two * _MIX[0] + one * _MIX[1] + ids * _MIX[2] + context) & _MASK
        k2 = (two * _MIX[1] + (one_shape * np.uint64(8) + shape + np.uint64(64)) * _MIX[4] + context) & _MASK
        k1 = (ids * _MIX[4] + np.uint64(0x51ED270B)) & _MASK
    follow = code[1:] & 3
    follow = np.where(follow == COMMA, np.where(place < 4, MORE, NOTHING), follow)
    link_next = np.zeros(n, dtype=bool)
    link_next[:-1] = np.isin(plain[1:], list(_LINK_WORDS))
    follow = np.where((follow == MORE) & link_next, NOTHING, follow)
    return k3, k2, k1, follow, last


def count_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ends, continuations) over all positions of the texts."""
    k3, k2, k1, follow, _ = sequences(texts)
    known = (follow == END) | (follow == MORE)
    end = (follow[known] == END).astype(np.uint64)
    both = np.concatenate([k3[known] * np.uint64(2) + end, k2[known] * np.uint64(2) + end, k1[known] * np.uint64(2) + end])
    both.sort()
    if not len(both):
        return both, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    sizes = np.diff(np.append(first, len(both)))
    both = both[first]
    is_end = (both & np.uint64(1)) > 0
    keys, ends, more = merge_counts(both >> np.uint64(1), np.where(is_end, sizes, 0), np.where(is_end, 0, sizes))
    n_end = int(end.sum())
    return np.append(keys, np.uint64(TOTALS)), np.append(ends, n_end), np.append(more, len(end) - n_end)


def merge_counts(keys: np.ndarray, ends: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    if not len(keys):
        return keys, ends, more
    return keys[first], np.add.reduceat(ends[order], first), np.add.reduceat(more[order], first)


def open_structures(text: str) -> list[str]:
    """What a stack automaton leaves open at the end: brackets, quotes, elements, emphasis and code."""
    stack: list[str] = []
    for m in _MARKS.finditer(text):
        mark = m.group()
        if stack and stack[-1] in ("```", "`") and mark != stack[-1]:
            continue  # inside code nothing else counts
        if mark in _OPEN:
            stack.append(mark)
        elif mark in _CLOSE:
            if _CLOSE[mark] in stack:
                while stack.pop() != _CLOSE[mark]:
                    pass
        elif mark[0] == "<":
            element = _ELEMENT.fullmatch(mark)
            if element is None or element[3] or element[2].lower() in _VOID:
                continue  # an address in angle brackets, or nothing to close
            name = f"<{element[2].lower()}>"
            if not element[1]:
                stack.append(name)
            elif name in stack:
                while stack.pop() != name:
                    pass
        elif mark in stack:
            while stack.pop() != mark:
                pass
        elif mark not in _LOOSE or m.end() < len(text) and text[m.end()].isalnum():
            stack.append(mark)
    return stack


def broken_escape(value: str) -> bool:
    """The value stops inside an entity, a backslash escape, a percent escape or the bytes of one character, or a tag."""
    if "&" in value[-9:] and _ENTITY_CUT.search(value[-9:]) or "\\" in value[-5:] and _ESCAPE_CUT.search(value[-5:]):
        return True
    if "%" in value[-3:]:
        run = _PERCENTS.search(value.rsplit(None, 1)[-1]).group()
        whole, rest = run[: len(run) // 3 * 3], run[len(run) // 3 * 3 :]
        if rest and (whole or _LINK_AT_END.search(value.rsplit(None, 1)[-1])):
            return True
        if whole:
            try:
                bytes.fromhex(whole.replace("%", "")).decode("utf-8")
            except UnicodeDecodeError as e:
                return "unexpected end" in e.reason
    at = value.rfind("<")
    return at >= 0 and _TAG_CUT.match(value, at) is not None


def without_mark(value: str) -> tuple[str, bool]:
    """The value without dots a cutting source sets at its end, alone, in brackets, or before its own link; and whether there were any."""
    body = value
    at = max(body.rfind("http://"), body.rfind("https://"))
    if at >= 0 and not any(c.isspace() for c in body[at:]):
        body = body[:at].rstrip()
    bare = body[:-1] if body.endswith(("…]", "..]")) else body
    if bare.endswith("…"):
        kept = bare[:-1]
    elif bare.endswith("..."):
        kept = bare.rstrip(".")
    else:
        return value, False
    kept = (kept[:-1] if bare is not body and kept.endswith("[") else kept).rstrip()
    return (kept, True) if kept else (value, False)


#: What is noted about a value: kind of its end.
WHOLE, CUT, TAIL, LINK, TAG = "whole", "cut", "tail", "link", "tag"
_LAST_SENTENCE = re.compile(r"(?:[.!?…。！？]['\"”’)\]]*\s|[。！？\n|/])(?=[^.!?…。！？\n|/]*$)")
_WHOLE_LINK = re.compile(r"(?:https?://|www\.)[\w.-]+\.[A-Za-z]{2,}/\S")


def inspect(text: str) -> tuple[str, str, bool, str]:
    """(kind, its last sentence, link or tag, whether a cut mark was taken off, reason)."""
    value = text.rstrip()
    if not value:
        return WHOLE, "", False, "blank"
    value, marked = without_mark(value)
    end = value[-1]
    if end == "�" or "\ud800" <= end <= "\udfff":
        return CUT, "", marked, "character"
    if broken_escape(value):
        return CUT, "", marked, "escape"
    last = value.rsplit(None, 1)[-1]
    link = _LINK_AT_END.search(last)
    if link:
        piece = link.group()
        return (LINK, piece, marked, "link") if _WHOLE_LINK.match(piece) else (CUT, "", marked, "link")
    if last[0] in "#@":
        return (TAG, last, marked, "tag") if len(last) > 1 else (CUT, "", marked, "tag")
    bare = value.rstrip(_CLOSERS)
    opened = open_structures(value)
    hard = [o for o in opened if o not in _SOFT]
    opened = [o for o in opened if o not in _LOOSE]
    if bare and bare[-1] in _ENDS:
        if hard and (hard[0] not in _QUOTES or end in _ENDS):
            return CUT, "", marked, "quote" if hard[0] in _QUOTES else "bracket" if hard[0] in _OPEN else "markup"
        body = bare[:-1]
        word = body.rsplit(None, 1)[-1] if body.split() else ""
        if not (word and word[-1].isdigit() and "." in word):
            return WHOLE, "", marked, "terminator"
        value = body
    elif end in ",;、，(“«「[{-–—/:":
        return CUT, "", marked, "open"
    elif opened:
        return CUT, "", marked, "quote" if opened[0] in _QUOTES else "bracket" if opened[0] in _OPEN else "markup"
    elif not (end.isalnum() or end in _CLOSERS):
        return WHOLE, "", marked, "symbol"
    value = value.rstrip(_CLOSERS) or value
    start = 0
    for m in _LAST_SENTENCE.finditer(value):
        start = m.end()
    return TAIL, value[start:] or value, marked, "word"


_QUOTES = ('"', "“", "«", "「", "『")


def code_key(piece: str) -> int:
    return zlib.crc32(f"L|{len(piece)}".encode()) + (1 << 61)


def link_keys(link: str) -> tuple[int, int]:
    """Structure of a link (parts of its path, code or word), and its last piece: a word, or the length of a code."""
    piece = re.split(r"[/\-_.?=&]", link.rstrip(".,)"))[-1]
    coded = any(ch.isupper() or ch.isdigit() for ch in piece) or "-" not in link.rsplit("/", 1)[-1]
    structure = zlib.crc32(f"S|{link.count('/')}|{coded}|{link.rsplit('/', 1)[-1].count('-')}".encode()) + (1 << 61)
    if coded:
        return structure, code_key(piece)
    word = (np.uint64(_word(piece) >> 2) * _MIX[4] + np.uint64(0x51ED270B)) & _MASK if piece else np.uint64(0)
    return structure, int(word)


def tag_key(tag: str) -> int:
    return zlib.crc32(f"T|{tag.lower()}".encode()) + (1 << 61)


_INNER_LINK = re.compile(r"(?:https?://|www\.)[^\s]+(?=\s+\S)|(?<!\S)[#@]\w+(?=\s+\S)", re.I)


def count_pieces(text: str, counts: dict[int, int]) -> None:
    """Links and tags that are followed by something are known to be whole."""
    for piece in _INNER_LINK.findall(text):
        for key in (tag_key(piece),) if piece[0] in "#@" else link_keys(piece):
            counts[key] = counts.get(key, 0) + 1


# ---------------------------------------------------------------- distributed

_TAILS = "row_id bigint, source string, field_name string, kind string, marked boolean, reason string, n_chars int, digest bigint, key3 bigint, key2 bigint, key1 bigint, goes_on boolean, ends bigint, more bigint"
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
_NAMES = [f.split()[0] for f in _TAILS.split(", ")]
_FIELDS = ("text", "note_tweet")
#: Key under which all ends and continuations of the corpus are summed.
TOTALS = 0


def _values(bookmarks: DataFrame) -> DataFrame:
    source = F.coalesce(F.nullif(F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")), F.lit("")), F.lit("?"))
    return bookmarks.select("row_id", source.alias("source"), F.col("text").alias("t"), F.col("note_tweet.text").alias("n"))


def goes_on(text: str, longer: str) -> bool:
    """The longer form of a text repeats it and goes on inside its last sentence: what the short form lost is known."""
    core, _ = without_mark(text.rstrip())
    return bool(core) and len(longer.rstrip()) > len(core) and longer.startswith(core) and core.rstrip(_CLOSERS)[-1:] not in _ENDS


def tail_keys(found: list[tuple[str, str, bool, str]]) -> np.ndarray:
    """(n, 3) keys of the ends that need the corpus; 0 where there is none."""
    keys = np.zeros((len(found), 3), dtype=np.int64)
    tails = [i for i, f in enumerate(found) if f[0] == TAIL]
    if tails:
        k3, k2, k1, _, last = sequences([found[i][1] for i in tails])
        for i, at in zip(tails, last):
            if at >= 0:  # shapes speak only for names and numbers
                tail = found[i][1].rstrip(_CLOSERS + " ")
                word = _TOKEN.findall(tail.rsplit(None, 1)[-1])[-1:] or [""]
                named = len(word[0]) > 1 and not word[0][0].islower() and not _CJK.match(word[0])
                keys[i] = (int(k3[at]), int(k2[at]) if named else 0, int(k1[at]))
    with np.errstate(over="ignore"):
        for i, (kind, piece, _, _) in enumerate(found):
            if kind == LINK:
                keys[i, 0], keys[i, 2] = link_keys(piece)
                last = piece.rstrip(".,)").rsplit("/", 1)[-1]
                keys[i, 1] = code_key(last) if "-" not in last else 0
            elif kind == TAG:
                keys[i, 2] = tag_key(piece)
    return keys


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over all values, two kinds of rows: what each value's end is, and (without row_id) counts by key."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pieces: dict[int, int] = {}

    def rows_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, t)) for name, t in zip(_NAMES, _TYPES)], _NAMES)

    def flush() -> pa.RecordBatch:
        if pieces:
            held.append((np.fromiter(pieces.keys(), np.uint64), np.fromiter(pieces.values(), np.int64), np.zeros(len(pieces), np.int64)))
        keys, ends, more = merge_counts(*(np.concatenate(c) for c in zip(*held)))
        held.clear()
        pieces.clear()
        return rows_of(len(keys), key1=pa.array(keys.astype(np.int64)), ends=pa.array(ends), more=pa.array(more))

    for batch in batches:
        rows, found, texts_read = [], [], []
        for row_id, source, *texts in zip(*(c.to_pylist() for c in batch.columns)):
            for name, text in zip(_FIELDS, texts):
                if not text or text.isspace():
                    continue
                texts_read.append(text)
                seen = inspect(text)
                more = name == _FIELDS[0] and seen[0] in (TAIL, LINK, TAG) and bool(texts[1]) and goes_on(text, texts[1])
                rows.append((row_id, source, name, len(text), zlib.crc32(text.encode("utf-8", "replace")), more))
                found.append(seen)
                if "/" in text or "#" in text or "@" in text:
                    with np.errstate(over="ignore"):
                        count_pieces(text, pieces)
        keys = tail_keys(found)
        column = lambda values, i, t: pa.array([v[i] for v in values], t)
        yield rows_of(
            len(rows), row_id=column(rows, 0, pa.int64()), source=column(rows, 1, pa.string()), field_name=column(rows, 2, pa.string()), kind=column(found, 0, pa.string()), marked=column(found, 2, pa.bool_()),
            reason=column(found, 3, pa.string()), n_chars=column(rows, 3, pa.int32()), digest=column(rows, 4, pa.int64()), key3=pa.array(keys[:, 0]), key2=pa.array(keys[:, 1]), key1=pa.array(keys[:, 2]), goes_on=column(rows, 5, pa.bool_()),
        )
        held.append(count_keys(texts_read))
        if sum(len(h[0]) for h in held) > 2 * FLUSH_AT:
            held[:] = [merge_counts(*(np.concatenate(c) for c in zip(*held)))]
            if len(held[0][0]) > FLUSH_AT:
                yield flush()
    if held or pieces:
        yield flush()


def inspect_values(bookmarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ends of all values, and (key, ends, more): how often an end and how often more follows in the corpus."""
    read = cut(spread(_values(bookmarks)).mapInArrow(_read, _TAILS), "ends")  # written once, read for the ends, lengths, baselines and counts
    counts = read.where("ends is not null").groupBy(F.col("key1").alias("key")).agg(F.sum("ends").alias("ends"), F.sum("more").alias("more"))
    return read.where("ends is null").drop("ends", "more"), counts


#: A length is one at which a source cuts if its open values there are this many times the median around it, by this
#: many standard deviations of their number, and more than half of all its values of that length. There an end that
#: looks whole is a cut if such ends are twice as many as around it, by ``BARE_SIGMAS``: most of them are surplus then.
CAP_RATIO, CAP_SIGMAS, CAP_WINDOW, BARE_RATIO, BARE_SIGMAS = 4.0, 4.0, 12, 2.0, 3.0


def cut_lengths(known: DataFrame) -> DataFrame:
    """(source, field_name, marked, n_chars): lengths at which a source cuts; one row per source and length before it.

    Every text counts once, so a post delivered often does not look like a limit.
    """
    bare = (F.col("kind") == TAIL) & (F.col("share") >= END_SHARE)
    texts = known.groupBy("source", "field_name", "marked", "n_chars", "digest").agg(F.max(F.col("kind").isin(TAIL, CUT).cast("int")).alias("open"), F.max(bare.cast("int")).alias("bare"))
    per = texts.groupBy("source", "field_name", "marked", "n_chars").agg(F.count("*").alias("n"), F.sum("open").alias("open"), F.sum("bare").alias("bare"))
    around = Window.partitionBy("source", "field_name", "marked").orderBy("n_chars").rangeBetween(-CAP_WINDOW, CAP_WINDOW)
    level = lambda name: F.percentile_approx(name, F.lit(0.5)).over(around)  # noqa: E731  a limit and the length before it do not hide each other
    above = lambda name, at, ratio, sigmas: (F.col(name) >= ratio * F.col(at)) & (F.col(name) - F.col(at) >= sigmas * F.sqrt(F.col(at) + 1))
    return per.withColumn("level", level("open")).withColumn("bare_level", level("bare")).where(
        above("open", "level", CAP_RATIO, CAP_SIGMAS) & above("bare", "bare_level", BARE_RATIO, BARE_SIGMAS) & (F.col("open") > 0.5 * F.col("n"))
    ).select("source", "field_name", "marked", "n_chars")


def end_share(ends3, more3, ends2, more2, ends1, more1) -> Column:
    """Share of ends after the last words of a tail.

    Three words decide where they were seen ``SEEN`` times; then the shapes of the last two words after the word
    before them, if the last word itself is known; then the last word alone.
    """
    seen3, seen2, seen1 = ends3 + more3, ends2 + more2, ends1 + more1
    alone = ends1 / (seen1 + 6)
    return F.when(seen3 >= SEEN, ends3 / seen3).when((seen2 >= 5) & (seen1 >= 8), F.greatest(ends2 / seen2, alone)).otherwise(alone)


_SALTS = 16


def baselines(known: DataFrame, ratio: float) -> DataFrame:
    """(source, field_name, marked, missing, cuts, least_share): how often whole values of a source lack a terminator, how
    often it cuts, and the share of ends under which an open end of it is a cut.

    A cut falls behind any words that go on, a missing terminator behind any that end: of an end with share s, the odds of
    a cut are cuts / missing x (1 - s) / s x ends / continuations of the corpus (``ratio``).
    """
    cut_now = (F.col("kind") == CUT) | (F.col("kind") == TAIL) & (F.col("share") < END_SHARE)
    bare = (F.col("kind") == TAIL) & ~cut_now
    per = known.groupBy("source", "field_name", "marked").agg(F.count("*").alias("n"), F.count_if(cut_now).alias("n_cut"), F.count_if(bare).alias("n_bare"))
    odds = (F.col("n_cut") + 0.5) / (F.col("n_bare") + 0.5) * F.lit(ratio)
    return per.select(
        "source", "field_name", "marked", (F.col("n_bare") / F.greatest(F.col("n") - F.col("n_cut"), F.lit(1))).alias("missing"), (F.col("n_cut") / F.col("n")).alias("cuts"),
        F.greatest(F.lit(LEAST_SHARE), F.least(F.lit(MOST_SHARE), odds / (1 + odds))).alias("least_share"),
    )


def judge_values(bookmarks: DataFrame) -> DataFrame:
    """(row_id, source, field_name, kind, reason, is_cut, rule) of all values; ``rule`` says what settled a cut."""
    tails, counts = inspect_values(bookmarks)
    totals = counts.where(F.col("key") == TOTALS).first()
    ratio = totals["ends"] / max(1, totals["more"]) if totals else 1.0
    # one exchange brings an end's three keys to the counts, one more brings what was found back to the end
    asked = tails.where(F.col("kind").isin(TAIL, LINK, TAG)).select("row_id", "field_name", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"key{i}").alias("key")) for i in (3, 2, 1)])).alias("k"))
    asked = asked.where("k.key <> 0").select("row_id", "field_name", "k.level", "k.key")
    answered = asked.join(counts.where(F.col("key") != TOTALS), "key")
    only = lambda name, i: F.sum(F.when(F.col("level") == i, F.col(name))).alias(f"{name}{i}")
    known = answered.groupBy("row_id", "field_name").agg(*[only(n, i) for i in (3, 2, 1) for n in ("ends", "more")])
    joined = tails.join(known, ["row_id", "field_name"], "left")
    six = [f"{n}{i}" for i in (3, 2, 1) for n in ("ends", "more")]
    number = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in six]
    named = joined.select("row_id", "source", "field_name", "kind", "reason", "marked", "n_chars", "digest", "goes_on", *number).withColumn("share", end_share(*map(F.col, six)))
    named = cut(named, "shares")  # read for the baselines and for the decision
    # few rows per source, salted: a source may hold a third of all values
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(_SALTS)).cast("int"))
    caps = spread(cut_lengths(named).withColumn("at_cap", F.lit(True)))
    base = spread(baselines(named, ratio).select("source", "field_name", "marked", "least_share"))
    both = salted.join(base, ["source", "field_name", "marked", "salt"]).join(caps, ["source", "field_name", "marked", "n_chars", "salt"], "left")
    seen1, seen2, seen3 = (F.col(f"ends{i}") + F.col(f"more{i}") for i in (1, 2, 3))
    kind, open_end = F.col("kind"), F.col("kind").isin(TAIL, LINK, TAG)
    rule = (
        F.when((kind == CUT) & F.col("reason").isin("bracket", "quote", "markup"), "stack")
        .when((kind == CUT) & F.col("reason").isin("character", "escape", "link", "tag"), "piece").when(kind == CUT, "open")
        .when((kind == TAIL) & (F.col("share") < F.col("least_share")), "baseline").when((kind == TAIL) & F.coalesce("at_cap", F.lit(False)), "length")
        .when((kind == LINK) & ((seen3 == 0) | ((seen1 == 0) & (seen2 == 0))), "piece").when((kind == TAG) & (seen1 == 0), "piece")
        .when(open_end & F.col("goes_on"), "long form")
    )
    return both.withColumn("rule", rule).select("row_id", "source", "field_name", "kind", "reason", F.col("rule").isNotNull().alias("is_cut"), "rule")


def cut_values(bookmarks: DataFrame) -> DataFrame:
    return judge_values(bookmarks).where("is_cut").select("row_id", "field_name")


def cut_report(bookmarks: DataFrame) -> DataFrame:
    """(source, field_name, n_values, n_cut, cut_share, by_stack, by_piece, by_open, by_baseline, by_length, by_long_form): how often each source cuts each field, and what settled it."""
    by = [F.count_if(F.col("rule") == r).alias(f"by_{r.replace(' ', '_')}") for r in ("stack", "piece", "open", "baseline", "length", "long form")]
    per = judge_values(bookmarks).groupBy("source", "field_name").agg(F.count("*").alias("n_values"), F.count_if("is_cut").alias("n_cut"), *by)
    return per.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_values"), 6)).select("source", "field_name", "n_values", "n_cut", "cut_share", *[c for c in per.columns if c.startswith("by_")])
