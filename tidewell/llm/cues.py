"""Raw transcript cues: labels, annotations, hesitations and spoken words, shared by the turn and run operators.

One Aho-Corasick automaton per cast holds every way to write each of its speakers, and the names of sounds; another holds
the fillers. Context rules say which hits count: a label opens a cue or follows a sentence and stands before a colon or
dash, in brackets or in a voice tag; a sound stands in brackets; set-off words are fillers only before a comma or dots.
Where a label is expected and nothing is hit, the nearest way to write a speaker is taken if it is near enough. The hits'
intervals are subtracted from the text. A cue without any sign of these is read for fillers only.

Rows of one transcript are cut into blocks of ``BLOCK`` positions, so the longest transcript is spread over many
tasks; what crosses a block edge (who speaks, an open run or turn) is settled afterwards on the edge items alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a transcript handled in one piece (memory bound; results do not depend on it).
BLOCK = 4096

#: Hesitations that are never words.
HESITATIONS = ("uh", "um", "er", "erm", "hmm", "hm", "mmm", "mm", "uhm", "ah", "äh", "ähm", "öhm", "euh", "heu", "hum", "eh", "em", "ehm")
#: Words that are fillers only where a comma or dots set them off.
SET_OFF = ("like", "you know", "i mean", "sort of", "kind of", "sozusagen", "halt", "du coup", "enfin", "ben", "bah", "o sea", "este", "pues", "bueno")
#: Sounds, as they are named in annotations.
SOUNDS = (
    "music", "applause", "laughter", "laughs", "laughing", "chuckles", "crosstalk", "inaudible", "unintelligible", "silence", "noise", "cough", "coughs",
    "coughing", "sigh", "sighs", "phone buzzing", "phone ringing", "phone rings", "keyboard clicks", "keyboard clacking", "door closes", "door opens", "door slams",
    "cheering", "cheers", "background noise", "beep", "static", "typing", "footsteps", "musik", "gelächter", "applaus", "beifall", "unverständlich", "musique",
    "rires", "applaudissements", "musica", "música", "risas", "aplausos", "inaudible speech", "foreign", "pause", "breathing", "whispering", "sniffs", "gasps",
)

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_VOICE = re.compile(r"<v(?:\.[^\s<>]*)?\s+([^<>]+)>", re.I)
_CLOCK = r"(?:\d{1,3}:)?\d{1,2}:\d\d(?:[.,]\d{1,3})?"
_BRACKETED_CLOCK = re.compile(rf"[\[(<{{]\s*{_CLOCK}\s*(?:-+>\s*{_CLOCK}\s*)?[\])>}}]")
_LEADING_CLOCK = re.compile(rf"^\s*{_CLOCK}(?:\s*-+>\s*{_CLOCK})?(?=\s|$)\s*")
_NOTE = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|\*[^*]+\*|♪[^♪]*♪?|【[^】]*】|\{[^{}]*\}")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_REPEAT = re.compile(r"([^\W\d_])\1+")
_LEAD = re.compile(r"[\s>\-–—•]*")
#: Every cue with a label, an annotation, a time or markup has one of these.
_SIGNS = re.compile(r"[<\[({*♪【:]|\s[\-–—]\s|^\d")
#: What stands behind a label: a role in brackets, then a colon or a dash between blanks; inside a cue a colon and a blank.
_BEHIND = re.compile(r"\s*(?:\(([^()]*)\)\s*)?(?::|\s[\-–—](?=\s))\s*")
_BEHIND_INNER = re.compile(r"\s*(?:\([^()]*\)\s*)?:\s+")
_BEFORE_INNER = re.compile(r"[\w.!?…\"”')\]]\s+(?:>>\s*|-\s+)?$")
_HEAD = re.compile(r"([^\W_][^:()\[\]\x00]*?)\s*(?:\(([^()]*)\)\s*)?(?::|\s[\-–—](?=\s))\s*")
FUZZY = 0.8


def _fold(text: str) -> str:
    return " ".join(text.lower().replace("’", "'").split())


def _squeeze(text: str) -> str:
    """Folded text with runs of one letter as one letter: doubled letters are the commonest slip."""
    return _REPEAT.sub(r"\1", _fold(text))


class Phrases:
    """Whole-word hits of an Aho-Corasick automaton."""

    def __init__(self, phrases: dict[str, object]):
        self.machine = ahocorasick.Automaton()
        for phrase, value in phrases.items():
            self.machine.add_word(phrase, (len(phrase), value))
        self.any = bool(phrases)
        if self.any:
            self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, object]]:
        """(start, end, value), leftmost and longest first, without overlaps."""
        if not self.any:
            return []
        found = []
        n = len(text)
        for end, (size, value) in self.machine.iter(text):
            start, end = end - size + 1, end + 1
            if (start and (text[start - 1].isalnum() or text[start - 1] == "_") and text[start].isalnum()) or (end < n and (text[end].isalnum() or text[end] == "_") and text[end - 1].isalnum()):
                continue
            found.append((start, -end, value))
        found.sort(key=lambda h: h[:2])
        out, at = [], 0
        for start, end, value in found:
            if start >= at:
                out.append((start, -end, value))
                at = -end
        return out


_FILLERS = Phrases({f: False for f in SET_OFF} | {h: True for h in HESITATIONS})
_SOUND_SET = {_squeeze(s) for s in SOUNDS}


class Cast:
    """Labels of one transcript: an automaton over every way to write a speaker that is not shared by two, and the sounds."""

    def __init__(self, speakers: list[tuple[int, str | None, str | None, str | None]]):
        ways: dict[str, set[int]] = {}
        for number, name, role, tag in speakers:
            parts = _fold(name or "").split()
            forms = {" ".join(parts), _fold(role or ""), _fold(tag or "")}
            if len(parts) > 1:
                first, last = parts[0], parts[-1]
                forms |= {first, last, f"{first[0]}. {last}", f"{first[0]} {last}", f"{last}, {first}", f"{first} {last[0]}.", " ".join(parts[1:])}
            for form in forms:
                if form:
                    ways.setdefault(_squeeze(form), set()).add(number)
        self.ways = {form: next(iter(numbers)) for form, numbers in ways.items() if len(numbers) == 1}
        self.longest = max(map(len, self.ways), default=0)
        self._forms = [(form, len(form), frozenset(form)) for form in self.ways if form[:1].isalpha()]
        self._nearest: dict[str, int | None] = {}
        self.machine = ahocorasick.Automaton()
        for sound in _SOUND_SET:
            self.machine.add_word(sound, (len(sound), None))
        for form, number in self.ways.items():
            self.machine.add_word(form, (len(form), number))
        self.machine.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, speaker) of all labels that stand as whole words, the longest at each place, in order."""
        if not self.ways:
            return []
        low = _lower(text).replace("’", "'")
        slim = _REPEAT.sub(r"\1", low)
        found: dict[int, tuple[int, int]] = {}
        for end, (size, number) in self.machine.iter(slim):
            start, end = end - size + 1, end + 1
            if number is None or start and slim[start - 1].isalnum() and slim[start].isalnum() or end < len(slim) and slim[end].isalnum() and slim[end - 1].isalnum():
                continue
            if found.get(start, (0, 0))[0] < end:
                found[start] = (end, number)
        if not found:
            return []
        if len(slim) != len(low):  # back from squeezed places to those of the text
            places = [i for i, c in enumerate(low) if not (i and c == low[i - 1] and c.isalpha())]
            places.append(len(low))
        else:
            places = range(len(low) + 1)
        return [(places[start], places[end], number) for start, (end, number) in sorted(found.items())]

    def find(self, label: str, fuzzy: bool = False) -> int | None:
        """The speaker of a text that is a label as a whole, with its role in brackets or without; the nearest one if ``fuzzy``."""
        key = _squeeze(label.strip(" :-–—>"))
        number = self.ways.get(key)
        if number is None and key.endswith(")") and "(" in key:
            number = self.ways.get(key[: key.index("(")].strip())
        if number is None and fuzzy and 4 <= len(key) <= self.longest + 3 and key not in _SOUND_SET and not any(c.isdigit() for c in key):
            if key not in self._nearest:
                self._nearest[key] = self._near(key)
            number = self._nearest[key]
        return number

    def _near(self, key: str) -> int | None:
        """The speaker whose form is most similar, from ``FUZZY`` on."""
        n, best = len(key), (0.0, "")
        for form, size, letters in self._forms:
            # the letters in common bound the similarity from above
            if abs(size - n) <= 3 and 2 * sum(map(letters.__contains__, key)) >= FUZZY * (size + n):
                best = max(best, (SequenceMatcher(None, key, form).ratio(), form))
        return self.ways[best[1]] if best[0] >= FUZZY else None

    def names_sound(self, note: str) -> bool:
        """A sound's name stands in the note as whole words."""
        key = _squeeze(note)
        for end, (size, number) in self.machine.iter(key):
            start, end = end - size + 1, end + 1
            if number is None and not (start and key[start - 1].isalnum() or end < len(key) and key[end].isalnum()):
                return True
        return False


def _lower(text: str) -> str:
    """Lower case of the same length: some capitals grow when lowered."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Cue:
    spans: list[tuple[int | None, str]] = field(default_factory=list)  # (speaker by label or None, cleaned words)
    sounds: tuple[str, ...] = ()

    @property
    def kind(self) -> str:
        return "speech" if any(text for _, text in self.spans) else "sound" if self.sounds else "none"

    @property
    def last_label(self) -> int | None:
        return next((number for number, _ in reversed(self.spans) if number is not None), None)


_MARK = "\x00"
_MARKED = re.compile(_MARK + r"(\d+)" + _MARK)
def _subtract(text: str, cuts: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in cuts:
        out.append(text[at:start])
        out.append(" ")
        at = end
    out.append(text[at:])
    return "".join(out)


_TAIL_PURE, _TAIL_SET_OFF = re.compile(r"\s?(?:,|\.{2,}|…|-)?"), re.compile(r"\s?(?:,|\.{3}|…)")


def strip_fillers(text: str) -> str:
    """Cuts hesitations, and set-off words where a comma or dots follow them."""
    low = _lower(text)
    cuts = []
    for start, end, pure in _FILLERS.hits(low):
        if not pure:
            m = _TAIL_SET_OFF.match(text, end)
            if not m or (low[start:end] == "este" and "," in m.group()):
                continue
            tail = m.end()
        else:
            tail = _TAIL_PURE.match(text, end).end()
            if tail > end and text[end : end + 1] == "." and text[end : end + 2] != "..":
                tail = end
            if start and text[start - 1] in "-'’":
                continue
        cuts.append((start, tail))
    return _subtract(text, cuts) if cuts else text


_BEFORE_POINT, _OPENING = re.compile(r"\s+([,.!?…;:])"), re.compile(r"^[\s,;:>\-–—….]+")


def _clean(raw: str) -> str:
    """Spoken words without fillers; empty if there are none."""
    clean = _BEFORE_POINT.sub(r"\1", " ".join(strip_fillers(raw).split()))
    if clean[:1].isalnum():
        return clean
    clean = _OPENING.sub("", clean)
    return clean if _WORD.search(clean) else ""


def _opening_label(t: str, hits: list[tuple[int, int, int]], cast: Cast, fuzzy: bool) -> tuple[int, int] | None:
    """(end, speaker) of a label at the start of a text."""
    at = _LEAD.match(t).end()
    for start, end, number in hits:
        if start == at:
            behind = _BEHIND.match(t, end)
            if behind:
                return behind.end(), number
        elif start > at:
            break
    head = _HEAD.match(t, at)
    if not head:
        return None
    number = cast.find(head.group(2)) if head.group(2) else None
    if number is None and fuzzy:
        number = cast.find(head.group(1), fuzzy=True)
    return (head.end(), number) if number is not None else None


def _with_marks(t: str, cast: Cast, sounds: list[str]) -> str:
    """The text with labels as marks and without times, tags and annotations."""
    if "<" in t:
        t = _VOICE.sub(lambda m: f" {_MARK}{n}{_MARK} " if (n := cast.find(m.group(1), True)) is not None else " ", t)
    if ":" in t:
        t = _BRACKETED_CLOCK.sub(" ", t)
    if "<" in t:
        t = _TAG.sub("", t)
    if t.lstrip()[:1].isdigit():
        t = _LEADING_CLOCK.sub("", t)

    def note(m: re.Match) -> str:
        whole = m.group()
        inner = whole.strip("[](){}*♪【】 ").strip()
        number = cast.find(inner, whole[0] == "[")
        if number is not None and whole[0] in "[(【":
            # a role behind a name, as in "Name (role):", belongs to the label that is read below
            if whole[0] == "(" and t[m.end() :].lstrip()[:1] == ":" and any(not t[end : m.start()].strip() for _, end, _ in cast.hits(t[: m.start()])):
                return whole
            return f" {_MARK}{number}{_MARK} "
        if whole[0] == "(" and not cast.names_sound(inner) and (inner[:1].isdigit() or " " in inner):
            return whole
        sounds.append(_squeeze(inner))
        return " "

    t = " ".join(_NOTE.sub(note, t).split())
    if ":" not in t and " -" not in t and " –" not in t and " —" not in t:
        return t
    hits = cast.hits(t)
    label = _opening_label(t, hits, cast, fuzzy=True)
    if label is None:  # behind hesitations
        bare = strip_fillers(t)
        if bare != t:
            bare = bare[_LEAD.match(bare).end() :]
            label = _opening_label(bare, cast.hits(bare), cast, fuzzy=False)
            if label:
                t = bare
    if label:
        t = f"{_MARK}{label[1]}{_MARK} {t[label[0]:]}"
        hits = cast.hits(t) if ":" in t else []
    out, at = [], 0
    for start, end, number in hits:  # the longest known label before the colon comes first; blanks are single, so what precedes it is short
        if start >= at and (behind := _BEHIND_INNER.match(t, end)) and (before := _BEFORE_INNER.search(t, max(0, start - 8), start)):
            out += [t[at : max(at, before.start() + 1)], f" {_MARK}{number}{_MARK} "]
            at = behind.end()
    return "".join([*out, t[at:]]) if out else t


def parse_cue(text: str | None, cast: Cast) -> Cue:
    """Null and blank texts give a cue without words and sounds."""
    cue = Cue()
    if not text or text.isspace():
        return cue
    t = html.unescape(text) if "&" in text else text
    t = " ".join(t.replace("\u200b", "").replace(_MARK, " ").split())
    if not _SIGNS.search(t):
        clean = _clean(t)
        if clean:
            cue.spans.append((None, clean))
        return cue
    sounds: list[str] = []
    parts = _MARKED.split(_with_marks(t, cast, sounds))
    cue.sounds = tuple(sorted(sounds))
    for i in range(0, len(parts), 2):
        number, clean = int(parts[i - 1]) if i else None, _clean(parts[i])
        if number is not None or clean:
            cue.spans.append((number, clean))
    return cue


# ---------------------------------------------------------------- rows in blocks

def block_rows(segments: DataFrame, speakers: DataFrame, block: int | None = 0) -> DataFrame:
    """Cues and, before them, the cast of their transcript, together by (source, block), in order.

    One shuffle by (source, block): the cues go once, the cast once per block of its transcript. ``block`` is the number of
    positions of a block (``BLOCK`` by default), or None for whole transcripts.
    Rows without a source or a position cannot be ordered and are left out.
    """
    number = (F.lit(0) if block is None else F.floor(F.col("pos") / (block or BLOCK))).cast("bigint").alias("block")
    cues = segments.where("source_id is not null and pos is not null").select("source_id", number, "pos", "start_s", "end_s", "text")
    nothing = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    cue_rows = cues.select("source_id", "block", F.lit(1).alias("is_cue"), "pos", "start_s", "end_s", "text", *nothing(("n_blocks", "bigint"), ("speaker_no", "int"), ("full_name", "string"), ("role_name", "string"), ("diar_tag", "string")))
    every = cues.select("source_id", "block").distinct().withColumn("n_blocks", F.count("*").over(Window.partitionBy("source_id")))  # one slim row per block
    cast = every.join(speakers.select("source_id", "speaker_no", "full_name", "role_name", "diar_tag"), "source_id", "left")
    cast_rows = cast.select("source_id", "block", F.lit(0).alias("is_cue"), *nothing(("pos", "int"), ("start_s", "double"), ("end_s", "double"), ("text", "string")), "n_blocks", "speaker_no", "full_name", "role_name", "diar_tag")
    return cue_rows.unionByName(cast_rows).repartition("source_id", "block").sortWithinPartitions("source_id", "block", "is_cue", "pos")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list[tuple]]]:
    """(source, block, whether it is the only one, cues as (pos, start, end, Cue)) from sorted rows; rows equal in all columns count once."""
    key, alone, cast, cues, seen = None, False, [], [], set()

    def done():
        known = Cast(cast)
        return key[0], key[1], alone, [(pos, start, end, parse_cue(text, known)) for pos, start, end, text in cues]

    for batch in batches:
        for source, block, is_cue, pos, start, end, text, n_blocks, number, name, role, tag in zip(*(c.to_pylist() for c in batch.columns)):
            if (source, block) != key:
                if key is not None and cues:
                    yield done()
                key, alone, cast, cues, seen = (source, block), False, [], [], set()
            if not is_cue:
                alone = n_blocks == 1
                if number is not None:
                    cast.append((number, name, role, tag))
                continue
            row = (pos, start, end, text)
            if row not in seen:
                seen.add(row)
                cues.append(row)
    if key is not None and cues:
        yield done()
