"""Keyword piles, link lists and tag lists among documents.

A document is read once: lines (long ones at sentence ends, and what has none every ``UNIT_WORDS`` words) become units,
each with its words and eight coarse features. A hidden Markov model labels the units as prose (sentences, or records as in
logs), link list, tag list or menu (Viterbi). Its start, transition and emission probabilities are fitted by Baum-Welch on the unit sequences of all
documents, whole, from first guesses that also serve as a weak prior, so the states keep their meaning. A document is
flagged if the units that are not prose hold more than ``MIN_SHARE`` of its words; a link counts as many words as it has
parts, in scripts without blanks two letters count as a word.

Texts are read in one narrow stage and written as two bytes and a number of words per unit. Each round of Baum-Welch is a
narrow stage over these, of which one row of sums per task comes to the driver; labelling is another: no shuffle, no state
between documents.

Defined results: null, empty and blank texts are not flagged; repeated rows give repeated results; a document of
one unit is judged by that unit; very long texts are labelled in linear time; without documents the first guesses hold.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.session import cut, spread

STATES = ("prose", "link_list", "tag_list", "menu")
#: Hidden states, and the label of each: prose is written by people in sentences or by machines in records.
HIDDEN = ("sentence", "record", "link_list", "tag_list", "menu")
LABEL = (0, 0, 1, 2, 3)
MIN_SHARE = 0.5
UNIT_WORDS = 24
#: First guess of the probability that the next unit is of the same state.
STAY = 0.9
#: Rounds of Baum-Welch, and how many units the first guesses weigh.
FIT_ROUNDS, PRIOR = 10, 200.0
#: Units of a piece, pieces of a block, and bytes of different sequences that are worked on at once; results do not depend on them.
FIT_UNITS, FIT_BLOCK, FIT_BYTES = 100, 512, 1 << 20
#: A bigram of a document is hot from this count and this share of its words on.
HOT_COUNT, HOT_SHARE = 5, 0.02

#: The commonest function words of the nine languages.
FUNCTION_WORDS = frozenset(
    "the a an of and or but in on at to for from with by is are was were be it its this that these those as if while because when our their his her my your we they i you he she not no than then so also all each every into over under after before until since without despite once "
    "el la los las un una de del y o pero en por para con sin es son al que se su sus lo no como cuando hasta desde "
    "le les des du et ou mais dans sur pour par avec sans est sont au aux ce cette ces qui que ne pas plus son sa ses nos notre quand depuis "
    "der die das den dem des ein eine einer eines und oder aber doch denn in im am an auf für mit von vom zu zum zur bei nach vor bis ist sind nicht noch alle unser seit wegen trotz ohne laut "
    "o os as um uma do da dos das e ou mas em no na nos nas por para com sem ao se seu sua não nosso até desde porque enquanto "
    "il lo gli i un uno una di del della delle dei dal dalla e o ma in nel nella con per da su al alla che si non suo sua nostro finché perché mentre quando dopo senza "
    "de het een en of maar in op aan van voor met door bij naar tot is zijn niet nog ons onze die dat dit als te om na zonder sinds omdat terwijl want "
    "и в на с по к у о от до за из без для не но а что как это так же при после перед хотя если наш наша все".split()
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LINK = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"')\]]+|\b(?:[\w-]+\.)+[a-z]{2,}/[^\s<>\"')\]]*|</?a\b[^>]*>", re.I)
_TAG = re.compile(r"#[^\s#]+")
_STOPS, _BEHIND_STOP = frozenset(".!?。！？…:;"), "'\"”’)] \t\r\f\v\xa0\u3000"
_CUT = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_STAMP = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
_OPENING = re.compile(r"[{\[]\s*\"|\$|--?\w|```")
_FIELD = re.compile(r"\w=\w")
_LEVELS, _LEVEL = ("INFO", "WARN", "ERROR", "DEBUG", "TRACE"), re.compile(r"\b(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE)\b")
_BLOB = re.compile(r"(?<![\w/.#-])[A-Za-z0-9+/]{60,}={0,2}(?![\w/.-])")
_SEP = re.compile(r"[,|;·•/>#\\»~]|\s-\s|\$")
_KANA = re.compile(r"[぀-ゟ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def units(text: str) -> list[str]:
    """Lines; long ones at sentence ends, and what has none every UNIT_WORDS words."""
    out = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        for piece in _CUT.split(line) if len(line) > 120 else [line]:
            if not piece.strip():
                continue
            if len(piece) <= 300:
                out.append(piece)
                continue
            words = piece.split(" ")
            if len(words) < 4:
                out.append(piece)
            else:
                out += [p for i in range(0, len(words), UNIT_WORDS) if (p := " ".join(words[i : i + UNIT_WORDS])).strip()]
    return out


@dataclass
class Unit:
    text: str
    plain: str
    words: list[str]
    link_chars: int
    n_words: int
    n_cjk: int


def read_units(text: str) -> tuple[list[Unit], set[tuple[str, str]]]:
    """The units of a text, each tokenised once, and the bigrams the text keeps coming back to.

    Lines repeated whole (but for leading numbers, as in time stamps), and long sentences repeated, count once for the bigrams.
    """
    out, seen, counts, total = [], set(), Counter(), 0
    for piece in units(text):
        plain, chars, parts = piece, 0, 0
        if "/" in piece or "www" in piece or "<a" in piece:
            links = _LINK.findall(piece)
            if links:
                chars, parts = sum(map(len, links)), len(_WORD.findall(" ".join(links)))
                plain = _LINK.sub(" ", piece)
        words = _WORD.findall(plain.lower())
        cjk = 0 if plain.isascii() else len(_CJK.findall(plain))
        out.append(Unit(piece, plain, words, chars, len(words) + parts + cjk // 2, cjk))
        first = 0
        while first < len(words) and words[first].isdigit():
            first += 1
        body = words[first:] if first else words
        key = " ".join(body)
        if key in seen:
            continue
        seen.add(key)
        total += len(body)
        counts.update(zip(body, body[1:]))
    least = max(HOT_COUNT, HOT_SHARE * total)
    return out, {p for p, c in counts.items() if c >= least and not (p[0] in FUNCTION_WORDS and p[1] in FUNCTION_WORDS)}


def is_record(plain: str) -> bool:
    """Whether a line has a time stamp, opens like data or code, has a field with a value, a level, or encoded bytes.

    Signs without which a pattern cannot match are looked for first.
    """
    return bool(
        "=" in plain and _FIELD.search(plain)
        or "-" in plain and _STAMP.search(plain)
        or (opening := plain.lstrip())[:1] in "{[$-`" and _OPENING.match(opening)
        or any(map(plain.__contains__, _LEVELS)) and _LEVEL.search(plain)
        or len(plain) >= 60 and max(map(len, plain.split()), default=0) >= 60 and _BLOB.search(plain)
    )


def observe(unit: Unit, hot: set[tuple[str, str]]) -> tuple[int, ...]:
    """(links, function words, sentence end, repetition, separators, hot phrases, tags, record) as small classes."""
    text, plain, words = unit.text, unit.plain, unit.words
    n, m = max(1, len(text)), max(1, len(words))
    tags = sum(map(len, _TAG.findall(plain))) if "#" in plain else 0
    if unit.n_cjk and unit.n_cjk * 3 > len(plain.replace(" ", "")):
        grammar = len(_KANA.findall(plain)) / max(1, len(plain.replace(" ", "")))
    else:
        grammar = sum(map(FUNCTION_WORDS.__contains__, words)) / m
    pairs = list(zip(words, words[1:]))
    again = 1 - len(set(pairs)) / len(pairs) if pairs else 0.0
    heat = min(1.0, 2 * sum(map(hot.__contains__, pairs)) / m) if hot else 0.0
    separators = len(_SEP.findall(plain)) / m
    share = unit.link_chars / n
    return (
        0 if share < 0.05 else 1 if share < 0.35 else 2,
        0 if grammar < 0.04 else 1 if grammar < 0.16 else 2,
        1 if text.rstrip(_BEHIND_STOP)[-1:] in _STOPS else 0,
        0 if again < 0.04 else 1 if again < 0.25 else 2,
        0 if separators < 0.1 else 1 if separators < 0.22 else 2,
        0 if heat < 0.15 else 1 if heat < 0.4 else 2,
        0 if tags < 0.3 * n else 1,
        1 if is_record(plain) else 0,
    )


#: First guesses of P(class | state) per feature, in the order of STATES.
EMISSION = (
    ((0.93, 0.06, 0.01), (0.93, 0.06, 0.01), (0.05, 0.2, 0.75), (0.9, 0.08, 0.02), (0.75, 0.2, 0.05)),  # share of links
    ((0.04, 0.16, 0.8), (0.5, 0.25, 0.25), (0.6, 0.25, 0.15), (0.65, 0.25, 0.1), (0.5, 0.3, 0.2)),  # function words
    ((0.25, 0.75), (0.7, 0.3), (0.9, 0.1), (0.88, 0.12), (0.7, 0.3)),  # ends like a sentence
    ((0.94, 0.05, 0.01), (0.8, 0.15, 0.05), (0.7, 0.2, 0.1), (0.45, 0.3, 0.25), (0.3, 0.35, 0.35)),  # repeats within the unit
    ((0.7, 0.25, 0.05), (0.5, 0.3, 0.2), (0.3, 0.3, 0.4), (0.15, 0.3, 0.55), (0.55, 0.2, 0.25)),  # separators
    ((0.72, 0.2, 0.08), (0.6, 0.2, 0.2), (0.5, 0.2, 0.3), (0.3, 0.3, 0.4), (0.08, 0.22, 0.7)),  # hot phrases of the document
    ((0.985, 0.015), (0.985, 0.015), (0.97, 0.03), (0.55, 0.45), (0.97, 0.03)),  # hash tags
    ((0.97, 0.03), (0.1, 0.9), (0.9995, 0.0005), (0.9995, 0.0005), (0.9995, 0.0005)),  # log lines, data, code: written by machines, not piled up
)

#: All combinations of classes, and the number of each.
KINDS = tuple(itertools.product(*(range(len(e[0])) for e in EMISSION)))
NUMBER = {seen: i for i, seen in enumerate(KINDS)}


def _first_guess() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    k = len(HIDDEN)
    return np.array([0.8, 0.05, 0.05, 0.05, 0.05]), np.full((k, k), (1 - STAY) / (k - 1)) + np.eye(k) * (STAY - (1 - STAY) / (k - 1)), [np.array(e) for e in EMISSION]


@dataclass
class PageModel:
    """Start, transition and emission probabilities of the hidden Markov model."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]
    _known: dict[tuple[int, ...], tuple[list[float], bool]] = field(default_factory=dict)

    @classmethod
    def guessed(cls) -> PageModel:
        return cls(*_first_guess())

    def __post_init__(self) -> None:
        self.log_start, self.into = np.log(self.start).tolist(), np.log(self.move).T.tolist()
        self.most_into = [max(x) for x in self.into]

    def own(self, seen: tuple[int, ...]) -> tuple[list[float], bool]:
        """Log probability of what was observed in every hidden state (as many as combinations of classes), and whether a
        sentence after a sentence is so likely that no other step into any state could be better."""
        got = self._known.get(seen)
        if got is None:
            own = [float(sum(np.log(e[s, c]) for e, c in zip(self.emit, seen))) for s in range(len(HIDDEN))]
            plain = own[0] + self.into[0][0] >= max(o + m for o, m in zip(own, self.most_into)) and own[0] + self.log_start[0] >= max(o + s for o, s in zip(own, self.log_start))
            got = self._known[seen] = own, plain
        return got

    def path(self, observed: list[tuple[int, ...]]) -> list[int]:
        """Most probable label of each unit (Viterbi over the hidden states)."""
        known = [self.own(x) for x in observed]
        if all(plain for _, plain in known):
            return [0] * len(observed)
        states = range(len(HIDDEN))
        score = [a + b for a, b in zip(self.log_start, known[0][0])]
        back = []
        for own, _ in known[1:]:
            choice, now = [], []
            for s in states:
                steps = [a + b for a, b in zip(score, self.into[s])]
                best = max(steps)
                choice.append(steps.index(best))
                now.append(best + own[s])
            back.append(choice)
            score = now
        path = [score.index(max(score))]
        for choice in reversed(back):
            path.append(choice[path[-1]])
        return [LABEL[s] for s in reversed(path)]

    def shares(self, text: str | None) -> list[float]:
        """Share of the words that each state holds, in the order of STATES; all prose for blank texts."""
        if not text or text.isspace():
            return [1.0, 0.0, 0.0, 0.0]
        found, hot = read_units(text)
        return _by_state(self.path([observe(u, hot) for u in found]), [u.n_words for u in found])


def _by_state(path: list[int], words: list[int]) -> list[float]:
    sizes = [0] * len(STATES)
    for state, n in zip(path, words):
        sizes[state] += n
    total = sum(sizes)
    return [s / total for s in sizes] if total else [1.0, 0.0, 0.0, 0.0]


def baum_welch(sequences: list[list[tuple[int, ...]]], rounds: int = FIT_ROUNDS, prior: float = PRIOR) -> PageModel:
    """Maximum a posteriori fit of all probabilities; the first guesses count like ``prior`` units."""
    coded = Counter(_code(x) for x in sequences if x)
    return _climb(lambda *now: _expected(coded, *now), rounds, prior)


def _climb(expected: Callable[..., np.ndarray], rounds: int, prior: float) -> PageModel:
    """Rounds from the first guesses; ``expected`` sums up all sequences under the probabilities of a round.

    What is kept of the probabilities is so short that the order in which tasks were added does not show.
    """
    start, move, emit = _first_guess()
    k = len(start)
    ends = np.cumsum([k, k * k, *(e.size for e in emit)])[:-1]
    guess = np.concatenate([start, move.ravel(), *(e.ravel() for e in emit)])
    for _ in range(rounds):
        counts = expected(start, move, emit)
        if not counts.any():
            break
        start, move, *emit = [_shares(x.reshape(-1, k) if i < 2 else x.reshape(k, -1)) for i, x in enumerate(np.split(counts + prior * guess, ends))]
        start = start[0]
    return PageModel(start, move, emit)


def _shares(counts: np.ndarray) -> np.ndarray:
    return (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).astype(np.float64)


def _code(seen: list[tuple[int, ...]]) -> bytes:
    return np.array([NUMBER[x] for x in seen], dtype="<u2").tobytes()


def _expected(sequences: dict[bytes, int], start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> np.ndarray:
    """Expected starts, steps and classes by state over coded sequences, each as often as it occurs, one behind the other.

    Long sequences are taken in pieces, to each of which the states before and behind it are carried, so the sums are those
    of the whole sequence.
    """
    k, classes = len(start), np.array(KINDS)
    own = np.ones((len(KINDS), k))
    for f, e in enumerate(emit):
        own *= e[:, classes[:, f]].T
    pieces, long, nothing, anything = [], [], np.zeros(k), np.ones(k)
    for codes, times in sequences.items():
        units = np.frombuffer(codes, dtype="<u2")
        if len(units) <= FIT_UNITS:
            pieces.append((units, times, nothing, anything))
        else:
            long += [(units[i : i + FIT_UNITS], times, i == 0) for i in range(0, len(units), FIT_UNITS)]
    if long:
        parts, times, first = zip(*long)
        pieces += zip(parts, times, *_carry(parts, first, own, start, move))
    pieces.sort(key=lambda x: len(x[0]))  # of like lengths, so little is padded
    weight, moves, begins = np.zeros((len(KINDS), k)), np.zeros((k, k)), np.zeros(k)
    for first in range(0, len(pieces), FIT_BLOCK):
        parts, times, before, behind = zip(*pieces[first : first + FIT_BLOCK])
        _expect(*_padded(parts), np.array(times, dtype=float), np.array(before), np.array(behind), own, start, move, weight, moves, begins)
    counts = [np.stack([np.bincount(classes[:, f], weight[:, s], e.shape[1]) for s in range(k)]) for f, e in enumerate(emit)]
    return np.concatenate([begins, moves.ravel(), *(c.ravel() for c in counts)])


def _padded(parts) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in parts])
    real = np.arange(sizes.max()) < sizes[:, None]
    at = np.zeros(real.shape, dtype=np.int64)
    at[real] = np.concatenate(parts)
    return at, real


def _carry(parts, first, own, start, move) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece of sequences one behind the other: the states before it, given all before (zeros: it is the first one of
    a sequence), and how well each last state of it agrees with all behind."""
    k, n = len(start), len(parts)
    across = np.empty((n, k, k))  # from the state before a piece to its last one
    for at_first in range(0, n, FIT_BLOCK):
        block = slice(at_first, at_first + FIT_BLOCK)
        at, real = _padded(parts[block])
        now = np.where(np.array(first[block])[:, None, None], start, move)
        for i in range(at.shape[1]):
            step = (now @ move if i else now) * own[at[:, i]][:, None]
            now = np.where(real[:, i, None, None], step / step.max(axis=(1, 2), keepdims=True), now)
        across[block] = now
    before, behind = np.zeros((n, k)), np.ones((n, k))
    for i in range(1, n):
        if not first[i]:
            now = across[i - 1, 0] if first[i - 1] else before[i - 1] @ across[i - 1]
            before[i] = now / now.sum()
    for i in range(n - 2, -1, -1):
        if not first[i + 1]:
            now = across[i + 1] @ behind[i + 1]
            behind[i] = now / now.max()
    return before, behind


def _expect(at, real, times, before, behind, own, start, move, weight, moves, begins) -> None:
    """Adds the expected states, steps and starts of a block of pieces (forward and backward pass)."""
    b, t = at.shape
    seen = np.where(real[..., None], own[at], 1.0)
    opens = ~before.any(axis=1)
    ahead, scale = np.empty((b, t, len(start))), np.ones((b, t))
    now = np.where(opens[:, None], start, before @ move) * seen[:, 0]
    for i in range(t):
        if i:
            now = np.where(real[:, i, None], (ahead[:, i - 1] @ move) * seen[:, i], ahead[:, i - 1])
        scale[:, i] = now.sum(axis=1)
        ahead[:, i] = now / scale[:, i, None]
    state = np.empty_like(ahead)
    behind = behind / (ahead[:, -1] * behind).sum(axis=1, keepdims=True)
    for i in range(t - 1, -1, -1):
        state[:, i] = ahead[:, i] * behind
        inner = np.where(real[:, i, None], seen[:, i] * behind / scale[:, i, None], 0.0)
        moves += (ahead[:, i - 1] if i else before).T @ (inner * times[:, None]) * move
        behind = np.where(real[:, i, None], inner @ move.T, behind)
    state /= np.maximum(state.sum(axis=2, keepdims=True), 1e-300)
    state *= (real * times[:, None])[..., None]
    for s in range(len(start)):
        weight[:, s] += np.bincount(at.ravel(), state[..., s].ravel(), len(weight))
    begins += state[opens, 0].sum(axis=0)


# ---------------------------------------------------------------- distributed


def _read(documents: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, the coded units, the words of each unit) of every document; nulls for blank texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes = [], []
            for text in batch.column(1).to_pylist():
                if not text or text.isspace():
                    codes.append(None)
                    sizes.append(None)
                    continue
                found, hot = read_units(text)
                codes.append(_code([observe(u, hot) for u in found]))
                sizes.append(np.array([u.n_words for u in found], dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), pa.array(sizes, pa.binary())], ["id", "codes", "sizes"])

    id_type = documents.schema[id_col].dataType.simpleString()
    return spread(documents.select(id_col, text_col)).mapInArrow(read, f"id {id_type}, codes binary, sizes binary")


def _fit(pages: DataFrame) -> PageModel:
    """The model fitted on all units of all documents; of each task only one row of sums comes to the driver."""
    coded = pages.select("codes").where("length(codes) > 0")

    def expected(start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, waiting, size = 0.0, Counter(), 0
            for batch in batches:
                for codes in batch.column(0).to_pylist():
                    if codes not in waiting:
                        size += len(codes)
                    waiting[codes] += 1
                    if size > FIT_BYTES:
                        total, waiting, size = total + _expected(waiting, start, move, emit), Counter(), 0
            if waiting:
                total = total + _expected(waiting, start, move, emit)
            if not isinstance(total, float):
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

        return np.array([r["x"] for r in coded.mapInArrow(sums, "x array<double>").collect()] or [[0.0] * (len(start) + move.size + sum(e.size for e in emit))]).sum(axis=0)

    return _climb(expected, FIT_ROUNDS, PRIOR)


def fit(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> PageModel:
    """The model fitted on all documents."""
    return _fit(cut(_read(documents, text_col, id_col), "pages"))


def page_labels(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: PageModel | None = None) -> DataFrame:
    """(id, prose_share, link_share, tag_share, menu_share, is_spam) of every document."""
    id_type = documents.schema[id_col].dataType.simpleString()
    pages = _read(documents, text_col, id_col)
    if model is None:
        pages = cut(pages, "pages")
        model = _fit(pages)
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: PageModel = shipped.value
        for batch in batches:
            paths: dict[bytes, list[int]] = {}
            shares = []
            for codes, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if codes is not None and codes not in paths:
                    paths[codes] = fitted.path([KINDS[i] for i in np.frombuffer(codes, dtype="<u2").tolist()])
                shares.append(_by_state(paths.get(codes, []), np.frombuffer(words or b"", dtype="<u4").tolist()))
            columns = [pa.array([round(s[i], 4) for s in shares], pa.float64()) for i in range(len(STATES))]
            spam = pa.array([1 - s[0] > MIN_SHARE for s in shares], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, spam], [id_col, "prose_share", "link_share", "tag_share", "menu_share", "is_spam"])

    return pages.mapInArrow(label, f"`{id_col}` {id_type}, prose_share double, link_share double, tag_share double, menu_share double, is_spam boolean")


def spam_pages(documents: DataFrame) -> DataFrame:
    return page_labels(documents).where("is_spam").select("doc_id")
