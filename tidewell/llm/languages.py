"""Language of every document and of every passage of a mixed one, with a confidence.

A bidirectional GRU over bytes labels every byte; bytes are pooled to words, a Viterbi pass over the words
with a price for every switch cuts the text into passages of one language, and a passage counts from
``MIN_WORDS`` words on (in scripts without blanks from ``MIN_CHARS`` letters on). Links, tags, handles, numbers and
symbols are no language and are not read.

The network is trained on the driver on the labelled sample sentences (at most ``MAX_SAMPLES`` of them, a documented
bound), strung together at random so that it learns to switch, and shipped to the tasks (a few 100 kB). Training is
repeated only when the samples change. Labelling is one narrow stage over all texts, whole: no shuffle.

Defined results: null, blank and language-less texts have no passages and no language (null); repeated rows get
repeated results; labels that name no known language name none; very long texts are read in chunks that carry the states over.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.byte_gru import STRIDE, ByteGRU, train
from tidewell.llm.sample import hash_sample
from tidewell.session import spread

MAX_SAMPLES = 20_000
MIN_WORDS, MIN_CHARS = 4, 7
HIDDEN, STEPS, BATCH, LENGTH = 16, 130, 128, 40
#: Labelled texts whose labels the first network agrees with train it further (about so many, by hashed row number).
MAX_LABELLED, MORE_STEPS = 8_000, 120
#: Longest text (in characters) that a network is trained on: with the rows above it bounds what comes to the driver.
MAX_TRAINING_CHARS = 4_000
#: Price of a switch of language between sentences and inside one, in log probability summed over steps.
SWITCH, SWITCH_INSIDE = 22.0, 45.0
#: Steps of a text that are read side by side with other texts; longer texts are read alone, in chunks that hand their
#: states on in both directions, so the result does not depend on it.
PIECE = 1024

#: Language codes by which labels name a language.
CODES = {
    "en": "en", "eng": "en", "es": "es", "spa": "es", "fr": "fr", "fra": "fr", "fre": "fr", "de": "de", "deu": "de", "ger": "de", "pt": "pt", "por": "pt",
    "it": "it", "ita": "it", "nl": "nl", "nld": "nl", "dut": "nl", "ja": "ja", "jpn": "ja", "ru": "ru", "rus": "ru",
}
_SPELLED = re.compile(r"\S+(?:\s?[\[(]at[\])]\s?|\sAT\s)\S+(?:(?:\s?[\[(]dot[\])]\s?|\sDOT\s)\S+)*", re.I)
_NOISE = re.compile(r"(?:https?://|www\.)\S+|[#@][\w]+|\S+@\S+|&[a-z]+;|<[^<>\s][^<>]*>|�")
_WORD = re.compile(r"[぀-ヿ㐀-鿿々ー]+|[^\W\d_぀-ヿ㐀-鿿々ー]+(?:['’\-][^\W\d_぀-ヿ㐀-鿿々ー]+)*")
_PRODUCT = re.compile(r"\([^()]{1,40}\d\)")


def label_language(label: str | None) -> str | None:
    """The language a label names, or None."""
    if not label:
        return None
    return CODES.get(re.split(r"[-_]", label.strip().lower())[0])


_SPLIT = re.compile(f"({_WORD.pattern})").split
_BOUNDARY = re.compile(r"[.!?]['\"”’)\]]*(?:\s|$)|[。！？\n|—–…]|\s/\s|\s-\s")
_bounds: dict[str, bool] = {}


def _is_boundary(gap: str) -> bool:
    got = _bounds.get(gap)
    if got is None:
        if len(_bounds) > 100_000:
            _bounds.clear()
        got = _bounds[gap] = bool(_BOUNDARY.search(gap))
    return got


def readable(text: str) -> tuple[list[str], list[bool]]:
    """The words of a text and whether a sentence may start at each, without links, tags, handles, markup and numbers.

    Scripts without blanks come in runs.
    """
    bare = _NOISE.sub(" ", text) if any(c in text for c in ":#@<&�") else text
    if "at]" in bare or "at)" in bare or " AT " in bare:
        bare = _SPELLED.sub(" ", bare)
    parts = _SPLIT(_PRODUCT.sub(" ", bare) if "(" in bare else bare)
    return parts[1::2], [g != " " and (g == ". " or _is_boundary(g)) for g in parts[0:-1:2]]


def plain_words(text: str) -> str:
    return " ".join(readable(text)[0])


_encoded: dict[str, bytes] = {}


def encoded(word: str) -> bytes:
    """The bytes of a word and a blank, filled up to whole steps."""
    got = _encoded.get(word)
    if got is None:
        if len(_encoded) > 200_000:
            _encoded.clear()
        raw = word.encode("utf-8") + b" "
        got = raw.ljust(-(-len(raw) // STRIDE) * STRIDE)
        if len(word) < 40:
            _encoded[word] = got
    return got


def is_unspaced(word: str) -> bool:
    return "぀" <= word[0] <= "鿿"


class LanguageModel:
    def __init__(self, languages: list[str], network: ByteGRU):
        self.languages, self.network = languages, network

    def word_scores(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text the log probabilities (words, languages), summed over the steps of each word."""
        pieces: list[tuple[bytes, list[int]]] = []
        owners: list[int] = []
        out: list[np.ndarray] = [np.zeros((0, len(self.languages)), np.float32)] * len(texts)
        for i, words in enumerate(texts):
            raw = [encoded(w) for w in words]
            sizes = [len(r) // STRIDE for r in raw]
            if sum(sizes) > PIECE:
                found = self.network.long_log_probabilities(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, STRIDE), PIECE)
                out[i] = np.add.reduceat(found, np.cumsum([0, *sizes[:-1]]), axis=0)
            elif words:
                pieces.append((b"".join(raw), sizes))
                owners.append(i)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i][0]))
        scores: list = [None] * len(pieces)
        at = 0
        while at < len(order):
            longest = len(pieces[order[at]][0])
            stop = at + 1
            while stop < len(order) and stop - at < 1500 and len(pieces[order[stop]][0]) <= max(longest + 24, longest * 1.1) and (stop - at + 1) * len(pieces[order[stop]][0]) < 240_000:
                stop += 1
            group = order[at:stop]
            width = len(pieces[group[-1]][0])
            block = np.frombuffer(b"".join([pieces[i][0].ljust(width) for i in group]), np.uint8).reshape(len(group), width // STRIDE, STRIDE)
            found = self.network.log_probabilities(block).transpose(1, 0, 2)  # (B, T, C)
            t = width // STRIDE
            counts = [len(pieces[i][1]) for i in group]
            steps = np.concatenate([pieces[i][1] for i in group])
            ends = np.cumsum(counts)
            begins = np.cumsum(steps) - steps
            row = np.repeat(np.arange(len(group)), counts)
            starts = begins - begins[ends - counts][row] + row * t
            used = np.array([len(pieces[i][0]) // STRIDE for i in group])
            pads = np.arange(len(group)) * t + used  # what follows the last word is no part of it
            every = np.concatenate([starts, pads[used < t]])
            into = np.argsort(every, kind="stable")
            sums = np.add.reduceat(np.ascontiguousarray(found).reshape(-1, found.shape[2]), every[into], axis=0)
            back = np.empty((len(every), sums.shape[1]), np.float32)
            back[into] = sums
            for i, part in zip(group, np.split(back[: len(starts)], ends[:-1])):
                scores[i] = part
            at = stop
        for i, owner in enumerate(owners):
            out[owner] = scores[i]
        return out

    def passages(self, words: list[str], starts: list[bool], scores: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(language, first word, last word, confidence) of the passages that are long enough."""
        n, c = scores.shape
        if n == 0:
            return []
        run = np.cumsum(scores, axis=0)
        best = int(run[-1].argmax())
        run -= run[:, best : best + 1].copy()
        # no other language gains more than the price of a switch on any stretch: one language
        low = np.minimum.accumulate(run, axis=0)
        np.minimum(low, 0, out=low)
        if n > 1 and float((run[1:] - low[:-1]).max()) > SWITCH:
            path = self._viterbi(*self._sentences(starts, scores))
        else:
            return self._passage(words, best, 0, n, run[-1])
        out, start = [], 0
        for i in range(1, n + 1):
            if i == n or path[i] != path[start]:
                out += self._passage(words, path[start], start, i, scores[start:i].sum(axis=0))
                start = i
        return out

    def _passage(self, words: list[str], language: int, start: int, stop: int, total: np.ndarray) -> list[tuple[str, int, int, float]]:
        n = stop - start
        spaced, letters = n, 0
        if self.languages[language] == "ja" or n < MIN_WORDS:
            letters = sum(len(w) for w in words[start:stop] if is_unspaced(w))
            spaced = sum(not is_unspaced(w) for w in words[start:stop])
        if spaced < MIN_WORDS and letters < MIN_CHARS:
            return []
        score = (total / max(1.0, n / 2)).tolist()
        top = score[language]
        return [(self.languages[language], start, stop - 1, 1 / sum(math.exp(min(50.0, s - top)) for s in score))]

    @staticmethod
    def _sentences(starts: list[bool], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return scores, np.where(np.array(starts), SWITCH, SWITCH_INSIDE)

    @staticmethod
    def _viterbi(scores: np.ndarray, price: np.ndarray) -> list[int]:
        n, c = scores.shape
        rows, prices = scores.tolist(), price.tolist()
        state, back, every = rows[0], [], range(c)
        for i in range(1, n):
            best = max(state)
            top = state.index(best)
            jump = best - prices[i]
            own = rows[i]
            back.append([k if state[k] >= jump else top for k in every])
            state = [(state[k] if state[k] >= jump else jump) + own[k] for k in every]
        at = state.index(max(state))
        path = [at]
        for choice in reversed(back):
            at = choice[at]
            path.append(at)
        return path[::-1]

    def label(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """Passages of each text; equal texts of a batch are read once."""
        places: dict[str, int] = {}
        read: list[tuple[list[str], list[bool]]] = []
        for t in texts:
            if t and t not in places:
                places[t] = len(read)
                read.append(readable(t))
        found = [self.passages(w, b, s) for (w, b), s in zip(read, self.word_scores([w for w, _ in read]))]
        return [found[places[t]] if t else [] for t in texts]


def training_batches(samples: list[tuple[str, str]], languages: list[str], steps: int, seed: int = 11):
    """Random strings of sample sentences with switches of language, cut into windows; labels by position."""
    rng = np.random.default_rng(seed)
    by = {code: [plain_words(t) for lang, t in samples if lang == code] for code in languages}
    by = {k: [t for t in v if t] for k, v in by.items()}

    def one() -> tuple[np.ndarray, np.ndarray]:
        data, labels = b"", []
        while len(labels) < LENGTH + 12:
            at = int(rng.integers(len(languages)))
            for _ in range(int(rng.integers(1, 3))):
                words = by[languages[at]][int(rng.integers(len(by[languages[at]])))].split(" ")
                if rng.random() < 0.6 and len(words) > 4:
                    i = int(rng.integers(len(words) - 3))
                    words = words[i : i + int(rng.integers(3, len(words) - i + 1))]
                way = rng.random()
                if way < 0.2:
                    words = [w.lower() if way < 0.15 else w.upper() for w in words]
                raw = b"".join(encoded(w) for w in words)
                data += raw
                labels += [at] * (len(raw) // STRIDE)
        cut = int(rng.integers(0, 10))
        return np.frombuffer(data, np.uint8).reshape(-1, STRIDE)[cut : cut + LENGTH], np.array(labels[cut : cut + LENGTH])

    for _ in range(steps):
        rows = [one() for _ in range(BATCH)]
        yield np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])


_trained: dict[int, LanguageModel] = {}


def fit(samples: DataFrame, labelled: DataFrame | None = None) -> LanguageModel:
    """Trains the network on the labelled sample sentences; the same samples are trained on once per driver.

    ``labelled`` rows (row_id, lang, text), some wrong, teach it more: of a sample of ``MAX_LABELLED`` by hashed row
    number those whose label the network confirms are added to the samples for a second round.
    """
    rows = [(r["lang"], r["text"]) for r in samples.where("lang is not null").where(F.length("text") <= MAX_TRAINING_CHARS).select("lang", "text").orderBy("lang", "text").limit(MAX_SAMPLES).collect()]
    pairs = sorted((label_language(a), b) for a, b in rows if label_language(a) and readable(b)[0])
    languages = sorted({a for a, _ in pairs}) or ["en"]
    key = hash(tuple(pairs))
    if key not in _trained:
        network = ByteGRU(len(languages), HIDDEN)
        if pairs:
            train(network, training_batches(pairs, languages, STEPS))
        _trained[key] = LanguageModel(languages, network)
    model = _trained[key]
    if labelled is None or not pairs:
        return model
    more = hash_sample(labelled.select("row_id", "lang", "text"), "row_id", MAX_LABELLED).where("lang is not null").where(F.length("text") <= MAX_TRAINING_CHARS).select("lang", "text").collect()
    texts = sorted({(label_language(r["lang"]), r["text"]) for r in more if label_language(r["lang"]) in languages})
    confirmed = list(pairs)
    for (lang, text), found in zip(texts, model.label([t for _, t in texts])):
        if found and {f[0] for f in found} == {lang}:
            confirmed += [(lang, piece) for piece in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n", text) if readable(piece)[0]]
    key = hash(tuple(confirmed))
    if key not in _trained:
        network = ByteGRU(len(languages), HIDDEN)
        network.p = {k: v.copy() for k, v in model.network.p.items()}
        train(network, training_batches(confirmed, languages, MORE_STEPS, seed=13), rate=0.01)
        _trained[key] = LanguageModel(languages, network)
    return _trained[key]


def _apply(df: DataFrame, columns: tuple[str, ...], model: LanguageModel, make, schema: str, types: tuple) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: LanguageModel = shipped.value
        for batch in batches:
            given = [c.to_pylist() for c in batch.columns]
            rows = [r for values, found in zip(zip(*given), fitted.label(given[-1])) for r in make(values, found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return spread(df.select(*columns)).mapInArrow(run, schema)


def document_languages(bookmarks: DataFrame, samples: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(row_id, lang, confidence, n_languages): the language with most words of each text; null without passages."""
    model = model or fit(samples, bookmarks)

    def make(values, found):
        held: dict[str, list[float]] = {}
        for lang, a, b, p in found:
            cell = held.setdefault(lang, [0.0, 0.0])
            cell[0] += b - a + 1
            cell[1] += p * (b - a + 1)
        top = max(held.items(), key=lambda x: (x[1][0], x[0]), default=(None, [1.0, 0.0]))
        return [(values[0], top[0], round(top[1][1] / top[1][0], 4) if top[0] else None, len(held))]

    return _apply(bookmarks, ("row_id", "text"), model, make, "row_id bigint, lang string, confidence double, n_languages int", (pa.int64(), pa.string(), pa.float64(), pa.int32()))


def passages(bookmarks: DataFrame, samples: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(row_id, passage_no, lang, first_word, last_word, confidence) of every passage."""
    model = model or fit(samples, bookmarks)
    make = lambda values, found: [(values[0], i, *x[:3], round(x[3], 4)) for i, x in enumerate(found)]
    return _apply(bookmarks, ("row_id", "text"), model, make, "row_id bigint, passage_no int, lang string, first_word int, last_word int, confidence double", (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()))


def unlabelled_languages(bookmarks: DataFrame, samples: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(row_id, lang): languages with a passage in the text that the row's label does not name."""
    model = model or fit(samples, bookmarks)
    make = lambda values, found: [(values[0], x) for x in dict.fromkeys(f[0] for f in found) if x != label_language(values[1])]
    return _apply(bookmarks, ("row_id", "lang", "text"), model, make, "row_id bigint, lang string", (pa.int64(), pa.string()))
