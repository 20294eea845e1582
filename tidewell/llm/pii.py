"""Personal items in free text: found, typed, and replaced by placeholders.

1. Spans are proposed loosely: everything written like an address of mail, every group of seven digits or more (as one
   that may be a phone number or an identity number), every code of letters and digits, every number beside capitalised or street words,
   every two or three capitalised words, and every word the gazetteer knows as part of a person's name. Most proposals are
   no items (products, versions, dates, post numbers, the first words of a sentence).
2. Labelers vote for a kind, against all, or abstain: formats, the gazetteer of name parts (taken from the account names of the
   corpus), street words, label words before it, what follows it, and shapes of other numbers. They may contradict each other.
3. The vote patterns of all proposals of all rows are counted, and expectation-maximisation over these counts estimates
   how reliable each labeler is and how probable each pattern makes an item.
4. A span classifier (logistic regression over votes, shape and hashed context words) is trained on these probabilities
   and decides about every proposal, so context that no labeler names counts too.

Bounds: ``FIT_TEXTS`` texts with proposals fit the classifier (their hashed features only come to the driver). The
gazetteer is shipped to the tasks if it has at most ``MAX_SHIPPED_PARTS`` parts; a larger one is joined to the words of
the texts, so no part is dropped. The votes are counted over all rows; proposing is one narrow stage, written once.

Defined results: null and blank texts hold no items; an item that occurs twice in a text is one case; overlapping
proposals are settled for the longer of one kind, the more exact kind first; rows are judged independently, whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.sample import hash_sample
from tidewell.session import cut, spread

KINDS = ("email", "phone", "id_number", "address", "name")
FIT_TEXTS = 10_000
MAX_SHIPPED_PARTS = 50_000
#: Different partners a name part needs: a brand has one, a first or last name has several.
MIN_PARTNERS = 2
FEATURES = 1 << 12
EM_ROUNDS, TRAIN_ROUNDS = 25, 60

# ---------------------------------------------------------------- shapes that propose

_LOCAL, _LABEL = r"(?<![\w.+/@-])[A-Za-z0-9](?:[\w.+-]*\w)?", r"[A-Za-z0-9-]+"
_DOT = r"(?:\.|\s?[\[(]\s?[Dd][Oo][Tt]\s?[\])]\s?|\sDOT\s)"
_EMAIL = re.compile(rf"{_LOCAL}(?:@|\s?[\[(]\s?[Aa][Tt]\s?[\])]\s?|\sAT\s){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![\w@+])")
_EMAIL_WORDS = re.compile(rf"{_LOCAL}\sat\s{_LABEL}(?:\s?(?:\.|dot)\s?{_LABEL})*\sdot\s[A-Za-z]{{2,24}}(?![\w@+])")
_DIGITS = re.compile(r"(?<![\w.,/#@:(-])[+(]?\d(?:[\d().]|[\s\-/]{1,3}(?=[\d(]))*\d(?![\w@])")
_SPELLED = re.compile(r"[\[(]\s?[Aa][Tt]\s?[\])]|\sAT\s")
_ANY_DIGIT = re.compile(r"\d")
_SEVEN = re.compile(r"\d[\d\s().\-/]{5,}\d")
_CODED = re.compile(r"(?<![\w/#@.-])(?=[\w-]*\d)(?=[\w-]*[A-Za-z])[A-Za-z\d]+(?:-[A-Za-z\d]+){0,2}(?![\w@-])")
_CODE_DIGITS = re.compile(r"\d{6}|\d{2}[A-Za-z]\d{2}")
_PART = r"[^\W\d_][\w'’\-]*"
_NEXT = r"[\w'’\-]*"
_STREET_EN = r"(?:street|str?|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|way|boulevard|blvd|square|sq|terrace|ter|place|pl|close|crescent|parkway|pkwy|highway|hwy)"
_STREET_FR = r"(?:rue|avenue|av|boulevard|bd|boul|impasse|all[ée]e|chemin|place|pl|quai|cours|passage|square|route)\.?"
_STREET_ES = r"(?:calle|c/|avenida|avda|av|plaza|pza|paseo|camino|carrera|ronda|travesía|via|viale|piazza|corso|rua|praça|largo|travessa)\.?"
_STREET_DE = r"(?:straße|strasse|str\.|weg|gasse|allee|platz|damm|ufer|ring|hain|steig|hof|markt|laan|straat|plein|gracht)"
_END = r"\d{1,5}[A-Za-z]?(?!\w|[.,:/-]\d)"
_HOUSE = re.compile(r"(?<![\w.,/:-])\d{1,5}[A-Za-z]?(?!\w|[.,:/-]\d)")
_NUMBER_FIRST = tuple(
    re.compile(p, re.I)
    for p in (
        rf"\d{{1,5}}[A-Za-z]?\s+(?:{_PART}\s+){{1,3}}{_STREET_EN}(?!\w)",
        rf"\d{{1,5}}\s?(?:[a-d]|bis|ter)?,?\s+{_STREET_FR}\s+(?:(?:de\s+la|de\s+l['’]|des|du|de|d['’])\s*)?{_PART}(?:[\s-](?-i:[A-ZÀ-Þ]){_NEXT}){{0,2}}",
    )
)
_NUMBER_LAST = tuple(
    re.compile(p, re.I)
    for p in (
        rf"(?<![\w/-]){_STREET_ES}\s*(?:(?:de\s+las|de\s+los|de\s+la|del|de|da|do|dos|das|della|dei)\s+)?{_PART}(?:\s(?!en\b|el\b|desde\b){_PART}){{0,2}},?\s+(?:n[º°.]\s?)?{_END}",
        rf"(?<![\w/-])(?:(?:an der|auf der|im|alte|neue|alter|obere|untere|kleine|große)\s+)?{_PART}{_STREET_DE}\s+{_END}",
        rf"(?<![\w/-])(?:am|im|an der|auf der|zum|zur)\s(?-i:[A-ZÄÖÜ]){_NEXT}\s+{_END}",
    )
)
_WORDS_THEN_NUMBER = re.compile(rf"(?<![\w@#/.'’-])(?:[A-ZÀ-Þ]{_NEXT}\s){{1,2}}{_END}")
_NUMBER_THEN_WORDS = re.compile(rf"(?<![\w.,/:-])\d{{1,5}}[A-Za-z]?,?\s[A-ZÀ-Þ]{_NEXT}(?:\s[A-ZÀ-Þ]{_NEXT}){{0,2}}")
_CAP = r"(?:[A-ZÀ-Þ][a-zà-ÿ]+(?:['’-][A-ZÀ-Þ][a-zà-ÿ]+)*|[A-ZÀ-Þ]{3,}(?:['’-][A-ZÀ-Þ]+)*)"
_NAME_FORM = rf"(?:{_CAP}(?:\s+(?:[A-ZÀ-Þ]\.\s+)?(?:(?:de|van|von|der|da|del|di|le|la)\s+)?{_CAP}){{1,2}}|[A-ZÀ-Þ]\.\s{_CAP}|{_CAP},\s{_CAP})(?![\w@/])"
_NAMES = re.compile(rf"(?<![\w@#/.'’-])(?=({_NAME_FORM}))")
_PERSON_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")

# ---------------------------------------------------------------- labelers

#: Titles before names, in the languages of the posts.
TITLES = frozenset("dr prof mr mrs ms miss mx sir herr frau hr fr sr sra srta dta don doña mme mlle m ing dott".split())
#: Label words of phone and identity numbers, prepositions and nouns of persons and places, labels and units of other numbers.
_PHONE_BEFORE = re.compile(r"(?:\b(?:call|ring|text|phone|cell|mobile|tel|telephone|number|voicemail|hotline|fax|whatsapp|sms|dial|ruf\w*|\w*nummer|telefon\w*|handy|appelle[rz]?|numéro|portable|téléphone\w*|llám\w+|llama\w*|teléfono|móvil|guardia|astreinte|telefone|chiama\w*)|📞|☎|📱)\W*(?:\w+\W+){0,3}$", re.I)
_ID_BEFORE = re.compile(r"(?:\bids?\b|identity|security|insurance|passport|passeport|pasaporte|reisepass|\bpass\b|tax|licen[cs]e|ssn|nif|dni|nie|bsn|cpf|identi\w+|identidad|identité|ausweis\w*|steuer\w*|seguro|fiscal|social|national)\W*(?:\w+\W+){0,4}$", re.I)
_PLACE_BEFORE = re.compile(r"(?:\bat|\bto|\bin|\bnear|\boffice|\baddress|\bau|\ben|\bà|\bbureau|\badresse|\boficina|\bdirección|\bbüro|\bist|\bwohnt|\bgegend)\W*(?:\w+\W+){0,2}$", re.I)
_PERSON_BEFORE = re.compile(r"(?:\b(?:by|to|with|from|for|ask|dear|hi|hello|thanks?|thank you|signed|contact|neighbou?r|colleague|friend|à|an|von|mit|de|a|con|avec|par|por|aan|van|grazie|merci|danke|gracias|señora?|herr|frau)|\b(?:mrs?|ms|dr|prof|mme|sra?|hr|fr)\.?|[:–—])[\s,:]*$", re.I)
_PERSON_AFTER = re.compile(r"^\W{0,2}(?:wrote|said|says|asked|asks|told|tells|replied|thinks|joined|and I|schrieb|sagte|sagt|écrit|a dit|escribió|dijo)\b", re.I)
_NO_PERSON_AFTER = re.compile(r"^(?:\s\d|\s(?:Beta|Alpha|Pro|Inc|Ltd|GmbH|API|SDK|App|Version)\b)")
_OTHER_LABEL = re.compile(r"(?:build|versi[oó]n|release|commit|ticket|issue|pages?|post|room|step|chunk|port|line|frame|order|invoice|sku|v|=|\$|€|£|#)\s*$", re.I)
_UNIT_AFTER = re.compile(r"^\s*(?:tokens?|minutes|seconds|hours|days|percent|%|views?|pages?|ms\b|files|lines|rows|px|kb|mb|gb|of\b|at \d)", re.I)
_OTHER_NUMBER = re.compile(r"(?:(?:19|20)\d\d[.\-/ ]\d{1,2}(?:[.\-/ ]\d{1,2}){0,2}|\d{16,}|\d{1,4}(?:\.\d{1,3}){4,}|(?=[a-f\d]*[a-f])[a-f\d]{7,40})$")
#: Function words that start sentences before a noun, in languages that write nouns or sentences with capitals.
_DETERMINERS = frozenset("the a an our their this that these those its his her my your every each any der die das ein eine unser unsere mein meine dieser diese dieses kein keine jeder le la les un une notre nos mon ma ce cette el los las una nuestro mi este esta".split())
_PHONE_SHAPES = tuple(re.compile(p + r"$") for p in (
    r"\(0\d{2,4}\)\s?\d{5,8}",
    r"(?:\+|00)\d[\d\s().\-/]{6,18}\d", r"\(?\d{3}\)?[\s.\-]?\d{3}[.\-\s]\d{4}", r"\(\d{3,4}\)\s?\d{3}[\s.\-]?\d{4}", r"\d{3}[\s.\-]\d{4}", r"0\d{4}[\s-]?\d{3}[\s-]?\d{3}", r"0\d{4}\s\d{6}",
    r"0\d(?:[\s.\-]\d{2}){4}", r"0\d{2,4}\s?/\s?\d{4,6}(?:-\d{1,4})?", r"[679]\d{2}(?:[\s.\-]\d{3}){2}", r"0\d{9,10}",
))
_ID_SHAPES = tuple(re.compile(p + r"$") for p in (r"\d{3}-\d{2}-\d{4}", r"\d{3} \d{2} \d{4}", r"\d{9}", r"\d{3}\.\d{3}\.\d{3}-\d{2}", r"[A-Za-z]-?\d{6,9}", r"[A-Za-z]\d{2}[A-Za-z]\d{2}[A-Za-z]\d{2,3}", r"\d{8}-?[A-Za-z]"))
#: Street words and endings, searched for before any street pattern is tried (in lower case).
STREETS = (
    "street", "road", "avenue", "lane", "drive", "court", "boulevard", "square", "terrace", "close", "crescent", "parkway", "highway", " st", " rd", " ave", " ln", " dr", " ct", " way", " blvd", " sq", " ter", " pl", " pkwy", " hwy",
    "rue", "av", "bd", "boul", "impasse", "allée", "allee", "chemin", "place", "quai", "cours", "passage", "route", "calle", "c/", "plaza", "pza", "paseo", "camino", "carrera", "ronda", "travesía", "via", "piazza", "corso", "rua", "praça", "largo", "travessa",
    "straße", "strasse", "str.", "weg", "gasse", "platz", "damm", "ufer", "ring", "hain", "steig", "hof", "markt", "laan", "straat", "plein", "gracht", "am ", "im ", "an der ", "auf der ", "zum ", "zur ",
)
#: What a text needs for each pattern of streets before numbers.
_LAST_SIGNS = (
    ("calle", "c/", "avenida", "avda", "av", "plaza", "pza", "paseo", "camino", "carrera", "ronda", "travesía", "via", "viale", "piazza", "corso", "rua", "praça", "largo", "travessa"),
    ("straße", "strasse", "str.", "weg", "gasse", "allee", "platz", "damm", "ufer", "ring", "hain", "steig", "hof", "markt", "laan", "straat", "plein", "gracht"),
    ("am", "im", "an der", "auf der", "zum", "zur"),
)
_streets = ahocorasick.Automaton()
for _s in STREETS:
    _streets.add_word(_s, _s)
_streets.make_automaton()


#: What a proposal may be, by how it was found; every family may also be none of it.
FAMILIES = {"email": ("email",), "number": ("phone", "id_number"), "address": ("address",), "name": ("name",)}
NONE, ABSTAIN = "none", "-"
#: Labelers that look at the span itself; EM starts with twice the trust in them, and finds its own.
OF_THE_SPAN = ("sign", "format", "street", "gazetteer")
CLASSES = (*KINDS, NONE)


@dataclass
class Candidate:
    start: int
    end: int
    family: str
    text: str
    kind: str = NONE
    votes: dict[str, str] = field(default_factory=dict)
    extra: list[str] = field(default_factory=list)

    @property
    def pattern(self) -> str:
        return ",".join(f"{k}={v}" for k, v in sorted(self.votes.items()))


class Gazetteer:
    """First and last name parts; of all texts (found by an Aho-Corasick automaton), or of one text."""

    def __init__(self, firsts: set[str], lasts: set[str], search: bool = True):
        self.firsts, self.lasts = firsts, lasts
        parts = {p for p in firsts | lasts if len(p) > 2}
        self.machine = None
        if search and parts:
            self.machine = ahocorasick.Automaton()
            for part in parts:
                self.machine.add_word(part, part)
            self.machine.make_automaton()
        self.any = bool(parts)

    def role(self, word: str) -> str:
        w = word.lower()
        return ("F" if w in self.firsts else "") + ("L" if w in self.lasts else "")

    def touches(self, low: str) -> bool:
        return self.any if self.machine is None else next(self.machine.iter(low), None) is not None


def _inside_token(text: str, start: int, end: int) -> bool:
    """Part of a link, a handle, a tag or an address."""
    left = text[max(0, start - 1) : start]
    right = text[end : end + 1]
    if left in ("@", "#", "/", "_", ".", "+", "=", "-") and left or right in ("@", "_", "/", "+"):
        return True
    return right == "." and text[end + 1 : end + 2].isalnum() or right == "-" and text[end + 1 : end + 2].isalnum()


def _known_names(text: str, names: Gazetteer) -> list[tuple[int, int]]:
    """Spans of a known first and last part in one of the written orders, and of one known part behind a title."""
    words = [(m.start(), m.end(), m.group()) for m in _PERSON_WORD.finditer(text)]
    out, i = [], 0
    while i < len(words):
        start, end, word = words[i]
        bare = word.rstrip(".")
        role = names.role(bare)
        nxt = words[i + 1] if i + 1 < len(words) else None
        part = nxt[2].rstrip(".") if nxt else ""
        gap = text[end : nxt[0]] if nxt else ""
        found = None
        if len(bare) == 1 and word.endswith(".") and gap == " " and "L" in names.role(part):
            found = (start, nxt[0] + len(part), 2)
        elif role and not word.endswith(".") and gap == " ":
            third = words[i + 2] if i + 2 < len(words) else None
            if "F" in role and "L" in names.role(part) or (bool(names.role(part)) and bare.islower() and part.islower()):
                found = (start, nxt[0] + len(part), 2)
            elif "F" in role and len(part) == 1 and nxt[2].endswith(".") and third and text[nxt[1] : third[0]] == " " and "L" in names.role(third[2].rstrip(".")):
                found = (start, third[0] + len(third[2].rstrip(".")), 3)
        elif "L" in role and not word.endswith(".") and gap == ", " and "F" in names.role(part):
            found = (start, nxt[0] + len(part), 2)
        if found is None and role and i and words[i - 1][2].rstrip(".").lower() in TITLES:
            found = (start, start + len(bare), 1)
        if found is None and i and bare.islower() and (role or names.role(part)) and gap == " " and len(part) > 2 and part.islower():
            found = (start, nxt[0] + len(part), 0)  # small letters, one known part
        if found and not text[found[1] : found[1] + 1].isalnum():
            out.append(found[:2])
        i += found[2] if found and found[2] else 1
    return out


def _vote(c: Candidate, text: str, names: Gazetteer) -> None:
    before, after = text[max(0, c.start - 48) : c.start], text[c.end : c.end + 24]
    value = c.text
    pick = lambda *cases: next((v for met, v in cases if met), ABSTAIN)
    if c.family == "email":
        c.votes = {
            "sign": pick(("@" in value or _SPELLED.search(value), "email")),
            "link": pick(("://" in before[-12:] or value[:4] == "http", NONE)),
            "twice": pick(("@" not in value and "@" in text[c.end : c.end + 40].split(" ")[0], NONE)),
        }
    elif c.family == "number":
        phone, number = any(p.match(value) for p in _PHONE_SHAPES), any(p.match(value) for p in _ID_SHAPES)
        by_phone, by_id = _PHONE_BEFORE.search(before), _ID_BEFORE.search(before)
        c.votes = {
            "format": pick((phone and number, ABSTAIN), (phone, "phone"), (number, "id_number"), (True, NONE)),
            "label": pick((by_phone and by_id, ABSTAIN), (by_phone, "phone"), (by_id, "id_number")),
            "other": pick((_OTHER_NUMBER.match(value), NONE)),
            "against": pick((_UNIT_AFTER.match(after) or _OTHER_LABEL.search(before), NONE)),
        }
    elif c.family == "address":
        c.votes = {
            "street": pick((any(p.fullmatch(value) for p in (*_NUMBER_FIRST, *_NUMBER_LAST)), "address"), (True, NONE)),
            "capitals": pick((any(w[0].isupper() for w in re.findall(_PART, value)) or value.islower() and text.islower(), ABSTAIN), (True, NONE)),
            "place": pick((_PLACE_BEFORE.search(before), "address")),
            "against": pick((_OTHER_LABEL.search(before) or _UNIT_AFTER.match(after), NONE)),
        }
    else:
        words = [w.strip(".,") for w in value.split()]
        known = [bool(names.role(w)) for w in words]
        ends = (known[0] or len(words[0]) == 1) and known[-1]
        c.votes = {
            "gazetteer": pick((ends, "name"), (not any(known), NONE)),
            "person": pick((_PERSON_BEFORE.search(before), "name")),
            "after": pick((_PERSON_AFTER.match(after), "name"), (_NO_PERSON_AFTER.match(after), NONE)),
            "determiner": pick((any(w.lower() in _DETERMINERS for w in words), NONE)),
            "capitals": pick((all(w[:1].isupper() for w in words), ABSTAIN), (True, NONE)),
        }
    left = re.findall(r"\w+", before.lower())[-2:]
    right = re.findall(r"\w+", after.lower())[:1]
    shape = re.sub(r"\d", "9", re.sub(r"[^\W\d_]+", lambda m: "A" if m.group().isupper() else "a" if m.group().islower() else "Aa", value))[:20]
    c.extra = [f"{c.family}|s|{shape}", *(f"{c.family}|l|{w}" for w in left), *(f"{c.family}|r|{w}" for w in right)]


def candidates(text: str, names: Gazetteer) -> list[Candidate]:
    """All proposed spans with the votes of the labelers."""
    spans: dict[tuple[int, int, str], None] = {}
    low = text.lower()
    add = lambda start, end, family: spans.setdefault((start, end, family))
    if "@" in text or " AT " in text or "(at)" in low or "[at]" in low:
        for m in _EMAIL.finditer(text):
            add(*m.span(), "email")
    if " at " in low and " dot " in low:
        for m in _EMAIL_WORDS.finditer(text):
            add(*m.span(), "email")
    if _ANY_DIGIT.search(text):
        if _CODE_DIGITS.search(text):
            for m in _CODED.finditer(text):
                if _CODE_DIGITS.search(m.group()) and not m.group().isdigit():
                    add(*m.span(), "number")
        if _SEVEN.search(text):
            for m in _DIGITS.finditer(text):
                value = m.group()
                if sum(ch.isdigit() for ch in value) >= 7:
                    add(*m.span(), "number")
        typed = next(_streets.iter(low), None) is not None
        if typed:
            for p, sign in zip(_NUMBER_LAST, _LAST_SIGNS):
                if any(s in low for s in sign):
                    for m in p.finditer(text):
                        add(*m.span(), "address")
        for house in _HOUSE.finditer(text) if typed else ():
            for p in _NUMBER_FIRST:
                m = p.match(text, house.start())
                if m:
                    add(*m.span(), "address")
        for p in (_WORDS_THEN_NUMBER, _NUMBER_THEN_WORDS):
            for m in p.finditer(text):
                add(*m.span(), "address")
    for m in _NAMES.finditer(text):
        if not _inside_token(text, *m.span(1)):
            add(*m.span(1), "name")
    if names.touches(low):
        for start, end in _known_names(text, names):
            if not _inside_token(text, start, end):
                add(start, end, "name")
    out = [Candidate(start, end, family, text[start:end]) for start, end, family in spans]
    for c in out:
        _vote(c, text, names)
    return out


# ---------------------------------------------------------------- model


def fit_reliabilities(patterns: dict[tuple[str, str], int]) -> tuple[dict, dict[tuple[str, str], dict[str, float]]]:
    """EM over counted (family, vote pattern): P(vote | class) of every labeler, and the class probabilities of every pattern."""
    read = {p: [v.split("=") for v in p[1].split(",")] for p in patterns}
    belief: dict[tuple[str, str], dict[str, float]] = {}
    for p, votes in read.items():
        scores = {k: math.exp(1.5 * sum((2 if name in OF_THE_SPAN else 1) * (v == k) for name, v in votes)) for k in (*FAMILIES[p[0]], NONE)}
        belief[p] = {k: x / sum(scores.values()) for k, x in scores.items()}
    table: dict = {}
    for _ in range(EM_ROUNDS):
        table, prior = {}, {}
        for p, n in patterns.items():
            classes = belief[p]
            for k, own in classes.items():
                prior[p[0], k] = prior.get((p[0], k), 1.0) + n * own
            for name, vote in read[p]:
                cell = table.setdefault((p[0], name), {k: {v: 0.5 + (v == k) for v in (*classes, ABSTAIN)} for k in classes})
                for k, own in classes.items():
                    cell[k][vote] += n * own
        for p, votes in read.items():
            scores = {}
            for k in belief[p]:
                scores[k] = math.log(prior[p[0], k]) + sum(math.log(table[p[0], name][k][vote] / sum(table[p[0], name][k].values())) for name, vote in votes)
            top = max(scores.values())
            weights = {k: math.exp(max(-40.0, s - top)) for k, s in scores.items()}
            belief[p] = {k: w / sum(weights.values()) for k, w in weights.items()}
    return table, belief


def features(c: Candidate) -> list[int]:
    named = {f"{c.family}|b", f"{c.family}|p|{c.pattern}", *(f"{c.family}|v|{k}|{v}" for k, v in c.votes.items()), *c.extra}
    return sorted({zlib.crc32(f.encode("utf-8", "replace")) % FEATURES for f in named})


def train_classifier(lists: list[list[int]], belief: list[dict[str, float]]) -> np.ndarray:
    """Softmax regression on the EM probabilities (full-batch AdaGrad over sparse features, L2-regularised)."""
    weights = np.zeros((FEATURES, len(CLASSES)))
    if not lists:
        return weights
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    columns = np.fromiter((i for x in lists for i in x), np.int64, len(rows))
    target = np.array([[b.get(k, 0.0) for k in CLASSES] for b in belief])
    squares = np.full_like(weights, 1e-6)
    by_column = np.argsort(columns, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(columns[by_column]) > 0])
    used, begins = columns[by_column][first], np.flatnonzero(np.r_[True, np.diff(rows) > 0])
    for _ in range(TRAIN_ROUNDS):
        score = np.add.reduceat(weights[columns], begins, axis=0)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        error = score / score.sum(axis=1, keepdims=True) - target
        gradient = 0.02 * weights
        gradient[used] += np.add.reduceat(error[rows[by_column]], first, axis=0)
        squares += gradient**2
        weights -= 0.8 * gradient / np.sqrt(squares)
    return weights


def settle(found: list[tuple[float, Candidate]]) -> list[Candidate]:
    """Items above one half, without overlaps, in order of place: mail and phone first, names last, then the more probable (to a tenth), the longer, the earlier."""
    kept: list[Candidate] = []
    rank = {k: i for i, k in enumerate(KINDS)}
    for _, c in sorted(((p, c) for p, c in found if p >= 0.5 and c.kind != NONE), key=lambda x: (rank[x[1].kind] > 1, x[1].kind == "name", -round(x[0], 1), -(x[1].end - x[1].start), x[1].start)):
        if all(c.end <= k.start or c.start >= k.end for k in kept):
            kept.append(c)
    return sorted(kept, key=lambda c: c.start)


@dataclass
class Model:
    weights: np.ndarray
    reliabilities: dict
    beliefs: dict[tuple[str, str], dict[str, float]] = field(default_factory=dict)

    def decide(self, c: Candidate, own: list[int]) -> tuple[float, Candidate]:
        """The probability of the likeliest class of the family, which becomes the kind."""
        score = self.weights[own].sum(axis=0)
        score = np.exp(score - score.max())
        every = dict(zip(CLASSES, (score / score.sum()).tolist()))
        c.kind = max((*FAMILIES[c.family], NONE), key=every.__getitem__)
        return every[c.kind], c

    def settled(self, found: list[dict]) -> list[Candidate]:
        """Items among the written proposals of a text."""
        return settle([self.decide(Candidate(c["s"], c["e"], c["family"], c["text"]), c["f"]) for c in found])

    def items(self, text: str | None, names: Gazetteer) -> list[Candidate]:
        if not text or text.isspace():
            return []
        return settle([self.decide(c, features(c)) for c in candidates(text, names)])


# ---------------------------------------------------------------- distributed


def name_parts(bookmarks: DataFrame) -> DataFrame:
    """(role, part): first and last parts of account names of two to four words that occur with ``MIN_PARTNERS`` partners."""
    clean = F.trim(F.regexp_replace(F.col("author.name"), r"[^\p{L}\p{M}'’\- ]", ""))
    words = bookmarks.select(F.lower(clean).alias("name")).distinct().select(F.split("name", r"\s+").alias("p")).where("size(p) between 2 and 4")
    ends = words.select(F.col("p")[0].alias("first"), F.element_at("p", -1).alias("last")).where("length(first) > 1 and length(last) > 1").distinct()
    sides = ends.select(F.explode(F.array(F.struct(F.lit("F").alias("role"), F.col("first").alias("part")), F.struct(F.lit("L").alias("role"), F.col("last").alias("part")))).alias("x"))
    return sides.groupBy("x.role", "x.part").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PARTNERS).select("role", "part")


_SALTS = 32


def with_own_parts(posts: DataFrame, parts: DataFrame) -> DataFrame:
    """``posts`` (row_id, text) with the name parts that occur in each text: a join for gazetteers too large to ship.

    Words are joined once per distinct text, salted, since a frequent word may be a name part; parts are few beside words.
    """
    words = posts.where("text is not null").select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"])
    words = words.select("h", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}'’\-]+"))).alias("part"), F.pmod("h", F.lit(_SALTS)).alias("salt"))
    spread = parts.select("role", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint"))).alias("salt"))
    own = words.join(spread, ["part", "salt"]).groupBy("h").agg(F.collect_set(F.concat("role", "part")).alias("own_parts"))  # as many as words of a text
    return posts.withColumn("h", F.xxhash64("text")).join(own, "h", "left").select("row_id", "text", "own_parts")


def with_gazetteer(bookmarks: DataFrame, most: int = MAX_SHIPPED_PARTS) -> tuple[DataFrame, object]:
    """The posts, and the gazetteer to ship, or None where each row brings its own parts."""
    posts = bookmarks.select("row_id", "text")
    parts = name_parts(bookmarks)
    known = parts.limit(most + 1).collect()
    if len(known) > most:
        return with_own_parts(posts, cut(parts, "parts")), None
    sets = tuple({r["part"] for r in known if r["role"] == role} for role in "FL")
    return spread(posts).withColumn("own_parts", F.lit(None).cast("array<string>")), bookmarks.sparkSession.sparkContext.broadcast(sets)


def _gazetteers(shipped):
    """A function from a row's own parts to the gazetteer to use."""
    if shipped is not None:
        every = Gazetteer(*shipped.value)
        return lambda own: every
    return lambda own: Gazetteer({p[1:] for p in own or () if p[0] == "F"}, {p[1:] for p in own or () if p[0] == "L"}, search=False)


_PROPOSED = "row_id bigint, c array<struct<s:int,e:int,family:string,text:string,votes:string,f:array<int>>>"
_C = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("family", pa.string()), ("text", pa.string()), ("votes", pa.string()), ("f", pa.list_(pa.int32()))]))


def propose(posts: DataFrame, shipped, texts: bool = False) -> DataFrame:
    """(row_id, c): the proposals of every text that has any; written once, read for the counts, the fit and the decision.

    With ``texts`` all rows are written, with their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = _gazetteers(shipped)
        for batch in batches:
            ids, found, kept = [], [], []
            for row_id, text, own in zip(*(c.to_pylist() for c in batch.columns)):
                got = candidates(text, pick(own)) if text and not text.isspace() else []
                if got or texts:
                    ids.append(row_id)
                    kept.append(text)
                    found.append([{"s": c.start, "e": c.end, "family": c.family, "text": c.text, "votes": c.pattern, "f": features(c)} for c in got])
            arrays = [pa.array(ids, pa.int64()), pa.array(found, _C), *([pa.array(kept, pa.string())] if texts else [])]
            yield pa.RecordBatch.from_arrays(arrays, ["row_id", "c", *(["body"] if texts else [])])

    schema = _PROPOSED + (", body string" if texts else "")
    return cut(posts.select("row_id", "text", "own_parts").mapInArrow(run, schema), "proposals")


def fit_proposals(proposed: DataFrame) -> Model:
    """Reliabilities from the vote patterns of all rows; the classifier from the features of about ``FIT_TEXTS`` texts."""
    each = proposed.select("row_id", F.explode("c").alias("c"))
    patterns = {(r["family"], r["votes"]): r["count"] for r in each.groupBy("c.family", "c.votes").count().collect()}  # at most families x 3^5
    table, belief = fit_reliabilities(patterns)
    sample = hash_sample(proposed.where("size(c) > 0").select("row_id", "c"), "row_id", FIT_TEXTS).select("row_id", F.explode("c").alias("c")).select("row_id", "c.s", "c.e", "c.family", "c.votes", "c.f").collect()
    sample.sort(key=lambda r: (r["row_id"] is None, r["row_id"] or 0, r["s"], r["e"], r["family"]))
    return Model(train_classifier([r["f"] for r in sample], [belief[(r["family"], r["votes"])] for r in sample]), table, belief)


def find_items(bookmarks: DataFrame) -> DataFrame:
    """(row_id, kind, pii_text), each item of a text once."""
    proposed = propose(*with_gazetteer(bookmarks))
    model = bookmarks.sparkSession.sparkContext.broadcast(fit_proposals(proposed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        for batch in batches:
            rows = []
            for row_id, found in zip(*(c.to_pylist() for c in batch.columns)):
                kept = fitted.settled(found)
                rows += [(row_id, *x) for x in dict.fromkeys((c.kind, c.text) for c in kept)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["row_id", "kind", "pii_text"])

    return proposed.mapInArrow(run, "row_id bigint, kind string, pii_text string")


def redact(text: str | None, items: list[Candidate]) -> str | None:
    """The text with every item replaced by a placeholder of its kind, the rest unchanged."""
    if not text or not items:
        return text
    out, at = [], 0
    for c in items:
        out += [text[at : c.start], f"[{c.kind.upper()}]"]
        at = c.end
    return "".join([*out, text[at:]])


def redact_texts(bookmarks: DataFrame) -> DataFrame:
    """(row_id, text) of all rows, items replaced; null texts stay null."""
    proposed = propose(*with_gazetteer(bookmarks), texts=True)
    model = bookmarks.sparkSession.sparkContext.broadcast(fit_proposals(proposed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        for batch in batches:
            ids, found, texts = (c.to_pylist() for c in batch.columns)
            clean = [redact(t, fitted.settled(c)) if c else t for t, c in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(clean, pa.string())], ["row_id", "text"])

    return proposed.select("row_id", "c", "body").mapInArrow(run, "row_id bigint, text string")
