"""Personal information in free text: found, typed and replaced by placeholders.

Generators with high recall propose overlapping spans: mail addresses, runs of digits with signs and letters, runs of
capitalised words, and capitalised words with a house number; no list of words decides what is proposed. Boosted trees, one
for each type, judge each span by its format and its context; spans over the calibrated threshold are redacted, the surest
first, none overlapping another. A name has up to ``NAME_WORDS`` words besides particles and titles, a street up to ``STREET_WORDS``.

The trees are fitted here, on a bounded sample of labelled form fields (``SAMPLE`` rows by hash): fields whose label names a
kind of personal data are examples of it, fields of other labels are counter-examples. Half of the examples are seen with
their label as context and half without, so format and context are both learned; all rows of an example are on one side of
the hold-out. Addresses in running text have counter-examples from a bounded sample of free text (``SAMPLE_FREE`` fields): a number
beside capitalised words without any sign of an address, be it a kind of street, a cue or a postcode. The labelled fields also give the lexicon (words of names, of addresses and of companies) and the frequencies of
the shapes of numbers; in fitting, an example's own words do not count for it, so words never seen before are judged as words
seen once were. Labels are used for fitting only; later every text is judged alike, whatever its size.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.boosting import Boosted

SAMPLE, SAMPLE_FREE = 12_000, 2_000
NAME_WORDS, STREET_WORDS = 7, 9
TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# Words in labels, or before a span, that speak for or against a type; in several languages, lower case.
CUES = {
    "email": "email e-mail mail courriel correo correio posta elektronische",
    "phone": "phone mobile tel tél telefon telefono teléfono telefone telephone cell fax call appeler llame chiamare ligar handy mobil rufen anrufen telefonisch rappeler numéro móvil cellulare",
    "id_number": "ssn social sécurité security national identity identité identidad identidade identità id passport passeport pasaporte passaporto passaporte ausweis ausweisnummer ausweis-nr personalausweis reisepass sozialversicherungsnummer sociale social seguridad segurança sicurezza carta documento dni nif nie cpf fiscale pièce паспорт",
    "address": "address home adresse anschrift domicilio indirizzo endereço morada wohnhaft residente résidant demeurant domicile residing lives residence mora vive adresse",
    "name": "name nom nombre nome nachname vorname signed signature unterschrift unterschrieben applicant witness contact assinado firmado firmato signé by por von par da mr mrs ms dr prof herr frau señor señora monsieur madame antragsteller kontakt ansprechpartner ansprechpartnerin protokoll selon laut según secondo segundo according letter left sent taken suivi persona responsável referente",
    "goods": "part parts serial serie teil teilenummer teilenr artikel pieza peça pezzo pièce ref réf ref. cod code item no. order invoice rechnung factura facture fattura fatura commande bestellung version model modell case ticket measured gemessen quantity total period date reference handle company société firma empresa department lot batch kisten boxes eur usd",
}
# Words and endings of street names, forms of companies, particles and titles of names.
STREET = "street st avenue ave road rd lane ln drive court ct square terrace way close crescent boulevard blvd place row walk rue chemin allée avenue impasse quai calle plaza avenida paseo camino carrer via viale piazza corso vicolo largo rua travessa praça alameda estrada platz straße strasse weg gasse allee ufer damm graben steig".split()
STREET_END = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "graben", "ufer", "damm", "ring", "steig")
COMPANY = "ltd limited gmbh ag kg inc llc plc corp co sa sarl srl spa bv nv holdings holding werke mills sons freight transports transport spedition trading group société firma company works industries logistics brothers bros & e.k. ohg".split()
PARTICLES = "van de la von der den del della di du dos da le el ter y e".split()
TITLES = "mr mrs ms dr prof herr frau sir madame m mme sr sra sig dott".split()
# Labels of form fields by the type of their values; other labels with values are counter-examples.
LABELS = {
    "email": "e-mail|email|email address|courriel|mail|correo|e-mail-adresse", "phone": "phone|mobile|telefon|tél.|tel|tel.|telephone|fax|teléfono|telefono|telefone",
    "id_number": "ssn|national id|passport no.|ausweis-nr.|passport|identity no.|social security number", "address": "home address|address|anschrift|domicilio|adresse|indirizzo|endereço|street",
    "name": "name|full name|nom|signed by|nachname, vorname|applicant|signature|unterschrift|witness",
}
OPEN_LABELS = "contact|remarks|notes|comments|bemerkungen|description"

_CUE_WORDS = {k: frozenset(v.split()) for k, v in CUES.items()}
_ADDRESS_CUES = _CUE_WORDS["address"] | frozenset("in at a em na no en go to is à".split())
_STREETS = frozenset(STREET)

_EMAIL = re.compile(r"[\w.+\-|]+(?:@|\s?[(\[]\s?(?:at|arroba)\s?[)\]]\s?)[\w\-|]+(?:(?:\.|\s?[(\[]\s?(?:dot|punkt)\s?[)\]]\s?)[\w\-|]+)+", re.IGNORECASE)
_NUMBER = re.compile(r"(?<![\w.@])(?:[A-Z]{1,3}[ \-]?)?[+(]?\d(?:[\s().\-/]{0,2}\d){4,15}(?:[ \-]?[A-Z](?![\w]))?(?![\w@])")
_OTHER_BLANK = re.compile(r"[^\S ]")
_PARTS = re.compile(r"\S+")
_CORE = re.compile(r"\d(?:[\s().\-/]{0,2}\d){4}")
_HOUSE = re.compile(r"\d{1,5}(?:[\-–/]\d{1,3})?[a-zA-Z]?[,.:;)]*\Z")
_SPELT = re.compile(r"\(at\)|\[at\]|\[dot\]", re.IGNORECASE)
_GROUPS = re.compile(r"(?<![\w@])(?:[A-Z]{1,2}\s?(?:\d\s?){6,9}[A-Z]?|\d{8}-[A-Z])(?![\w@])")
_POSTCODE = re.compile(r"[,\s]\s?\d{5}\s[^\W\d_a-zß-ÿ]|\s[^\W\d_]+\s\d{5}\b")
_CAP = re.compile(r"[^\W\d_a-zß-öø-ÿ][\w’'\-@|]*\.?|[&]")
_SPLIT = re.compile(r"[^\w@|’'\-]+")
_DIVISION = re.compile(r"(?<=[^\W\d_])[\-‐¬­]\n(?=[^\W\d_])")
_ALIKE = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "5": "s", "@": "a", "9": "g", "6": "b", "c": "e", "t": "f", "h": "b"})


def _plain(word: str) -> str:
    """A word in lower case with glyphs that scanners confuse made alike."""
    s = word.lower().translate(_ALIKE)
    for a, b in (("ri", "n"), ("rn", "m"), ("ei", "d"), ("ii", "u"), ("in", "m")):
        s = s.replace(a, b)
    return s


def _street(word: str) -> bool:
    w = word.strip(".,").lower()
    return w in _STREETS or word[:1].isupper() and len(w) > 5 and w.endswith(STREET_END)


class Span(NamedTuple):
    start: int
    end: int
    source: str


class View:
    """A text with line breaks as blanks and divided words joined, and the way back to the places in the original."""

    def __init__(self, text: str):
        self.original = text
        self.places: np.ndarray | None = None
        cuts = [m.span() for m in _DIVISION.finditer(text)]
        if cuts:
            bounds = [0, *(x for cut in cuts for x in cut), len(text)]
            kept = list(zip(bounds[::2], bounds[1::2]))
            self.places = np.concatenate([np.arange(i, j) for i, j in kept] + [np.array([len(text)])])
            text = "".join(text[i:j] for i, j in kept)
        text = text.replace("\n", " ").replace("\r", " ").replace("\t", " ")
        self.text = _OTHER_BLANK.sub(" ", text) if _OTHER_BLANK.search(text) else text

    def back(self, span: Span) -> tuple[int, int]:
        if self.places is None:
            return span.start, span.end
        return int(self.places[span.start]), int(self.places[span.end - 1]) + 1


class Tokens:
    """The runs between blanks of a text, what each tells, and where it stands; two blanks leave an empty run, which parts all."""

    def __init__(self, text: str, words: Mapping[str, Word]):
        self.text, self.runs = text, text.split(" ")
        self.words = list(map(words.__getitem__, self.runs))
        self._ends = list(accumulate(map(len, self.runs)))

    def start(self, i: int) -> int:
        return self._ends[i] - len(self.runs[i]) + i

    def end(self, i: int) -> int:
        return self._ends[i] + i


def _addresses(t: Tokens, i: int) -> list[Span]:
    """Spans of the house number at run ``i`` with the street before or after it; a wide gap or an empty line ends a street."""
    out = []
    w, runs, words = t.runs[i], t.runs, t.words
    # number first: words to a comma or the end of a sentence
    if w[-1].isalnum() or w[-1] == ",":
        after = []
        for j in range(i + 1, min(len(runs), i + 1 + STREET_WORDS)):
            if not runs[j] or words[j].digits:
                break
            after.append(j)
            if runs[j][-1] in ",.;:)":
                break
        streets = [j for j in after if words[j].street]
        if streets:
            ends = [after[-1]] if runs[after[-1]][-1] in ",.;:)" else [*streets, after[-1]]
        else:  # without a known kind of street, the capitalised words that follow; five digits before a place are its postcode
            ends = []
            for j in after if len(w) < 5 or not w[:5].isdigit() else []:
                if words[j].big:
                    ends = [j]
                elif not words[j].particle:
                    break
        start = t.start(i)
        if i >= 2 and runs[i - 2].lower() in ("flat", "apt", "apt.", "unit", "apartment") and runs[i - 1].rstrip(",").isalnum():
            start = t.start(i - 2)
        out += [Span(start, t.start(j) + len(runs[j].rstrip(",.;:)")), "address") for j in ends]
    # number last: back to the first capital or street word that is no cue, and to the first of the words just before
    first, run, street, near = None, True, False, None
    for j in range(i - 1, max(-1, i - 1 - STREET_WORDS), -1):
        word = runs[j]
        if not word or word[-1] in ".;:)" or words[j].digits or word[-1] == "," and j < i - 1 or word.lower() in _ADDRESS_CUES:
            break
        run = run and (words[j].big or words[j].particle)
        if words[j].big or words[j].street:
            first, street = j, street or words[j].street
            if run:
                near = j
    end = t.start(i) + len(w.rstrip(",.:;)"))
    if first is not None and street:
        out.append(Span(t.start(first), end, "address"))
    elif near is not None:
        out.append(Span(t.start(near), end, "address"))
    return out


def generate(t: Tokens) -> list[Span]:
    """Candidate spans of all types but names, of a text with blanks only as white space; they overlap."""
    out: set[Span] = set()
    text = t.text
    if "@" in text or "(" in text or "[" in text:
        for m in _EMAIL.finditer(text):
            out.add(Span(*m.span(), "email"))
    if _CORE.search(text):
        for m in _NUMBER.finditer(text):
            a, b = m.span()
            out.add(Span(a, b, "number"))
            body = text[a:b]
            # without letters at the ends, and parts between wide gaps or after a full stop
            digits = re.search(r"[+(]?\d.*\d", body)
            out.add(Span(a + digits.start(), a + digits.end(), "number"))
            pieces = list(_PARTS.finditer(body))
            if len(pieces) > 1:
                for i in range(len(pieces)):
                    for j in range(i + 1, len(pieces) + 1):
                        s, e = pieces[i].start(), pieces[j - 1].end()
                        if (i, j) != (0, len(pieces)) and sum(ch.isdigit() for ch in body[s:e]) >= 6:
                            out.add(Span(a + s, a + e, "number"))
                            if body[e - 1] in ".,)/-":
                                out.add(Span(a + s, a + e - 1, "number"))
        for m in _GROUPS.finditer(text):
            out.add(Span(*m.span(), "number"))
    words, n = t.words, len(t.words)
    for i, w in enumerate(words):
        if not w.house:
            continue
        low, high = max(0, i - STREET_WORDS), min(n, i + 1 + STREET_WORDS)
        if i and (words[i - 1].big or words[i - 1].particle) or i + 1 < n and (words[i + 1].big or words[i + 1].particle) or any([x.street for x in words[low:high]]):
            out.update(_addresses(t, i))
    return sorted(out)


class Lexicon(NamedTuple):
    """Counts learned from the labelled sample; all bounded by its size."""

    names: dict[str, int]
    others: dict[str, int]
    streets: dict[str, int]
    shapes: dict[str, tuple[int, int, int]]


class Word(NamedTuple):
    """What a run between blanks tells about names, whatever its neighbours."""

    lead: int
    core: str
    low: str
    cap: bool
    particle: bool
    title: bool
    stop: bool
    full: bool
    ends: bool
    comma: bool
    closed: bool
    named: tuple[int, ...]
    seen: int
    other: int
    single: bool
    company: int
    street: bool
    streets: int
    pieces: int
    letters: int
    cues: tuple[int, ...]
    upper: bool
    big: bool
    digits: bool
    house: bool


def _word(w: str, lexicon: Lexicon, own: frozenset[str] = frozenset()) -> Word:
    """``own`` are words of an example that do not count for it."""
    core = w.strip("\"“”„«»()[]:;!?/")
    bare = core.rstrip(".,")
    low = bare.lower()
    known = lambda table, t: max(0, table.get(t, 0) - (t in own))
    pieces = [t for t in _SPLIT.split(core) if t]
    plain = {t: _plain(t) for t in pieces}
    parts = [t for t in pieces if len(t) > 1 and t.lower() not in PARTICLES and t.lower() not in TITLES]
    named = tuple(max(known(lexicon.names, _plain(p)) for p in [t, *t.split("-")]) for t in parts)
    cue_words = {x for x in re.split(r"[^\w&.\-]+", w.lower()) if x}
    cue_words |= {x.strip(".-") for x in cue_words}
    return Word(
        w.find(core) if core else 0, core, low, _CAP.fullmatch(core.rstrip(",")) is not None, low in PARTICLES, low in TITLES,
        w.endswith((":", ";", "!", "?", ")", "]")), w.endswith(".") and len(low) > 1 and low not in TITLES, w.endswith(("!", "?")) or w.endswith(".") and len(low) > 1 and low not in _NO_STOP, core.endswith(","), w[-1:] in ".,:;!?)]\"”»",
        named, sum(x > 0 for x in named), max((known(lexicon.others, plain[t]) for t in parts), default=0), any(len(t) == 1 for t in pieces), sum(t.lower().strip(".") in COMPANY for t in pieces) + ("&" in core),
        any(map(_street, [w, *pieces])), sum(known(lexicon.streets, plain[t]) > 0 for t in pieces), len(pieces), sum(map(str.isalpha, bare)), tuple(i for i, cues in enumerate(_CUE_WORDS.values()) if cues & cue_words), core[:1].isupper(),
        w[:1].isupper(), any(map(str.isdigit, w)), w[:1].isdigit() and _HOUSE.match(w) is not None,
    )


_NO_STOP = frozenset("no nr ref réf cod tel tél dr mr ms prof mrs n".split())
_NONE = (0.0,) * len(CUES)
_NO_WORD = _word("", Lexicon({}, {}, {}, {}))


def name_candidates(t: Tokens, label: tuple[float, ...] = _NONE) -> list[tuple[Span, list[float]]]:
    """All spans of runs of capitalised words, with their features; a comma may part surname and given name, once.

    Single words, and spans of any number of runs' words up to ``NAME_WORDS`` besides particles and titles, are proposed alike.
    """
    infos, runs = t.words, t.runs
    n = len(infos)
    out: list[tuple[Span, list[float]]] = []
    cued = {i for i, w in enumerate(infos) if w.cues}

    def near(i: int) -> tuple[float, ...]:
        """For each kind of cue, how near its last word stands before run ``i``: 1 for the last word, then less."""
        if cued.isdisjoint(range(i - 8, i)):
            return label
        got, back, j = list(label), 0, i - 1
        while j >= 0 and back < 5:
            w = infos[j]
            if w.core:
                back += 1
                if w.ends:
                    break
                for k in w.cues:
                    got[k] = max(got[k], 1.0 / back)
            j -= 1
        return tuple(got)

    i = 0
    while i < n:
        w = infos[i]
        if not (w.cap or w.particle and i + 1 < n and infos[i + 1].upper):
            i += 1
            continue
        j, commas = i, 0
        while j < n:
            w = infos[j]
            if not (w.cap or w.particle and (j > i or j + 1 < n and infos[j + 1].upper)):
                break
            j += 1
            if w.stop or w.full or w.comma and commas:
                break
            commas += w.comma
        for a in range(i, j):
            first = infos[a]
            if first.low == "&":
                continue
            cues = None
            counted = commas = pieces = letters = company = streets = other = known = parts = 0
            least = -1
            single = title = street = False
            before = infos[a - 1] if a else _NO_WORD
            for b in range(a, j):
                w = infos[b]
                counted += not (w.particle or w.title)
                if counted > NAME_WORDS or commas > 1 or b > a and infos[b - 1].full:
                    break
                if w.named:
                    lowest = min(w.named)
                    least = lowest if least < 0 else min(least, lowest)
                    parts += len(w.named)
                    known += w.seen
                pieces, letters, company, streets, other = pieces + w.pieces, letters + w.letters, company + w.company, streets + w.streets, max(other, w.other)
                single, title, street = single or w.single, title or w.title, street or w.street
                if not (w.particle or b == a and len(w.low) < 3 or w.low == "&"):
                    if cues is None:
                        cues = near(a)
                        start, led = t.start(a) + first.lead, title or before.title
                    after = infos[b + 1] if b + 1 < n and not w.closed else _NO_WORD
                    out.append((Span(start, t.start(b) + w.lead + len(w.core.rstrip(".,")), "name"), (
                        *cues, least, known / parts if parts else -1.0, other, parts, commas > 0, single, led or title, company, after.company > 0 or after.core != "" and b + 2 < n and infos[b + 2].low == "&", before.company > 0,
                        after.upper, after.seen > 0, before.upper and not before.closed, before.seen > 0 and not before.closed, street, streets, pieces, letters, a == 0 and b == n - 1, a == 0 or before.full,
                    )))
                commas += w.comma
        i = max(j, i + 1)
    return out


def shape(text: str) -> str:
    return re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "A", text))


_COMPATIBLE = {"email": ("email",), "number": ("phone", "id_number"), "address": ("address",), "name": ("name",)}


def _near_cues(context: str) -> list[float]:
    """For each kind of cue, how near its last word stands: 1 for the last word of the context, then less."""
    words = [w for w in re.split(r"[^\w&.\-]+", context.lower()) if w][-5:]
    out = [0.0] * len(CUES)
    for back, w in enumerate(reversed(words)):
        bare = w.strip(".-")
        for i, cues in enumerate(_CUE_WORDS.values()):
            if (w in cues or bare in cues) and not out[i]:
                out[i] = 1.0 / (1 + back)
    return out


def features(text: str, span: Span, label: str, lexicon: Lexicon, own: frozenset[str] = frozenset()) -> list[float]:
    """Format and context of a mail address, number or address; ``own`` are words of an example that do not count for it."""
    body = text[span.start : span.end]
    before = text[max(0, span.start - 60) : span.start]
    # a sentence that ended before is no context
    cut = max(before.rfind(". "), before.rfind("! "), before.rfind("? "))
    ended = cut >= 0 and before[:cut].rsplit(" ", 1)[-1].lower().strip("(") not in _NO_STOP
    near = before[cut + 2 :] if ended else before
    after = text[span.end : span.end + 24]
    cues = _near_cues(near)
    if label:
        cues = [max(a, b) for a, b in zip(cues, _near_cues(label))]
    tokens = [w for w in _SPLIT.split(body) if w]
    digits = sum(ch.isdigit() for ch in body)
    seen = list(lexicon.shapes.get(shape(body), (0, 0, 0))) if span.source == "number" else [0, 0, 0]
    if body in own:
        seen = [max(0, n - (i == max(range(3), key=seen.__getitem__))) for i, n in enumerate(seen)]
    total = sum(seen) + 1
    only = re.sub(r"\D", "", body)
    words = [t for t in tokens if not any(map(str.isdigit, t))]
    known = [max(0, lexicon.streets.get(_plain(t), 0) - (_plain(t) in own)) for t in words]
    next_word = after.lstrip(" ").split(" ")[0] if after.startswith(" ") else ""
    return [
        *cues,
        math.log2((seen[0] + 0.1) / total), math.log2((seen[1] + 0.1) / total), float(sum(seen)),
        float(digits), float(len(body)), float(sum(ch.isalpha() for ch in body)), float(int(only[:2].ljust(2, "0")) if only else -1), float(body[:1] in "+("), float(len(tokens)),
        float("@" in body), float(bool(_SPELT.search(body))), float("," in body), float(body[:1].isdigit()), float(sum(t[:1].isupper() for t in words)),
        float(any(map(_street, words))), float(sum(n > 0 for n in known)), sum(n > 0 for n in known) / len(words) if words else -1.0, float(max((lexicon.others.get(_plain(t), 0) for t in words), default=0)),
        float(bool(_POSTCODE.match(text, span.end) or _POSTCODE.search(body))), float(next_word[:1].isupper()), float(next_word[:1].islower()), float(not after[:1].isalnum()), float(body == text.strip()),
    ]


class _Words(dict):
    """``Word`` of each run between blanks that was met; emptied when it has grown large."""

    def __init__(self, lexicon: Lexicon, own: frozenset[str] = frozenset()):
        super().__init__()
        self.lexicon, self.own = lexicon, own

    def __missing__(self, w: str) -> Word:
        if len(self) > 100_000:
            self.clear()
        self[w] = out = _word(w, self.lexicon, self.own)
        return out

    def __reduce__(self):
        return _Words, (self.lexicon, self.own)


class Redactor:
    def __init__(self, models: dict[str, Boosted], lexicon: Lexicon):
        self.models, self.lexicon, self.words = models, lexicon, _Words(lexicon)

    def find(self, texts: list[tuple[str, str]]) -> list[list[tuple[int, int, str, float]]]:
        """For each (text, label) the personal spans (start, end, type, probability), in order, without overlap."""
        views = [View(t) for t, _ in texts]
        owners, spans, rows = ([], []), ([], []), ([], [])
        for i, ((_, label), view) in enumerate(zip(texts, views)):
            t = Tokens(view.text, self.words)
            for span in generate(t):
                owners[0].append(i)
                spans[0].append(span)
                rows[0].append(features(view.text, span, label, self.lexicon))
            for span, row in name_candidates(t, tuple(_near_cues(label)) if label else _NONE):
                owners[1].append(i)
                spans[1].append(span)
                rows[1].append(row)
        hits: list[list[tuple[float, int, Span, str]]] = [[] for _ in texts]
        for own, span, row in zip(owners, spans, rows):
            if not row:
                continue
            x = np.array(row, dtype=np.float64)
            kinds = np.array([s.source for s in span])
            for kind, types in _COMPATIBLE.items():
                at = np.flatnonzero(kinds == kind)
                if not len(at):
                    continue
                for t in types:
                    if t in self.models:
                        p = self.models[t].probability(x[at])
                        sure = p >= self.models[t].threshold
                        for k, v in zip(at[sure], p[sure]):
                            hits[own[k]].append((float(v), span[k].end - span[k].start, span[k], t))
        out = []
        for view, found in zip(views, hits):
            taken: list[tuple[int, int, str, float]] = []
            # the surest first, of about equally sure ones the longest
            for p, _, span, t in sorted(found, key=lambda h: (-round(h[0], 1), -h[1], h[2].start, h[3])):
                a, b = view.back(span)
                if all(b <= s or a >= e for s, e, _, _ in taken):
                    taken.append((a, b, t, p))
            out.append(sorted(taken))
        return out


def redact(text: str, found: list[tuple[int, int, str, float]]) -> str:
    """The text with each span replaced by the placeholder of its type and all else unchanged."""
    out, at = [], 0
    for a, b, t, _ in found:
        out += [text[at:a], PLACEHOLDERS[t]]
        at = b
    return "".join([*out, text[at:]])


def _label_type(label: str | None, field_type: str | None) -> str | None:
    """Type an example's label names, "none" for other labels, None where the label tells nothing."""
    low = (label or "").strip().lower()
    for t, names in LABELS.items():
        if low in names.split("|"):
            return t
    if not low or low in OPEN_LABELS.split("|") or re.fullmatch(r"\w+\s\d+", low) or field_type not in ("text", None):
        return None
    return "none"


def fit(fields: list[tuple[str, str | None, str | None]], free: Iterable[str] = ()) -> Redactor:
    """A redactor from (value, label, field type) of form fields and free texts, the same for the same ones in any order."""
    examples = []
    for value, label, kind in sorted(set(fields), key=str):
        t = _label_type(label, kind)
        text = re.sub(r"^/s/\s*", "", value.strip())
        if t is not None and text and text.lower() not in ("n/a", "none", "-") and len(text) <= 80:
            examples.append((re.sub(r"\s", " ", text), label or "", t))
    names, streets, others = Counter(), Counter(), Counter()
    shapes: dict[str, list[int]] = {}
    for text, _, t in examples:
        words = [w for w in _SPLIT.split(text) if len(w) > 1 and not any(ch.isdigit() for ch in w)]
        street = {_plain(w) for w in _SPLIT.split(re.split(r",|\s\d{5}\b", text)[0])}
        for w in {_plain(p) for w in words for p in [w, *w.split("-")]}:
            if t == "name" and w not in PARTICLES and w not in TITLES:
                names[w] += 1
            elif t == "address" and w in street and w not in PARTICLES:
                streets[w] += 1
            elif t == "none":
                others[w] += 1
        if any(ch.isdigit() for ch in text):
            shapes.setdefault(shape(text), [0, 0, 0])[{"phone": 0, "id_number": 1}.get(t, 2)] += 1
    # a word of names may be in the name of a company; one of streets is rarely elsewhere
    lexicon = Lexicon(
        dict(names), {w: n for w, n in others.items() if not names.get(w)}, {w: n for w, n in streets.items() if n > 3 * (names.get(w, 0) + others.get(w, 0))}, {s: tuple(n) for s, n in shapes.items()},
    )
    rows: dict[str, list] = {t: [] for t in TYPES}
    truth: dict[str, list[int]] = {t: [] for t in TYPES}
    example: dict[str, list[int]] = {t: [] for t in TYPES}
    for nth, (text, label, t) in enumerate(examples):
        own = frozenset([text, *(_plain(p) for w in _SPLIT.split(text) for p in [w, *w.split("-")])])
        words = _Words(lexicon, own)
        for shown in (label, ""):
            # seen alone, and as it stands in running text after words without meaning for it
            frame = ("", "") if zlib.crc32(text.encode()) % 2 else ("It was found that ", " in the end.")
            whole = frame[0] + text + frame[1]
            tokens = Tokens(whole, words)
            found = [(span, None) for span in generate(tokens)] + name_candidates(tokens, tuple(_near_cues(shown)) if shown else _NONE)
            for span, f in found:
                if span.start < len(frame[0]) or span.end > len(frame[0]) + len(text):
                    continue
                body = whole[span.start : span.end]
                covered = (span.end - span.start) / len(text)
                f = f or features(whole, span, shown, lexicon, own)
                for kind in _COMPATIBLE[span.source]:
                    if kind == "email" and t == "none" and body == text:
                        continue  # a mail address alone in a field is one, whatever the label
                    full = body == text or kind == "address" and (covered >= 0.4 or text.startswith(body) and text[len(body) :][:1] in ",; ") and any(map(str.isdigit, body)) and any(ch.isalpha() for ch in body)
                    if t == kind and not full and covered > 0.3 and kind != "name":
                        continue  # a part of an example is neither
                    rows[kind].append(f)
                    truth[kind].append(int(t == kind and full))
                    example[kind].append(nth)
    every = _Words(lexicon)
    for nth, text in enumerate(sorted(set(free)), len(examples)):
        view = View(text).text
        for span in generate(Tokens(view, every)):
            words = [w for w in _SPLIT.split(view[span.start : span.end]) if w]
            if span.source == "address" and not any(map(_street, words)) and not _POSTCODE.match(view, span.end):
                f = features(view, span, "", lexicon)
                if not f[tuple(CUES).index("address")]:
                    rows["address"].append(f)
                    truth["address"].append(0)
                    example["address"].append(nth)
    models = {t: Boosted().fit(np.array(rows[t], dtype=np.float64), np.array(truth[t], dtype=np.float64), np.array(example[t])) for t in TYPES if rows[t] and 0 < sum(truth[t]) < len(truth[t]) or rows[t] and sum(truth[t])}
    return Redactor(models, lexicon)


def fit_from(form_fields: DataFrame, value: str = "value", label: str = "label", kind: str = "field_type", sample: int = SAMPLE, free: int = SAMPLE_FREE) -> Redactor:
    """A redactor fitted on about ``sample`` short fields and ``free`` longer ones, chosen by a hash of their content; small
    tables are used whole. How many fields there are does not change how a text is judged beyond what the sample teaches."""
    rows = form_fields.select(value, label, kind).filter(F.col(value).isNotNull()).withColumn("_long", F.length(value) > 80)
    n = {r["_long"]: r["n"] for r in rows.groupBy("_long").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = [int(min(1.0, want / max(1, n.get(at, 0))) * (1 << 30)) for at, want in ((False, sample), (True, free))]
    share = F.when(F.col("_long"), F.lit(shares[1])).otherwise(F.lit(shares[0]))
    some = rows.filter(F.pmod(F.xxhash64(value, label, kind), F.lit(1 << 30)) < share).distinct().collect()
    return fit([tuple(r)[:3] for r in some if not r["_long"]], [r[value] for r in some if r["_long"]])


def personal_spans(df: DataFrame, keys: list[str], text: str, redactor: Redactor, label: str | None = None) -> DataFrame:
    """(keys, redacted, spans): the text with placeholders, and the type, place and probability of each span.

    Null texts stay null, empty ones empty, both without spans. ``label`` names a column with words that serve as context.
    Rows are judged one by one, repeated rows alike; other columns are not read, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(redactor)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pii_type", T.StringType()), T.StructField("probability", T.DoubleType())])
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("redacted", T.StringType()), T.StructField("spans", T.ArrayType(span))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)] + [F.col(text).alias("t"), (F.col(label) if label else F.lit("")).cast("string").alias("l")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts, labels = part.column(len(keys)).to_pylist(), part.column(len(keys) + 1).to_pylist()
                found = own.find([(t or "", lab or "") for t, lab in zip(texts, labels)])
                out = [None if t is None else redact(t, f) for t, f in zip(texts, found)]
                spans = [[{"start": a, "end": b, "pii_type": k, "probability": round(p, 4)} for a, b, k, p in f] for f in found]
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(keys))), pa.array(out, pa.string()), pa.array(spans, arrow.field(len(keys) + 1).type)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
