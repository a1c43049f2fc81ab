"""Problem 3: personal information inside free text, found and replaced by typed placeholders.

Identifiers of a fixed form (mail addresses, telephone and bank numbers, cards, identity numbers, street addresses) are found by their
grammar and checksums. Names have no form; how much a term reveals of a person is estimated from the corpus. Two kinds of terms are counted:
words, by how often they occur in protected entities of type PERSON and how often elsewhere (in firms, places, addresses, and
in the text around placeholders); and contexts (the two words before a position), by how often a PERSON placeholder and how often anything else
follows them. The disclosure of a term is the log ratio of the two, that is, its pointwise mutual information with the
protected entities up to a constant. Runs of words whose disclosure exceeds the threshold are removed, as are runs of unknown
capitalised words in a context that exceeds it.

The counts cover all texts with placeholders and all recorded entities. They are joined with the terms of each row, so nothing that
grows with the corpus is broadcast; only terms that make up more than ``FREQUENT`` of all words, of which there are at most
1/``FREQUENT``, travel with the tasks instead, scores and all, as each of them would be a hot key of that join. Positions are code points.

Defined results: null and empty texts have no spans; placeholders already in a text are never part of a span; spans do not overlap; repeated rows count each.
"""

from __future__ import annotations

import gc
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps
from itertools import accumulate, compress, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.checks import luhn_valid
from maskwright.llm.canonlist import fold
from maskwright.llm.variants import PARTICLES, TITLES
from maskwright.runtime import bounded, cut, once

#: Disclosure (log ratio) above which a word counts as one of a name, and a context as one before a name.
WORD_DISCLOSURE = 0.0
CONTEXT_DISCLOSURE = 1.5
#: Occurrences that a context needs before it can disclose anything.
CONTEXT_SUPPORT = 5
#: Occurrences below which a word never seen in an entity counts as unknown.
UNKNOWN_BELOW = 12
#: Weight of an occurrence in the text around placeholders: names that an earlier run missed stand there too.
TEXT_WEIGHT = 0.1
#: Share of all words from which a term is frequent.
FREQUENT = 1e-5
#: Pieces of text that a worker keeps facts of.
KEPT = 1 << 17
#: Score below which a frequent word that no person bears reveals nothing, and what it is set to.
REVEALS_LITTLE, REVEALS_NOTHING = -3.0, -99.0

# Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}

_PLACEHOLDER = re.compile(r"(?:<|&lt;)\s*/?\s*pii\b[^<>]*?/?\s*(?:>|&gt;)", re.I)


@contextmanager
def _no_cycles() -> Iterator[None]:
    """The collector rests while a batch is worked on, which makes no cycles, so that what a worker keeps of chunks is not gone through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _batch(function: Callable) -> Callable:
    @wraps(function)
    def quiet(*columns: pa.Array) -> pa.Array:
        with _no_cycles():
            return function(*columns)

    return quiet


@lru_cache(1)
def _placeholders(text: str) -> list[tuple[int, int]]:
    """Spans of the placeholders; both passes over a text ask for them in a row."""
    return [m.span() for m in _PLACEHOLDER.finditer(text)] if "<" in text or "&lt;" in text else []


_DOT = r"(?:\.| ?[(\[]dot[)\]] ?)"
_CARD = re.compile(r"(?<![\w+-])[2-6](?:[  \-]?\d){12,18}(?![\w]|-\d)")
_NATIONAL = re.compile(
    r"(?<![\w+./\-])(?:"
    r"\d{3}([ -])\d{2}\1\d{4}"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}"
    r"|\d{8}-?[A-Z]|\d{2}\.\d{3}\.\d{3}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"
    r"|(?=[A-Z0-9]*[A-Z])[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}\d"
    r")(?![\w]|-\w)"
)
_S = r"[  ]"
_PHONE = re.compile(
    rf"(?<![\w+./\-@$€])(?:"
    rf"(?:\+|00)[1-9]\d{{0,2}}(?:{_S}?\(0\){_S}?|[  .\-]?)\d(?:[  ./\-]?\d){{5,11}}"
    rf"|\(0\d{{2,4}}\){_S}?\d{{5,8}}"
    rf"|0\d(?:[  .]?\d{{2}}){{4}}"
    rf"|0\d{{1,4}}[  /\-]\d{{3,8}}(?:[  \-]\d{{3,4}})?"
    rf"|(?:\+?1[  .\-]?)?(?:\([2-9]\d{{2}}\){_S}?|[2-9]\d{{2}}[  .\-])\d{{3}}[  .\-]\d{{4}}"
    rf"|[6-9]\d{{2}}([  \-])\d{{3}}\1\d{{3}}"
    rf")(?![\w]|[\-/]\d|,\d|{_S}?(?:EUR|€|\$))"
)
# Numbers that only look alike: case, order, serial numbers, versions, dates and amounts.
_OTHER_NUMBER = re.compile(r"(?<!\w)(?:[A-Z][A-Za-z]{1,7}[ \-]\d{9}(?!\d)(?: [A-Z]\b)?|SN\d+-\d+|B-\d{7}|\d/\d{4}/\d{2}|v?\d+(?:\.\d+)+(?:-rc\d+)?(?!\.?\d))")

_CAP = r"[A-ZÀ-ÖØ-ÞЀ-Я]"
_NAME = rf"(?:{_CAP}[\w'’]*[\w](?:-{_CAP}[\w'’]+)*)"
_PLACE = rf"(?:(?:(?:Bad|Sankt|St\.?|Saint|San|Santa|Groß|Gross|Klein|Port|Villa|Neu|Ober|Nieder|Alt|New|Old|Le|La|El|Los|Las){_S})?{_NAME})"
# Words for streets by language.
_STREETS = {
    "en": r"Street|Road|Lane|Avenue|Close|Drive|Court|Square|Way|St\.|Rd\.?|Ave\.?|Ln\.?|Dr\.|Blvd\.?",
    "de": r"straße|strasse|str\.|weg|gasse|allee|ring|damm|ufer|platz|-Platz|-Straße|-Weg|-Allee",
    "fr": r"rue|avenue|av\.|boulevard|bd\.?|place|impasse|chemin|allée|quai|route|cours",
    "es": r"Calle|C/|Plaza|Avda\.|Avenida|Paseo|Camino|Ronda",
    "it": r"Via|Viale|Piazza|Corso|Largo|Vicolo",
}
_ADDRESS = re.compile(
    rf"(?<![\w/\-])(?:"
    rf"(?:Flat{_S}\d+[A-Za-z]?,{_S})?\d+[A-Za-z]?{_S}{_NAME}(?:{_S}{_NAME})?{_S}(?:{_STREETS['en']})(?![\w])(?:,{_S}{_PLACE}(?:{_S}(?:[A-Z]{{1,2}}\d{{1,2}}{_S}\d[A-Z]{{2}}|\d{{5}})(?!\w))?)?"
    rf"|{_CAP}[\w\-]*?(?:{_STREETS['de']}){_S}\d+(?:{_S}?[a-z](?!\w))?(?:,{_S}\d{{5}}{_S}{_PLACE})?"
    rf"|\d+(?:{_S}(?:bis|ter))?,?{_S}(?:{_STREETS['fr']})(?:{_S}(?:de{_S}la|de|du|des|d'))?{_S}?{_NAME}(?:,{_S}\d{{5}}{_S}{_PLACE})?"
    rf"|(?:{_STREETS['es']}){_S}?(?:de{_S}la{_S}|de{_S}|del{_S})?{_NAME},?{_S}\d+(?:,{_S}(?:\d+º{_S}[A-Z](?!\w)|piso{_S}\d+))?(?:,{_S}\d{{5}}{_S}{_PLACE})?"
    rf"|(?:{_STREETS['it']}){_S}(?:di{_S}|della{_S}|del{_S})?{_NAME},?{_S}\d+(?:/[A-Z](?!\w)|{_S}bis(?!\w))?(?:,{_S}\d{{5}}{_S}{_PLACE})?"
    rf")"
)
_DIGIT = re.compile(r"\d")


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _iban_end(text: str, start: int) -> int | None:
    """End of the account number that begins at ``start``, if its length and checksum hold."""
    want = IBAN_LENGTHS.get(text[start : start + 2].upper())
    got, i = [], start
    while want and i < len(text) and len(got) < want:
        if text[i].isascii() and text[i].isalnum():
            got.append(text[i].upper())
        elif text[i] not in "  -" or text[i - 1] in "  -":
            return None
        i += 1
    if not want or len(got) < want or (i < len(text) and text[i].isalnum()):
        return None
    return i if iban_valid("".join(got)) else None


# Digits with what may stand between the groups of a number.
_BETWEEN = r"[  .\-/()]{1,3}"
_DIGIT_GROUPS = re.compile(rf"\d+(?:{_BETWEEN}\d+)*")
_DIGITS = re.compile(r"\d+")
# Those long enough or with a letter near them, and a few more.
_REST = rf"(?>\d*(?:{_BETWEEN}\d+)*)"
_TELLING_GROUPS = re.compile(rf"\d(?<!\d\d)(?:(?:(?=(?:\d|{_BETWEEN[:-5]}){{6}})|(?<=[^\W\d_]\d)|(?<=[^\W\d_][ \-]\d)){_REST}|{_REST}(?=[\s\S]?[^\W\d_]))")
#: Digits below which a number without letters beside it is no identifier.
_LEAST_DIGITS = 7
# What may stand before the first digit of an identifier.
_LEAD = re.compile(r"(?<![\w+./\-@$€])(?:[A-Z]{2} |[A-Z][A-Za-z]{1,7}[ \-]|[A-Za-z]{1,9}|B-|[XYZ]-|[+(])\Z")
_LEAD_SIZE = 10
# What is written like a bank account number, its checksum aside.
_IBAN_LIKE = re.compile(r"[A-Za-z]{2}\d{2}(?:[  \-]?[A-Z0-9]{4}){2,7}(?:[  \-]?\d{1,4})?(?!\w)")
_AT = re.compile(r"[@＠)\]]")
_SPELLED_AT = re.compile(r"[(\[]at[)\]]", re.I)
# The part before the sign of a mail address, read backwards from it.
_LOCAL = re.compile(r" ?[A-Za-z0-9_+\-]+(?:(?:\.| ?[)\]]tod[(\[] ?)[A-Za-z0-9_+\-]+)*", re.I)
_DOMAIN = re.compile(rf" ?[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+", re.I)
# Runs of what an address is made of; none goes beyond its run.
_ADDRESS_RUN = re.compile(r"[\w\-'’,./º  ]+")


@lru_cache(1)
def _street_words():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in "|".join(_STREETS.values()).replace(".?", "").replace("\\", "").split("|"):
        automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


def _emails(text: str) -> Iterator[tuple[int, int]]:
    backwards = None
    for at in _AT.finditer(text):
        start, end = at.span()
        if at[0] in ")]":
            start -= 3
            if start < 0 or not _SPELLED_AT.match(text, start, end):
                continue
        if domain := _DOMAIN.match(text, end):
            backwards = backwards or text[::-1]
            if local := _LOCAL.match(backwards, len(text) - start):
                yield len(text) - local.end(), domain.end()


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, in the runs that hold a digit and a word for streets."""
    words = _street_words()
    if next(words.iter(text), None):
        for run in _ADDRESS_RUN.finditer(text):
            if _DIGIT.search(text, *run.span()) and next(words.iter(text, *run.span()), None):
                yield from (m.span() for m in _ADDRESS.finditer(text, *run.span()))


def _numbers(text: str) -> Iterator[tuple[int, int, str | None]]:
    """Identifiers with digits, in order; None for numbers that only look like them."""
    done = 0
    for group in _TELLING_GROUPS.finditer(text):
        first, last = group.span()
        if last - first < _LEAST_DIGITS and not (
            text[last : last + 1].isalpha() or text[last : last + 2][1:].isalpha() or (first and (text[first - 1].isalpha() or (text[first - 1] in " -" and text[first - 2 : first - 1].isupper())))
        ):
            continue
        for run in _DIGITS.finditer(text, first, last):
            first = run.start()
            if first < done:
                continue
            starts = [first]
            if first and text[first - 1] in " -+(" or first and text[first - 1].isalpha():
                lead = _LEAD.search(text, max(0, first - _LEAD_SIZE), first)
                if lead and (text[first - 1] not in " -" or lead[0][:2].isupper() or run.end() - first == 9):
                    starts = [lead.start(), first]
            for at in starts:
                if at < done:
                    continue
                end, kind = _number_at(text, at)
                if end:
                    yield at, end, kind
                    done = end
                    break


def _number_at(text: str, at: int) -> tuple[int, str | None]:
    """(end, type) of the identifier that begins at a position; 0 for none, type None for what only looks like one."""
    end, kind = 0, None
    if text[at].isalpha() and (stop := _iban_end(text, at)) is not None:
        end, kind = stop, "IBAN"
    elif m := _NATIONAL.match(text, at):
        end, kind = m.end(), "NATIONAL_ID"
    elif text[at].isalpha():
        if m := _IBAN_LIKE.match(text, at):
            end = m.end()
    elif m := _CARD.match(text, at):
        digits = re.sub(r"\D", "", m[0])
        end, kind = m.end(), "CREDIT_CARD" if luhn_valid(digits) and len(set(digits)) > 1 else None
    elif m := _PHONE.match(text, at):
        digits = re.sub(r"\D", "", m[0].replace("(0)", ""))
        other = _OTHER_NUMBER.match(text, at)
        good = 7 <= len(digits) <= 15 and len(set(digits)) > 1 and not (other and other.end() > m.end())
        end, kind = (m.end(), "PHONE") if good else (0, None)
    if not end and (m := _OTHER_NUMBER.match(text, at)):
        end = m.end()
    return end, kind


def structured_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the identifiers of a fixed form, without overlaps, in order of position."""
    found: list[tuple[int, int, str]] = []
    taken = [*_placeholders(text)]

    def add(start: int, end: int, kind: str | None) -> None:
        for a, b in taken:
            if start < b and a < end:
                return
        taken.append((start, end))
        if kind:
            found.append((start, end, kind))

    if "@" in text or "＠" in text or "at)" in text or "at]" in text:
        for a, b in _emails(text):
            add(a, b, "EMAIL")
    if _DIGIT.search(text):
        numbers = list(_numbers(text))
        for a, b, kind in numbers:
            if kind in ("IBAN", "NATIONAL_ID", "CREDIT_CARD"):
                add(a, b, kind)
        for a, b in _addresses(text):
            add(a, b, "ADDRESS")
        for a, b, kind in numbers:
            if kind in (None, "PHONE"):
                add(a, b, kind)
    return sorted(found)


_INVISIBLE = "­​‌‍⁠﻿"
_LETTER = rf"(?:[^\W\d_][̀-ͯ{_INVISIBLE}]*)"
_TOKEN = re.compile(rf"([A-ZÀ-Þ]\.(?:-?[A-ZÀ-Þ]\.?)?(?!\w)|[{_INVISIBLE}]*{_LETTER}+(?:[-'’]{_LETTER}+)*)")
_PLAIN_TOKEN = re.compile(r"([A-ZÀ-Þ]\.(?:-?[A-ZÀ-Þ]\.?)?(?!\w)|[^\W\d_]+(?:[-'’][^\W\d_]+)*)")
_MARKED = re.compile(f"[\u0300-\u036f{_INVISIBLE}]")
_CAMEL = re.compile(r"(?<=[^\W\d_A-ZÀ-Þ])(?=(?:van|von|de|di)?[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ])")
_INITIAL = re.compile(r"[A-ZÀ-Þ](?:\.(?:-?[A-ZÀ-Þ]\.?)?)?")
_BLANKS = re.compile(r"[    　]{1,2}")


class Word:
    """A word with its place, its term and the context before it; ``gap`` tells how the next word follows."""

    __slots__ = ("start", "end", "text", "key", "capital", "parts", "before", "gap")

    def __init__(self, start: int, end: int, text: str, key: str, capital: bool, parts: list[str], before: str, gap: int = 0):
        self.start, self.end, self.text, self.key, self.capital, self.parts, self.before, self.gap = start, end, text, key, capital, parts, before, gap


@lru_cache(1 << 17)
def _facts(text: str) -> tuple[str, bool, list[str], bool]:
    """(term, begins with a capital, terms of its parts, particle) of a word."""
    plain = fold(text).rstrip(".")
    capital = not text.lstrip(_INVISIBLE)[:1].islower()
    inner = text[1:]
    pieces = [] if inner.islower() or not inner else [p for p in _CAMEL.split(text) if p]
    return ("t:" if capital else "l:") + plain, capital, ["t:" + fold(p) for p in pieces] if len(pieces) > 1 else [], plain in PARTICLES


BLANK, COMMA = 1, 2


def _gap(gap: str) -> int:
    """How a word follows another: 0 otherwise, a blank, or a comma."""
    if gap == " " or _BLANKS.fullmatch(gap):
        return BLANK
    return COMMA if gap[:1] == "," and len(gap) < 4 and (len(gap) == 1 or bool(_BLANKS.fullmatch(gap[1:]))) else 0


_NO_GAPS = ["", ""]


class _Chunk:
    """What stands between two blanks: its words with their places in it, and the gaps before each of them and behind the last."""

    __slots__ = ("words", "starts", "gaps", "small", "elements", "capitals", "head", "tail", "plain")

    def __init__(self, text: str):
        marked = not text.isascii() and _MARKED.search(text)
        if text.isalpha() and not marked:
            self.words, self.gaps, self.starts = [text], _NO_GAPS, [0]
            self.small = self.elements = [text.casefold()]
            self.capitals, self.head, self.tail, self.plain = [] if text[0].islower() else [0], "", "", True
            return
        parts = (_TOKEN if marked else _PLAIN_TOKEN).split(text)
        self.words, self.gaps, self.starts = parts[1::2], parts[::2], list(accumulate(map(len, parts)))[::2]
        self.small = [w.casefold() for w in self.words]
        #: The words in small letters and the marks of the gaps between them; where in there the words with capitals are; the marks of the outer gaps, and whether there are words and none of those.
        self.elements, self.capitals = [], []
        marks = list(map(_mark, self.gaps))
        for word, small, mark in zip(self.words, self.small, ["", *marks[1:-1]], strict=False):
            if mark:
                self.elements.append(mark)
            if not word.lstrip(_INVISIBLE)[:1].islower():
                self.capitals.append(len(self.elements))
            self.elements.append(small)
        self.head, self.tail = marks[0], marks[-1]
        self.plain = bool(self.elements) and not self.head and not self.tail


class _Kept(dict):
    """Values of chunks, made where they are missing.

    Beyond ``KEPT`` of them those not asked for since the last time are let go, which changes no result.
    """

    def __init__(self, make):
        self._make, self._older = make, {}

    def __missing__(self, text: str):
        if len(self) >= KEPT:
            self._older = dict(self)
            self.clear()
        if (value := self._older.get(text)) is None:
            value = self._make(text)
        self[text] = value
        return value


_CHUNKS = _Kept(_Chunk)


def _before(chunks: list[str], i: int, j: int, gap: str | None = None) -> tuple[str, tuple[int, int] | None]:
    """The gap before the word ``j`` of the chunk ``i``, or all of it that ends in ``gap``, and the place of the word before."""
    chunk = _CHUNKS[chunks[i]]
    gap = chunk.gaps[j] if gap is None else gap
    if j:
        return gap, (i, j - 1)
    while i:
        i -= 1
        chunk = _CHUNKS[chunks[i]]
        if chunk.words:
            return f"{chunk.gaps[-1]} {gap}", (i, len(chunk.words) - 1)
        gap = f"{chunks[i]} {gap}"
    return gap, None


def _context(chunks: list[str], i: int, j: int, gap: str | None = None) -> tuple[str, str]:
    """The two things before a word: words in small letters, or what gaps leave of themselves."""
    if gap is None and not j and i > 1:  # most often plain words and blanks
        last = _CHUNKS[chunks[i - 1]]
        if len(last.words) == 1 and last.gaps == _NO_GAPS and not _CHUNKS[chunks[i]].gaps[0]:
            other = _CHUNKS[chunks[i - 2]]
            if other.words and not other.gaps[-1]:
                return other.small[-1], last.small[0]
    found: list[str] = []
    while len(found) < 2:
        gap, at = _before(chunks, i, j, gap)
        if mark := _mark(gap):
            found.append(mark)
        if at is None:
            found += ["^", "^"]
        else:
            i, j = at
            found.append(_CHUNKS[chunks[i]].small[j])
        gap = None
    return found[1], found[0]


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with null characters in place of the spans, which may overlap."""
    parts, at = [], 0
    for a, b in sorted(spans):
        parts += (text[at : max(at, a)], "\0" * (b - max(at, a)))
        at = max(at, b)
    return "".join(parts) + text[at:]


def words_of(text: str, masked: list[tuple[int, int, str]], telling: _Kept | None = None) -> list[Word]:
    """The words outside the spans ``masked`` and outside placeholders that may be part of a name.

    These are the words that stand beside another such one, or are glued from parts. Words that are not ``telling`` are none, but for particles
    before capitals and initials, as no run of names goes over them. Words that begin with a capital in front of another have the context before them.
    """
    if cover := [(a, b) for a, b, _ in masked] + _placeholders(text):
        text = _masked(text, cover)
    chunks = text.split(" ")
    kept = list(map((_telling() if telling is None else telling).__getitem__, chunks))
    begins, begin, last = {}, 0, 0  # where the chunks with such words are
    for i in compress(range(len(chunks)), kept):
        begin += sum(map(len, chunks[last:i])) + i - last
        begins[i], last = begin, i
    if not begins:
        return []
    found = [(i, j) for i in begins for j in kept[i]]
    if any(j < 0 for _, j in found):  # particles that reveal nothing by themselves

        def leads(i: int, j: int) -> bool:
            chunk = _CHUNKS[chunks[i]]
            end = begins[i] + chunk.starts[j] + len(chunk.words[j])
            return text[end + 1 : end + 2].isupper()

        found = [(i, j if j >= 0 else ~j) for i, j in found if j >= 0 or leads(i, ~j)]
    gaps = [0]
    for (i, j), (x, y) in zip(found, found[1:], strict=False):
        gap = None
        if i == x:
            if y == j + 1:
                gap = _CHUNKS[chunks[i]].gaps[y]
        elif y == 0 and j == len(_CHUNKS[chunks[i]].words) - 1:
            if x == i + 1:
                gap = f"{_CHUNKS[chunks[i]].gaps[-1]} {_CHUNKS[chunks[x]].gaps[0]}"
            elif (before := _before(chunks, x, 0))[1] == (i, j):
                gap = before[0]
        gaps.append(0 if gap is None else _gap(gap))
    gaps.append(0)
    out: list[Word] = []
    for k, (i, j) in enumerate(found):
        behind = gaps[k + 1]
        chunk = _CHUNKS[chunks[i]]
        word = chunk.words[j]
        key, capital, parts, _ = _facts(word)
        if behind or gaps[k] or parts:
            start = begins[i] + chunk.starts[j]
            before = "L:{} {}".format(*_context(chunks, i, j)) if capital and behind == BLANK else ""
            out.append(Word(start, start + len(word), word, key, capital, parts, before, behind))
    return out


@lru_cache(4)
def _telling(nothing: frozenset[str] = frozenset()) -> _Kept:
    """By chunk, the words in it whose terms are not in ``nothing``; the complement of the number of a particle that does before a capital only."""

    def telling(text: str) -> list[int]:
        out = []
        for j, word in enumerate(_CHUNKS[text].words):
            key, capital, _, particle = _facts(word)
            if key not in nothing or (capital and len(word) < 3):
                out.append(j)
            elif particle:
                out.append(~j)
        return out

    return _Kept(telling)


def features_of(words: list[Word]) -> set[str]:
    """The terms of a text whose disclosure is looked up."""
    keys: set[str] = set()
    for w in words:
        keys.add(w.key)
        keys.update(w.parts)
        if w.capital:
            keys.add("f" + w.key[1:])
        if w.before:
            keys.add(w.before)
    return keys


def person_spans(words: list[Word], scores: dict[str, float]) -> list[tuple[int, int, str]]:
    """Runs of words that reveal a person: at least two words of a name, or a family name, a comma and a first name."""
    kinds: list[str] = []
    for w in words:
        plain = w.key[2:]
        score = scores.get(w.key)
        if plain in TITLES and (len(plain) > 1):
            kinds.append("X")
        elif _INITIAL.fullmatch(w.text):
            kinds.append("I")
        elif plain in PARTICLES:
            kinds.append("P")
        elif len(w.parts) > 1 and scores.get(w.parts[0], -9) > WORD_DISCLOSURE and (score is None or score > WORD_DISCLOSURE):
            kinds.append("G")
        elif score is not None and score > WORD_DISCLOSURE:
            kinds.append("N")
        elif score is None and w.capital and len(plain) > 2 and not plain.isdigit():
            kinds.append("U")
        else:
            kinds.append("X")

    def joined(i: int) -> bool:
        return words[i].gap == BLANK

    def comma(i: int) -> bool:
        return words[i].gap == COMMA

    def first(i: int) -> bool:
        return kinds[i] == "I" or (kinds[i] == "N" and scores.get("f" + words[i].key[1:], -1) > 0)

    for k in range(1, len(words)):  # a family name that firms or places bear too, right behind a first name
        w, b = words[k], k - 1
        while b > 0 and kinds[b] in "IP" and joined(b - 1):
            b -= 1
        if kinds[k] == "X" and w.capital and scores.get(w.key, 0.0) > REVEALS_NOTHING and w.key[2:] not in TITLES and joined(k - 1) and kinds[b] == "N" and first(b) and len(w.key) > 4:
            kinds[k] = "U"

    found: list[tuple[int, int, str]] = []
    n, i = len(words), 0
    while i < n:
        if kinds[i] == "X":
            i += 1
            continue
        j = i
        while j + 1 < n and kinds[j + 1] != "X" and joined(j):
            j += 1
        for k in range(i + 1, j + 1):  # a particle behind a whole name leads to something else
            before = [x for x in range(i, k) if kinds[x] in "NUG"]
            if kinds[k] == "P" and ((len(before) > 1 and not all(first(x) for x in before)) or (len(before) == 1 and not first(before[0]) and any(kinds[x] == "I" for x in range(i, k)))):
                j = k - 1
                break
        a, b = i, j  # the run a..b
        i = j + 1
        while a <= b and (kinds[b] == "P" or (kinds[b] == "I" and b == a)):
            b -= 1
        if a > b:
            continue
        solid = [k for k in range(a, b + 1) if kinds[k] in "NUG"]
        # a family name, a comma and a first name
        if len(solid) == 1 and kinds[solid[0]] in "NU" and solid[0] == b and all(kinds[k] == "P" for k in range(a, b)) and b == j and b + 1 < n and comma(b) and first(b + 1) and not first(b):
            end = b + 1
            if kinds[end] == "N" and end + 1 < n and joined(end) and kinds[end + 1] == "I":
                end += 1
            if kinds[b] == "N" or kinds[end] == "N":
                found.append((words[a].start, words[end].end, "PERSON"))
                i = end + 1
                continue
        while a < b and kinds[a] == "P" and not (kinds[b] in "IN" and len(solid) < 2 or (len(solid) == 2 and first(b) and not first(solid[0]))):
            a += 1
        if not solid:
            continue
        glued = [k for k in solid if kinds[k] == "G"]
        if glued:
            found.append((words[glued[0]].start, words[glued[0]].end, "PERSON"))
            continue
        count = len(solid) + sum(kinds[k] == "I" for k in range(a, b + 1))
        named = any(kinds[k] == "N" for k in solid)
        told = scores.get(words[a].before, -9) > CONTEXT_DISCLOSURE
        if count < 2 or not (named or (told and len(solid) == 2)):
            continue
        if len(solid) > 3:  # more than one name's worth: start at the first words that reveal one
            lead = [k for k in solid if kinds[k] == "N"][0]
            a = max(a, lead)
        if kinds[solid[0]] == "U" and len(solid) > 2 and not told:
            a = solid[1]
        found.append((words[a].start, words[b].end, "PERSON"))
    return found


# --- statistics ---------------------------------------------------------------------------------------------------------


def _emit(counts: dict[str, list[int]]) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][2] for k in keys], pa.int64())], ["key", "inside", "outside", "around"])


_COUNTS = "key string, inside long, outside long, around long"


def _count_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with _no_cycles():
            out = _entity_counts(batch)
        yield out


def _entity_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for kind, original in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        side = 0 if kind == "PERSON" else 1
        names = [fold(w).rstrip(".") for w in (_PLAIN_TOKEN if original.isascii() else _TOKEN).findall(original)]
        names = [x for x in names if x not in TITLES and len(x) > 1]
        for x in names:
            counts["t:" + x][side] += 1
            counts["l:" + x][side] += 1
        solid = [x for x in names if x not in PARTICLES]
        if side == 0 and len(solid) > 1:
            turned = "," in original
            for k, x in enumerate(solid):
                counts["f:" + x][int((k == 0) == turned)] += 1
    return _emit(counts)


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, and contexts before capitalised words and before placeholders, of texts with placeholders."""
    for batch in batches:
        with _no_cycles():
            out = _text_counts(batch)
        yield out


def _text_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    words: Counter[str] = Counter()
    before: Counter[tuple[str, str]] = Counter()
    people: Counter[tuple[str, str]] = Counter()
    others: Counter[tuple[str, str]] = Counter()
    for text in batch.column(0).to_pylist():
        if text:
            _count_text(text, words, before, people, others)
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    for chunk, n in words.items():
        for word in _CHUNKS[chunk].words:
            counts[_facts(word)[0]][2] += n
    for side, contexts in ((1, before), (0, people), (1, others)):
        for (a, b), n in contexts.items():
            counts[f"L:{a} {b}"][side] += n
    return _emit(counts)


def _count_text(text: str, seen: Counter, before: Counter, people: Counter, others: Counter) -> None:
    """``seen`` counts chunks, the others contexts."""
    places = _placeholders(text)
    marks = [(a, "person" in text[a:b].casefold()) for a, b in places]
    text = _masked(text, places)
    chunks = text.split(" ")
    seen.update(chunks)
    of = _CHUNKS.__getitem__
    elements, pending, found = ["^", "^"], "", []
    for chunk in map(of, chunks):
        if chunk.plain and not pending:  # as most are
            elements += chunk.elements
            for j in chunk.capitals:
                at = len(elements) - len(chunk.elements) + j
                found.append((elements[at - 2], elements[at - 1]))
            continue
        mark = chunk.head
        if pending or mark:  # the gap goes on from the chunk before
            mark = next((m for m in "#^" if m in (pending, mark)), mark or pending)
        if not chunk.elements:
            pending = mark
            continue
        if mark:
            elements.append(mark)
        at = len(elements)
        elements += chunk.elements
        for j in chunk.capitals:
            found.append((elements[at + j - 2], elements[at + j - 1]))
        pending = chunk.tail
    before.update(found)
    for start, person in marks:  # of the chunk i, that begins at ``begin``; there are no blanks in what is masked
        i, begin = text.count(" ", 0, start), text.rfind(" ", 0, start) + 1
        chunk = of(chunks[i])
        j = next((j for j, s in enumerate(chunk.starts) if begin + s > start), len(chunk.words))  # the word behind the placeholder
        at = begin + chunk.starts[j - 1] + len(chunk.words[j - 1]) if j else begin
        (people if person else others)[_context(chunks, i, j, text[at:start])] += 1


def _mark(gap: str) -> str:
    """What the text between two words leaves of itself in a context: a placeholder, the end of a line, its last sign."""
    if not gap or gap == " ":
        return ""
    return "#" if "\x00" in gap else "^" if "\n" in gap or "\r" in gap else "".join(gap.split())[-1:]


def disclosure_table(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, score, outside, inside) of all terms: ``entities`` has (pii_type, original), ``texts`` the text with placeholders; equal texts count once."""
    named = entities.where("original IS NOT NULL AND pii_type IN ('PERSON', 'ORG', 'LOCATION', 'ADDRESS')").select("pii_type", "original")
    counts = named.mapInArrow(_count_entities, _COUNTS).unionAll(texts.distinct().mapInArrow(_count_texts, _COUNTS))
    total = counts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("inside", "outside", "around")])
    context = F.col("key").startswith("L:")
    # a word seen a few times, only in texts, may be a name that an earlier run missed
    known = total.where(context | (F.col("inside") + F.col("outside") > 0) | (F.col("around") >= UNKNOWN_BELOW))
    ratio = F.log((F.col("inside") + 0.2) / (F.col("outside") + TEXT_WEIGHT * F.col("around") + 0.2))
    score = F.when(context & (F.col("inside") + F.col("outside") < CONTEXT_SUPPORT), F.lit(-9.0)).otherwise(ratio)
    return known.select("key", score.alias("score"), (F.col("outside") + F.col("around")).alias("outside"), "inside")


# --- search -------------------------------------------------------------------------------------------------------------

SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _spans_array(rows: list[list[tuple[int, int, str]]]) -> pa.Array:
    """``SPANS`` of (start, end, type) in rows."""
    flat = [s for row in rows for s in row]
    columns = [pa.array([s[i] for s in flat], _ARROW_SPANS.value_type.field(c).type) for c, i in (("type", 2), ("start", 0), ("end", 1))]
    ends = pa.array([0, *accumulate(map(len, rows))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["type", "start", "end"])).cast(_ARROW_SPANS)


#: Between the words, and between the fields of a word, that the first pass hands to the second; neither occurs in a word.
_WORD_END, _FIELD_END = "\x1e", "\x1f"
_FIRST = T.StructType([T.StructField("fixed", SPANS), T.StructField("words", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("revealing", T.BooleanType())])
_ARROW_FIRST = (pa.string(), pa.list_(pa.string()), pa.bool_())


def _first_pass(frequent: dict[str, float]):
    """Identifiers of fixed form, the words that may reveal something, the terms to look up, and whether a frequent one reveals something."""
    nothing = frozenset(k for k, score in frequent.items() if score == REVEALS_NOTHING)

    @once
    @F.arrow_udf(_FIRST)
    @_batch
    def first(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[], [], [], []]
        telling = _telling(nothing)  # once a batch, as equal sets are compared element by element
        for text in texts.to_pylist():
            spans = structured_spans(text) if text else []
            words = words_of(text, spans, telling) if text else []
            terms = features_of(words)
            row = (
                spans,
                _WORD_END.join([f"{w.start}{_FIELD_END}{w.end}{_FIELD_END}{w.gap}{_FIELD_END}{w.text}{_FIELD_END}{w.before}" for w in words]),
                [t for t in terms if t not in frequent],
                any(frequent.get(t, REVEALS_NOTHING) > WORD_DISCLOSURE for t in terms),
            )
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return pa.StructArray.from_arrays([_spans_array(columns[0]), *(pa.array(c, t) for c, t in zip(columns[1:], _ARROW_FIRST, strict=True))], _FIRST.names)

    return first


def _second_pass(frequent: dict[str, float]):
    """Spans of persons, from the words of the first pass and the scores of its terms."""

    @once
    @F.arrow_udf(SPANS)
    @_batch
    def second(words: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        known = zip(keys.flatten().to_pylist(), values.flatten().to_pylist(), strict=True)
        for packed, n in zip(words.to_pylist(), keys.value_lengths().to_pylist(), strict=True):
            built = []
            for row in packed.split(_WORD_END) if packed else ():
                start, end, gap, text, before = row.split(_FIELD_END)
                built.append(Word(int(start), int(end), text, *_facts(text)[:3], before, int(gap)))
            scores = {t: frequent[t] for t in features_of(built) if t in frequent} | dict(islice(known, n or 0))
            out.append(person_spans(built, scores))
        return _spans_array(out)

    return second


@once
@F.arrow_udf(SPANS)
@_batch
def structured_arrow(texts: pa.Array) -> pa.Array:
    return _spans_array([structured_spans(t) if t else [] for t in texts.to_pylist()])


def frequent_terms(terms: DataFrame, share: float = FREQUENT) -> dict[str, float]:
    """Scores of the terms that make up more than ``share`` of all words; at most 1/``share`` of each kind can.

    A frequent word that no person bears gets ``REVEALS_NOTHING``; one that some entity has may still be a name behind a first name.
    """
    n = F.col("outside") + F.col("inside")
    total = terms.where("key LIKE 't:%' OR key LIKE 'l:%'").agg(F.sum(n)).first()[0] or 0
    word = F.col("key").startswith("l:") | (F.col("key").startswith("t:") & (F.col("inside") == 0))
    score = F.when(word & (F.col("score") < REVEALS_LITTLE), REVEALS_NOTHING).otherwise(F.col("score"))
    return {r.key: r.score for r in terms.where(n > share * total).select("key", score.alias("score")).collect()}


def find_personal(spark: SparkSession, texts: DataFrame, table_of_terms: DataFrame) -> DataFrame:
    """(source_table, row_id, spans) from (source_table, row_id, text) rows and the disclosure table.

    Texts are read and cut into words once; only words that may reveal something, and their terms, are shuffled, never the texts.
    """
    terms = cut(table_of_terms)
    frequent = frequent_terms(terms)
    read = texts.where(F.length("text") > 0).select("source_table", "row_id", _first_pass(frequent)(F.col("text")).alias("p")).select("source_table", "row_id", "p.*")
    rows = cut(read)
    keys = rows.select("source_table", "row_id", F.explode("keys").alias("key"))
    known = keys.join(bounded(terms).select("key", "score"), "key").groupBy("source_table", "row_id").agg(F.collect_list(F.struct("key", "score")).alias("known"))
    joined = rows.drop("keys").join(known, ["source_table", "row_id"], "left")
    revealing = F.col("revealing") | F.coalesce(F.exists("known", lambda k: k.score > WORD_DISCLOSURE), F.lit(False))  # without one there is no name
    told = [F.when(revealing, F.col(c)) for c in ("words", "known.key", "known.score")]
    return joined.select("source_table", "row_id", F.concat("fixed", _second_pass(frequent)(*told)).alias("spans"))


@once
@F.arrow_udf(T.StringType())
def _mask_arrow(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        for s in sorted(found or (), key=lambda s: -s["start"]):
            text = f"{text[: s['start']]}[{s['type']}]{text[s['end'] :]}"
        out.append(text)
    return pa.array(out, pa.string())


def masked(found: DataFrame) -> DataFrame:
    """(source_table, row_id, text) with each span replaced by its type in brackets; the rest of the text is unchanged."""
    return found.select("source_table", "row_id", _mask_arrow(F.col("text"), F.col("spans")).alias("text"))
