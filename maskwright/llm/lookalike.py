"""Problem 6: one form for strings that are displayed alike.

Two results are kept apart. The ``skeleton`` is a key for comparisons: strings that look the same have the same one, as letters of other
scripts are written as the Latin letters they look like, wherever they stand. The ``canonical`` form is text to go on with: it
changes such a letter only inside words that mix scripts, so that words of another script stay what they are.

A string passes the quick check when it is ASCII (tested in the JVM; it never leaves it) or when none of its characters is unstable:
invisible ones, odd blanks, width and ligature forms, combining marks, look-alike letters, whatever canonical composition
changes and whatever may combine with the character before it. In the others only the unstable segments are rewritten, each with the
starter before it and the marks after it, and spliced back. The properties of a character are looked up once in each worker, over
the whole code space.

Defined results: null stays null, the empty text stays empty, blanks at the ends and runs of blanks are kept (one can see
them), case is kept.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.runtime import cut, once

# Letters of other scripts (Cyrillic, Greek, Armenian, Cherokee, phonetic) and the Latin letters they look like.
LOOKALIKES = dict(
    zip(
        "аеіѕосрјхуһԁԛԝѵӏҽ" "АВЕЅІЈКМНОРСТХУԚԜѴӀ" "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϲϳͿ" "օսոհցզՍՕՏ" "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ" "ɡɑ",
        "aeisocpjxyhdqwvle" "ABESIJKMHOPCTXYQWVI" "ovABEZHIKMNOPTYXCcjJ" "ounhgqUOS" "ABCDEGHJKLMPRSTVWZ" "ga",
        strict=True,
    )
)
# Characters that are displayed as nothing.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f\ufeff"

#: Compatibility forms that look like what they stand for; others, such as raised letters, can be told apart.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def _same_look(ch: str) -> str | None:
    """What a compatibility character is displayed as, or None where the two can be told apart."""
    parts = unicodedata.decomposition(ch).split()
    if not parts or not parts[0].startswith("<"):
        return None
    ligature = parts[0] == "<compat>" and (0xFB00 <= ord(ch) <= 0xFB06 or 0x2000 <= ord(ch) <= 0x200A or ch in "\u205f\u3000")
    return unicodedata.normalize("NFKC", ch) if ligature or parts[0] in _SAME_LOOK else None


@lru_cache(1)
def _seconds() -> frozenset[str]:
    """The characters that may combine with the one before them: second parts of canonical decompositions, vowels and finals of Hangul."""
    pairs = (d.split() for c in range(sys.maxunicode + 1) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<")
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2) | frozenset(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))


class _Changes(dict):
    """What each character becomes in a form, None for stable ones; found where it is missing."""

    def __init__(self, letters: bool):
        self._table = {c: "" for c in INVISIBLE} | (LOOKALIKES if letters else {})

    def __missing__(self, ch: str) -> str | None:
        to = self._table.get(ch)
        if to is None and (shown := _same_look(ch)) is not None:
            to = "".join(self._table.get(x, x) for x in shown)
        second = unicodedata.category(ch) in ("Mc", "Mn", "Lo") and ch in _seconds()
        if to is None and (second or unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch or unicodedata.normalize("NFD", ch)[0] in self._table):
            to = ch
        self[ch] = to
        return to


_KEY, _TEXT = _Changes(True), _Changes(False)


def _spliced(text: str, changes: _Changes) -> str:
    """``text`` with its unstable segments rewritten."""
    if text.isascii() or all(changes[ch] is None for ch in set(text)):
        return text
    out, done, i, n = [], 0, 0, len(text)
    while i < n:
        if changes[text[i]] is None:
            i += 1
            continue
        start = max(done, i - 1)
        while i < n and changes[text[i]] is not None:
            i += 1
        segment = "".join([ch if (to := changes[ch]) is None else to for ch in text[start:i]])
        again = "".join([ch if (to := changes[ch]) is None else to for ch in unicodedata.normalize("NFD", segment)])
        out += (text[done:start], unicodedata.normalize("NFC", again))
        done = i
    return "".join(out) + text[done:]


def skeleton(text: str | None) -> str | None:
    """The key that all strings which look like ``text`` share."""
    return text if text is None else _spliced(text, _KEY)


_MARKS = r"\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
_WORD = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*")


@lru_cache(1 << 12)
def _script(ch: str) -> str:
    """The script of a letter; phonetic letters are one of their own."""
    return "LATIN" if ch.isascii() else "PHONETIC" if 0x250 <= ord(ch) < 0x2B0 else unicodedata.name(ch, "?").split()[0]


def _unmixed(word: re.Match) -> str:
    return "".join([LOOKALIKES.get(ch, ch) for ch in word[0]]) if len({_script(ch) for ch in word[0] if ch.isalpha()}) > 1 else word[0]


def canonical(text: str | None) -> str | None:
    """``text`` in its one form; look-alike letters are changed only inside words of mixed script."""
    if text is None or text.isascii():
        return text
    plain = _spliced(text, _TEXT)
    return unicodedata.normalize("NFC", _WORD.sub(_unmixed, plain)) if any(ch in LOOKALIKES for ch in set(plain)) else plain


def _on_unstable(form):
    @once
    @F.arrow_udf(T.StringType())
    def change(texts: pa.Array) -> pa.Array:
        return pa.array([form(x) for x in texts.to_pylist()], pa.string())

    # ASCII is stable in every form
    return lambda text: F.coalesce(change(F.when(F.octet_length(text) != F.length(text), text)), text)


canonical_column, skeleton_column = _on_unstable(canonical), _on_unstable(skeleton)


def unify(df: DataFrame, column: str, into: str = "canonical") -> DataFrame:
    """``df`` with the one form of ``column`` in ``into``. Null stays null; other columns are untouched."""
    return df.withColumn(into, canonical_column(F.col(column)))


def equal_looking_pairs(values: DataFrame, column: str) -> DataFrame:
    """Pairs (text_a < text_b) of different strings of ``column`` that look the same.

    Two strings that both are their own skeleton differ visibly, so one side of every pair is a string that changed: the
    changed strings are joined with all strings on the skeleton, and no pairs of unchanged strings are made. Nulls and
    repeated rows make no pairs.
    """
    distinct = values.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct()
    forms = cut(distinct.withColumn("form", skeleton_column(F.col("text"))))
    left = forms.where("text <> form").select(F.col("text").alias("l"), "form")
    right = forms.select(F.col("text").alias("r"), "form")
    pairs = left.join(right, "form").where("l < r OR (l > r AND r = form)")
    return pairs.select(F.least("l", "r").alias("text_a"), F.greatest("l", "r").alias("text_b"))
