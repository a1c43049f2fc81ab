"""Placeholders: making, parsing, finding them again after translation, and putting the originals back."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.patterns import SPACE
from maskwright.operators.recognise import ARROW_SPANS
from maskwright.operators.resolve import by_position
from maskwright.policy import ALL_TYPES, ENTITIES, Policy, Span
from maskwright.runtime import once

# Quotation marks and blanks that translators put into tags.
_QUOTE = "[\"'`«»‘’‚“”„]"
_GAP = f"[{SPACE}\\u200b]*"
_GAP1 = f"[{SPACE}\\u200b]+"
_OPEN, _CLOSE = "(?:<|&lt;)", "(?:>|&gt;)"


def _attribute(name: str, value: str) -> str:
    return f"{name}{_GAP}={_GAP}{_QUOTE}({value}){_QUOTE}"


_TYPE = _attribute("type", "[A-Z_]+")
_ID = f"id{_GAP}={_GAP}{_QUOTE}([0-9]+)(?:/?{_CLOSE}?)?{_QUOTE}"
_GENDER = f"(?:{_GAP}{_attribute('gender', '[A-Za-z0-9_]+')})?"
_SCOPE = f"(?:{_GAP}{_attribute('scope', '[A-Za-z0-9_]+')})?"
_END = f"(?:{_GAP}(?:/(?:{_GAP}{_CLOSE})?|{_CLOSE}))?"
TYPE_FIRST = re.compile(f"{_OPEN}{_GAP}PII{_GAP1}{_TYPE}{_GENDER}{_SCOPE}{_GAP1}{_ID}{_END}", re.I)
ID_FIRST = re.compile(f"{_OPEN}{_GAP}PII{_GAP1}{_ID}{_GAP1}{_TYPE}{_END}", re.I)
STRICT = re.compile(r'<PII type="([A-Z_]+)"(?: gender="(\w+)")?(?: scope="(\w+)")? id="([0-9]+)"/>')


def make_tag(kind: str, number: int, gender: str | None = None, scope: str | None = None) -> str:
    extra = "".join(f' {n}="{v}"' for n, v in (("gender", gender), ("scope", scope)) if v and v != "unknown")
    return f'<PII type="{kind}"{extra} id="{number}"/>'


def parse_tag(tag: str) -> tuple[str, int, str | None, str | None] | None:
    """(type, id, gender, scope) of a tag in strict form, or None."""
    m = STRICT.fullmatch(tag)
    return (m[1], int(m[4]), m[2], m[3]) if m and m[1] in ALL_TYPES else None


def map_key(kind: str, number: int) -> str:
    return f"{kind}_{number}"


def split_key(key: str) -> tuple[str, int] | None:
    m = re.fullmatch(r"(.+)_([0-9]+)", key)
    return (m[1], int(m[2])) if m and m[1] in ALL_TYPES else None


def number_spans(spans: Sequence[Span], policy: Policy, known: Mapping[str, str] | None = None) -> list[tuple[Span, int]]:
    """Spans in order with their numbers: those of a value in ``known`` again, else counted on from the highest."""
    taken = [(split_key(k), v) for k, v in (known or {}).items()]
    numbers = {(k[0], v): k[1] for k, v in taken if k}
    last = max((k[1] for k, _ in taken if k), default=0)
    out, seen = [], dict(numbers)
    for span in by_position(spans):
        number = (seen if policy.reuse_ids else numbers).get((span.type, span.text))
        if number is None:
            last += 1
            number = seen[span.type, span.text] = last
        out.append((span, number))
    return out


def tag_text(text: str, spans: Sequence[Span], policy: Policy, known: Mapping[str, str] | None = None) -> tuple[str, list[tuple[Span, int]], dict[str, str]]:
    """The text with tags, its numbered spans and the map from keys to originals."""
    numbered = number_spans(spans, policy, known)
    return replaced(text, numbered), numbered, {map_key(s.type, n): s.text for s, n in numbered}


def replaced(text: str, numbered: Sequence[tuple[Span, int]]) -> str:
    """The text with a tag in place of each numbered span."""
    for span, number in sorted(numbered, key=lambda x: -x[0].start):
        text = text[: span.start] + make_tag(span.type, number, span.gender, span.scope) + text[span.end :]
    return text


@once
@F.arrow_udf(T.StringType())
def replace_numbered(texts: pa.Array, entities: pa.Array) -> pa.Array:
    """Texts with tags in place of entities (structs of a span and its id); null for null."""
    rows = zip(texts.to_pylist(), entities.to_pylist(), strict=True)
    return pa.array([t if t is None or not found else replaced(t, [(Span.of(e), e["id"]) for e in found]) for t, found in rows], pa.string())


def find_tags(text: str, strict: bool = False) -> list[tuple[int, str, str, int, str | None, str | None]]:
    """(position, matched text, type, id, gender, scope) of the tags, also of mangled ones unless ``strict``."""
    found: dict[int, tuple] = {}
    if "<" not in text and "&lt;" not in text:
        return []
    # where every opening sign begins a tag as it is made, there are no others
    plain = strict or text.count("<") + text.count("&lt;") == sum(1 for _ in STRICT.finditer(text))
    for rx in (STRICT,) if plain else (TYPE_FIRST, ID_FIRST):
        for m in rx.finditer(text):
            number, kind, gender, scope = (m[1], m[2], None, None) if rx is ID_FIRST else (m[4], m[1], m[2], m[3])
            if kind.upper() in ALL_TYPES:
                found.setdefault(m.start(), (m.start(), m[0], kind.upper(), int(number), gender and gender.lower(), scope and scope.lower()))
    return [found[k] for k in sorted(found)]


def rehydrate_text(text: str, originals: Mapping[str, str], strict: bool = False) -> str:
    """``text`` with the originals of known tags; unknown tags stay."""
    for at, matched, kind, number, _, _ in reversed(find_tags(text, strict)):
        if (value := originals.get(map_key(kind, number))) is not None:
            text = text[:at] + value + text[at + len(matched) :]
    return text


# --- Columns ------------------------------------------------------------------------------------------------------------

_ENTITY = pa.struct([*ARROW_SPANS.value_type, ("id", pa.int32())])
TAGGED = T.StructType([T.StructField("text", T.StringType()), T.StructField("entities", ENTITIES), T.StructField("originals", T.MapType(T.StringType(), T.StringType()))])
_ARROW_TAGGED = pa.struct([("text", pa.string()), ("entities", pa.list_(_ENTITY)), ("originals", pa.map_(pa.string(), pa.string()))])
TAGS = T.ArrayType(
    T.StructType(
        [T.StructField("position", T.IntegerType()), T.StructField("matched", T.StringType()), T.StructField("type", T.StringType()), T.StructField("id", T.IntegerType())]
        + [T.StructField(n, T.StringType()) for n in ("gender", "scope")]
    )
)
_ARROW_TAGS = pa.list_(pa.struct([("position", pa.int32()), ("matched", pa.string()), ("type", pa.string()), ("id", pa.int32()), ("gender", pa.string()), ("scope", pa.string())]))


def tag_column(kind: Column, number: Column, gender: Column | None = None, scope: Column | None = None) -> Column:
    said = lambda name, c: F.lit("") if c is None else F.coalesce(F.when(c != "unknown", F.concat(F.lit(f' {name}="'), c, F.lit('"'))), F.lit(""))
    return F.concat(F.lit('<PII type="'), kind, F.lit('"'), said("gender", gender), said("scope", scope), F.lit(' id="'), number.cast("string"), F.lit('"/>'))


def tag_spans(text: Column, spans: Column, policy: Policy, known: Column | None = None) -> Column:
    """Struct of the tagged text, its entities and originals; null for null."""

    @once
    @F.arrow_udf(TAGGED)
    def tag(texts: pa.Array, found: pa.Array, maps: pa.Array) -> pa.Array:
        out = []
        for t, rows, m in zip(texts.to_pylist(), found.to_pylist(), maps.to_pylist(), strict=True):
            if t is None:
                out.append(None)
                continue
            tagged, numbered, originals = tag_text(t, [Span.of(r) for r in rows or ()], policy, dict(m or ()))
            out.append({"text": tagged, "entities": [s.row() | {"id": n} for s, n in numbered], "originals": list(originals.items())})
        return pa.array(out, _ARROW_TAGGED)

    return tag(text, spans, F.lit(None).cast("map<string,string>") if known is None else known)


def tags_of(text: Column, strict: bool = False) -> Column:
    @once
    @F.arrow_udf(TAGS)
    def tags(texts: pa.Array) -> pa.Array:
        names = ("position", "matched", "type", "id", "gender", "scope")
        return pa.array([None if t is None else [dict(zip(names, x, strict=True)) for x in find_tags(t, strict)] for t in texts.to_pylist()], _ARROW_TAGS)

    return tags(text)


def rehydrate(text: Column, originals: Column, strict: bool = False) -> Column:
    @once
    @F.arrow_udf(T.StringType())
    def back(texts: pa.Array, maps: pa.Array) -> pa.Array:
        return pa.array([None if t is None else rehydrate_text(t, dict(m or ()), strict) for t, m in zip(texts.to_pylist(), maps.to_pylist(), strict=True)], pa.string())

    return back(text, originals)


def count_by_type(entities: Column) -> Column:
    """Map of all types to their number of entities, zeros included."""

    def entry(kind: str) -> Column:
        return F.struct(F.lit(kind), F.coalesce(F.size(F.filter(entities, lambda e: e.type == kind)), F.lit(0)))

    return F.map_from_entries(F.array(*map(entry, ALL_TYPES)))
