"""Checks of tagged texts: overlaps, numbers, tags, the map, and what may have leaked."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import patterns as P
from maskwright.operators.tag import find_tags
from maskwright.policy import Policy
from maskwright.runtime import once

OVERLAPPING_ENTITIES, DUPLICATE_ID, MALFORMED_TAG, MISSING_TAG, INCOMPLETE_PII_MAP, LEAK_DETECTED = "OVERLAPPING_ENTITIES", "DUPLICATE_ID", "MALFORMED_TAG", "MISSING_TAG", "INCOMPLETE_PII_MAP", "LEAK_DETECTED"

_TAG = re.compile(r"<PII[^>]*/>")
_LOOSE_TAG = re.compile(r"<PII[^>]*>", re.I)


def inside_tag(text: str, at: int) -> bool:
    """Does ``at`` lie between the nearest opening bracket before it and the bracket that closes that one?"""
    opened = text.rfind("<", 0, at + 1)
    closed = text.find(">", opened) if opened >= 0 else -1
    return opened >= 0 and closed >= 0 and opened < at < closed


_LEAKS = {kind: P.compiled(pattern) for kind, pattern in P.LEAKS}
# What each match of a pattern holds.
_PARTS = {"EMAIL": re.compile("@"), "PHONE": re.compile("[0-9]{8}"), "IBAN": re.compile("[A-Z]{2}[0-9]{2}"), "CREDIT_CARD": P.compiled(r"[0-9]{4}[\s-]?[0-9]{4}"), "IP_ADDRESS": re.compile(r"[0-9]\.[0-9]")}


def leaks(text: str, policy: Policy) -> list[tuple[str, str, int]]:
    """(type, text, position) of what still looks like structured data; positions are those of the text with each tag made 20 blanks."""
    blanked = _TAG.sub(" " * 20, text) if "<PII" in text else text
    found = []
    for kind, rx in _LEAKS.items():
        if kind in policy.enabled and (part := _PARTS[kind].search(blanked)):  # the pattern itself is dearer
            found += [(kind, m[0], m.start()) for m in rx.finditer(blanked) if not inside_tag(text, m.start())]
    return found


def errors(text: str, entities: Sequence[dict], originals: dict[str, str] | None, policy: Policy, leaked: Sequence[tuple[str, str, int]] | None = None) -> list[tuple[str, str]]:
    """(code, detail) of everything that is wrong with a tagged text; without ``originals`` the map is not checked."""
    out = []
    ordered = sorted(entities, key=lambda e: (e["start"], e["end"]))
    if any(b["start"] < a["end"] for a, b in zip(ordered, ordered[1:], strict=False)):
        for i, a in enumerate(entities):
            out += [(OVERLAPPING_ENTITIES, f"{a['id']} and {b['id']}") for b in entities[i + 1 :] if a["start"] < b["end"] and b["start"] < a["end"]]
    first: dict[int, str] = {}
    for e in entities:
        if first.setdefault(e["id"], e["text"]) != e["text"]:
            out.append((DUPLICATE_ID, str(e["id"])))
    if "<" in text:
        out += [(MALFORMED_TAG, m[0]) for m in _LOOSE_TAG.finditer(text) if not m[0].endswith("/>")]
    if entities:
        present = {t[3] for t in find_tags(text)}
        out += [(MISSING_TAG, str(e["id"])) for e in entities if e["id"] not in present]
    if originals is not None:
        out += [(INCOMPLETE_PII_MAP, key) for e in entities if (key := f"{e['type']}_{e['id']}") not in originals]
    if policy.leak_scan and (leaked := leaks(text, policy) if leaked is None else leaked):
        out.append((LEAK_DETECTED, ", ".join(sorted({k for k, _, _ in leaked}))))
    return out


# --- Columns ------------------------------------------------------------------------------------------------------------


LEAKED = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("match", T.StringType()), T.StructField("position", T.IntegerType())]))
ERRORS = T.ArrayType(T.StructType([T.StructField("code", T.StringType()), T.StructField("detail", T.StringType())]))
ARROW_ERRORS = pa.list_(pa.struct([("code", pa.string()), ("detail", pa.string())]))


def leak_column(text: Column, policy: Policy | None = None) -> Column:
    """What ``leaks`` finds, as an array; null for null."""
    rules = policy or Policy()

    @once
    @F.arrow_udf(LEAKED)
    def scan(texts: pa.Array) -> pa.Array:
        found = [None if t is None else [{"kind": k, "match": m, "position": p} for k, m, p in leaks(t, rules)] for t in texts.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("match", pa.string()), ("position", pa.int32())])))

    return scan(text)


def error_column(text: Column, entities: Column, originals: Column | None = None, policy: Policy | None = None) -> Column:
    """What ``errors`` finds in a text and its entities (structs with type, start, end, text and id), as an array; null for null."""
    rules, given = policy or Policy(), originals is not None

    @once
    @F.arrow_udf(ERRORS)
    def check(texts: pa.Array, lists: pa.Array, maps: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), lists.to_pylist(), maps.to_pylist(), strict=True)
        return pa.array([None if t is None else [{"code": c, "detail": d} for c, d in errors(t, es or (), dict(m or ()) if given else None, rules)] for t, es, m in rows], ARROW_ERRORS)

    return check(text, entities, originals if given else F.lit(None).cast("map<string,string>"))


def overlapping_entities(entities: Column) -> Column:
    """Number of pairs of entities that overlap."""
    met = F.transform(entities, lambda a, i: F.size(F.filter(entities, lambda b, j: (j > i) & (a.start < b.end) & (b.start < a.end))))
    return F.aggregate(met, F.lit(0), lambda s, n: s + n)


def malformed_tags(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit("(?i)<PII[^>]*>"), 0), lambda t: ~t.endswith("/>"))


def missing_tags(entities: Column, tags: Column) -> Column:
    return F.array_except(F.transform(entities, lambda e: e.id), F.transform(tags, lambda t: t.id))


def missing_keys(entities: Column, originals: Column) -> Column:
    return F.array_except(F.transform(entities, lambda e: F.concat_ws("_", e.type, e.id.cast("string"))), F.map_keys(originals))
