"""Types of personal data, policies and schemas."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# The entity types, from low to high priority.
TYPE_PRIORITY = (
    "URL", "IP_ADDRESS", "LOCATION", "ORG", "PERSON", "DATE_OF_BIRTH", "PHONE", "EMAIL", "ADDRESS", "CASE_ID", "CUSTOMER_ID", "ACCOUNT_NUMBER", "BIC_SWIFT", "IBAN", "CREDIT_CARD", "TAX_ID", "NATIONAL_ID",
)
ALL_TYPES = tuple(sorted(TYPE_PRIORITY))
REGEX_TYPES = ("EMAIL", "PHONE", "IBAN", "BIC_SWIFT", "CREDIT_CARD", "IP_ADDRESS", "URL", "CASE_ID", "CUSTOMER_ID")
NER_TYPES = ("PERSON", "ORG", "LOCATION", "ADDRESS", "DATE_OF_BIRTH")
# Labels of named-entity models and the types they stand for.
LABEL_TYPES = {"PER": "PERSON", "PERSON": "PERSON", "ORG": "ORG", "ORGANIZATION": "ORG", "LOC": "LOCATION", "LOCATION": "LOCATION", "GPE": "LOCATION", "DATE": "DATE_OF_BIRTH", "MISC": "ADDRESS"}

REGEX, NER, HYBRID = "REGEX", "NER", "HYBRID"

SEMANTIC = T.StructType([T.StructField(n, T.StringType()) for n in ("gender", "scope", "title")])
SPAN = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("semantic", SEMANTIC),
    ]
)
SPANS = T.ArrayType(SPAN)
ENTITIES = T.ArrayType(T.StructType([*SPAN.fields, T.StructField("id", T.IntegerType())]))


@dataclass(frozen=True)
class Span:
    """A match in a text; positions are code points, the end is exclusive."""

    type: str
    start: int
    end: int
    confidence: float
    source: str
    text: str
    gender: str | None = None
    scope: str | None = None
    title: str | None = None

    def row(self) -> dict:
        named = any((self.gender, self.scope, self.title))
        semantic = {"gender": self.gender, "scope": self.scope, "title": self.title} if named else None
        return {"type": self.type, "start": self.start, "end": self.end, "confidence": self.confidence, "source": self.source, "text": self.text, "semantic": semantic}

    @classmethod
    def of(cls, row: dict) -> Span:
        semantic = row.get("semantic") or {}
        return cls(row["type"], row["start"], row["end"], row["confidence"], row["source"], row["text"], semantic.get("gender"), semantic.get("scope"), semantic.get("title"))


def label_type(label: str) -> str | None:
    """The type that a model's label, with or without its B- or I-, stands for."""
    plain = re.sub(r"^[BI]-", "", label).upper()
    return None if plain == "O" else LABEL_TYPES.get(plain)


def _thresholds() -> dict[str, float]:
    return {t: 0.7 if t in ("PERSON", "ORG") else 0.5 for t in ALL_TYPES}


@dataclass(frozen=True)
class Policy:
    """What is looked for and how it is replaced."""

    enabled: frozenset[str] = frozenset(ALL_TYPES)
    regex_enabled: frozenset[str] = frozenset(REGEX_TYPES)
    ner_enabled: frozenset[str] = frozenset(NER_TYPES)
    priority: tuple[str, ...] = TYPE_PRIORITY
    thresholds: dict[str, float] = field(default_factory=_thresholds)
    custom_patterns: tuple = ()
    allowlist: frozenset[str] = frozenset()
    denylist: tuple[str, ...] = ()
    reuse_ids: bool = False
    semantic: bool = False
    leak_scan: bool = True

    def merge(self, **changes) -> Policy:
        """Fields are replaced whole; thresholds are merged type by type."""
        if "thresholds" in changes:
            changes["thresholds"] = self.thresholds | changes["thresholds"]
        return replace(self, **changes)

    def rank(self, kind: str) -> int:
        """Position in the priority list, -1 for a type that it lacks."""
        order = self.priority or TYPE_PRIORITY
        return order.index(kind) if kind in order else -1


@dataclass(frozen=True)
class IdPattern:
    name: str
    pattern: str
    type: str = "CASE_ID"
    validate: Callable[[str], bool] | None = None
    ignore_case: bool = False
