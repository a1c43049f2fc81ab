"""Resolution of overlapping matches: policy, allow list, overlaps, deny list."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.patterns import SPACE
from maskwright.policy import REGEX, TYPE_PRIORITY, Policy, Span

REGEX_PRIORITY, LONGER_SPAN, HIGHER_CONFIDENCE, TYPE_FIRST = "REGEX_PRIORITY", "LONGER_SPAN", "HIGHER_CONFIDENCE", "TYPE_PRIORITY"


_BLANKS = "".join(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x10000)))))


def by_position(spans: Sequence[Span], descending: bool = False) -> list[Span]:
    """By start, the longer first; equal ones keep their order. ``descending``: the last start first."""
    return sorted(spans, key=lambda s: (-s.start if descending else s.start, s.start - s.end))


def overlap(a: Span, b: Span) -> bool:
    return a.start < b.end and b.start < a.end


def wins(new: Span, old: Span, policy: Policy, strategy: str = REGEX_PRIORITY, regex_first: bool = True) -> bool:
    """Does ``new`` replace ``old``? Ties go to the old one."""
    if regex_first and (new.source == REGEX) != (old.source == REGEX):
        return new.source == REGEX
    size, trust, rank = (lambda s: s.end - s.start), (lambda s: s.confidence), (lambda s: policy.rank(s.type))
    first = {LONGER_SPAN: [size], HIGHER_CONFIDENCE: [trust], TYPE_FIRST: [rank]}.get(strategy, [])
    for of in (*first, size, trust, rank):
        if of(new) != of(old):
            return of(new) > of(old)
    return False


def remove_overlaps(spans: Sequence[Span], policy: Policy, strategy: str = REGEX_PRIORITY, regex_first: bool = True) -> list[Span]:
    """Greedy by position: each span is held against the first kept one that it meets."""
    kept: list[Span] = []
    for span in by_position(spans):
        at = next((i for i, k in enumerate(kept) if overlap(span, k)), None)
        if at is None:
            kept.append(span)
        elif wins(span, kept[at], policy, strategy, regex_first):
            kept[at] = span
    return kept


def allowed(text: str | None, policy: Policy) -> bool:
    """Is the text on the allow list? Null is not."""
    return bool(policy.allowlist) and text is not None and text.lower().strip(_BLANKS) in policy.allowlist


def protected(spans: Sequence[Span]) -> list[tuple[int, int]]:
    """The places that matches of patterns hold against a model's."""
    return [(s.start, s.end) for s in spans]


def in_protected(span: Span, places: Sequence[tuple[int, int]]) -> bool:
    return any(span.start < b and a < span.end for a, b in places)


def resolve(regex: Sequence[Span], ner: Sequence[Span], text: str, policy: Policy, strategy: str = REGEX_PRIORITY, regex_first: bool = True) -> list[Span]:
    """The spans that are replaced: filtered by policy and allow list, without overlaps, with what the deny list adds."""
    usable = [s for s in (*regex, *ner) if s.type in policy.enabled and s.confidence >= policy.thresholds.get(s.type, 0.5) and not allowed(s.text, policy)]
    kept = remove_overlaps(usable, policy, strategy, regex_first)
    forced = [
        Span("EMAIL", m.start(), m.end(), 1.0, REGEX, m[0])
        for pattern in policy.denylist
        for m in re.finditer(pattern, text)
        if not any(k.start <= m.start() and k.end >= m.end() for k in kept)
    ]
    distinct = {(s.start, s.end, s.type): s for s in reversed([*kept, *forced])}
    return by_position(list(distinct.values())[::-1])


# --- the same on arrays of structs, in the JVM --------------------------------------------------------------------------


def sort_spans(spans: Column, descending: bool = False) -> Column:
    ranked = F.transform(spans, lambda s, i: F.struct((-s.start if descending else s.start).alias("a"), (s.start - s.end).alias("b"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(ranked), lambda r: r.s)


def filter_policy(spans: Column, policy: Policy) -> Column:
    least = F.create_map(*[F.lit(x) for t in sorted(policy.enabled) for x in (t, policy.thresholds.get(t, 0.5))])
    return F.filter(spans, lambda s: s.type.isin(*sorted(policy.enabled)) & (s.confidence >= F.try_element_at(least, s.type)))


def apply_allowlist(spans: Column, policy: Policy) -> Column:
    if not policy.allowlist:
        return spans
    plain = lambda s: F.regexp_replace(F.lower(s.text), f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.filter(spans, lambda s: ~F.coalesce(plain(s).isin(*sorted(policy.allowlist)), F.lit(False)))


def outside_protected(spans: Column, places: Column) -> Column:
    """The spans that overlap none of the given ones."""
    return F.filter(spans, lambda s: ~F.exists(places, lambda p: (s.start < p.end) & (p.start < s.end)))


def rank_column(kind: Column, priority: Sequence[str] = TYPE_PRIORITY) -> Column:
    return F.array_position(F.array(*map(F.lit, priority)), kind) - 1


def wins_column(new: Column, old: Column, policy: Policy, strategy: str = REGEX_PRIORITY, regex_first: bool = True) -> Column:
    size, trust, rank = (lambda s: s.end - s.start), (lambda s: s.confidence), (lambda s: rank_column(s.type, policy.priority or TYPE_PRIORITY))
    first = {LONGER_SPAN: [size], HIGHER_CONFIDENCE: [trust], TYPE_FIRST: [rank]}.get(strategy, [])
    out = F.lit(False)
    for of in reversed((*first, size, trust, rank)):
        out = F.when(of(new) != of(old), of(new) > of(old)).otherwise(out)
    if regex_first:
        out = F.when((new.source == REGEX) != (old.source == REGEX), new.source == REGEX).otherwise(out)
    return out


def remove_overlaps_column(spans: Column, element: str, policy: Policy, strategy: str = REGEX_PRIORITY, regex_first: bool = True) -> Column:
    """``remove_overlaps`` as a fold; ``element`` is the spans' SQL type."""

    def step(kept: Column, span: Column) -> Column:
        meets = lambda k: (span.start < k.end) & (k.start < span.end)
        at = F.array_position(F.transform(kept, lambda k: meets(k)), True)
        placed = F.transform(kept, lambda k, i: F.when((i + 1 == at) & wins_column(span, k, policy, strategy, regex_first), span).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(span))).otherwise(placed)

    return F.aggregate(sort_spans(spans), F.array().cast(f"array<{element}>"), step)
