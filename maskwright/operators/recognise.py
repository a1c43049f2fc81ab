"""Recognisers and their registry; detection is one Arrow crossing for all of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import checks as C
from maskwright.functions import patterns as P
from maskwright.policy import REGEX, SPANS, IdPattern, Policy, Span
from maskwright.runtime import once


def _distinct(spans: Iterable[Span]) -> list[Span]:
    """The first of the spans with the same ends."""
    return list({(s.start, s.end): s for s in reversed(list(spans))}.values())[::-1]


def keep_against_last(spans: Sequence[Span], better: Callable[[Span, Span], bool]) -> list[Span]:
    """Spans by start; one that meets the last one kept replaces it if it is better, else it is dropped."""
    kept: list[Span] = []
    for span in sorted(spans, key=lambda s: s.start):
        if not kept or span.start >= kept[-1].end:
            kept.append(span)
        elif better(span, kept[-1]):
            kept[-1] = span
    return kept


def longer(a: Span, b: Span) -> bool:
    return a.end - a.start > b.end - b.start


Parts = Iterable[tuple[int, int, int]]


def whole(text: str, patterns: int) -> Parts:
    return [(k, 0, len(text)) for k in range(patterns)]


@dataclass(frozen=True)
class Recogniser:
    """Patterns in order, with their confidence, checks and a rule for spans that meet.

    ``where`` gives, for a text and the number of patterns, the (pattern, start, end) outside of which that pattern cannot match, by pattern and
    position; a part includes the character behind what can match.
    """

    type: str
    name: str
    patterns: tuple[tuple[re.Pattern, float], ...]
    validate: Callable[[str], bool] = lambda text: True
    normalise: Callable[[str], str] = lambda text: text.strip()
    better: Callable[[Span, Span], bool] | None = None
    last_check: Callable[[str], bool] | None = None  # for matches of the last pattern only
    span_types: tuple[str, ...] = ()
    checks: tuple[Callable[[str], bool] | None, ...] = ()  # for the matches of each pattern
    where: Callable[[str, int], Parts] = whole

    def find(self, text: str) -> list[Span]:
        found = []
        last = len(self.patterns) - 1
        for k, a, b in self.where(text, last + 1):
            rx, confidence = self.patterns[k]
            kind = self.span_types[k] if self.span_types else self.type
            check = self.checks[k] if self.checks else self.last_check if k == last else None
            for m in rx.finditer(text, a, b):
                if self.validate(m[0]) and (check is None or check(m[0])):
                    found.append(Span(kind, m.start(), m.end(), confidence, REGEX, m[0]))
        if len(found) > 1:
            found = _distinct(found)
        return keep_against_last(found, self.better) if self.better else found


# --- where patterns can match: cheap tests before dear patterns -----------------------------------------------------------

_NUMBERS = P.compiled(r"[0-9+(][0-9+()\s./-]{5,}")
_ACCOUNT_RUN = P.compiled(r"[A-Za-z0-9\s.-]+")
_DIGITS = re.compile("[0-9]{2,}")
_CAPITALS_DIGITS = P.compiled(r"[A-Z]{2}[\s-]?[0-9]{4}")
_FOUR_DIGITS = re.compile("[0-9]{4}")
_SIX_CAPITALS = re.compile("[A-Z]{6}")


@lru_cache(8)
def _numbers(text: str) -> list[tuple[int, int, int]]:
    """(start, end, digits) of the runs that telephone and card numbers are written in."""
    return [(m.start(), m.end() + 1, len(C.digits_of(m[0]))) for m in _NUMBERS.finditer(text)]


def _with_digits(least: int) -> Callable[[str, int], Parts]:
    def where(text: str, patterns: int) -> Parts:
        parts = [(a, b) for a, b, n in _numbers(text) if n >= least]
        return [(k, a, b) for k in range(patterns) for a, b in parts] if parts else ()

    return where


def _accounts(text: str, patterns: int) -> Parts:
    """Runs of letters, digits and separators from two letters before two digits on, long enough for an account number."""
    parts, done = [], 0
    for m in _DIGITS.finditer(text):
        start = m.start() - 2
        if start >= done and text[start : start + 2].isalpha() and text[start : start + 2].isascii():
            done = _ACCOUNT_RUN.match(text, start).end()
            if done - start > 12:
                parts.append((start, done + 1))
    return [(k, a, b) for k in range(patterns) for a, b in parts] if parts else ()


def _cases(text: str, patterns: int) -> Parts:
    """For the first pattern what lies around capitals before four digits, as its matches have 19 characters at most; for the second its words."""
    parts: list[list[int]] = []
    for m in _CAPITALS_DIGITS.finditer(text):
        start, end = max(0, m.start() - 1), m.start() + 20
        if parts and start <= parts[-1][1]:
            parts[-1][1] = end
        else:
            parts.append([start, end])
    return [*((0, a, b) for a, b in parts), *(((1, 0, len(text)),) if _CASE_WORDS(text) else ())]


def _if(*tests: Callable[[str], object]) -> Callable[[str, int], Parts]:
    """The whole text where the pattern's test holds."""
    return lambda text, patterns: [(k, 0, len(text)) for k, test in enumerate(tests) if test(text)]


def _addresses(text: str, patterns: int) -> Parts:
    parts = [(0, a, b) for a, b, n in _numbers(text) if n > 3 and text.count(".", a, b) > 2] if "." in text else []
    if "::" in text or text.count(":") > 6:
        parts += [(k, 0, len(text)) for k in range(1, patterns)]
    return parts


def _has(word: str) -> Callable[[str], bool]:
    return lambda text: word in text


def _case_words(*words: str) -> Callable[[str], bool]:
    def there(text: str) -> bool:
        small = text.lower()
        return any(w in small for w in words)

    return there


_CASE_WORDS = _case_words("case", "file", "ref", "ticket")


def _of(*patterns: str, confidence: float, ignore_case: bool = False) -> tuple[tuple[re.Pattern, float], ...]:
    return tuple((P.compiled(p, ignore_case), confidence) for p in patterns)


EMAIL = Recogniser("EMAIL", "Email Address", _of(P.EMAIL, confidence=0.98), C.email_valid, lambda t: t.strip().lower(), where=_if(_has("@")))
PHONE = Recogniser(
    "PHONE",
    "Phone Number",
    _of(P.PHONE_INTERNATIONAL, P.PHONE_INTERNATIONAL_FORMATTED, P.PHONE_GERMAN, P.PHONE_GERMAN_PARENS, P.PHONE_US, P.PHONE_UK, P.PHONE_FRENCH, P.PHONE_FRENCH_FORMATTED, confidence=0.9),
    C.phone_valid,
    C.phone_normal,
    longer,
    where=_with_digits(7),
)
IBAN = Recogniser("IBAN", "IBAN", _of(P.IBAN_SPACES, P.IBAN_SEPARATORS, confidence=0.99, ignore_case=True), C.iban_valid, C.iban_normal, where=_accounts)
BIC = Recogniser("BIC_SWIFT", "BIC/SWIFT Code", _of(P.BIC, confidence=0.95), C.bic_valid, lambda t: t.strip().upper(), where=_if(_SIX_CAPITALS.search))
CARD = Recogniser(
    "CREDIT_CARD",
    "Credit Card",
    _of(P.CARD_VISA, P.CARD_MASTERCARD, P.CARD_AMEX, P.CARD_DISCOVER, P.CARD_DINERS, P.CARD_JCB, P.CARD_GENERIC, confidence=0.98),
    C.card_valid,
    C.digits_of,
    lambda a, b: a.confidence > b.confidence or longer(a, b),
    C.card_like,
    where=_with_digits(13),
)
IP = Recogniser(
    "IP_ADDRESS",
    "IP Address",
    (*_of(P.IPV4, confidence=0.9), *_of(*P.IPV6, confidence=0.855), *_of(P.IPV6_MAPPED, confidence=0.855, ignore_case=True)),
    lambda t: C.ipv4_valid(t) if ":" not in t else len(t) >= 3 and C.ipv6_valid(t),
    where=_addresses,
)
URL = Recogniser("URL", "URL", _of(P.URL_SCHEME, P.URL_WWW, P.URL_MAILTO, confidence=0.92), C.url_valid, better=lambda a, b: a.end > b.end, where=_if(_has("://"), _has("www."), _has("mailto:")))

#: Templates for identifiers of an organisation.
COMMON_ID_PATTERNS = {
    "germanCaseId": IdPattern("German Case ID", P.CASE_GERMAN),
    "genericCaseNumber": IdPattern("Generic Case Number", P.CASE_GENERIC, ignore_case=True),
    "customerNumber": IdPattern("Customer Number", P.CUSTOMER_NUMBER, "CUSTOMER_ID", ignore_case=True),
    "accountReference": IdPattern("Account Reference", P.ACCOUNT_REFERENCE, "ACCOUNT_NUMBER", ignore_case=True),
    "invoiceNumber": IdPattern("Invoice Number", P.INVOICE_NUMBER, ignore_case=True),
    "orderNumber": IdPattern("Order Number", P.ORDER_NUMBER, ignore_case=True),
    "policyNumber": IdPattern("Policy Number", P.POLICY_NUMBER, ignore_case=True),
    "taxIdGeneric": IdPattern("Tax ID", P.TAX_ID, "TAX_ID"),
}


def custom_ids(patterns: Sequence[IdPattern], name: str = "Custom ID", where: Callable[[str, int], Parts] = whole) -> Recogniser:
    """A recogniser of the given patterns, each with its own check; whatever they find, it stands under CASE_ID in the registry."""
    compiled = tuple((P.compiled(p.pattern, p.ignore_case), 0.9) for p in patterns)
    return Recogniser("CASE_ID", name, compiled, span_types=tuple(p.type for p in patterns), checks=tuple(p.validate for p in patterns), where=where)


CASE = custom_ids([COMMON_ID_PATTERNS["germanCaseId"], COMMON_ID_PATTERNS["genericCaseNumber"]], "Case ID", _cases)
CUSTOMER = custom_ids([COMMON_ID_PATTERNS["customerNumber"]], "Customer ID", _if(lambda text: _FOUR_DIGITS.search(text) and _case_words("cust", "kd", "kunden")(text)))


def regex_recogniser(type: str, name: str, patterns: Sequence[str], confidence: float = 0.95, validate: Callable[[str], bool] | None = None, ignore_case: bool = False) -> Recogniser:
    return Recogniser(type, name, _of(*patterns, confidence=confidence, ignore_case=ignore_case), validate or (lambda text: True))


class Registry:
    """Recognisers by type, in order of registration."""

    def __init__(self, recognisers: Iterable[Recogniser] = ()):
        self._by_type: dict[str, list[Recogniser]] = {}
        self.register(*recognisers)

    def register(self, *recognisers: Recogniser) -> Registry:
        for r in recognisers:
            self._by_type.setdefault(r.type, []).append(r)
        return self

    def unregister(self, type: str) -> None:
        self._by_type.pop(type, None)

    def clear(self) -> None:
        self._by_type.clear()

    def types(self) -> list[str]:
        return list(self._by_type)

    def has(self, type: str) -> bool:
        return bool(self._by_type.get(type))

    def of(self, type: str) -> list[Recogniser]:
        return list(self._by_type.get(type, ()))

    def all(self) -> list[Recogniser]:
        return [r for rs in self._by_type.values() for r in rs]

    def find_all(self, text: str, policy: Policy) -> list[Span]:
        """Matches of the enabled types that reach their type's threshold, type by type."""
        out = []
        for kind, recognisers in self._by_type.items():
            if kind in policy.enabled and kind in policy.regex_enabled:
                least = policy.thresholds.get(kind, 0.5)
                out += [s for r in recognisers for s in r.find(text) if s.confidence >= least]
        return out


def default_registry() -> Registry:
    return Registry((EMAIL, PHONE, IBAN, BIC, CARD, IP, URL, CASE, CUSTOMER))


def detect(text: Column, policy: Policy | None = None, registry: Registry | None = None) -> Column:
    """The matches of all recognisers in ``text``, unresolved; null for null, empty for the empty text."""
    policy, registry = policy or Policy(), registry or default_registry()

    @once
    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else [s.row() for s in registry.find_all(t, policy)] for t in texts.to_pylist()]
        return pa.array(rows, ARROW_SPANS)

    return find(text)


def find_table(policy: Policy | None = None, registry: Registry | None = None):
    """The matches as a table function for SQL: register it and use it with LATERAL. Null and empty texts have no rows."""
    rules, recognisers = policy or Policy(), registry or default_registry()

    class Find:
        def eval(self, text: str):
            for s in recognisers.find_all(text, rules) if text else ():
                yield s.type, s.start, s.end, s.confidence, s.source, s.text

    return F.udtf(Find, returnType="type string, start int, end int, confidence double, source string, text string", useArrow=True)


ARROW_SPANS = pa.list_(
    pa.struct(
        [
            ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("source", pa.string()), ("text", pa.string()),
            ("semantic", pa.struct([("gender", pa.string()), ("scope", pa.string()), ("title", pa.string())])),
        ]
    )
)
