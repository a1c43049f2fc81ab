"""Checksums, validations and normal forms, as plain functions and as Columns.

Null gives null in every Column; the plain functions take text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions import patterns as P

_NOT_DIGIT = re.compile(r"[^0-9]")
_WHITE = P.compiled(r"\s+")


def digits_of(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def luhn_valid(text: str) -> bool:
    digits = digits_of(text)
    return bool(digits) and (luhn_sum(digits[:-1]) + int(digits[-1])) % 10 == 0


def luhn_sum(prefix: str) -> int:
    """Sum of a number's digits, every second one from the right doubled, before its check digit."""
    doubled = (2 * int(d) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(prefix)))
    return sum(d - 9 if d > 9 else d for d in doubled)


def luhn_check_digit(prefix: str) -> int:
    return -luhn_sum(digits_of(prefix)) % 10


def iban_normal(text: str) -> str:
    return _WHITE.sub("", text).upper()


def iban_valid(text: str) -> bool:
    iban = iban_normal(text)
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]+", iban) or not 15 <= len(iban) <= 34:
        return False
    if len(iban) != P.IBAN_LENGTHS.get(iban[:2], len(iban)):
        return False
    return int("".join(str(int(ch, 36)) for ch in iban[4:] + iban[:4])) % 97 == 1


def iban_format(text: str) -> str:
    iban = iban_normal(text)
    return " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))


def email_valid(text: str) -> bool:
    if len(text) > 254 or ".." in text or text.count("@") != 1:
        return False
    local, domain = text.split("@")
    if not 1 <= len(local) <= 64 or local[0] == "." or local[-1] == "." or len(domain) > 253 or "." not in domain:
        return False
    return len(domain.rsplit(".", 1)[1]) >= 2


def is_sequence(digits: str) -> bool:
    """At least five digits, each one more, or each one less, than the one before."""
    steps = {int(b) - int(a) for a, b in zip(digits, digits[1:], strict=False)}
    return len(digits) >= 5 and steps in ({1}, {-1})


def phone_valid(text: str) -> bool:
    digits = digits_of(text)
    return 7 <= len(digits) <= 15 and len(set(digits)) > 1 and not is_sequence(digits)


def phone_normal(text: str) -> str:
    return ("+" if text.startswith("+") else "") + digits_of(text)


def bic_valid(text: str) -> bool:
    bic = text.strip().upper()
    return len(bic) in (8, 11) and bic[4:6] in P.COUNTRY_CODES


def card_valid(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_valid(digits)


_BRANDS = (
    ("visa", r"^4"),
    ("mastercard", r"^5[1-5]|^2(?:2[2-9][1-9]|2[3-9]|[3-6]|7[01]|720)"),
    ("amex", r"^3[47]"),
    ("discover", r"^6(?:011|4[4-9]|5)"),
    ("diners", r"^3(?:6|8|0[0-5])"),
    ("jcb", r"^35(?:2[89]|[3-8])"),
)


def card_brand(text: str) -> str:
    digits = digits_of(text)
    return next((name for name, rx in _BRANDS if re.search(rx, digits)), "unknown")


def card_like(text: str) -> bool:
    """For sixteen digits of no known brand: a known first digit, or groups of four."""
    known = ("4", "5", "34", "37", "6011", "65", "36", "38", "35")
    return digits_of(text).startswith(known) or bool(P.compiled(r"[0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4}").search(text))


def ipv4_valid(text: str) -> bool:
    parts = text.split(".")
    if len(parts) != 4 or not all(re.fullmatch(r"0|[1-9][0-9]{0,2}", p) and int(p) < 256 for p in parts):
        return False
    return any(int(p) > 9 for p in parts)


def ipv6_valid(text: str) -> bool:
    if text.lower().startswith("::ffff:") and "." in text:
        return ipv4_valid(text[7:])
    if "::" in text:
        if len(re.findall("::", text)) > 1 or text.count(":") < 2:
            return False
    elif text.count(":") != 7:
        return False
    return all(re.fullmatch(r"[0-9a-fA-F]{0,4}", part) for part in text.split(":"))


def url_valid(text: str) -> bool:
    rest = re.sub(r"^(?:https?|ftp|file|mailto)://?", "", text)
    return len(text) >= 5 and "." in rest and len(re.split(r"[/?#]", rest.rsplit(".", 1)[1])[0]) >= 2


def structured_id(text: str) -> bool:
    digits, letters = len(digits_of(text)), len(re.sub(r"[^A-Za-z]", "", text))
    packed = P.compiled(r"[\s\-_]").sub("", text)
    return digits >= 3 and (digits + letters) / len(packed) >= 0.9


# --- Columns ------------------------------------------------------------------------------------------------------------


def digits_column(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_column(text: Column) -> Column:
    digits = digits_column(text)
    return F.when(text.isNull(), None).otherwise((F.length(digits) > 0) & F.call_function("luhn_check", digits))


def card_column(text: Column) -> Column:
    digits = digits_column(text)
    return luhn_column(text) & F.length(digits).between(13, 19) & ~digits.rlike(r"^(\d)\1+$")


def brand_column(text: Column) -> Column:
    digits = digits_column(text)
    found = F.lit("unknown")
    for name, rx in reversed(_BRANDS):
        found = F.when(digits.rlike(rx), name).otherwise(found)
    return F.when(text.isNotNull(), found)


def luhn_digit_column(prefix: Column) -> Column:
    digits = F.reverse(F.split(digits_column(prefix), ""))
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(-total, F.lit(10)).cast("int")


def iban_normal_column(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, f"[{P.SPACE}]+".replace("\\x0b", "\\x0B"), ""))


def iban_column(text: Column) -> Column:
    """Shape, length of the country and checksum; all in the JVM."""
    iban = iban_normal_column(text)
    lengths = F.create_map(*[F.lit(x) for pair in P.IBAN_LENGTHS.items() for x in pair])
    moved = F.split(F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4)), "")
    value = lambda ch: F.when(ch.between("0", "9"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(F.filter(moved, lambda ch: ch != ""), F.lit(0), lambda a, ch: F.pmod(F.when(ch.between("0", "9"), a * 10).otherwise(a * 100) + value(ch), F.lit(97)).cast("int"))
    shape = iban.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & F.length(iban).between(15, 34)
    length = F.coalesce(F.try_element_at(lengths, F.substring(iban, 1, 2)), F.length(iban)) == F.length(iban)
    return F.when(text.isNull(), None).otherwise(shape & length & F.coalesce(F.when(shape, rest) == 1, F.lit(False)))


def iban_format_column(text: Column) -> Column:
    return F.trim(F.regexp_replace(iban_normal_column(text), "(.{4})", "$1 "))


def phone_column(text: Column) -> Column:
    digits = digits_column(text)
    run = (F.length(digits) >= 5) & (F.lit("0123456789").contains(digits) | F.lit("9876543210").contains(digits))
    return F.length(digits).between(7, 15) & ~digits.rlike(r"^(\d)\1*$") & ~run


def phone_normal_column(text: Column) -> Column:
    return F.concat(F.when(text.startswith("+"), "+").otherwise(""), digits_column(text))


def internal_ipv4_column(ip: Column) -> Column:
    return ip.rlike(P.IPV4_INTERNAL)


def domain_column(url: Column) -> Column:
    """Host of a URL or of an address without scheme, in small letters."""
    whole = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.lower(F.try_parse_url(whole, F.lit("HOST")))
