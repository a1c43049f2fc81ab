"""The patterns of the recognisers, as text.

They are compiled with ASCII classes and word borders; white space is the wider set that ``SPACE`` holds, so that all engines agree.
"""

from __future__ import annotations

import re

# Fixed value: white space, as members of a class.
SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def compiled(pattern: str, ignore_case: bool = False) -> re.Pattern:
    """``pattern`` with the wide white space in place of its ``\\s``."""
    inside = re.sub(r"\[((?:[^\]\\]|\\.)*)\]", lambda m: "[" + m[1].replace("\\s", SPACE) + "]", pattern)
    return re.compile(inside.replace("\\s", f"[{SPACE}]"), re.ASCII | (re.I if ignore_case else 0))


EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,10}\b"

PHONE_INTERNATIONAL = r"(?<![0-9])(?:\+|00)[1-9][0-9]{6,14}(?![0-9])"
PHONE_INTERNATIONAL_FORMATTED = r"(?<![0-9])(?:\+|00)[1-9][0-9]{0,2}[\s.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{2,4}(?:[\s.-]?[0-9]{2,4})?(?![0-9])"
PHONE_GERMAN = r"(?<![0-9])0[1-9][0-9]{1,4}[\s/-]?[0-9]{3,8}(?![0-9])"
PHONE_GERMAN_PARENS = r"(?<![0-9])\(0[1-9][0-9]{1,4}\)[\s]?[0-9]{3,8}(?![0-9])"
PHONE_US = r"(?<![0-9])(?:\([0-9]{3}\)[\s.-]?|[0-9]{3}[\s.-])[0-9]{3}[\s.-][0-9]{4}(?![0-9])"
PHONE_UK = r"(?<![0-9])0[1-9][0-9]{2,4}[\s][0-9]{5,6}(?![0-9])"
PHONE_FRENCH = r"(?<![0-9])0[1-9][0-9]{8}(?![0-9])"
PHONE_FRENCH_FORMATTED = r"(?<![0-9])0[1-9](?:[\s.-]?[0-9]{2}){4}(?![0-9])"

IBAN_SPACES = r"\b[A-Z]{2}[0-9]{2}[\s]?(?:[A-Z0-9]{4}[\s]?){2,7}[A-Z0-9]{1,4}\b"
IBAN_SEPARATORS = r"\b[A-Z]{2}[0-9]{2}[\s.-]?(?:[A-Z0-9]{4}[\s.-]?){2,7}[A-Z0-9]{1,4}\b"
BIC = r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"

CARD_VISA = r"\b4[0-9]{3}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{1,4}\b"
CARD_MASTERCARD = r"\b(?:5[1-5][0-9]{2}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b"
CARD_AMEX = r"\b3[47][0-9]{2}[\s-]?[0-9]{6}[\s-]?[0-9]{5}\b"
CARD_DISCOVER = r"\b(?:6011|64[4-9][0-9]|65[0-9]{2})[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b"
CARD_DINERS = r"\b(?:36[0-9]{2}|38[0-9]{2}|30[0-5][0-9])[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{2}\b"
CARD_JCB = r"\b35(?:2[89]|[3-8][0-9])[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b"
CARD_GENERIC = r"\b[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}\b"

IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9])\b"
IPV6 = (
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}\b",
    r"\b[0-9a-fA-F]{1,4}:(?::[0-9a-fA-F]{1,4}){1,6}\b",
    r"\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b",
    r"\b::\b",
)
IPV6_MAPPED = r"\b::ffff:(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
IPV4_INTERNAL = r"^(?:10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|0\.)"

URL_SCHEME = r"\b(?:https?|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]*[-A-Za-z0-9+&@#/%=~_|]"
URL_WWW = r"\bwww\.[-A-Za-z0-9+&@#/%?=~_|!:,.;]*[-A-Za-z0-9+&@#/%=~_|]"
URL_MAILTO = r"\bmailto:[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

CASE_GERMAN = r"\b[A-Z]{2,3}[\s-]?[0-9]{4,10}[\s-]?[A-Z0-9]{0,4}\b"
CASE_GENERIC = r"\b(?:CASE|FILE|REF|TICKET)[\s-]?[A-Z0-9]{4,12}\b"
CUSTOMER_NUMBER = r"\b(?:CUST|CUSTOMER|KD|KUNDEN)[\s-]?(?:NR|NO|NUM|NUMBER)?[\s-]?[0-9]{4,12}\b"
ACCOUNT_REFERENCE = r"\b(?:ACC|ACCT|KONTO)[\s-]?[0-9]{6,12}\b"
INVOICE_NUMBER = r"\b(?:INV|INVOICE|RG|RECHNUNG)[\s-]?[A-Z0-9]{4,12}\b"
ORDER_NUMBER = r"\b(?:ORD|ORDER|BESTELLUNG)[\s-]?[A-Z0-9]{4,12}\b"
POLICY_NUMBER = r"\b(?:POL|POLICY|VERTRAG)[\s-]?[A-Z0-9]{6,15}\b"
TAX_ID = r"\b[0-9]{2,3}[\s/-]?[0-9]{2,4}[\s/-]?[0-9]{2,4}[\s/-]?[0-9]{1,4}\b"

LEAKS = (
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("PHONE", r"(?:\+|00)[1-9][0-9]{7,14}|0[1-9][0-9]{6,11}"),
    ("IBAN", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
    ("CREDIT_CARD", r"[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}"),
    ("IP_ADDRESS", r"(?:\d{1,3}\.){3}\d{1,3}"),
)

# Country codes of bank identifiers.
COUNTRY_CODES = frozenset(
    "AD AE AF AG AI AL AM AO AR AS AT AU AW AZ BA BB BD BE BF BG BH BI BJ BM BN BO BR BS BT BW BY BZ CA CD CF CG CH CI CK CL CM CN CO CR CU CV CY CZ DE DJ DK DM DO DZ EC EE EG ER ES ET "
    "FI FJ FK FM FO FR GA GB GD GE GF GH GI GL GM GN GP GQ GR GT GU GW GY HK HN HR HT HU ID IE IL IN IQ IR IS IT JM JO JP KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY "
    "MA MC MD ME MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW "
    "SA SB SC SD SE SG SH SI SK SL SM SN SO SR SS ST SV SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ UA UG US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW".split()
)
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LU": 20, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "SE": 24, "SK": 24,
}
