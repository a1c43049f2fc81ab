"""SQL counterparts of the recognisers and of resolution, written on their own: patterns and lists are spelled out here, not taken from the operators.

The SQL engine's patterns know no look-arounds. Positions come from the lengths of matches and of what lies between them; borders of
numbers are marked by two control characters around each run of digits before telephone patterns are tried.
"""

from __future__ import annotations

from maskwright.functions.patterns import COUNTRY_CODES

# White space, as members of a class.
_BLANK = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{_BLANK}]"
_SEP, _DASH, _SLASH = f"[{_BLANK}.-]", f"[{_BLANK}-]", f"[{_BLANK}/-]"
_S, _E = r"\x01", r"\x02"
_J = f"(?:{_E}{_SEP}{_S})?"

# Types from low to high priority.
PRIORITY = "URL IP_ADDRESS LOCATION ORG PERSON DATE_OF_BIRTH PHONE EMAIL ADDRESS CASE_ID CUSTOMER_ID ACCOUNT_NUMBER BIC_SWIFT IBAN CREDIT_CARD TAX_ID NATIONAL_ID".split()
LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = {odd} THEN (CAST(d[i] AS INTEGER) * 2) % 10 + (CAST(d[i] AS INTEGER) * 2) // 10 ELSE CAST(d[i] AS INTEGER) END))"
_DIGITS = "regexp_replace(match, '[^0-9]', '', 'g')"
_DISTINCT = f"len(list_distinct(string_split({_DIGITS}, '')))"

_PHONES = (
    rf"(?:^|[^{_E}])((?:\+{_S}|{_S}00)[1-9][0-9]{{6,14}}{_E})",
    rf"(?:^|[^{_E}])((?:\+{_S}|{_S}00)[1-9][0-9]{{0,2}}(?:{_E}{_SEP}?\({_S}[0-9]{{1,4}}{_E}\){_SEP}?{_S}|{_J}[0-9]{{1,4}}{_J})[0-9]{{2,4}}{_J}[0-9]{{2,4}}(?:{_J}[0-9]{{2,4}})?{_E})",
    rf"({_S}0[1-9][0-9]{{1,4}}(?:{_E}{_SLASH}{_S})?[0-9]{{3,8}}{_E})",
    rf"(?:^|[^{_E}])(\({_S}0[1-9][0-9]{{1,4}}{_E}\){WS}?{_S}[0-9]{{3,8}}{_E})",
    rf"(?:^|[^{_E}])((?:\({_S}[0-9]{{3}}{_E}\){_SEP}?|{_S}[0-9]{{3}}{_E}{_SEP}){_S}[0-9]{{3}}{_E}{_SEP}{_S}[0-9]{{4}}{_E})",
    rf"({_S}0[1-9][0-9]{{2,4}}{_E}{WS}{_S}[0-9]{{5,6}}{_E})",
    rf"({_S}0[1-9][0-9]{{8}}{_E})",
    rf"({_S}0[1-9](?:{_J}[0-9]{{2}}){{4}}{_E})",
)
_D4 = "[0-9]{4}"
_CARDS = (
    rf"\b4[0-9]{{3}}{_DASH}?{_D4}{_DASH}?{_D4}{_DASH}?[0-9]{{1,4}}\b",
    rf"\b(?:5[1-5][0-9]{{2}}|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{{2}}|27[01][0-9]|2720){_DASH}?{_D4}{_DASH}?{_D4}{_DASH}?{_D4}\b",
    rf"\b3[47][0-9]{{2}}{_DASH}?[0-9]{{6}}{_DASH}?[0-9]{{5}}\b",
    rf"\b(?:6011|64[4-9][0-9]|65[0-9]{{2}}){_DASH}?{_D4}{_DASH}?{_D4}{_DASH}?{_D4}\b",
    rf"\b(?:36[0-9]{{2}}|38[0-9]{{2}}|30[0-5][0-9]){_DASH}?{_D4}{_DASH}?{_D4}{_DASH}?[0-9]{{2}}\b",
    rf"\b35(?:2[89]|[3-8][0-9]){_DASH}?{_D4}{_DASH}?{_D4}{_DASH}?{_D4}\b",
    rf"\b{_D4}{_DASH}?{_D4}{_DASH}?{_D4}{_DASH}?{_D4}\b",
)
_H = "[0-9a-fA-F]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]|[0-9])"
_ADDRESSES = (
    rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", rf"\b(?:{_H}:){{7}}{_H}\b", rf"\b(?:{_H}:){{1,7}}:\b", rf"\b(?:{_H}:){{1,6}}:{_H}\b", rf"\b(?:{_H}:){{1,5}}(?::{_H}){{1,2}}\b", rf"\b(?:{_H}:){{1,4}}(?::{_H}){{1,3}}\b",
    rf"\b(?:{_H}:){{1,3}}(?::{_H}){{1,4}}\b", rf"\b(?:{_H}:){{1,2}}(?::{_H}){{1,5}}\b", rf"\b{_H}:(?::{_H}){{1,6}}\b", rf"\b::(?:{_H}:){{0,5}}{_H}\b", r"\b::\b",
)
_IBAN_LENGTHS = "{'AD': 24, 'AT': 20, 'BE': 16, 'CH': 21, 'CZ': 24, 'DE': 22, 'DK': 18, 'ES': 24, 'FI': 18, 'FR': 27, 'GB': 22, 'GR': 27, 'HU': 28, 'IE': 22, 'IT': 27, 'LI': 21, 'LU': 20, 'NL': 18, 'NO': 15, 'PL': 28, 'PT': 25, 'SE': 24, 'SK': 24}"
_PLAIN = f"upper(regexp_replace(match, '{WS}+', '', 'g'))"
_IBAN_VALID = f"""regexp_full_match({_PLAIN}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') AND length({_PLAIN}) BETWEEN 15 AND 34 AND length({_PLAIN}) = coalesce(element_at(MAP {_IBAN_LENGTHS}, {_PLAIN}[1:2])[1], length({_PLAIN}))
    AND CASE WHEN regexp_full_match({_PLAIN}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[1:4], ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))),
        lambda a, x: (CASE WHEN x < 10 THEN a * 10 ELSE a * 100 END + x) % 97) = 1 ELSE false END"""
_KINDS = {
    # (patterns, condition on match and k, is the first argument better than the second where they meet; None: nothing is dropped)
    "EMAIL": ([r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?)*\.[a-zA-Z]{2,10}\b"],
              "length(match) <= 254 AND match NOT LIKE '%..%' AND match NOT LIKE '.%' AND match NOT LIKE '%.@%' AND strpos(match, '@') <= 65", None),
    "PHONE": (_PHONES, f"length({_DIGITS}) BETWEEN 7 AND 15 AND {_DISTINCT} > 1 AND NOT (contains('0123456789', {_DIGITS}) OR contains('9876543210', {_DIGITS}))", "longer"),
    "IBAN": ([rf"(?i)\b[A-Z]{{2}}[0-9]{{2}}{WS}?(?:[A-Z0-9]{{4}}{WS}?){{2,7}}[A-Z0-9]{{1,4}}\b", rf"(?i)\b[A-Z]{{2}}[0-9]{{2}}{_SEP}?(?:[A-Z0-9]{{4}}{_SEP}?){{2,7}}[A-Z0-9]{{1,4}}\b"], _IBAN_VALID, None),
    "CREDIT_CARD": (_CARDS, f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_DISTINCT} > 1 AND {LUHN.format(odd=1).replace('d[i]', f'{_DIGITS}[i]').replace('len(d)', f'length({_DIGITS})')} % 10 = 0 "
                    f"AND (k < 6 OR regexp_matches({_DIGITS}, '^(?:4|5|34|37|6011|65|36|38|35)') OR regexp_matches(match, '{_D4}{_DASH}{_D4}{_DASH}{_D4}{_DASH}{_D4}'))", "longer"),
    "IP_ADDRESS": (_ADDRESSES, "CASE WHEN strpos(match, ':') = 0 THEN list_max(list_transform(string_split(match, '.'), lambda x: CAST(x AS INTEGER))) > 9 "
                   "WHEN strpos(match, '::') > 0 THEN length(match) >= 3 AND NOT regexp_matches(match, '::.*::|:::') AND length(match) - length(replace(match, ':', '')) >= 2 ELSE length(match) - length(replace(match, ':', '')) = 7 END", None),
    "URL": ([r"\b(?:https?|ftp|file)://[-A-Za-z0-9+&@#/%?=~_|!:,.;]*[-A-Za-z0-9+&@#/%=~_|]", r"\bwww\.[-A-Za-z0-9+&@#/%?=~_|!:,.;]*[-A-Za-z0-9+&@#/%=~_|]", r"\bmailto:[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
            "length(match) >= 5 AND contains(regexp_replace(match, '^(?:https?|ftp|file|mailto)://?', ''), '.') AND length(regexp_extract(string_split(regexp_replace(match, '^(?:https?|ftp|file|mailto)://?', ''), '.')[-1], '^[^/?#]*')) >= 2", "further"),
    "BIC_SWIFT": ([r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"], "match[5:6] IN (" + ", ".join(f"'{c}'" for c in sorted(COUNTRY_CODES)) + ")", None),
    "CASE_ID": ([rf"\b[A-Z]{{2,3}}{_DASH}?[0-9]{{4,10}}{_DASH}?[A-Z0-9]{{0,4}}\b", rf"(?i)\b(?:CASE|FILE|REF|TICKET){_DASH}?[A-Z0-9]{{4,12}}\b"], "true", None),
    "CUSTOMER_ID": ([rf"(?i)\b(?:CUST|CUSTOMER|KD|KUNDEN){_DASH}?(?:NR|NO|NUM|NUMBER)?{_DASH}?[0-9]{{4,12}}\b"], "true", None),
}
_BETTER = {"longer": "b[1].e - b[1].s > a[len(a)].e - a[len(a)].s", "further": "b[1].e > a[len(a)].e"}


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _matches(k: int, pattern: str, source: str, marked: bool) -> str:
    """(turn_id, k, start_pos, match) of one pattern in the texts of ``source``."""
    text = rf"regexp_replace(text, '([0-9]+)', chr(1) || '\1' || chr(2), 'g')" if marked else "text"
    plain = "length(translate({}, chr(1) || chr(2), ''))" if marked else "length({})"
    whole, group = f"regexp_extract_all({text}, '{_quoted(pattern)}')", f"regexp_extract_all({text}, '{_quoted(pattern)}', 1)" if marked else None
    size = f"lambda x: {plain.format('x')}"
    lead = f"{plain.format('found[i]')} - {plain.format('inner_of[i]')}" if marked else "0"
    return f"""
        SELECT turn_id, {k} AS k, CAST(list_sum(list_transform(gaps[1:i], {size})) + coalesce(list_sum(list_transform(found[1:i - 1], {size})), 0) + {lead} AS INTEGER) AS start_pos,
            {"translate(inner_of[i], chr(1) || chr(2), '')" if marked else "found[i]"} AS match
        FROM (SELECT turn_id, unnest(range(1, len(found) + 1)) AS i, found, inner_of, gaps FROM (
            SELECT turn_id, {whole} AS found, {group or "[]"} AS inner_of, string_split_regex({text}, '{_quoted(pattern)}') AS gaps FROM {source} WHERE text IS NOT NULL))
    """


def kept(kind: str, source: str = "session_turn", first: int = 0) -> str:
    """(turn_id, ord, start_pos, end_pos, match) of the matches of a type that a recogniser returns, in its order."""
    patterns, valid, better = _KINDS[kind]
    union = " UNION ALL ".join(_matches(k, p, source, kind == "PHONE") for k, p in enumerate(patterns))
    once = f"SELECT turn_id, start_pos, CAST(start_pos + length(match) AS INTEGER) AS end_pos, any_value(match) AS match, max(k) AS k FROM ({union}) WHERE {valid} GROUP BY ALL"
    if better is None:
        return f"SELECT turn_id, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY k, start_pos) AS INTEGER) AS ord, start_pos, end_pos, match FROM ({once})"
    return f"""
        SELECT turn_id, CAST(i AS INTEGER) AS ord, kept[i].s AS start_pos, kept[i].e AS end_pos, kept[i].m AS match FROM (
            SELECT turn_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM (
                SELECT turn_id, list_reduce(xs, lambda a, b: CASE WHEN b[1].s >= a[len(a)].e THEN a || b WHEN {_BETTER[better]} THEN a[1:len(a) - 1] || b ELSE a END) AS kept FROM (
                    SELECT turn_id, list_transform(list({{'s': start_pos, 'e': end_pos, 'm': match}} ORDER BY start_pos, k), lambda x: [x]) AS xs FROM ({once}) GROUP BY turn_id)))
    """


def resolved(spans: str, key: str) -> str:
    """(key, spans) with overlaps removed, from rows (key, n, pii_type, s, e, c, regex, m): greedy by position, ties by n."""
    rank = "list_position([" + ", ".join(f"'{t}'" for t in PRIORITY) + "], pii_type)"
    at = "coalesce(list_position(list_transform(a, lambda x: b[1].s < x.e AND x.s < b[1].e), true), 0)"
    wins = "CASE WHEN b[1].g <> a[{at}].g THEN b[1].g WHEN b[1].e - b[1].s <> a[{at}].e - a[{at}].s THEN b[1].e - b[1].s > a[{at}].e - a[{at}].s WHEN b[1].c <> a[{at}].c THEN b[1].c > a[{at}].c ELSE b[1].r > a[{at}].r END".format(at=at)
    return f"""
        SELECT {key}, list_reduce(xs, lambda a, b: CASE WHEN {at} = 0 THEN a || b WHEN {wins} THEN a[1:{at} - 1] || b || a[{at} + 1:] ELSE a END) AS spans FROM (
            SELECT {key}, list_transform(list({{'t': pii_type, 's': s, 'e': e, 'c': c, 'g': regex, 'r': {rank}, 'm': m}} ORDER BY s, e DESC, n), lambda x: [x]) AS xs FROM ({spans}) GROUP BY {key})
    """


# The recognisers in their order, and what they trust their matches.
_TRUST = {"EMAIL": "0.98", "PHONE": "0.9", "IBAN": "0.99", "BIC_SWIFT": "0.95", "CREDIT_CARD": "0.98", "IP_ADDRESS": "CASE WHEN strpos(match, ':') > 0 THEN 0.855 ELSE 0.9 END", "URL": "0.92", "CASE_ID": "0.9", "CUSTOMER_ID": "0.9"}


def anonymised(leaks_of) -> str:
    """Every message with its matches resolved, numbered by position and replaced by tags, the last one first."""
    found = " UNION ALL ".join(f"SELECT turn_id, {k} * 100000 + ord AS n, '{kind}' AS pii_type, start_pos AS s, end_pos AS e, CAST({trust} AS DOUBLE) AS c, true AS regex, match AS m FROM ({kept(kind, 'src')})" for k, (kind, trust) in enumerate(_TRUST.items()))
    return rf"""
        WITH src AS (SELECT turn_id, conversation_id, turn, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM session_turn),
        found AS ({found}),
        r AS ({resolved("SELECT * FROM found", "turn_id")}),
        u AS (SELECT turn_id, unnest(spans) AS x FROM r),
        o AS (SELECT turn_id, x, row_number() OVER (PARTITION BY turn_id ORDER BY x.s, x.e DESC) AS id FROM u),
        l AS (SELECT turn_id, count(*) AS n, list({{'t': '', 's': x.s, 'e': x.e, 'g': '<PII type="' || x.t || '" id="' || id || '"/>'}} ORDER BY x.s DESC, x.e DESC) AS xs FROM o GROUP BY turn_id),
        a AS (SELECT s.*, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN text ELSE list_reduce(list_prepend({{'t': text, 's': CAST(0 AS INTEGER), 'e': CAST(0 AS INTEGER), 'g': ''}}, xs), lambda a, b: {{'t': a.t[1:b.s] || b.g || a.t[b.e + 1:], 's': CAST(0 AS INTEGER), 'e': CAST(0 AS INTEGER), 'g': ''}}).t END AS tagged FROM src s LEFT JOIN l USING (turn_id)),
        t AS (SELECT turn_id AS result_id, tagged AS anonymized_text FROM a)
        SELECT turn_id, conversation_id, turn, tagged AS anonymized_text, CAST(n AS INTEGER) AS entity_count, CASE WHEN text IS NOT NULL THEN turn_id NOT IN (SELECT result_id FROM ({leaks_of("t")})) END AS leak_scan_passed FROM a
    """
