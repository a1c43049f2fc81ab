"""Problem 2: mapping freely typed values to the entries of a canonical list.

A value is brought to one form (look-alike characters, case, accents) and searched, written without blanks and signs, by an
automaton that holds all canonical names and aliases at once. Of the mentions found the longest ones that do not overlap
win. Values without a mention go to token-set similarity: noise (numbers, generic words, names of a context list such as
countries) is set aside, abbreviated prefixes are spelled out, and the rest is compared with the names that share
enough pairs of letters, in either order of the tokens, by edits of neighbouring letters.

The lists are bounded (``MOST_ENTRIES``, about what an automaton in each worker's memory can hold) and travel with the tasks; every
value is mapped on its own, after the values were made distinct. Aliases, generic words and contexts are tables that the caller may pass.

Defined results: null and blank values are no cases and get no row from ``map_rows``; a value that is exactly a key or a
canonical name is left out there too, as it needs no mapping; everything else gets the key of one entry or ``unmatched``. Of entries
with the same name the one whose context (country) the value names wins, else the one of the highest weight, else the smallest key.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.lookalike import skeleton
from maskwright.runtime import bounded, cut, once

UNMATCHED = "unmatched"
MOST_ENTRIES = 100_000
#: Names that a joined prefix begins at least.
JOINED_PREFIX = 8
#: Edits allowed in a name of at least so many letters.
EDITS = ((14, 3), (8, 2), (4, 1))
_TOKENS = re.compile(r"[^\W\d_]+|\d+")

# Words around place names that do not change the place.
GENERIC = frozenset(
    "stadt city town village ville ciudad citta cidade comune commune gemeinde municipality municipio of de di the la centre center centro innenstadt zentrum downtown near bei "
    "greater area region raum metro".split()
)
# What countries are called beside their listed names, by code.
COUNTRY_ALIASES = {
    "DE": "Deutschland|Allemagne|Alemania|Germania|DEU|GER|D|BRD|Federal Republic of Germany|Bundesrepublik Deutschland",
    "AT": "Österreich|Oesterreich|Autriche|AUT|A|Republik Österreich|Republic of Austria",
    "CH": "Schweiz|Suisse|Suiza|Svizzera|CHE|Swiss Confederation|Confoederatio Helvetica",
    "FR": "Frankreich|Francia|FRA|F|République française|French Republic",
    "ES": "Spanien|España|Espagne|Spagna|ESP|E|Kingdom of Spain|Reino de España",
    "IT": "Italien|Italia|Italie|ITA|I|Italian Republic",
    "NL": "Niederlande|Pays-Bas|Países Bajos|Paesi Bassi|Nederland|Holland|NLD|The Netherlands",
    "BE": "Belgien|Belgique|Bélgica|Belgio|België|BEL|B|Kingdom of Belgium",
    "GB": "Vereinigtes Königreich|Royaume-Uni|Reino Unido|Regno Unito|Great Britain|Großbritannien|Grande-Bretagne|Britain|England|UK|U.K.|GBR",
    "IE": "Irland|Irlande|Irlanda|Éire|IRL|Republic of Ireland|Rep. of Ireland",
    "PT": "Portogallo|PRT|POR|Portuguese Republic|República Portuguesa",
    "PL": "Polen|Pologne|Polonia|Polska|POL|Republic of Poland",
    "CZ": "Czech Republic|Czech Rep.|Tschechien|Tchéquie|Chequia|Cechia|Česko|Tschechische Republik|CZE",
    "DK": "Dänemark|Danemark|Dinamarca|Danimarca|Danmark|DNK|Kingdom of Denmark",
    "SE": "Schweden|Suède|Suecia|Svezia|Sverige|SWE|Kingdom of Sweden",
    "US": "USA|U.S.A.|U.S.|United States of America|America|Vereinigte Staaten|Vereinigte Staaten von Amerika|États-Unis|Estados Unidos|Stati Uniti|EE. UU.",
    "NO": "Norwegen|Norvège|Noruega|Norvegia|Norge|NOR",
    "FI": "Finnland|Finlande|Finlandia|Suomi|FIN",
    "HU": "Ungarn|Hongrie|Hungría|Ungheria|Magyarország|HUN",
    "SK": "Slowakei|Slovaquie|Eslovaquia|Slovacchia|Slovensko|SVK",
    "GR": "Griechenland|Grèce|Grecia|Hellas|GRC",
    "LU": "Luxemburg|Luxemburgo|Lussemburgo|LUX",
    "CA": "Kanada|Canadá|CAN",
    "JP": "Japon|Japón|Giappone|Nippon|JPN",
}
# What genders are called, by listed value.
GENDER_ALIASES = {
    "male": "m|1m|?m|masculine|masc|man|boy|mann|männlich|männl|homme|masculin|masculino|hombre|varón|maschile|maschio|uomo|herr|mr",
    "female": "f|1f|?f|w|feminine|fem|woman|girl|frau|weiblich|weibl|femme|féminin|femenino|mujer|femminile|femmina|donna|mrs|ms",
    "neutral": "n|?|neuter|unisex|either|both|mixed|mixte|neutre|neutro|any|beides|divers|ambos|entrambi",
    "unknown": "u|unk|not known|unbekannt|inconnu|desconocido|sconosciuto|not specified|undefined",
}


@lru_cache(1 << 16)
def fold(text: str) -> str:
    """One form, small letters, without accents."""
    if text.isascii():
        return text.lower()
    plain = unicodedata.normalize("NFD", (skeleton(text) or "").casefold().replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l"))
    return "".join(ch for ch in plain if not unicodedata.combining(ch))


def spellings(text: str) -> set[str]:
    """The folded text, and the one with German vowels written out."""
    out = (skeleton(text) or "").casefold()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("å", "aa")):
        out = out.replace(a, b)
    return {fold(text), fold(out)}


def squeeze(text: str) -> str:
    return "".join(_TOKENS.findall(text))


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between a and b, or most + 1 if they are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def edits_allowed(length: int) -> int:
    return next((n for least, n in EDITS if length >= least), 0)


def _pairs(text: str) -> set[str]:
    return {text[i : i + 2] for i in range(len(text) - 1)}


@dataclass
class Entry:
    key: str
    name: str
    aliases: tuple[str, ...] = ()
    context: str | None = None
    weight: float = 0.0


@dataclass
class Canon:
    """A canonical list, ready to map values.

    ``short`` is the length up to which names and aliases must be a whole token; ``generic`` words and what ``contexts`` finds are noise beside a
    name. ``whole``: the value as a whole must be an alias, up to edits (for lists of words), instead of holding a mention.
    """

    entries: list[Entry]
    contexts: Canon | None = None
    generic: frozenset[str] = frozenset()
    short: int = 4
    whole: bool = False
    _ready: bool = field(default=False, repr=False)

    def __getstate__(self):
        return self.entries, self.contexts, self.generic, self.short, self.whole

    def __setstate__(self, state):
        self.__init__(*state)

    def _prepare(self) -> None:
        import ahocorasick

        if len(self.entries) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} entries")
        self._by_form: dict[str, list[Entry]] = defaultdict(list)
        self._tokens: dict[str, tuple[str, ...]] = {}
        firsts: Counter[str] = Counter()
        for entry in self.entries:
            for name in {entry.name, *entry.aliases}:
                for form in spellings(name):
                    flat = squeeze(form)
                    if flat and entry not in self._by_form[flat]:
                        self._by_form[flat].append(entry)
            firsts.update({t[0] for form in [fold(entry.name)] for t in [_TOKENS.findall(form)] if len(t) > 1})
        #: Words that begin several names; a mention right behind another such word is another name.
        self._prefixes = {w for w, n in firsts.items() if n >= 3 and len(w) > 1}
        flats = set(self._by_form)
        begins = Counter(form[:size] for form in flats for size in range(3, 10))
        longer: dict[str, int] = defaultdict(int)
        for begin, n in begins.items():
            longer[begin[:-1]] = max(longer[begin[:-1]], n)
        #: Joined prefixes: beginnings of many names, after which these go on in different ways.
        self._prefixes |= {b for b, n in begins.items() if n >= JOINED_PREFIX and 2 * longer[b] < n and len(b) < 9}
        self._automaton = ahocorasick.Automaton()
        for form in flats:
            if len(form) > self.short:
                self._automaton.add_word(form, form)
        if len(self._automaton):
            self._automaton.make_automaton()
        self._index: dict[str, list[str]] = defaultdict(list)
        for form in flats:
            for pair in _pairs(form):
                self._index[pair].append(form)
        self._ready = True

    def mentions(self, value: str) -> list[tuple[int, int, str]]:
        """The longest mentions that do not overlap, as (start, end, form) in the squeezed value."""
        flat, starts, ends = "", set(), set()
        for token in _TOKENS.findall(value):
            starts.add(len(flat))
            flat += token
            ends.add(len(flat))
        found = []
        if len(self._automaton):
            found = [(last + 1 - len(form), last + 1, form) for last, form in self._automaton.iter(flat)]
        at = 0
        for token in _TOKENS.findall(value):
            if len(token) <= self.short and token in self._by_form:
                found.append((at, at + len(token), token))
            at += len(token)
        found = [m for m in found if not any(flat[: m[0]].endswith(p) and not m[2].startswith(p) for p in self._prefixes)]
        found.sort(key=lambda m: (m[0] - m[1], m[0]))
        kept: list[tuple[int, int, str]] = []
        for m in found:
            if all(m[1] <= k[0] or m[0] >= k[1] for k in kept):
                kept.append(m)
        return kept

    def _choose(self, forms: Iterable[str], context: str | None) -> str:
        candidates = {e.key: e for form in forms for e in self._by_form[form]}.values()
        best = min(candidates, key=lambda e: (e.context is None or e.context != context, -e.weight, len(e.key), e.key))
        return best.key

    def _spelled_out(self, tokens: list[str]) -> list[list[str]]:
        """The tokens with a short first one replaced by each prefix that it may stand for."""
        out = [tokens]
        if len(tokens) > 1 and len(tokens[0]) < 4:
            for p in self._prefixes:
                if p[0] == tokens[0][0] and p != tokens[0] and not Counter(tokens[0]) - Counter(p):
                    out.append([p, *tokens[1:]])
        return out

    def _similar(self, tokens: list[str]) -> str | None:
        """The form closest to the tokens in either order, if close enough and closer than any other entry's."""
        turned = [tokens[1:] + tokens[:1], tokens[-1:] + tokens[:-1]] if len(tokens) > 1 else []
        best: list[tuple[float, str]] = []
        for order in {tuple(o) for base in [tokens, *turned] for o in self._spelled_out(list(base))}:
            flat = "".join(order)
            if len(flat) < 3:
                continue
            shared = Counter(f for pair in _pairs(flat) for f in self._index.get(pair, ()))
            for form, n in shared.items():
                allowed = edits_allowed(min(len(form), len(flat)))
                if n + 3 * allowed + 1 >= len(_pairs(form)) and (d := edits(flat, form, allowed)) <= allowed:
                    best.append((d, form))
        if not best:
            return None
        best.sort()
        rivals = [f for d, f in best if d == best[0][0]]
        listed = [f for f in rivals if any(f in {squeeze(x) for x in spellings(e.name)} for e in self._by_form[f])]
        rivals = listed or rivals  # a listed name before an alias
        best = [(best[0][0], f) for f in rivals]
        names = {e.name for f in rivals for e in self._by_form[f]}
        return best[0][1] if len(names) == 1 or best[0][0] == 0 else None

    def find(self, value: str | None) -> str | None:
        """The key that ``value`` stands for, ``unmatched``, or None for a null or blank value."""
        if value is None or not (skeleton(value) or "").strip():
            return None
        if not self._ready:
            self._prepare()
        folded = fold(value)
        context = None
        if self.whole:
            for form in spellings(value):
                if (flat := squeeze(form)) in self._by_form:
                    return self._choose([flat], None)
            if folded.strip() in {fold(a) for e in self.entries for a in (e.key, *e.aliases)}:
                return next(e.key for e in self.entries if folded.strip() in {fold(a) for a in (e.key, *e.aliases)})
            close = self._similar(_TOKENS.findall(folded)) if len(squeeze(folded)) > self.short else None
            return self._choose([close], None) if close else UNMATCHED
        mentions = self.mentions(folded)
        tokens = _TOKENS.findall(folded)
        if self.contexts is not None:
            context, tokens = self._context(folded, tokens, mentions)
        if mentions:
            return self._choose([mentions[0][2]], context)
        numberless = [t for t in tokens if not t.isdigit()]
        for rest in ([t for t in numberless if t not in self.generic], numberless, [t for t in _TOKENS.findall(folded) if not t.isdigit()]):
            if rest and (close := self._similar(rest)):
                return self._choose([close], context)
        glued = [t[len(g) :] for t in tokens for g in self.generic if len(g) > 3 and t.startswith(g) and len(t) > len(g) + 4]
        if len(glued) == 1 and (close := self._similar([*glued, *[t for t in tokens if not t.isdigit() and t not in self.generic][1:]])):
            return self._choose([close], context)
        return UNMATCHED

    def _context(self, folded: str, tokens: list[str], mentions: list[tuple[int, int, str]]) -> tuple[str | None, list[str]]:
        """The context that the value names beside a mention, and the tokens without it."""
        contexts = self.contexts
        if not contexts._ready:
            contexts._prepare()
        flat = "".join(tokens)
        masked = flat
        for a, b, _ in mentions[:1]:
            masked = flat[:a] + " " * (b - a) + flat[b:]
        words, at = [], 0
        for t in tokens:
            words.append(masked[at : at + len(t)].strip())
            at += len(t)
        found = None
        used: set[int] = set()
        for size in (4, 3, 2, 1):
            for i in range(len(words) - size + 1):
                span = range(i, i + size)
                form = "".join(words[i : i + size])
                if len(form) > 1 and all(words[k] for k in span) and not used & set(span) and form in contexts._by_form and len(tokens) > size:
                    found = found or contexts._by_form[form][0].key
                    used |= set(span)
        if found is None and tokens and not mentions:  # a code glued to the end or the start
            for form, entries in contexts._by_form.items():
                if len(form) == 2 and folded.rstrip().endswith(form) and len(tokens[-1]) > 6:
                    last = tokens[-1][:-2]
                    if self._similar([*[t for t in tokens[:-1] if not t.isdigit()], last]) and not self._similar([t for t in tokens if not t.isdigit()]):
                        return entries[0].key, [*tokens[:-1], last]
        return found, [t for k, t in enumerate(tokens) if k not in used]


def countries(rows: Iterable[tuple[str, str]], aliases: Mapping[str, str] = COUNTRY_ALIASES) -> Canon:
    """The list of countries from (code, name) rows; ``aliases`` has further names by code, divided by bars."""
    entries = [Entry(code, name, (code, *aliases.get(code, "").split("|"))) for code, name in rows]
    return Canon([Entry(e.key, e.name, tuple(a for a in e.aliases if a)) for e in entries], whole=True, short=3)


def genders(rows: Iterable[str], aliases: Mapping[str, str] = GENDER_ALIASES) -> Canon:
    return Canon([Entry(g, g, tuple(a for a in aliases.get(g, "").split("|") if a)) for g in rows], whole=True, short=3)


def cities(rows: Iterable[tuple[int, str, str | None, int | None]], of_countries: Canon, generic: frozenset[str] = GENERIC) -> Canon:
    """The list of cities from (id, name, country as typed, population) rows."""
    entries = []
    for key, name, country, population in rows:
        found = of_countries.find(country)
        entries.append(Entry(str(key), name, (), None if found == UNMATCHED else found, float(population or 0)))
    return Canon(entries, contexts=of_countries, generic=generic, short=4)


def map_values(canon: Canon, value: Column) -> Column:
    @once
    @F.arrow_udf(T.StringType())
    def find(values: pa.Array) -> pa.Array:
        of: Callable = lru_cache(1 << 16)(canon.find)
        return pa.array([of(v) for v in values.to_pylist()], pa.string())

    return find(value)


def map_rows(df: DataFrame, key: str, value: str, canon: Canon, exact: Iterable[str], field_name: str) -> DataFrame:
    """(field_name, row_id, ref_key) of the rows whose value is neither null nor blank nor one of the ``exact`` ones.

    Distinct values are mapped once, spread over as many tasks as a shuffle has, and joined back on the value.
    """
    spark = df.sparkSession
    listed = spark.createDataFrame([(x,) for x in sorted({x for x in exact if x is not None})], "value string")  # as bounded as the list
    rows = df.select(F.col(key).alias("row_id"), F.col(value).alias("value")).where(F.col("value").rlike(r"\S")).join(F.broadcast(listed), "value", "left_anti")
    spread = rows.select("value").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    mapped = cut(spread.withColumn("ref_key", map_values(canon, F.col("value"))))
    joined = rows.join(bounded(mapped), "value").where("ref_key IS NOT NULL")
    return joined.select(F.lit(field_name).alias("field_name"), "row_id", "ref_key")
