"""Gender of names and scope of places: by joins with tables of any size, or by look-ups in lists of a checked size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.patterns import SPACE, compiled
from maskwright.policy import Span
from maskwright.runtime import bounded, cut

#: Inhabitants from which a city goes before a region of its name.
BIG_CITY = 500_000
#: Entries of all lists together that may travel with the tasks; beyond it use the joins.
MOST_ENTRIES = 2_000_000
# Forms of address, kinds of places, articles, and letters without their accents.
_PREFIX = r"^(dr\.?|mr\.?|mrs\.?|ms\.?|prof\.?|rev\.?|sir|dame|lord|lady)"
_KIND = "(city|town|village|state|province|region|county)$"
_ARTICLE = "^(la|le|les|el|los|las|il|lo|gli|i|die|der|das|de|het)"
_ACCENTS, _PLAIN = "àáâãäåèéêëìíîïòóôõöùúûüñçø", "aaaaaaeeeeiiiiooooouuuunco"
_LIGATURES = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))
_WS = f"[{SPACE}]"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_WS}+|{_WS}+$", "")


def first_name(name: Column) -> Column:
    plain = F.regexp_replace(_trimmed(name), f"(?i){_PREFIX}{_WS}+", "")
    return F.nullif(F.element_at(F.split(plain, f"{_WS}+"), 1), F.lit(""))


def place_name(place: Column) -> Column:
    """Small letters, without a word for the kind of place behind it, single blanks."""
    return F.regexp_replace(F.regexp_replace(_trimmed(F.lower(place)), f"{_WS}+{_KIND}", ""), f"{_WS}+", " ")


def without_accents(text: Column) -> Column:
    plain = F.translate(text, _ACCENTS, _PLAIN)
    for a, b in _LIGATURES:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return plain


def place_variants(place: Column) -> Column:
    """Other spellings under which a place is looked up: without its article, without accents."""
    name = place_name(place)
    the = F.when(name.startswith("the "), F.substring(name, 5, 1000))
    article = F.regexp_replace(name, f"{_ARTICLE}{_WS}+", "")
    plain = without_accents(name)
    return F.array_compact(F.array(the, F.when(article != name, article), F.when(plain != name, plain)))


def infer_gender(rows: DataFrame, name: str, names: DataFrame, into: str = "gender", order: str | None = None) -> DataFrame:
    """``rows`` with the gender of the first name: a left join with (name, gender); ``unknown`` where the name is not listed.

    Of repeated names the first by the column ``order`` counts, without one the first by gender; entries without a gender and null names are not listed.
    """
    first = F.min_by("gender", order) if order else F.min("gender")
    listed = names.where("name IS NOT NULL AND gender IS NOT NULL").groupBy(F.lower("name").alias("_first")).agg(first.alias("_gender"))
    joined = rows.withColumn("_first", F.lower(first_name(F.col(name)))).join(bounded(cut(listed)), "_first", "left")
    return joined.withColumn(into, F.coalesce("_gender", F.lit("unknown"))).drop("_first", "_gender")


def classify_place(rows: DataFrame, place: str, countries: DataFrame, cities: DataFrame, regions: DataFrame | None = None, into: str = "scope") -> DataFrame:
    """``rows`` with the scope of a place: country, big city, region, other city, else ``unknown``, its country and the confidence.

    ``countries`` has (name, code), ``cities`` (name, country, population), ``regions`` (name, country). Each distinct place is looked up once, under its
    name (confidence 1) and then under its variants (0.9), and joined back on the place.
    """
    big = F.coalesce(F.col("population"), F.lit(0)) >= BIG_CITY
    listed = countries.select(F.lower("name").alias("_name"), F.lit(1).alias("_rank"), F.lit("country").alias("_scope"), F.col("code").alias("_code"))
    listed = listed.unionAll(cities.select(F.lower("name"), F.when(big, 2).otherwise(4), F.lit("city"), F.col("country")))
    if regions is not None:
        listed = listed.unionAll(regions.select(F.lower("name"), F.lit(3), F.lit("region"), F.col("country")))
    best = cut(listed.where("_name IS NOT NULL").groupBy("_name").agg(F.min(F.struct("_rank", "_scope", "_code")).alias("_best")))
    places = rows.select(F.col(place).alias("_place")).where("_place IS NOT NULL").distinct()
    tries = places.select("_place", F.posexplode(F.concat(F.array(place_name(F.col("_place"))), place_variants(F.col("_place")))).alias("_try", "_name"))
    found = cut(tries.join(bounded(best), "_name").groupBy("_place").agg(F.min(F.struct("_try", "_best")).alias("_hit")))
    joined = rows.join(bounded(found), rows[place] == F.col("_place"), "left")
    confidence = F.when(F.col("_hit").isNull(), 0.0).when(F.col("_hit._try") == 0, 1.0).otherwise(0.9)
    scope = F.coalesce("_hit._best._scope", F.lit("unknown"))
    return joined.withColumn(into, scope).withColumn(f"{into}_country", F.col("_hit._best._code")).withColumn(f"{into}_confidence", confidence).drop("_place", "_hit")


# --- the same as look-ups -----------------------------------------------------------------------------------------------

_STRIP = compiled(r"^\s+|\s+$")
_PREFIX_RX, _KIND_RX, _SPACES = compiled(_PREFIX + r"\s+", True), compiled(r"\s+" + _KIND), compiled(r"\s+")
_ARTICLE_RX = compiled(_ARTICLE + r"\s+")
_PLAIN_LETTERS = str.maketrans(dict(zip(_ACCENTS, _PLAIN, strict=True)) | dict(_LIGATURES))


@dataclass
class Lists:
    """Names, cities, countries and regions in memory, keys in small letters; ``names`` may have genders of a locale under (name, locale)."""

    names: dict = field(default_factory=dict)
    cities: dict[str, tuple[str | None, int]] = field(default_factory=dict)
    countries: dict[str, str] = field(default_factory=dict)
    regions: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, names: DataFrame | None = None, cities: DataFrame | None = None, countries: DataFrame | None = None, regions: DataFrame | None = None, most: int = MOST_ENTRIES) -> Lists:
        """From the tables of the readers; ``names`` may have a column locale. More than ``most`` entries are refused: use the joins."""
        out = cls()
        left = most
        for table, put in ((names, out._name), (cities, out._city), (countries, out._country), (regions, out._region)):
            rows = table.limit(left + 1).collect() if table is not None else []
            if len(rows) > left:
                raise ValueError(f"the lists have more than {most} entries; use infer_gender and classify_place")
            left -= len(rows)
            for r in rows:
                if r["name"] is not None:
                    put(r["name"].lower(), r.asDict())
        return out

    def _name(self, name: str, row: dict) -> None:
        if row["gender"] is not None:
            self.names.setdefault((name, row["locale"]) if row.get("locale") else name, row["gender"])

    def _city(self, name: str, row: dict) -> None:
        if name not in self.cities or (row["population"] or 0) > self.cities[name][1]:
            self.cities[name] = (row["country"], row["population"] or 0)

    def _country(self, name: str, row: dict) -> None:
        self.countries[name] = row["code"]

    def _region(self, name: str, row: dict) -> None:
        self.regions[name] = row["country"]

    def sizes(self) -> dict[str, int]:
        return {n: len(getattr(self, n)) for n in ("names", "cities", "countries", "regions")}

    def gender(self, name: str, locale: str | None = None) -> str:
        """Gender of a name's first part, that of the locale's language before the general one; ``unknown`` if it is not listed."""
        first = self._first(name)
        return self.names.get((first, (locale or "").split("-")[0])) or self.names.get(first) or "unknown"

    def _first(self, name: str) -> str:
        return _SPACES.split(_PREFIX_RX.sub("", _STRIP.sub("", name)))[0].lower()

    def has_name(self, name: str) -> bool:
        return self._first(name) in self.names

    def _place(self, name: str) -> tuple[str, str | None] | None:
        if name in self.countries:
            return "country", self.countries[name]
        city = self.cities.get(name)
        if city and city[1] >= BIG_CITY or city and name not in self.regions:
            return "city", city[0]
        return ("region", self.regions[name]) if name in self.regions else None

    def has_place(self, place: str) -> bool:
        return self._place(_place_name(place)) is not None

    def scope(self, place: str) -> tuple[str, str | None, float]:
        """(scope, country, confidence) of a place."""
        name = _place_name(place)
        if hit := self._place(name):
            return *hit, 1.0
        the, article, plain = name.removeprefix("the "), _ARTICLE_RX.sub("", name), name.translate(_PLAIN_LETTERS)
        hit = next((h for v in (the, article, plain) if v != name and (h := self._place(v))), None)
        return (*hit, 0.9) if hit else ("unknown", None, 0.0)

    def enrich(self, spans: Sequence[Span], locale: str | None = None) -> list[Span]:
        """Spans of persons with a gender, spans of places with a scope."""
        return [replace(s, gender=self.gender(s.text, locale)) if s.type == "PERSON" else replace(s, scope=self.scope(s.text)[0]) if s.type == "LOCATION" else s for s in spans]


def _place_name(place: str) -> str:
    return _SPACES.sub(" ", _KIND_RX.sub("", _STRIP.sub("", place.lower())))
