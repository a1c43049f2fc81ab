"""Readers of name, city, country and region lists in their public text formats."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Gender marks of the name list.
GENDER_MARKS = {"M": "male", "1M": "male", "?M": "male", "F": "female", "1F": "female", "?F": "female", "?": "neutral"}
# Columns of the city list.
CITY_NAME, CITY_ASCII, CITY_OTHERS, CITY_COUNTRY, CITY_POPULATION = 1, 2, 3, 8, 14
# Other names of countries.
COUNTRY_VARIANTS = {
    "United States": ("USA", "US", "America", "United States of America"),
    "United Kingdom": ("UK", "Britain", "Great Britain", "England"),
    "Germany": ("Deutschland",),
    "France": ("Frankreich",),
    "Spain": ("España", "Espana", "Spanien"),
    "Italy": ("Italia", "Italien"),
    "Netherlands": ("Holland", "The Netherlands", "Niederlande"),
    "Switzerland": ("Schweiz", "Suisse", "Svizzera"),
    "Austria": ("Österreich", "Oesterreich"),
    "Belgium": ("Belgien", "Belgique"),
    "Russia": ("Russland", "Russian Federation"),
    "China": ("People's Republic of China", "PRC"),
    "Japan": ("Nippon",),
    "South Korea": ("Korea", "Republic of Korea"),
    "United Arab Emirates": ("UAE", "Emirates"),
    "Czech Republic": ("Czechia", "Tschechien"),
}


# The files of the lists; the last may be missing.
FILES = {"names": "nam_dict.txt", "cities": "cities15000.txt", "countries": "countryInfo.txt", "regions": "admin1CodesASCII.txt"}
OPTIONAL = frozenset(["regions"])


def normal_gender(mark: Column) -> Column:
    """male, female or neutral for the marks of the name list and for these words; null for others."""
    words = GENDER_MARKS | {w.upper(): w for w in GENDER_MARKS.values()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.upper(F.trim(mark)))


def present(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Which of the lists' files the folder has."""
    where = spark._jvm.org.apache.hadoop.fs.Path
    files = where(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return {name: files.exists(where(posixpath.join(folder, file))) for name, file in FILES.items()}


def read_lists(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of all lists in a folder; an error names the files that are missing."""
    there = present(spark, folder)
    missing = [FILES[name] for name in FILES if not there[name] and name not in OPTIONAL]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    readers = {"names": read_names, "cities": read_cities, "countries": read_countries, "regions": read_regions}
    return {name: readers[name](spark, posixpath.join(folder, file)) for name, file in FILES.items() if there[name]}


def _numbered(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(n, line) of a text file that is read whole, as reference lists are; n counts from 0."""
    text = spark.read.option("encoding", encoding).text(path, wholetext=True)
    if encoding != "UTF-8":  # the text source knows UTF-8 only
        text = spark.read.format("binaryFile").load(path).select(F.decode("content", encoding).alias("value"))
    return text.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, gender); comment lines and those of multi-part marks are left out, the first entry of a name counts."""
    rows = _numbered(spark, path, "ISO-8859-1").where(~F.col("line").startswith("#") & F.col("line").rlike(r"\S") & (F.substring("line", 30, 1) != "+"))
    marks = F.create_map(*[F.lit(x) for pair in GENDER_MARKS.items() for x in pair])
    parsed = rows.select("n", F.try_element_at(marks, F.regexp_extract("line", r"^(\?M|\?F|1M|1F|M|F|\?)\s", 1)).alias("gender"), F.lower(F.regexp_extract("line", r"^\S+\s+(\S+)", 1)).alias("name"))
    return parsed.where("gender IS NOT NULL AND name <> ''").groupBy("name").agg(F.min_by("gender", "n").alias("gender"))


def _column(at: int) -> Column:
    return F.get(F.split("line", "\t"), F.lit(at))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """(name, country, population): each name, ASCII form and alternate name; of one name the most populous entry, the first of equal ones."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), (-F.monotonically_increasing_id()).alias("n")).where(F.size(F.split("line", "\t")) >= 15)
    others = F.filter(F.transform(F.split(_column(CITY_OTHERS), ","), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    names = F.array_distinct(F.filter(F.concat(F.array(_column(CITY_NAME), _column(CITY_ASCII)), others), lambda x: x != ""))
    flat = rows.select("n", F.explode(names).alias("name"), _column(CITY_COUNTRY).alias("country"), F.coalesce(F.expr(f"try_cast(get(split(line, '\\t'), {CITY_POPULATION}) AS BIGINT)"), F.lit(0)).alias("population"))
    return flat.groupBy(F.lower("name").alias("name")).agg(F.max_by("country", F.struct("population", "n")).alias("country"), F.max("population").alias("population"))


def country_names(name: Column, code: Column) -> Column:
    """All names under which a country is listed, in small letters: its name, its code and its variants."""
    variants = F.create_map(*[x for k, vs in COUNTRY_VARIANTS.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))])
    others = F.coalesce(F.try_element_at(variants, name), F.array().cast("array<string>"))
    return F.transform(F.array_compact(F.concat(F.array(name, code), others)), F.lower)


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(name, code): each country's name, code and variants; the last entry of a name counts."""
    rows = _numbered(spark, path).where(~F.col("line").startswith("#") & (F.size(F.split("line", "\t")) >= 5) & (_column(0) != "") & (_column(4) != ""))
    flat = rows.select("n", _column(0).alias("code"), F.explode(country_names(_column(4), _column(0))).alias("name"))
    return flat.groupBy("name").agg(F.max_by("code", "n").alias("code"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(name, country) from lines of ``CC.xx``, name and ASCII form; the last entry of a name counts."""
    rows = _numbered(spark, path).where((F.size(F.split("line", "\t")) >= 2) & _column(0).contains("."))
    flat = rows.select("n", F.element_at(F.split(_column(0), r"\."), 1).alias("country"), F.explode(F.array_distinct(F.array_compact(F.array(F.lower(_column(1)), F.lower(_column(2)))))).alias("name"))
    return flat.groupBy("name").agg(F.max_by("country", "n").alias("country"))
