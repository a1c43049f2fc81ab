"""The queries of the training-data problems and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.llm import canonlist, disclosure, encode, language, lookalike, mixing, mojibake, pieces, variants
from maskwright.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = variants.variant_pairs(table(spark, sf_dir, "detected_entity"), "pii_type", "original")
    return pairs.select(F.col("kind").alias("pii_type"), F.col("text_a").alias("original_a"), F.col("text_b").alias("original_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda name, *columns: [tuple(r) for r in table(spark, sf_dir, name).select(*columns).limit(canonlist.MOST_ENTRIES + 1).collect()]
    country_rows, gender_rows = listed("country_entry", "country_code", "country_name"), listed("gender_value", "gender")
    city_rows = listed("city_entry", "city_id", "city_name", "country", "population")
    of_countries = canonlist.countries(country_rows)
    places = table(spark, sf_dir, "detected_entity").where("pii_type = 'LOCATION'")
    found = canonlist.map_rows(places, "entity_key", "original", canonlist.cities(city_rows, of_countries), [r[1] for r in city_rows], "detected_entity.original")
    found = found.unionAll(canonlist.map_rows(table(spark, sf_dir, "city_entry"), "city_id", "country", of_countries, [r[0] for r in country_rows], "city_entry.country"))
    genders = canonlist.genders([r[0] for r in gender_rows])
    return found.unionAll(canonlist.map_rows(table(spark, sf_dir, "name_entry"), "name_id", "gender", genders, [r[0] for r in gender_rows], "name_entry.gender"))


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, results, entities = (table(spark, sf_dir, n) for n in ("session_turn", "tagging_result", "detected_entity"))
    terms = disclosure.disclosure_table(entities, results.select("anonymized_text"))
    texts = turns.select(F.lit("session_turn").alias("source_table"), F.col("turn_id").alias("row_id"), "text")
    texts = texts.unionAll(results.select(F.lit("tagging_result"), "result_id", "anonymized_text"))
    return disclosure.find_personal(spark, texts, terms)


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "detected_entity").where("pii_type = 'ADDRESS' AND original IS NOT NULL")
    spans = F.filter(disclosure.structured_arrow(F.col("original")), lambda s: s.type.isin("EMAIL", "PHONE", "IBAN"))
    return wide.select(F.lit("detected_entity").alias("source_table"), F.col("entity_key").alias("row_id"), spans.alias("spans"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _personal(spark, sf_dir).unionAll(_addresses(spark, sf_dir)).select("source_table", "row_id", F.explode("spans").alias("s"))
    return found.select("source_table", "row_id", F.col("s.type").alias("pii_type"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _personal(spark, sf_dir).unionAll(_addresses(spark, sf_dir)).where(F.size("spans") > 0)
    texts = table(spark, sf_dir, "session_turn").select(F.lit("session_turn").alias("source_table"), F.col("turn_id").alias("row_id"), "text")
    texts = texts.unionAll(table(spark, sf_dir, "tagging_result").select(F.lit("tagging_result"), "result_id", "anonymized_text"))
    wide = table(spark, sf_dir, "detected_entity").where("pii_type = 'ADDRESS'").select(F.lit("detected_entity"), "entity_key", "original")
    return disclosure.masked(texts.unionAll(wide).join(found, ["source_table", "row_id"], "left"))


TURN_LANGS, DOCUMENT_LANGS = ("en", "de", "fr", "es", "it"), ("en", "de", "fr", "es")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, documents = table(spark, sf_dir, "session_turn"), table(spark, sf_dir, "documents")
    model = language.fit([(turns, "turn_id", "text", "locale"), (documents, "doc_id", "text", "lang")], TURN_LANGS)
    a = language.identify(spark, model, turns, "turn_id", "text", "locale", TURN_LANGS, "session_turn")
    return a.unionAll(language.identify(spark, model, documents, "doc_id", "text", "lang", DOCUMENT_LANGS, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.relabel_cases(_segments(spark, sf_dir)).select("source_table", "row_id", "seg_no", "lang")


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).drop("known_label", "n_segments")


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "session_turn").select("turn_id", "model_version", "text")
    return pieces.with_limits(turns, table(spark, sf_dir, "ner_model_config"), "model_version", "max_length", "piece_overlap", "is_default")


def _spans() -> Column:
    return pieces.piece_spans(F.col("text"), F.col("piece_limit"), F.col("piece_overlap"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _limited(spark, sf_dir).select("turn_id", F.size(_spans()).alias("n"))
    return spans.where("n > 1").select("turn_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(_limited(spark, sf_dir), "text", F.col("piece_limit"), F.col("piece_overlap"), keep=["turn_id"])


def p5_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each message: characters that its pieces cover, whether all are within the limit, and whether neighbours share the overlap."""
    spans = _limited(spark, sf_dir).where("text IS NOT NULL").withColumn("spans", _spans())
    ends = F.transform("spans", lambda s: s.end)
    begins = lambda s, i: (i == 0) & (s.start == 0) | (s.start == F.greatest(F.lit(0), F.get(ends, i - 1) - F.col("piece_overlap")))
    chained = F.forall(F.transform("spans", begins), lambda ok: ok)
    return spans.select("turn_id", F.array_max(ends).alias("n_chars"), F.forall("spans", lambda s: s.end - s.start <= F.col("piece_limit")).alias("within"), chained.alias("chained"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "span_match").select("text").unionAll(table(spark, sf_dir, "detected_entity").select("original"))
    return lookalike.equal_looking_pairs(values, "text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ids.select("doc_id", encode.decode_ids(F.col("ids")).alias("text"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"), "doc_id", "text", "source", ["is_mt", "office", "kind_code", "lang"])


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p8_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the share of each source within 3 % of its target among the sources that have documents, and no document used too often?"""
    there = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(1)))  # one row a source
    off = F.abs(F.col("actual_share") * there / F.col("target_share") - 1)
    return p8_shares(spark, sf_dir).select("source", ((F.col("tokens") == 0) | (off < 0.03)).alias("reached"), (F.col("most_copies") <= F.col("max_repeat")).alias("allowed"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_masked": p3_masked,
    "p4_found": p4_found,
    "p4_segments": p4_segments,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_cover": p5_cover,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_reached": p8_reached,
    "p9_found": p9_found,
    "p9_repaired": p9_repaired,
}

ORACLE_SQL: dict[str, str] = {
    "p5_found": """
        SELECT t.turn_id
        FROM session_turn t LEFT JOIN ner_model_config m ON t.model_version = m.model_version
        WHERE length(t.text) > coalesce(m.max_length, (SELECT max_length FROM ner_model_config WHERE is_default))
    """,
    "p5_cover": "SELECT turn_id, CAST(length(text) AS INTEGER) AS n_chars, true AS within, true AS chained FROM session_turn WHERE text IS NOT NULL",
    "p8_reached": "SELECT source, true AS reached, true AS allowed FROM source_target",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
