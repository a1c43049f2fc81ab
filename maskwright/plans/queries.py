"""Queries over the operators, each on whole tables, and their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import checks as C
from maskwright.functions import patterns as P
from maskwright.operators import crypto, ner, semantic, session, spans, tag, titles, validate
from maskwright.operators.recognise import detect
from maskwright.operators.resolve import apply_allowlist, filter_policy, outside_protected, remove_overlaps_column
from maskwright.plans import oracle as O
from maskwright.plans.engine import Engine
from maskwright.policy import ALL_TYPES, REGEX_TYPES, SPAN, TYPE_PRIORITY, Policy
from maskwright.runtime import ensure_checkpoint_dir, table
from maskwright.sources import store
from maskwright.sources.semantic import country_names, normal_gender

KEY = bytes(range(32))
ALLOWED = ("n/a", "remote", "unknown", "hq")
NEW_TIME, OLD_TIME = 1_900_000_000_000, 1_735_000_000_000


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages, anonymised: one row a message."""
    turns = table(spark, sf_dir, "session_turn").select("turn_id", "conversation_id", "turn", "text")
    done = Engine().anonymise(turns, "text")
    return done.select("turn_id", "conversation_id", "turn", "anonymized_text", "entity_count", "leak_scan_passed")


def _found(spark: SparkSession, sf_dir: str, kind: str, text: F.Column | None = None) -> DataFrame:
    """(turn_id, ord, start_pos, end_pos, match) of one type in the messages."""
    only = Policy().merge(enabled=frozenset([kind]), regex_enabled=frozenset([kind]))
    rows = table(spark, sf_dir, "session_turn").select("turn_id", F.posexplode(detect(F.col("text") if text is None else text, only)).alias("i", "s"))
    return rows.select("turn_id", (F.col("i") + 1).alias("ord"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.text").alias("match"))


def _originals(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "detected_entity").where((F.col("pii_type") == kind) & F.col("original").isNotNull()).select("entity_key", "original")


def email_spans(spark, sf_dir):
    return _found(spark, sf_dir, "EMAIL")


def _address() -> F.Column:
    k = F.col("turn_id")
    return F.concat_ws(".", *[F.pmod(k * m, F.lit(n)).cast("string") for m, n in ((7, 300), (13, 256), (29, 300), (31, 11))])


def ip_spans(spark, sf_dir):
    """Messages signed with made-up addresses, some of them none: numbers over 255, versions of small numbers."""
    k = F.col("turn_id")
    six = F.concat(F.lower(F.hex(F.pmod(k * 37, F.lit(70000)))), F.lit("::"), F.lower(F.hex(F.pmod(k * 11, F.lit(4096)))))
    return _found(spark, sf_dir, "IP_ADDRESS", F.concat(F.coalesce("text", F.lit("")), F.lit("\nfrom "), _address(), F.lit(" or "), six, F.lit(" v"), F.pmod(k, F.lit(9)).cast("string"), F.lit(".0.1.2")))


def bic_spans(spark, sf_dir):
    return _found(spark, sf_dir, "BIC_SWIFT")


def phone_spans(spark, sf_dir):
    return _found(spark, sf_dir, "PHONE")


def iban_spans(spark, sf_dir):
    return _found(spark, sf_dir, "IBAN")


def card_spans(spark, sf_dir):
    return _found(spark, sf_dir, "CREDIT_CARD")


def url_spans(spark, sf_dir):
    """Messages with made-up links, one within another, with signs behind them, and without a domain."""
    k = F.col("turn_id").cast("string")
    link = F.concat(F.lit("\n(https://www.shop"), k, F.lit(".example/a?b="), k, F.lit("&c=1). www.site"), k, F.lit(".test, http://x"), k, F.lit(" mailto:a"), k, F.lit("@mail.example!"))
    return _found(spark, sf_dir, "URL", F.concat(F.coalesce("text", F.lit("")), link))


def case_id_spans(spark, sf_dir):
    return _found(spark, sf_dir, "CASE_ID")


def iban_check(spark, sf_dir):
    o = F.col("original")
    return _originals(spark, sf_dir, "IBAN").select("entity_key", C.iban_column(o).alias("valid"), C.iban_format_column(o).alias("grouped"))


def card_check(spark, sf_dir):
    o = F.col("original")
    return _originals(spark, sf_dir, "CREDIT_CARD").select("entity_key", C.card_column(o).alias("valid"), C.brand_column(o).alias("brand"), C.digits_column(o).alias("digits"))


def phone_check(spark, sf_dir):
    o = F.col("original")
    return _originals(spark, sf_dir, "PHONE").select("entity_key", C.phone_column(o).alias("valid"), C.phone_normal_column(o).alias("normal"))


def luhn_digit(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.luhn_digit_column(F.col("c_custkey").cast("string")).alias("digit"))


def ip_internal(spark, sf_dir):
    k = F.col("o_orderkey")
    ip = F.concat_ws(".", *[F.pmod(k * m, F.lit(256)).cast("string") for m in (7, 13, 29, 31)])
    return table(spark, sf_dir, "orders").select("o_orderkey", ip.alias("ip"), C.internal_ipv4_column(ip).alias("internal"))


def url_domain(spark, sf_dir):
    plain = _originals(spark, sf_dir, "EMAIL").where(F.col("original").rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+$"))
    url = F.concat(F.lit("https://www."), F.regexp_extract("original", "@(.*)$", 1), F.lit("/a?b=c"))
    return plain.select("entity_key", C.domain_column(url).alias("domain"))


def prenormalised(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "session_turn").select("turn_id", spans.prenormalise(t).alias("normal"), spans.to_normalised_offset(t, F.length(t)).alias("end_offset"), spans.to_original_offset(t, F.lit(40)).alias("original_40"), spans.utf16_offset(t, F.length(t)).alias("utf16_length"))


def _span_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of each message as an array of spans, in order of their key."""
    rows = table(spark, sf_dir, "span_match").where("result_id IS NOT NULL AND start_pos < end_pos AND confidence IS NOT NULL")
    span = F.struct(
        F.col("pii_type").alias("type"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "confidence", "source", "text", F.lit(None).cast(SPAN["semantic"].dataType).alias("semantic")
    )
    keyed = rows.select("result_id", F.struct("span_key", span.alias("s")).alias("k")).groupBy("result_id").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    return keyed.select("result_id", F.col("ks.s").alias("spans"))


def resolved_spans(spark, sf_dir):
    kept = remove_overlaps_column(filter_policy(F.col("spans"), Policy()), SPAN.simpleString(), Policy())
    rows = _span_arrays(spark, sf_dir).select("result_id", F.explode(kept).alias("s"))
    return rows.select("result_id", F.col("s.type").alias("pii_type"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


def policy_filter(spark, sf_dir):
    policy = Policy(allowlist=frozenset(ALLOWED))
    kept = apply_allowlist(filter_policy(F.col("spans"), policy), policy)
    return _span_arrays(spark, sf_dir).select("result_id", F.explode(kept).alias("s")).groupBy(F.col("s.type").alias("pii_type")).agg(F.count(F.lit(1)).alias("n"))


def protected_spans(spark, sf_dir):
    """Matches of models that meet no match of a pattern."""
    places = F.filter("spans", lambda s: s.source == "REGEX")
    left = outside_protected(F.filter("spans", lambda s: s.source != "REGEX"), places)
    return _span_arrays(spark, sf_dir).select("result_id", F.explode(left).alias("s")).select("result_id", F.col("s.type").alias("pii_type"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


def denied(spark, sf_dir):
    """What a deny list adds to messages in which nothing else is looked for."""
    only = Engine(Policy(enabled=frozenset(), denylist=("account|compte|cuenta|conto|Konto",)))
    turns = table(spark, sf_dir, "session_turn").select("turn_id", "text")
    return only.anonymise(turns, "text").select("turn_id", F.explode("entities").alias("e")).select("turn_id", F.col("e.id").alias("tag_id"), F.col("e.start").alias("start_pos"), F.col("e.text").alias("match"))


def overlap_pairs(spark, sf_dir):
    return spans.overlap_pairs(table(spark, sf_dir, "span_match"), "result_id", "span_key", "start_pos", "end_pos")


def no_overlap_results(spark, sf_dir):
    return _span_arrays(spark, sf_dir).select("result_id", spans.no_overlaps(F.col("spans")).alias("disjoint"))


def offset_adjustments(spark, sf_dir):
    rows = table(spark, sf_dir, "detected_entity").where("start_pos IS NOT NULL AND end_pos IS NOT NULL").groupBy("result_id", "start_pos", "end_pos").agg(F.max("pii_type").alias("pii_type"), F.max("tag_id").alias("tag_id"))
    size = F.length(tag.tag_column(F.col("pii_type"), F.coalesce("tag_id", F.lit(0))))
    out = spans.offset_adjustments(rows, "result_id", "start_pos", "end_pos", size)
    return out.select("result_id", "start_pos", "end_pos", *[F.col(c).cast("bigint").alias(c) for c in ("new_start", "new_end", "delta")])


def counts_by_type(spark, sf_dir):
    counts = table(spark, sf_dir, "detected_entity").groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"))
    types = spark.createDataFrame([(t,) for t in ALL_TYPES], "pii_type string")
    return types.join(counts, "pii_type", "left").select("pii_type", F.coalesce("n", F.lit(0)).alias("n"))


def tags_found(spark, sf_dir):
    rows = table(spark, sf_dir, "tagging_result").select("result_id", F.explode(tag.tags_of(F.col("anonymized_text"))).alias("t"))
    return rows.select("result_id", F.col("t.type").alias("pii_type"), F.col("t.id").alias("tag_id"))


def tags_strict(spark, sf_dir):
    rows = table(spark, sf_dir, "tagging_result").select("result_id", F.explode(tag.tags_of(F.col("anonymized_text"), strict=True)).alias("t"))
    return rows.select("result_id", F.col("t.type").alias("pii_type"), F.col("t.id").alias("tag_id"), F.col("t.gender").alias("gender"))


def rehydrated(spark, sf_dir):
    engine = Engine()
    done = engine.anonymise(table(spark, sf_dir, "session_turn").select("turn_id", "text"), "text")
    return engine.rehydrate(done, "anonymized_text", "originals").select("turn_id", "restored")


def leak_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "tagging_result").select("result_id", F.explode(validate.leak_column(F.col("anonymized_text"))).alias("l"))
    return rows.select("result_id", "l.kind", "l.match", F.col("l.position").alias("position"))


def _damaged() -> F.Column:
    """Anonymised texts, in three of seven of which tags lose their slash, become entities or lose their number's quotes."""
    t, k = F.col("anonymized_text"), F.pmod(F.col("result_id"), F.lit(7))
    return F.when(k == 1, F.regexp_replace(t, "/>", ">")).when(k == 2, F.regexp_replace(t, "<PII", "&lt;PII")).when(k == 3, F.regexp_replace(t, 'id="([0-9]+)"', "id=$1")).otherwise(t)


def malformed_tags(spark, sf_dir):
    return table(spark, sf_dir, "tagging_result").select("result_id", F.explode(validate.malformed_tags(_damaged())).alias("matched"))


def missing_tags(spark, sf_dir):
    """Entities recorded for a message whose number no tag of the message, damaged or not, bears."""
    entities = table(spark, sf_dir, "detected_entity").select("result_id", "tag_id").where("tag_id IS NOT NULL").distinct()
    present = table(spark, sf_dir, "tagging_result").select("result_id", F.explode(tag.tags_of(_damaged())).alias("t")).select("result_id", F.col("t.id").alias("tag_id"))
    return entities.join(present, ["result_id", "tag_id"], "left_anti")


def validation_errors(spark, sf_dir):
    """Errors by code of every result, its tags damaged in part, against the entities recorded for it."""
    span = F.struct("entity_key", F.struct(F.col("pii_type").alias("type"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.coalesce("original", F.lit("")).alias("text"), F.col("tag_id").alias("id")).alias("e"))
    whole = table(spark, sf_dir, "detected_entity").where("tag_id IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL")
    entities = whole.groupBy("result_id").agg(F.array_sort(F.collect_list(span)).alias("es")).select("result_id", F.col("es.e").alias("es"))
    rows = table(spark, sf_dir, "tagging_result").withColumn("damaged", _damaged()).select("result_id", "damaged").join(entities, "result_id", "left")
    flat = rows.select("result_id", F.explode(validate.error_column(F.col("damaged"), F.col("es"))).alias("x"))
    return flat.groupBy("result_id", F.col("x.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def _session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "tagging_result").select("result_id", "turn")
    entities = table(spark, sf_dir, "detected_entity").where("original IS NOT NULL AND conversation_id IS NOT NULL AND start_pos IS NOT NULL")
    rows = entities.join(results, "result_id").select("conversation_id", "turn", "start_pos", "pii_type", "original")
    return rows.where("turn IS NOT NULL").distinct()


def session_ids(spark, sf_dir):
    return session.number_entities(_session_rows(spark, sf_dir), "conversation_id", "turn", "start_pos", "pii_type", "original")


def session_ids_reused(spark, sf_dir):
    return session.number_entities(_session_rows(spark, sf_dir), "conversation_id", "turn", "start_pos", "pii_type", "original", reuse=True)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "session_turn").where("conversation_id IS NOT NULL AND turn IS NOT NULL").select("conversation_id", "turn", "turn_id", "text")


def _sessions(spark: SparkSession):
    """Sessions over a store of their own, in the shared folder."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/maps-{uuid.uuid4().hex}"
    return Engine(store=store.MapStore(spark, place), key=crypto.MemoryKey(KEY)).sessions()


def session_round_trip(spark, sf_dir):
    """All messages of all conversations anonymised, their maps sealed and stored, and the messages restored from the store."""
    sessions = _sessions(spark)
    done = sessions.anonymise(_turns(spark, sf_dir), "conversation_id", "turn", "turn_id", "text", now=NEW_TIME)
    return sessions.rehydrate(done, "conversation_id", "turn_id", "anonymized_text").select("turn_id", "restored")


def session_merge(spark, sf_dir):
    """Messages anonymised in two batches, the earlier turns first, against all of them at once: do the texts agree?"""
    turns, parts = _turns(spark, sf_dir), _sessions(spark)
    whole = _sessions(spark).anonymise(turns, "conversation_id", "turn", "turn_id", "text", now=NEW_TIME)
    batches = [parts.anonymise(turns.where(w), "conversation_id", "turn", "turn_id", "text", now=NEW_TIME) for w in ("turn < 6", "turn >= 6")]
    both = batches[0].unionByName(batches[1]).select("turn_id", F.col("anonymized_text").alias("again"))
    return whole.join(both, "turn_id").select("turn_id", F.col("anonymized_text").eqNullSafe(F.col("again")).alias("same"))


def session_counts(spark, sf_dir):
    return session.session_counts(table(spark, sf_dir, "detected_entity"), "conversation_id", "pii_type")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version of every stored map, and a new conversation for each."""
    rows = table(spark, sf_dir, "stored_map").drop("updated_at")
    again = rows.withColumn("ciphertext", F.reverse("ciphertext")).withColumn("model_version", F.lit(None).cast("string"))
    fresh = rows.withColumn("conversation_id", F.concat("conversation_id", F.lit("-new"))).withColumn("created_at", F.lit(None).cast("bigint"))
    return again.unionByName(fresh)


def store_upsert(spark, sf_dir):
    out = store.upsert(table(spark, sf_dir, "stored_map"), _changes(spark, sf_dir), NEW_TIME)
    return out.select("conversation_id", "ciphertext", "model_version", "created_at", "updated_at", F.coalesce(F.size("entity_counts"), F.lit(-1)).alias("n_types"))


def store_list(spark, sf_dir):
    return store.listing(table(spark, sf_dir, "stored_map"), 20, OLD_TIME).select("conversation_id", "created_at")


def store_cleanup(spark, sf_dir):
    return store.without_older(table(spark, sf_dir, "stored_map"), OLD_TIME).select("conversation_id")


def crypto_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "detected_entity").where("original IS NOT NULL")
    sealed = crypto.encrypt_map(F.create_map(F.concat_ws("_", "pii_type", F.col("tag_id").cast("string")), F.col("original")), KEY)
    return rows.select("entity_key", F.element_at(F.map_values(crypto.decrypt_map(sealed, KEY)), 1).alias("original"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "name_entry").select(F.col("first_name").alias("name"), normal_gender(F.col("gender")).alias("gender"), "name_id")


def gender_lookup(spark, sf_dir):
    return semantic.infer_gender(_originals(spark, sf_dir, "PERSON"), "original", _names(spark, sf_dir), order="name_id").select("entity_key", "gender")


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    countries = table(spark, sf_dir, "country_entry").select(F.explode(country_names(F.col("country_name"), F.col("country_code"))).alias("name"), F.col("country_code").alias("code"))
    cities = table(spark, sf_dir, "city_entry").select(F.col("city_name").alias("name"), "country", "population")
    return semantic.classify_place(_originals(spark, sf_dir, "LOCATION"), "original", countries, cities)


def location_scope(spark, sf_dir):
    return _scoped(spark, sf_dir).select("entity_key", "scope", F.col("scope_confidence").alias("confidence"))


def enriched_tags(spark, sf_dir):
    """The tags of persons with their gender and of places with their scope."""
    people = semantic.infer_gender(_originals(spark, sf_dir, "PERSON"), "original", _names(spark, sf_dir), order="name_id").select("entity_key", tag.tag_column(F.lit("PERSON"), F.col("entity_key"), gender=F.col("gender")).alias("tag"))
    return people.unionAll(_scoped(spark, sf_dir).select("entity_key", tag.tag_column(F.lit("LOCATION"), F.col("entity_key"), scope=F.col("scope"))))


def title_extract(spark, sf_dir):
    o = F.col("original")
    return _originals(spark, sf_dir, "PERSON").select("entity_key", titles.title_column(o).alias("title"), titles.name_column(o).alias("name"))


def bio_decode(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "N", F.when(F.col("l_linestatus") == "O", "B-PER").otherwise("I-PER")).when(F.col("l_returnflag") == "A", "I-ORG").otherwise("O")
    tokens = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(label).alias("label"))
    tokens = tokens.select("*", (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + 5).alias("e"), F.lit(0.5).alias("c"))
    found = ner.decode_labels_frame(tokens, "l_orderkey", "l_linenumber", "label", "s", "e", "c")
    return found.select("l_orderkey", "label", F.col("start").cast("bigint").alias("start_pos"), F.col("end").cast("bigint").alias("end_pos"))


def hourly_counts(spark, sf_dir):
    from maskwright.streaming.sessions import counts_in_windows

    rows = table(spark, sf_dir, "detected_entity").where("ingested_at IS NOT NULL")
    return counts_in_windows(rows, "ingested_at", "pii_type").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


_WS, _LUHN_SQL = O.WS, O.LUHN
_TITLE_RX = "|".join(t.replace(".", "\\.").replace("-", "\\-") for t in titles.titles()).replace("'", "''")
_QUOTES = "[\"''`«»‘’‚“”„]"
_G0, _G1 = _WS[:-1] + "\\x{200b}]*", _WS[:-1] + "\\x{200b}]+"
_TYPE_RX, _ID_RX = f"type{_G0}={_G0}{_QUOTES}([A-Z_]+){_QUOTES}", f"id{_G0}={_G0}{_QUOTES}([0-9]+)(?:/?(?:>|&gt;)?)?{_QUOTES}"
_EXTRA_RX = "".join(f"(?:{_G0}{n}{_G0}={_G0}{_QUOTES}(?:[A-Za-z0-9_]+){_QUOTES})?" for n in ("gender", "scope"))
_TAG_RX = (f"(?i)(?:<|&lt;){_G0}PII{_G1}{_TYPE_RX}{_EXTRA_RX}{_G1}{_ID_RX}", f"(?i)(?:<|&lt;){_G0}PII{_G1}{_ID_RX}{_G1}{_TYPE_RX}")
_TYPES_SQL = ", ".join(f"('{t}')" for t in ALL_TYPES)

def _tags_of(source: str) -> str:
    return f"""
    WITH t AS (
        SELECT result_id, unnest(regexp_extract_all(anonymized_text, '{_TAG_RX[0]}', 1)) AS k, unnest(regexp_extract_all(anonymized_text, '{_TAG_RX[0]}', 2)) AS i FROM {source}
        UNION ALL SELECT result_id, unnest(regexp_extract_all(anonymized_text, '{_TAG_RX[1]}', 2)), unnest(regexp_extract_all(anonymized_text, '{_TAG_RX[1]}', 1)) FROM {source}
    )
    SELECT result_id, upper(k) AS pii_type, CAST(i AS INTEGER) AS tag_id FROM t WHERE upper(k) IN (SELECT * FROM (VALUES {_TYPES_SQL}))
"""


_SESSION_SQL = """
    WITH r AS (
        SELECT DISTINCT e.conversation_id, t.turn, e.start_pos, e.pii_type, e.original FROM detected_entity e JOIN tagging_result t USING (result_id)
        WHERE e.original IS NOT NULL AND e.conversation_id IS NOT NULL AND e.start_pos IS NOT NULL AND t.turn IS NOT NULL
    ),
    f AS (SELECT *, turn = min(turn) OVER v AS in_first, row_number() OVER (PARTITION BY conversation_id, pii_type, original ORDER BY turn, start_pos) AS k FROM r WINDOW v AS (PARTITION BY conversation_id, pii_type, original)),
    n AS (SELECT *, {new} AS is_new FROM f),
    c AS (SELECT *, sum(CAST(is_new AS INTEGER)) OVER (PARTITION BY conversation_id ORDER BY turn, start_pos, pii_type, original) AS c FROM n)
    SELECT conversation_id, turn, start_pos, pii_type, original, CAST(CASE WHEN is_new THEN c ELSE max(CASE WHEN is_new THEN c END) OVER (PARTITION BY conversation_id, pii_type, original) END AS INTEGER) AS session_entity_id FROM c
"""
_DAMAGED_SQL = """CASE result_id % 7 WHEN 1 THEN replace(anonymized_text, '/>', '>') WHEN 2 THEN replace(anonymized_text, '<PII', '&lt;PII') WHEN 3 THEN regexp_replace(anonymized_text, 'id="([0-9]+)"', 'id=\\1', 'g') ELSE anonymized_text END"""
_DAMAGED_TABLE = f"(SELECT result_id, {_DAMAGED_SQL} AS anonymized_text FROM tagging_result)"
# What a leak scan looks for.
_LEAKS_SQL = {
    "EMAIL": "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}",
    "PHONE": "(?:\\+|00)[1-9][0-9]{7,14}|0[1-9][0-9]{6,11}",
    "IBAN": "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "CREDIT_CARD": f"[0-9]{{4}}{_WS[:-1]}-]?[0-9]{{4}}{_WS[:-1]}-]?[0-9]{{4}}{_WS[:-1]}-]?[0-9]{{4}}",
    "IP_ADDRESS": "(?:[0-9]{1,3}\\.){3}[0-9]{1,3}",
}


def _leaks_of(source: str) -> str:
    """(result_id, kind, match, position) of leaks in (result_id, anonymized_text), those inside a bracket of the unblanked text left out."""
    blanked = "regexp_replace(anonymized_text, '<PII[^>]*/>', repeat(' ', 20), 'g')"
    each = " UNION ALL ".join(
        f"SELECT result_id, anonymized_text AS t, '{kind}' AS kind, regexp_extract_all({blanked}, '{rx}') AS found, string_split_regex({blanked}, '{rx}') AS gaps FROM {source} WHERE anonymized_text IS NOT NULL" for kind, rx in _LEAKS_SQL.items()
    )
    return f"""
        SELECT result_id, kind, match, position FROM (
            SELECT *, least(position + 1, length(t)) - (strpos(reverse(t[1:position + 1]), '<') - 1) AS opened FROM (
                SELECT result_id, t, kind, found[i] AS match, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS position
                FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ({each}))))
        WHERE NOT (strpos(t[1:position + 1], '<') > 0 AND strpos(t[opened:], '>') > 0 AND position + 1 > opened AND position + 1 < opened + strpos(t[opened:], '>') - 1)
    """




def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


_GENDER_SQL = f"""
    WITH p AS (SELECT entity_key, lower(nullif(string_split_regex(regexp_replace({_trim("original")}, '(?i)^(dr\\.?|mr\\.?|mrs\\.?|ms\\.?|prof\\.?|rev\\.?|sir|dame|lord|lady){_WS}+', ''), '{_WS}+')[1], '')) AS f FROM detected_entity WHERE pii_type = 'PERSON' AND original IS NOT NULL),
    m AS (SELECT lower(first_name) AS f, name_id, CASE WHEN upper(trim(gender)) IN ('M', '1M', '?M', 'MALE') THEN 'male' WHEN upper(trim(gender)) IN ('F', '1F', '?F', 'FEMALE') THEN 'female' WHEN upper(trim(gender)) IN ('?', 'NEUTRAL') THEN 'neutral' END AS g FROM name_entry),
    n AS (SELECT f, arg_min(g, name_id) AS gender FROM m WHERE f IS NOT NULL AND g IS NOT NULL GROUP BY f)
    SELECT entity_key, coalesce(n.gender, 'unknown') AS gender FROM p LEFT JOIN n ON p.f = n.f
"""
# Other names of the listed countries, by the name that is listed.
_SCOPE_SQL = f"""
    WITH v(name, other) AS (VALUES ('United States', 'usa'), ('United States', 'us'), ('United States', 'america'), ('United States', 'united states of america'), ('United Kingdom', 'uk'), ('United Kingdom', 'britain'),
        ('United Kingdom', 'great britain'), ('United Kingdom', 'england'), ('Germany', 'deutschland'), ('France', 'frankreich'), ('Spain', 'españa'), ('Spain', 'espana'), ('Spain', 'spanien'), ('Italy', 'italia'), ('Italy', 'italien'),
        ('Netherlands', 'holland'), ('Netherlands', 'the netherlands'), ('Netherlands', 'niederlande'), ('Switzerland', 'schweiz'), ('Switzerland', 'suisse'), ('Switzerland', 'svizzera'), ('Austria', 'österreich'), ('Austria', 'oesterreich'),
        ('Belgium', 'belgien'), ('Belgium', 'belgique'), ('Japan', 'nippon'), ('Czech Republic', 'czechia'), ('Czech Republic', 'tschechien')),
    l AS (SELECT lower(country_name) AS name, 1 AS rank, 'country' AS scope FROM country_entry UNION ALL SELECT lower(country_code), 1, 'country' FROM country_entry
        UNION ALL SELECT other, 1, 'country' FROM v JOIN country_entry c ON c.country_name = v.name UNION ALL SELECT lower(city_name), 2, 'city' FROM city_entry),
    b AS (SELECT name, arg_min(scope, rank) AS scope FROM l WHERE name IS NOT NULL GROUP BY name),
    p AS (SELECT entity_key, regexp_replace(regexp_replace({_trim("lower(original)")}, '{_WS}+(city|town|village|state|province|region|county)$', ''), '{_WS}+', ' ', 'g') AS n FROM detected_entity WHERE pii_type = 'LOCATION' AND original IS NOT NULL),
    t AS (SELECT *, CASE WHEN n LIKE 'the %' THEN n[5:] END AS a, regexp_replace(n, '^(la|le|les|el|los|las|il|lo|gli|i|die|der|das|de|het){_WS}+', '') AS c,
        replace(replace(replace(translate(n, 'àáâãäåèéêëìíîïòóôõöùúûüñçø', 'aaaaaaeeeeiiiiooooouuuunco'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe') AS d FROM p)
    SELECT entity_key, coalesce(b0.scope, b1.scope, b2.scope, b3.scope, 'unknown') AS scope, CASE WHEN b0.scope IS NOT NULL THEN 1.0 WHEN coalesce(b1.scope, b2.scope, b3.scope) IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence
    FROM t LEFT JOIN b b0 ON b0.name = t.n LEFT JOIN b b1 ON b1.name = t.a LEFT JOIN b b2 ON b2.name = t.c LEFT JOIN b b3 ON b3.name = t.d
"""
_THRESHOLD = "CASE WHEN pii_type IN ('PERSON', 'ORG') THEN 0.7 ELSE 0.5 END"
_USABLE = "result_id IS NOT NULL AND start_pos < end_pos AND confidence IS NOT NULL"

QUERIES = {
    f.__name__: f
    for f in (
        flagship, email_spans, ip_spans, bic_spans, phone_spans, iban_spans, card_spans, url_spans, case_id_spans, iban_check, card_check, phone_check, luhn_digit, ip_internal, url_domain, prenormalised,
        resolved_spans, policy_filter, overlap_pairs, no_overlap_results, offset_adjustments, counts_by_type, tags_found, tags_strict, rehydrated, leak_scan, malformed_tags, missing_tags, validation_errors, protected_spans, denied,
        session_ids, session_ids_reused, session_counts, session_round_trip, session_merge, store_upsert, store_list, store_cleanup, crypto_round_trip, gender_lookup, location_scope, enriched_tags, title_extract, bio_decode, hourly_counts,
    )
}

ORACLE_SQL = {
    "enriched_tags": f"""
        SELECT entity_key, '<PII type="PERSON"' || CASE WHEN gender <> 'unknown' THEN ' gender="' || gender || '"' ELSE '' END || ' id="' || entity_key || '"/>' AS tag FROM ({_GENDER_SQL})
        UNION ALL SELECT entity_key, '<PII type="LOCATION"' || CASE WHEN scope <> 'unknown' THEN ' scope="' || scope || '"' ELSE '' END || ' id="' || entity_key || '"/>' FROM ({_SCOPE_SQL})
    """,
    "location_scope": f"SELECT entity_key, scope, confidence FROM ({_SCOPE_SQL})",
    "session_merge": "SELECT turn_id, true AS same FROM session_turn WHERE conversation_id IS NOT NULL AND turn IS NOT NULL",
    "session_round_trip": "SELECT turn_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS restored FROM session_turn WHERE conversation_id IS NOT NULL AND turn IS NOT NULL",
    "denied": """
        WITH t AS (SELECT turn_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM session_turn),
        m AS (SELECT turn_id, regexp_extract_all(t, 'account|compte|cuenta|conto|Konto') AS found, string_split_regex(t, 'account|compte|cuenta|conto|Konto') AS gaps FROM t),
        p AS (SELECT turn_id, unnest(range(1, len(found) + 1)) AS i, found, gaps FROM m)
        SELECT turn_id, CAST(i AS INTEGER) AS tag_id, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start_pos, found[i] AS match FROM p
    """,
    "protected_spans": f"""
        WITH s AS (SELECT * FROM span_match WHERE {_USABLE})
        SELECT result_id, pii_type, start_pos, end_pos FROM s WHERE source <> 'REGEX' AND NOT EXISTS (SELECT 1 FROM s r WHERE r.source = 'REGEX' AND r.result_id = s.result_id AND s.start_pos < r.end_pos AND r.start_pos < s.end_pos)
    """,
    "validation_errors": f"""
        WITH d AS {_DAMAGED_TABLE},
        e AS (SELECT * FROM detected_entity WHERE tag_id IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL AND result_id IN (SELECT result_id FROM d WHERE anonymized_text IS NOT NULL)),
        f AS (SELECT *, first_value(coalesce(original, '')) OVER (PARTITION BY result_id, tag_id ORDER BY entity_key) AS first_text FROM e),
        present AS ({_tags_of("d")})
        SELECT result_id, code, count(*) AS n FROM (
            SELECT a.result_id, 'OVERLAPPING_ENTITIES' AS code FROM e a JOIN e b ON a.result_id = b.result_id AND a.entity_key < b.entity_key AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos
            UNION ALL SELECT result_id, 'DUPLICATE_ID' FROM f WHERE coalesce(original, '') <> first_text
            UNION ALL SELECT result_id, 'MALFORMED_TAG' FROM (SELECT result_id, unnest(regexp_extract_all(anonymized_text, '(?i)<PII[^>]*>')) AS m FROM d) WHERE m NOT LIKE '%/>'
            UNION ALL SELECT result_id, 'MISSING_TAG' FROM e WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.result_id = e.result_id AND p.tag_id = e.tag_id)
            UNION ALL SELECT DISTINCT result_id, 'LEAK_DETECTED' FROM ({_leaks_of("d")})
        ) GROUP BY ALL
    """,
    "resolved_spans": f"WITH r AS ({O.resolved(f"SELECT result_id, span_key AS n, pii_type, start_pos AS s, end_pos AS e, confidence AS c, source = 'REGEX' AS regex, NULL AS m FROM span_match WHERE {_USABLE} AND confidence >= {_THRESHOLD}", 'result_id')}), u AS (SELECT result_id, unnest(spans) AS x FROM r) SELECT result_id, x.t AS pii_type, x.s AS start_pos, x.e AS end_pos FROM u",
    "url_spans": f"WITH src AS (SELECT turn_id, coalesce(text, '') || chr(10) || '(https://www.shop' || turn_id || '.example/a?b=' || turn_id || '&c=1). www.site' || turn_id || '.test, http://x' || turn_id || ' mailto:a' || turn_id || '@mail.example!' AS text FROM session_turn) {O.kept('URL', 'src')}",
    "case_id_spans": f"WITH c AS ({O.kept('CASE_ID')}), k AS ({O.kept('CUSTOMER_ID')}) SELECT * FROM c UNION ALL SELECT turn_id, CAST(ord + (SELECT count(*) FROM c WHERE c.turn_id = k.turn_id) AS INTEGER) AS ord, start_pos, end_pos, match FROM k",
    "card_spans": O.kept("CREDIT_CARD"),
    "iban_spans": O.kept("IBAN"),
    "phone_spans": O.kept("PHONE"),
    "email_spans": O.kept("EMAIL"),
    "bic_spans": O.kept("BIC_SWIFT"),
    "flagship": O.anonymised(_leaks_of),
    "ip_spans": f"WITH src AS (SELECT turn_id, coalesce(text, '') || chr(10) || 'from ' || concat_ws('.', turn_id * 7 % 300, turn_id * 13 % 256, turn_id * 29 % 300, turn_id * 31 % 11) || ' or ' || lower(to_hex(turn_id * 37 % 70000)) || '::' || lower(to_hex(turn_id * 11 % 4096)) || ' v' || (turn_id % 9) || '.0.1.2' AS text FROM session_turn) {O.kept('IP_ADDRESS', 'src')}",
    "iban_check": """
        WITH o AS (SELECT entity_key, upper(regexp_replace(original, '""" + _WS + """+', '', 'g')) AS t FROM detected_entity WHERE pii_type = 'IBAN' AND original IS NOT NULL),
        v AS (SELECT *, regexp_full_match(t, '[A-Z]{2}[0-9]{2}[A-Z0-9]+') AND length(t) BETWEEN 15 AND 34 AND length(t) = coalesce(element_at(MAP {""" + ", ".join(f"'{k}': {v}" for k, v in P.IBAN_LENGTHS.items()) + """}, t[1:2])[1], length(t)) AS shape FROM o)
        SELECT entity_key, shape AND CASE WHEN shape THEN list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(t[5:] || t[1:4], ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))),
            lambda a, d: (CASE WHEN d < 10 THEN a * 10 ELSE a * 100 END + d) % 97) = 1 ELSE false END AS valid,
            trim(regexp_replace(t, '(.{4})', '\\1 ', 'g')) AS grouped FROM v
    """,
    "card_check": f"""
        WITH o AS (SELECT entity_key, regexp_replace(original, '[^0-9]', '', 'g') AS digits FROM detected_entity WHERE pii_type = 'CREDIT_CARD' AND original IS NOT NULL),
        s AS (SELECT entity_key, digits, string_split(digits, '') AS d FROM o)
        SELECT entity_key, length(digits) BETWEEN 13 AND 19 AND CASE WHEN length(digits) > 0 THEN {_LUHN_SQL.format(odd=1)} % 10 = 0 ELSE false END AND len(list_distinct(d)) > 1 AS valid,
            CASE {" ".join(f"WHEN regexp_matches(digits, '{rx}') THEN '{name}'" for name, rx in C._BRANDS)} ELSE 'unknown' END AS brand, digits FROM s
    """,
    "phone_check": """
        WITH o AS (SELECT entity_key, original, regexp_replace(original, '[^0-9]', '', 'g') AS d FROM detected_entity WHERE pii_type = 'PHONE' AND original IS NOT NULL)
        SELECT entity_key, length(d) BETWEEN 7 AND 15 AND len(list_distinct(string_split(d, ''))) > 1 AND NOT (length(d) >= 5 AND (contains('0123456789', d) OR contains('9876543210', d))) AS valid,
            CASE WHEN original LIKE '+%' THEN '+' ELSE '' END || d AS normal FROM o
    """,
    "luhn_digit": f"WITH s AS (SELECT c_custkey, string_split(CAST(c_custkey AS VARCHAR), '') AS d FROM customer) SELECT c_custkey, CAST((10 - {_LUHN_SQL.format(odd=0)} % 10) % 10 AS INTEGER) AS digit FROM s",
    "ip_internal": f"WITH i AS (SELECT o_orderkey, concat_ws('.', o_orderkey * 7 % 256, o_orderkey * 13 % 256, o_orderkey * 29 % 256, o_orderkey * 31 % 256) AS ip FROM orders) SELECT o_orderkey, ip, regexp_matches(ip, '{P.IPV4_INTERNAL}') AS internal FROM i",
    "url_domain": "SELECT entity_key, 'www.' || lower(regexp_extract(original, '@(.*)$', 1)) AS domain FROM detected_entity WHERE pii_type = 'EMAIL' AND regexp_matches(original, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+$')",
    "prenormalised": """
        SELECT turn_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS normal, CAST(length(text) - len(regexp_extract_all(text, '\\r\\n')) AS INTEGER) AS end_offset,
            CAST(CASE WHEN text IS NOT NULL THEN 40 END + list_reduce(list_prepend({'n': 0, 'at': 0, 'go': true, 'p': 0}, list_transform(range(1, len(string_split(text, chr(13) || chr(10)))), lambda i: {'n': 0, 'at': 0, 'go': true, 'p': CAST(length(array_to_string(string_split(text, chr(13) || chr(10))[1:i], '')) + 2 * (i - 1) AS INTEGER)})),
                lambda a, b: CASE WHEN a.go AND a.at + b.p - a.n <= 40 THEN {'n': a.n + 1, 'at': b.p - a.n, 'go': true, 'p': 0} ELSE {'n': a.n, 'at': a.at, 'go': false, 'p': 0} END).n AS INTEGER) AS original_40,
            CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS utf16_length FROM session_turn
    """,
    "policy_filter": f"SELECT pii_type, count(*) AS n FROM span_match WHERE {_USABLE} AND confidence >= {_THRESHOLD} AND NOT coalesce(regexp_replace(lower(text), '^{_WS}+|{_WS}+$', '', 'g') IN ({', '.join(repr(a) for a in ALLOWED)}), false) GROUP BY pii_type",
    "overlap_pairs": """
        SELECT a.result_id, a.span_key AS key_a, b.span_key AS key_b FROM span_match a JOIN span_match b
        ON a.result_id = b.result_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos AND (a.start_pos < b.start_pos OR (a.start_pos = b.start_pos AND a.span_key < b.span_key))
        WHERE a.start_pos < a.end_pos AND b.start_pos < b.end_pos
    """,
    "no_overlap_results": f"""
        WITH s AS (SELECT result_id, start_pos, lag(end_pos) OVER (PARTITION BY result_id ORDER BY start_pos, end_pos DESC, span_key) AS before FROM span_match WHERE {_USABLE})
        SELECT result_id, bool_and(before IS NULL OR start_pos >= before) AS disjoint FROM s GROUP BY result_id
    """,
    "offset_adjustments": """
        WITH r AS (SELECT result_id, start_pos, end_pos, max(pii_type) AS k, max(tag_id) AS i FROM detected_entity WHERE start_pos IS NOT NULL AND end_pos IS NOT NULL GROUP BY ALL),
        s AS (SELECT *, length('<PII type="' || k || '" id="' || coalesce(i, 0) || '"/>') AS size FROM r),
        c AS (SELECT *, coalesce(sum(size - (end_pos - start_pos)) OVER (PARTITION BY result_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
        SELECT result_id, start_pos, end_pos, CAST(start_pos + before AS BIGINT) AS new_start, CAST(start_pos + before + size AS BIGINT) AS new_end, CAST(before + size - (end_pos - start_pos) AS BIGINT) AS delta FROM c
    """,
    "counts_by_type": f"SELECT t.pii_type, count(e.pii_type) AS n FROM (VALUES {_TYPES_SQL}) t(pii_type) LEFT JOIN detected_entity e ON e.pii_type = t.pii_type GROUP BY t.pii_type",
    "tags_found": _tags_of("tagging_result"),
    "tags_strict": r"""
        WITH t AS (SELECT result_id, unnest(regexp_extract_all(anonymized_text, '<PII type="[A-Z_]+"(?: gender="[A-Za-z0-9_]+")?(?: scope="[A-Za-z0-9_]+")? id="[0-9]+"/>')) AS m FROM tagging_result)
        SELECT result_id, regexp_extract(m, 'type="([A-Z_]+)"', 1) AS pii_type, CAST(regexp_extract(m, ' id="([0-9]+)"', 1) AS INTEGER) AS tag_id, nullif(regexp_extract(m, 'gender="([A-Za-z0-9_]+)"', 1), '') AS gender FROM t
    """,
    "rehydrated": "SELECT turn_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS restored FROM session_turn",
    "leak_scan": _leaks_of("tagging_result"),
    "malformed_tags": f"SELECT * FROM (SELECT result_id, unnest(regexp_extract_all(anonymized_text, '(?i)<PII[^>]*>')) AS matched FROM {_DAMAGED_TABLE}) WHERE matched NOT LIKE '%/>'",
    "missing_tags": f"SELECT DISTINCT result_id, tag_id FROM detected_entity e WHERE tag_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_tags_of(_DAMAGED_TABLE)}) t WHERE t.result_id = e.result_id AND t.tag_id = e.tag_id)",
    "session_ids": _SESSION_SQL.format(new="in_first"),
    "session_ids_reused": _SESSION_SQL.format(new="k = 1"),
    "session_counts": "SELECT conversation_id, pii_type, count(*) AS n FROM detected_entity GROUP BY ALL",
    "store_upsert": f"""
        WITH n AS (
            SELECT conversation_id, reverse(ciphertext) AS ciphertext, entity_counts, NULL AS model_version, created_at FROM stored_map
            UNION ALL SELECT conversation_id || '-new', ciphertext, entity_counts, model_version, NULL FROM stored_map
        )
        SELECT coalesce(n.conversation_id, o.conversation_id) AS conversation_id, CASE WHEN n.conversation_id IS NOT NULL THEN n.ciphertext ELSE o.ciphertext END AS ciphertext, coalesce(n.model_version, o.model_version) AS model_version,
            coalesce(o.created_at, n.created_at, {NEW_TIME}) AS created_at, CASE WHEN n.conversation_id IS NOT NULL THEN {NEW_TIME} ELSE o.updated_at END AS updated_at,
            CAST(coalesce(cardinality(coalesce(n.entity_counts, o.entity_counts)), -1) AS INTEGER) AS n_types
        FROM stored_map o FULL JOIN n ON o.conversation_id = n.conversation_id
    """,
    "store_list": f"SELECT conversation_id, created_at FROM stored_map WHERE created_at < {OLD_TIME} ORDER BY created_at DESC, conversation_id LIMIT 20",
    "store_cleanup": f"SELECT conversation_id FROM stored_map WHERE created_at >= {OLD_TIME} OR created_at IS NULL",
    "crypto_round_trip": "SELECT entity_key, original FROM detected_entity WHERE original IS NOT NULL",
    "gender_lookup": _GENDER_SQL,
    "title_extract": f"""
        SELECT entity_key, CASE WHEN hit THEN nullif(trim(regexp_extract(original, '(?i)^({_TITLE_RX}){_WS}+[^{_WS[1:]}', 1)), '') END AS title,
            CASE WHEN hit THEN regexp_replace(original, '(?i)^(?:{_TITLE_RX}){_WS}+([^{_WS[1:]})', '\\1') ELSE original END AS name
        FROM (SELECT entity_key, original, regexp_matches(original, '(?i)^({_TITLE_RX}){_WS}+[^{_WS[1:]}') AS hit FROM detected_entity WHERE pii_type = 'PERSON' AND original IS NOT NULL)
    """,
    "bio_decode": """
        WITH t AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'B-PER' ELSE 'I-PER' END WHEN l_returnflag = 'A' THEN 'I-ORG' ELSE 'O' END) AS label FROM lineitem GROUP BY ALL),
        k AS (SELECT *, nullif(regexp_extract(label, '^[BI]-([^-]+)$', 1), '') AS kind FROM t),
        b AS (SELECT *, kind IS NOT NULL AND (label LIKE 'B-%' OR lag(kind) OVER w IS DISTINCT FROM kind) AS begins FROM k WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
        i AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM b)
        SELECT l_orderkey, any_value(kind) AS label, CAST(min(l_linenumber * 10) AS BIGINT) AS start_pos, CAST(max(l_linenumber * 10 + 5) AS BIGINT) AS end_pos FROM i WHERE kind IS NOT NULL GROUP BY l_orderkey, island
    """,
    "hourly_counts": "SELECT strftime(date_trunc('hour', ingested_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M:%S') AS window_start, pii_type, count(*) AS n FROM detected_entity WHERE ingested_at IS NOT NULL GROUP BY ALL",
}

__all__ = ["ORACLE_SQL", "QUERIES", "REGEX_TYPES", "TYPE_PRIORITY", "flagship"]
