"""The core operators on small cases."""

import base64
import os
import random
import re
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import checks as C
from maskwright.operators import crypto, ner, semantic, session, spans, tag, titles, validate
from maskwright.operators.recognise import CARD, COMMON_ID_PATTERNS, EMAIL, IBAN, IP, PHONE, URL, Registry, custom_ids, default_registry, detect, find_table, whole
from maskwright.operators.resolve import LONGER_SPAN, allowed, apply_allowlist, by_position, in_protected, protected, remove_overlaps, remove_overlaps_column, resolve
from maskwright.operators.semantic import Lists
from maskwright.plans.engine import Engine
from maskwright.policy import NER, REGEX, SPAN, IdPattern, Policy, Span, label_type
from maskwright.runtime import once
from maskwright.sources import semantic as sources
from maskwright.sources import store


def found(recogniser, text):
    return [s.text for s in recogniser.find(text)]


@pytest.mark.parametrize(
    ("recogniser", "text", "expected"),
    [
        (EMAIL, "to a.b+c@mail.example.com.", ["a.b+c@mail.example.com"]),
        (EMAIL, "Kontakt: müller@beispiel.de", ["ller@beispiel.de"]),
        (EMAIL, "no..dots@x.example a@b", []),
        (PHONE, "+49 30 1234567 or 0301234567", ["+49 30 1234567", "0301234567"]),
        (PHONE, "0123456789", []),
        (IBAN, "DE89 3704 0044 0532 0130 00 and DE88370400440532013000", ["DE89 3704 0044 0532 0130 00"]),
        (CARD, "4111 1111 1111 1111, 4111111111111112", ["4111 1111 1111 1111"]),
        (IP, "10.0.0.99 1.2.3.4 2001:db8:0:0:0:0:2:1", ["10.0.0.99", "2001:db8:0:0:0:0:2:1"]),
        (URL, "see https://a.example/x?y=1.", ["https://a.example/x?y=1"]),
        (EMAIL, "", []),
    ],
)
def test_recognisers(recogniser, text, expected):
    assert found(recogniser, text) == expected


def test_registry_and_custom_ids():
    registry = Registry([custom_ids([COMMON_ID_PATTERNS["orderNumber"]])])
    assert registry.types() == ["CASE_ID"] and registry.has("CASE_ID") and not registry.has("EMAIL")
    assert [s.text for s in registry.find_all("Order 12345", Policy())] == ["Order 12345"]
    assert registry.find_all("Order 12345", Policy(enabled=frozenset())) == []
    registry.unregister("CASE_ID")
    assert registry.all() == []
    assert len(default_registry().all()) == 9


@given(st.text("0123456789", min_size=1, max_size=18))
def test_luhn_digit_makes_valid_numbers(prefix):
    assert C.luhn_valid(prefix + str(C.luhn_check_digit(prefix)))


def test_checks():
    assert C.iban_valid("gb82 west 1234 5698 7654 32") and not C.iban_valid("GB82WEST12345698765433") and not C.iban_valid("")
    assert C.iban_format("DE89370400440532013000") == "DE89 3704 0044 0532 0130 00"
    assert C.is_sequence("12345") and C.is_sequence("98765") and not C.is_sequence("1234")
    assert C.card_brand("3782-822463-10005") == "amex" and C.card_brand("9") == "unknown"
    assert not C.ipv4_valid("1.2.3.4") and not C.ipv4_valid("10.0.0.256") and C.ipv6_valid("::1")
    assert C.structured_id("AB-1234") and not C.structured_id("hello")
    assert label_type("B-PER") == "PERSON" and label_type("O") is None


def test_columns_match_plain_functions(spark):
    values = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111", "4111-1111-1111-1112", "", "+49 30 1234567", "0123456789", None, "NL91ABNA0417164300x"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", C.iban_column(F.col("t")).alias("i"), C.card_column(F.col("t")).alias("c"), C.phone_column(F.col("t")).alias("p"), C.brand_column(F.col("t")).alias("b")).collect()
    for r in rows:
        if r.t is None:
            assert (r.i, r.c, r.p, r.b) == (None,) * 4
        else:
            assert (r.i, r.c, r.p, r.b) == (C.iban_valid(r.t), C.card_valid(r.t), C.phone_valid(r.t), C.card_brand(r.t)), r.t


def random_spans(rng, n):
    kinds = ["EMAIL", "PERSON", "IBAN", "ORG", "URL"]
    out = []
    for _ in range(n):
        a = rng.randrange(30)
        out.append(Span(rng.choice(kinds), a, a + rng.randrange(1, 12), rng.choice([0.5, 0.7, 0.9]), rng.choice([REGEX, NER]), "x"))
    return out


@pytest.mark.parametrize("strategy", ["REGEX_PRIORITY", LONGER_SPAN, "HIGHER_CONFIDENCE", "TYPE_PRIORITY"])
def test_overlap_fold_in_the_jvm_equals_python(spark, strategy):
    rng = random.Random(7)
    cases = [random_spans(rng, rng.randrange(0, 9)) for _ in range(40)]
    frame = spark.createDataFrame([(i, [s.row() for s in c]) for i, c in enumerate(cases)], f"i int, spans array<{SPAN.simpleString()}>")
    got = {r.i: [(s.type, s.start, s.end) for s in r.k] for r in frame.select("i", remove_overlaps_column(F.col("spans"), SPAN.simpleString(), Policy(), strategy).alias("k")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == [(s.type, s.start, s.end) for s in remove_overlaps(c, Policy(), strategy)]


def test_resolution_rules():
    a, b = Span("PERSON", 0, 9, 0.9, NER, "John Sm@x"), Span("EMAIL", 5, 9, 0.98, REGEX, "Sm@x")
    assert resolve([b], [a], "John Sm@x", Policy()) == [b]
    assert resolve([b], [], "John Sm@x", Policy(allowlist=frozenset(["sm@x"]))) == []
    forced = resolve([], [], "code 77", Policy(denylist=("code [0-9]+",)))
    assert [(s.type, s.text) for s in forced] == [("EMAIL", "code 77")]
    assert resolve([], [], "", Policy()) == []


texts = st.lists(st.sampled_from(["a@b.example.com", "DE89370400440532013000", "+4930123456", " ", "x", "é", "😀", "\n", "$1", "\\", "4111111111111111"]), max_size=12).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_tagging_round_trip(text):
    tagged, numbered, originals = Engine().anonymise_text(text)
    assert tag.rehydrate_text(tagged, originals) == text
    assert [n for _, n in numbered] == list(range(1, len(numbered) + 1))


def test_reuse_and_known_numbers():
    spans_ = [Span("EMAIL", 0, 1, 1, REGEX, "a"), Span("EMAIL", 2, 3, 1, REGEX, "a"), Span("EMAIL", 4, 5, 1, REGEX, "b")]
    assert [n for _, n in tag.number_spans(spans_, Policy())] == [1, 2, 3]
    assert [n for _, n in tag.number_spans(spans_, Policy(reuse_ids=True))] == [1, 1, 2]
    assert [n for _, n in tag.number_spans(spans_, Policy(), {"EMAIL_4": "a"})] == [4, 4, 5]


@pytest.mark.parametrize("mangled", ['<PII type="EMAIL" id="2"/>', "<pii type='email' id='2' />", "&lt;PII type=„EMAIL“ id=“2”/&gt;", '< PII id = "2" type = "EMAIL" / >', '<PII type="EMAIL" gender="male" id="2/>"'])
def test_mangled_tags(mangled):
    assert tag.rehydrate_text(f"x {mangled} y", {"EMAIL_2": "q"}) == "x q y"
    assert tag.rehydrate_text(f"x {mangled} y", {"EMAIL_3": "q"}) == f"x {mangled} y"


def test_validation():
    entities = [{"type": "EMAIL", "id": 1, "start": 0, "end": 5, "text": "a"}, {"type": "EMAIL", "id": 1, "start": 3, "end": 6, "text": "b"}]
    codes = {c for c, _ in validate.errors('<PII type="EMAIL" id="2"> a@b.example', entities, {}, Policy())}
    assert codes == {validate.OVERLAPPING_ENTITIES, validate.DUPLICATE_ID, validate.MALFORMED_TAG, validate.MISSING_TAG, validate.INCOMPLETE_PII_MAP, validate.LEAK_DETECTED}
    assert validate.errors("", [], {}, Policy()) == []


def test_titles():
    assert titles.extract_title("Prof. Dr. Ada X") == ("Prof. Dr.", "Ada X", 10)
    assert titles.extract_title("Drake") == (None, "Drake", 0) and titles.only_title("Mrs.")
    merged = titles.merge_title_spans([Span("PERSON", 0, 3, 0.8, NER, "Dr."), Span("PERSON", 4, 7, 0.9, REGEX, "Ada")], "Dr. Ada")
    assert [(s.text, s.source) for s in merged] == [("Dr. Ada", "HYBRID")]
    assert titles.without_titles(merged)[0].text == "Ada"


def test_ner_decoding():
    vocabulary = {t: i for i, t in enumerate(["<s>", "</s>", "<unk>", "▁John", "▁S", "mith", "▁met"])}
    tokens = ner.Tokeniser(vocabulary).tokenise("John Smith met")
    assert [t.text for t in tokens] == ["<s>", "▁John", "▁S", "mith", "▁met", "</s>"]
    logits = {"▁John": 3, "▁S": 4, "mith": 4}
    by_id = {vocabulary[k]: v for k, v in logits.items()}
    import numpy as np

    predict = lambda batches: [np.array([[9.0 if by_id.get(i, 0) == k else 0.0 for k in range(9)] for i in ids]) for ids in batches]
    model = ner.Model(ner.Tokeniser(vocabulary), predict)
    assert [(s.type, s.text) for s in model.predict("John Smith met", Policy())] == [("PERSON", "John Smith")]
    assert ner.Model().predict("x", Policy()) == []
    assert ner.trim_span(Span("PERSON", 0, 5, 1, NER, '"Ab."')).text == "Ab"


def test_detection_and_engine_with_nulls(spark):
    df = spark.createDataFrame([(1, "a@b.example.com", "keep"), (2, None, None), (3, "", "x"), (4, "x\r\n10.0.0.99", "y")], "id int, text string, entities_ string")
    rows = {r.id: r for r in Engine().anonymise(df, "text").collect()}
    assert rows[2].anonymized_text is None and rows[2].entity_count == 0 and rows[3].anonymized_text == ""
    assert rows[4].anonymized_text == 'x\n<PII type="IP_ADDRESS" id="1"/>' and rows[1].counts["EMAIL"] == 1 and len(rows[1].counts) == 17
    assert df.limit(0).select(detect(F.col("text"))).count() == 0


def test_crypto(spark):
    df = spark.createDataFrame([({"EMAIL_1": "a"},), (None,), ({},)], "m map<string,string>")
    key, other = b"k" * 32, b"o" * 32
    rows = df.select("m", crypto.encrypt_map(F.col("m"), key).alias("s")).select("m", crypto.decrypt_map(F.col("s"), key).alias("a"), crypto.decrypt_map(F.col("s"), other).alias("b")).collect()
    assert all(r.m == r.a and r.b is None for r in rows)
    assert len(crypto.derive_key("p", b"salt", 10)) == 32 and crypto.MemoryKey().rotate() is not None
    with pytest.raises(ValueError):
        crypto.ConfiguredKey("YQ==")


def test_session_numbers_equal_a_fold(spark):
    rng = random.Random(3)
    rows = sorted({(rng.choice("ab"), rng.randrange(4), p, rng.choice(["EMAIL", "ORG"]), rng.choice("xyz")) for p in range(60)})
    for reuse in (False, True):
        expected = {}
        for conversation in "ab":
            known: dict[str, str] = {}
            for turn in range(4):
                mine = [r for r in rows if r[0] == conversation and r[1] == turn]
                numbered = tag.number_spans([Span(r[3], r[2], r[2] + 1, 1, REGEX, r[4]) for r in mine], Policy(reuse_ids=reuse), known)
                for s, n in numbered:
                    expected[conversation, turn, s.start] = n
                known |= {f"{s.type}_{n}": s.text for s, n in numbered}
        frame = spark.createDataFrame(rows, "c string, turn int, start int, kind string, text string")
        got = {(r.c, r.turn, r.start): r.session_entity_id for r in session.number_entities(frame, "c", "turn", "start", "kind", "text", reuse).collect()}
        assert got == expected


def test_store(spark, tmp_path):
    s = store.MapStore(spark, str(tmp_path / "maps"))
    rows = lambda *r: spark.createDataFrame([(c, t, "iv", "tag", None, v, a) for c, t, v, a in r], "conversation_id string, ciphertext string, iv string, auth_tag string, entity_counts map<string,bigint>, model_version string, created_at bigint")
    assert s.size() == 0 and not s.exists("a") and not s.delete("a")
    s.save(rows(("a", "1", "v1", None), ("b", "2", "v1", 5)), 10)
    s.save(rows(("a", "3", None, 99)), 20)
    got = {r.conversation_id: r for r in s.read().collect()}
    assert (got["a"].ciphertext, got["a"].model_version, got["a"].created_at, got["a"].updated_at) == ("3", "v1", 10, 20)
    assert [r.conversation_id for r in s.list(limit=1).collect()] == ["a"] and [r.conversation_id for r in s.list(older_than=10).collect()] == ["b"]
    assert s.cleanup(10) == 1 and s.delete("a") and s.size() == 0


def test_pairs_of_overlapping_spans_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), k, a := rng.randrange(900), a + rng.randrange(0, 400)) for k in range(80)]
    frame = spark.createDataFrame(rows, "g int, k int, s int, e int")
    got = {tuple(r) for r in spans.overlap_pairs(frame, "g", "k", "s", "e").collect()}
    real = [r for r in rows if r[2] < r[3]]
    assert got == {(a[0], a[1], b[1]) for a in real for b in real if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and (a[2], a[1]) < (b[2], b[1])}


def test_reference_lists(spark, tmp_path):
    names = tmp_path / "names.txt"
    names.write_bytes("# head\nM  Jörg                     x\nF  Anna\n?  Kim\nM  Anna\n".encode("latin-1"))
    assert {tuple(r) for r in sources.read_names(spark, str(names)).collect()} == {("jörg", "male"), ("anna", "female"), ("kim", "neutral")}
    cities = tmp_path / "cities.txt"
    cities.write_text("\t".join(["1", "Köln", "Koeln", "Cologne,K", "", "", "", "", "DE", "", "", "", "", "", "1000"]) + "\n" + "\t".join(["2", "Cologne", "Cologne", "", "", "", "", "", "US", "", "", "", "", "", "5"]) + "\n")
    assert {tuple(r) for r in sources.read_cities(spark, str(cities)).collect()} == {("köln", "DE", 1000), ("koeln", "DE", 1000), ("cologne", "DE", 1000)}


def test_conversation_stream(spark, tmp_path):
    from maskwright.streaming.sessions import anonymise_sessions

    schema = "conversation_id string, turn int, text string"
    spark.createDataFrame([("c", 2, "again\r\na@b.example.com"), ("c", 1, "a@b.example.com and x@y.example.com"), ("d", 1, None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = anonymise_sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    rows = {(r.conversation_id, r.turn): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["c", 2].text == 'again\n<PII type="EMAIL" id="1"/>' and rows["c", 1].entity_count == 2 and rows["d", 1].text is None


@pytest.mark.parametrize("language, count, some", [
    ("en", 79, "Mister|Sister|The Right Honorable|Rt. Hon.|Sergeant|Admiral|Esq."), ("de", 42, "Doktor|Major|Dipl.|Dr. phil.|Dr. rer. nat.|Bischof"), ("fr", 46, "M|Me.|Mgr|Soeur|Général"),
    ("es", 56, "Sra|Profesora|Abogado|Capitán|Sor"), ("it", 50, "Dott|Avvocato|Geom.|Principessa|Suor"), ("pt", 47, "Doutora|Engenheiro|Capitão|Irmã"), ("nl", 43, "De heer|Mijnheer|Doctorandus|Ds."),
    ("lv", 11, "jaunkundze|k-gs|profesors"), ("ar", 40, "Al-Sayyid|Ustadh|المهندسة|الشيخ|Sheikh"), ("zh", 20, "太太|老師|医生|閣下"),
])
def test_titles_of_all_languages(spark, language, count, some):
    assert len(titles.titles(language)) == count and len(titles.titles()) == 350
    for title in some.split("|"):
        assert titles.extract_title(f"{title} Ada X") == (title, "Ada X", len(title) + 1) and titles.only_title(title)
    rows = spark.createDataFrame([(f"{t} Ada X",) for t in some.split("|")], "name string").select(titles.title_column(F.col("name")), titles.name_column(F.col("name")))
    assert [tuple(r) for r in rows.collect()] == [(t, "Ada X") for t in some.split("|")]


def test_country_variants(spark, tmp_path):
    from maskwright.plans.queries import location_scope

    lines = [("US", "United States"), ("GB", "United Kingdom"), ("ES", "Spain"), ("NL", "Netherlands"), ("PL", "Poland")]
    listed = tmp_path / "countries.txt"
    listed.write_text("# head\n" + "".join("\t".join([code, "", "", "", name, ""]) + "\n" for code, name in lines))
    names = {tuple(r) for r in sources.read_countries(spark, str(listed)).collect()}
    assert {("usa", "US"), ("us", "US"), ("england", "GB"), ("gb", "GB"), ("españa", "ES"), ("the netherlands", "NL"), ("poland", "PL"), ("pl", "PL")} <= names
    assert len(names) == 2 * len(lines) + 4 - 1 + 4 + 3 + 3  # US is code and variant
    spark.createDataFrame(lines, "country_code string, country_name string").write.parquet(f"{tmp_path}/country_entry.parquet")
    spark.createDataFrame([("England", "US", 10**6), ("Berlin", "DE", 10**6)], "city_name string, country string, population long").write.parquet(f"{tmp_path}/city_entry.parquet")
    places = ["USA", "UK", "England", "España", "Espana", "holland", "GB", "Poland", "Berlin", "Atlantis"]
    spark.createDataFrame([(i, "LOCATION", p) for i, p in enumerate(places)], "entity_key long, pii_type string, original string").write.parquet(f"{tmp_path}/detected_entity.parquet")
    got = {r.entity_key: r.scope for r in location_scope(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(places))] == ["country"] * 8 + ["city", "unknown"]


def test_custom_ids_check_their_own_matches():
    ids = [IdPattern("a", "X[0-9]+"), IdPattern("b", "X1[0-9]*", validate=lambda t: False)]
    assert found(custom_ids(ids), "X12") == ["X12"] and found(custom_ids(ids[1:]), "X12") == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["+49", "00", "0", "12", "345", "6789", "4111", " ", "-", ".", "(", ")", "/", "DE89", "a", "::", "1.2", ":", "ffff", "AB", "ref", "CASE", "x@y.de", "\n", "www.", "http://a.b", "mailto:"]), max_size=20).map("".join))
def test_cheap_tests_drop_no_match(text):
    """Each recogniser finds what it finds with all patterns over the whole text."""
    for r in default_registry().all():
        assert r.find(text) == replace(r, where=whole).find(text), r.name


def test_allow_list_keeps_spans_without_text(spark):
    policy = Policy(allowlist=frozenset(["hq"]))
    rows = spark.createDataFrame([(t,) for t in (" HQ ", None, "hq2")], "text string").select("text", F.size(apply_allowlist(F.array(F.struct("text")), policy)).alias("n")).collect()
    assert {r.text: r.n for r in rows} == {" HQ ": 0, None: 1, "hq2": 1}
    assert allowed(" HQ ", policy) and not allowed(None, policy)


def test_order_protected_and_titles():
    spans_ = [Span("ORG", 10, 20, 0.9, NER, "x"), Span("ORG", 50, 55, 0.9, NER, "y"), Span("ORG", 10, 30, 0.9, NER, "z")]
    assert [s.text for s in by_position(spans_)] == ["z", "x", "y"] and [s.text for s in by_position(spans_, True)] == ["y", "z", "x"]
    places = protected([Span("EMAIL", 15, 18, 1, REGEX, "e")])
    assert [in_protected(s, places) for s in spans_] == [True, False, True]
    assert titles.starts_with_title("Mister Smith") and not titles.starts_with_title("Smith")


def test_keys_stay_out_of_plans(spark):
    key = bytes(range(7, 39))
    df = spark.createDataFrame([({"EMAIL_1": "a"},)], "m map<string,string>")
    out = df.select(crypto.encrypt_map(F.col("m"), key).alias("s")).select(crypto.decrypt_map(F.col("s"), crypto.MemoryKey(key)).alias("m"))
    plan = out._jdf.queryExecution().toString() + spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "extended")
    for text in (key.hex(), base64.b64encode(key).decode(), str(list(key)), ", ".join(map(str, key))):
        assert text.lower() not in plan.lower()
    assert out.first().m == {"EMAIL_1": "a"}
    with pytest.raises(ValueError):
        crypto.key_column(b"short")


LISTS = Lists({"anna": "female", "andrea": "female", ("andrea", "it"): "male"}, {"berlin": ("DE", 3_000_000), "georgia": ("US", 5)}, {"france": "FR", "usa": "US"}, {"georgia": "US", "bavaria": "DE"})


def test_lists_equal_the_joins(spark):
    names = spark.createDataFrame([("Anna", "female", 1), ("anna", "male", 2), ("Andrea", None, 0), ("andrea", "female", 3)], "name string, gender string, n int")
    people = ["Anna X", "Dr. Anna X", "ANDREA", "Nobody", "", "  ", None]
    got = {r.name: r.gender for r in semantic.infer_gender(spark.createDataFrame([(p,) for p in people], "name string"), "name", names, order="n").collect()}
    assert got == {p: LISTS.gender(p) if p is not None else "unknown" for p in people}
    assert LISTS.gender("Andrea Bianchi", "it-IT") == "male" and LISTS.has_name("Dr Anna") and not LISTS.has_name("x")

    countries = spark.createDataFrame([("France", "FR"), ("USA", "US")], "name string, code string")
    cities = spark.createDataFrame([("Berlin", "DE", 3_000_000), ("Georgia", "US", 5)], "name string, country string, population long")
    regions = spark.createDataFrame([("Georgia", "US"), ("Bavaria", "DE")], "name string, country string")
    places = ["Berlin", "berlin  city", "the USA", "La France", "Bävaria", "Georgia", "Atlantis", "", None, "Berlin"]
    rows = semantic.classify_place(spark.createDataFrame([(p,) for p in places], "place string"), "place", countries, cities, regions).collect()
    assert len(rows) == len(places)
    assert {r.place: (r.scope, r.scope_country, r.scope_confidence) for r in rows if r.place is not None} == {p: LISTS.scope(p) for p in places if p is not None}
    assert Lists.read(names.select("name", "gender"), cities, countries, regions).sizes() == {"names": 2, "cities": 2, "countries": 2, "regions": 2} and LISTS.has_place("Berlin") and not LISTS.has_place("x")
    with pytest.raises(ValueError):
        Lists.read(cities=cities, most=1)


def test_list_files(spark, tmp_path):
    assert sources.present(spark, str(tmp_path)) == {"names": False, "cities": False, "countries": False, "regions": False}
    with pytest.raises(FileNotFoundError, match="nam_dict.txt, cities15000.txt"):
        sources.read_lists(spark, str(tmp_path))
    (tmp_path / "nam_dict.txt").write_bytes(b"M  Jon\n")
    line = lambda country: "\t".join(["1", "Cologne", "Cologne", "", "", "", "", "", country, "", "", "", "", "", "5"]) + "\n"
    (tmp_path / "cities15000.txt").write_text(line("DE") + line("US"))
    (tmp_path / "countryInfo.txt").write_text("FR\t\t\t\tFrance\t\n")
    tables = sources.read_lists(spark, str(tmp_path))
    assert set(tables) == {"names", "cities", "countries"} and tables["cities"].first().country == "DE"
    assert Lists.read(**tables).scope("France") == ("country", "FR", 1.0)


def test_engine_with_gender_scope_and_checks(spark):
    class Everywhere:
        """A model that takes every capitalised word for a person, and every word in capitals for a place."""

        version = "test-1"

        def predict_all(self, texts, policy):
            return [[Span("LOCATION" if m[0].isupper() else "PERSON", m.start(), m.end(), 0.9, NER, m[0]) for m in re.finditer(r"\b[A-Z]\w+(?: [A-Z][a-z]+)?", t)] for t in texts]

    engine = Engine(Policy(semantic=True), model=Everywhere(), lists=LISTS, policy_version="7")
    rows = spark.createDataFrame([(1, "Anna met", "en"), (2, "Andrea met", "it"), (3, "seen BERLIN", None), (4, None, "en"), (5, "Xyz met", "")], "id int, text string, lang string")
    got = {r.id: r for r in engine.anonymise(rows, "text", locale="lang").collect()}
    assert got[1].anonymized_text == '<PII type="PERSON" gender="female" id="1"/> met' and 'gender="male"' in got[2].anonymized_text
    assert got[3].anonymized_text == 'seen <PII type="LOCATION" scope="city" id="1"/>' and got[5].anonymized_text == '<PII type="PERSON" id="1"/> met'
    assert got[1].errors == [] and got[4].errors is None and (got[1].model_version, got[1].policy_version) == ("test-1", "7")
    leaky = Engine(Policy(regex_enabled=frozenset())).anonymise(spark.createDataFrame([("a@b.example",)], "text string"), "text").first()
    assert not leaky.leak_scan_passed and [e.code for e in leaky.errors] == [validate.LEAK_DETECTED]


def test_leaks_leave_out_the_inside_of_tags():
    assert [m for _, m, _ in validate.leaks("x a@b.example <PII type='EMAIL' y c@d.example >", Policy())] == ["a@b.example"]


def test_sessions(spark, tmp_path):
    key = crypto.MemoryKey(b"k" * 32)
    engine = Engine(store=store.MapStore(spark, str(tmp_path / "maps")), key=key)
    sessions = engine.sessions()
    messages = [("c", 1, 1, "first@x.example"), ("c", 2, 2, "first@x.example and second@x.example"), ("d", 1, 3, None), (None, 1, 4, "a@x.example"), ("c", 2, 5, "third@x.example\r\nfirst@x.example")]
    schema = "session string, turn int, conversation_id int, text string"  # a column named as the store's own
    whole = spark.createDataFrame(messages, schema)
    run = lambda of, df: {r.conversation_id: r for r in of.anonymise(df, "session", "turn", "conversation_id", "text", now=5).collect()}
    first = run(sessions, whole.where("turn = 1"))
    second = run(sessions, whole.where("turn = 2"))
    ids = lambda r: [e.id for e in r.entities]
    assert ids(first[1]) == [1] and ids(second[2]) == [1, 2] and ids(second[5]) == [3, 1] and first[3].anonymized_text is None and 4 not in first
    other = Engine(store=store.MapStore(spark, str(tmp_path / "other")), key=key).sessions()
    assert {k: r.anonymized_text for k, r in run(other, whole).items()} == {k: r.anonymized_text for k, r in (first | second).items()}
    stored = {r.conversation_id: r for r in engine.store.read().collect()}
    assert stored["c"].entity_counts == {"EMAIL": 5} and set(stored) == {"c", "d"} and stored["c"].created_at == 5

    one = engine.session("c")
    back = one.rehydrate(spark.createDataFrame([(1, 'to <PII id="3" type="EMAIL"/>, <pii type=\'EMAIL\' id="2"/> <PII type="EMAIL" id="9"/>')], "k int, t string"), "k", "t").first()
    assert back.restored == 'to third@x.example, second@x.example <PII type="EMAIL" id="9"/>'
    assert one.anonymise(spark.createDataFrame([(3, 8, "second@x.example")], "turn int, k int, text string"), "turn", "k", "text").first().entities[0].id == 2
    assert one.exists() and one.load().count() == 1 and not engine.session("nobody").exists()
    with pytest.raises(ValueError, match="does not open"):
        Engine(store=engine.store, key=crypto.MemoryKey(b"w" * 32)).session("c").rehydrate(spark.createDataFrame([(1, "x")], "k int, t string"), "k", "t")
    assert one.delete() and not one.exists() and not one.delete()
    with pytest.raises(ValueError, match="anonymise comes first"):
        one.rehydrate(whole, "conversation_id", "text")
    with pytest.raises(ValueError, match="store and a key"):
        Engine().session("c")


def test_store_refuses_two_rows_for_a_conversation(spark, tmp_path):
    s = store.MapStore(spark, str(tmp_path / "maps"))
    rows = spark.createDataFrame([("a", "1", "iv", "tag", None, "v", None)] * 2, "conversation_id string, ciphertext string, iv string, auth_tag string, entity_counts map<string,bigint>, model_version string, created_at bigint")
    with pytest.raises(ValueError, match="conversation a"):
        s.save(rows, 1)


def test_offsets_of_line_ends(spark):
    text = "ab\r\ncd\r\n\r\ne"
    rows = spark.createDataFrame([(text, i) for i in range(len(text) + 1)] + [(None, 1)], "t string, i int").select("t", "i", spans.to_normalised_offset(F.col("t"), F.col("i")).alias("n"), spans.to_original_offset(F.col("t"), F.col("i")).alias("o")).collect()
    places = [i for i in range(len(text)) if text[i : i + 2] == "\r\n"]
    for r in rows:
        if r.t is None:
            assert r.n is None and r.o is None
            continue
        assert r.n == r.i - sum(p < r.i for p in places)
        counted = at = 0
        for p in places:
            if at + p - counted > r.i:
                break
            counted, at = counted + 1, p - counted
        assert r.o == r.i + counted


def test_models_see_batches():
    seen = []
    vocabulary = ner.test_vocabulary()

    def predict(batches):
        seen.append(len(batches))
        return [np.eye(9)[[3 if i == vocabulary["▁J"] else 0 for i in ids]] * 9 for ids in batches]

    model = ner.Model(ner.Tokeniser(vocabulary), predict, batch=2)
    got = model.predict_all(["J met", "", "met J and", "x"], Policy())
    assert [[s.text for s in spans_] for spans_ in got] == [["J"], [], ["J"], []] and seen == [2, 1]
    assert model.tokeniser.token(vocabulary["▁J"]) == "▁J" and model.tokeniser.number("nothing") == vocabulary["<unk>"]
    with pytest.raises(ValueError, match="no valid JSON"):
        ner.read_vocabulary("{x")


def test_functions_marked_once_are_evaluated_once(spark):
    @once
    @F.arrow_udf("array<int>")
    def twice(x):
        return pa.array([[v, v] for v in x.to_pylist()], pa.list_(pa.int32()))

    out = spark.range(3).select(F.explode(twice(F.col("id").cast("int"))).alias("v")).where("v > 0")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1 and out.count() == 4


def test_written_tables_go_with_their_block(spark):
    from maskwright.runtime import bounded, cut, discard, scratch

    with scratch():
        kept = cut(spark.range(5))
        path = kept._written_path
        assert bounded(kept).count() == 5 and os.path.exists(path.removeprefix("file:"))
    assert not os.path.exists(path.removeprefix("file:"))
    other = cut(spark.range(2))
    discard(other)
    assert not os.path.exists(other._written_path.removeprefix("file:"))


def test_recognisers_as_a_table_function(spark):
    spark.udtf.register("find_personal", find_table())
    spark.createDataFrame([(1, "a@b.example and c@d.example"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("messages")
    rows = spark.sql("SELECT id, f.type, f.start, f.text FROM messages, LATERAL find_personal(messages.text) f").collect()
    assert sorted((r.id, r.type, r.start, r.text) for r in rows) == [(1, "EMAIL", 0, "a@b.example"), (1, "EMAIL", 16, "c@d.example")]
