"""The whole pipeline on a DataFrame: one Arrow crossing from text to tagged and checked text, the rest in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.operators import crypto, validate
from maskwright.operators.ner import Model
from maskwright.operators.recognise import ARROW_SPANS, Registry, default_registry
from maskwright.operators.resolve import REGEX_PRIORITY, resolve
from maskwright.operators.semantic import Lists
from maskwright.operators.spans import prenormalise
from maskwright.operators.tag import _ARROW_TAGGED, TAGGED, count_by_type, rehydrate, tag_text
from maskwright.operators.titles import merge_title_spans, without_titles
from maskwright.policy import SPANS, Policy, Span
from maskwright.runtime import once, spread
from maskwright.sources.store import Store

DONE = T.StructType([*TAGGED.fields, T.StructField("errors", validate.ERRORS), T.StructField("leaked", T.BooleanType())])
_ARROW_DONE = pa.struct([*_ARROW_TAGGED, ("errors", validate.ARROW_ERRORS), ("leaked", pa.bool_())])


class Engine:
    """Finds, replaces and restores personal data in a text column.

    ``lists`` has the names and places that tags get a gender and a scope from where the policy asks for that; ``store`` and ``key`` serve sessions.
    """

    def __init__(
        self,
        policy: Policy | None = None,
        registry: Registry | None = None,
        model: Model | None = None,
        key: crypto.KeyProvider | None = None,
        lists: Lists | None = None,
        store: Store | None = None,
        policy_version: str = "1.0.0",
    ):
        self.policy, self.registry, self.model = policy or Policy(), registry or default_registry(), model or Model()
        self.key, self.lists, self.store, self.policy_version = key, lists, store, policy_version

    def spans_of(self, text: str, locale: str | None = None, policy: Policy | None = None) -> list[Span]:
        """The resolved spans of one text whose line ends are normalised, with titles, gender and scope if the policy asks for them."""
        rules = policy or self.policy
        return self._resolved(text, self.model.predict(text, rules), locale, rules)

    def _resolved(self, text: str, named: list[Span], locale: str | None, rules: Policy) -> list[Span]:
        spans = resolve(self.registry.find_all(text, rules), named, text, rules, REGEX_PRIORITY)
        if rules.semantic:
            spans = without_titles(merge_title_spans(spans, text))
            spans = self.lists.enrich(spans, locale) if self.lists else spans
        return spans

    def anonymise_text(self, text: str, known: Mapping[str, str] | None = None, policy: Policy | None = None, locale: str | None = None):
        """(tagged text, numbered spans, originals) of one text whose line ends are normalised."""
        rules = policy or self.policy
        return tag_text(text, self.spans_of(text, locale, rules), rules, known)

    def _each(self, texts: list[str | None], locales: list[str | None], rules: Policy):
        """Resolved spans of each text, None for null; the model sees the texts of a batch together."""
        named = self.model.predict_all([t or "" for t in texts], rules)
        return [None if t is None else self._resolved(t, n, l, rules) for t, n, l in zip(texts, named, locales, strict=True)]

    def detected(self, text: Column, locale: Column | None = None, policy: Policy | None = None) -> Column:
        """The resolved spans of texts whose line ends are normalised; null for null."""
        rules, engine = policy or self.policy, self._bare()

        @once
        @F.arrow_udf(SPANS)
        def find(texts: pa.Array, locales: pa.Array) -> pa.Array:
            found = engine._each(texts.to_pylist(), locales.to_pylist(), rules)
            return pa.array([None if spans is None else [s.row() for s in spans] for spans in found], ARROW_SPANS)

        return find(text, F.lit(None).cast("string") if locale is None else locale)

    def _bare(self) -> Engine:
        """Without what only the driver can use."""
        return self if self.key is None and self.store is None else Engine(self.policy, self.registry, self.model, None, self.lists, None, self.policy_version)

    def anonymise(self, df: DataFrame, text: str, known: str | None = None, policy: Policy | None = None, locale: str | None = None) -> DataFrame:
        """``df`` with anonymized_text, entities, originals, entity_count, counts, errors, leak_scan_passed, model_version and policy_version.

        Null text gives nulls and a count of 0. ``known`` names a map column of keys and originals of the conversation so far, ``locale`` a column with the
        locale that a first name's gender depends on. Inputs too small for the cores at hand are spread over them.
        """
        rules, engine = policy or self.policy, self._bare()

        @once
        @F.arrow_udf(DONE)
        def run(texts: pa.Array, maps: pa.Array, locales: pa.Array) -> pa.Array:
            out = []
            given = texts.to_pylist()
            for t, spans, m in zip(given, engine._each(given, locales.to_pylist(), rules), maps.to_pylist(), strict=True):
                if t is None:
                    out.append(None)
                    continue
                tagged, numbered, originals = tag_text(t, spans, rules, dict(m or ()))
                entities = [s.row() | {"id": n} for s, n in numbered]
                leaked = validate.leaks(tagged, rules) if rules.leak_scan else []
                wrong = [{"code": c, "detail": d} for c, d in validate.errors(tagged, entities, originals, rules, leaked)]
                out.append({"text": tagged, "entities": entities, "originals": list(originals.items()), "errors": wrong, "leaked": bool(leaked)})
            return pa.array(out, _ARROW_DONE)

        column = lambda name, kind: F.col(name) if name else F.lit(None).cast(kind)
        done = spread(df).withColumn("_tagged", run(prenormalise(F.col(text)), column(known, "map<string,string>"), column(locale, "string")))
        return done.select(
            *df.columns,
            F.col("_tagged.text").alias("anonymized_text"),
            *[F.col(f"_tagged.{c}").alias(c) for c in ("entities", "originals")],
            F.coalesce(F.size("_tagged.entities"), F.lit(0)).alias("entity_count"),
            count_by_type(F.col("_tagged.entities")).alias("counts"),
            F.col("_tagged.errors").alias("errors"),
            (~F.col("_tagged.leaked") if rules.leak_scan else F.lit(None).cast("boolean")).alias("leak_scan_passed"),
            F.lit(self.model.version).alias("model_version"),
            F.lit(self.policy_version).alias("policy_version"),
        )

    def anonymise_regex_only(self, df: DataFrame, text: str) -> DataFrame:
        return self.anonymise(df, text, policy=self.policy.merge(ner_enabled=frozenset()))

    def sealed(self, anonymised: DataFrame, key: bytes | crypto.KeyProvider | None = None) -> DataFrame:
        """The encrypted map in place of the originals."""
        secret = key or self.key
        if secret is None:
            raise ValueError("a key is needed to seal the originals")
        return anonymised.withColumn("pii_map", crypto.encrypt_map(F.col("originals"), secret)).drop("originals")

    def rehydrate(self, df: DataFrame, text: str, originals: str, into: str = "restored") -> DataFrame:
        return df.withColumn(into, rehydrate(F.col(text), F.col(originals)))

    def sessions(self):
        """Conversations whose maps are kept in the store."""
        from maskwright.plans.sessions import Sessions

        if self.store is None or self.key is None:
            raise ValueError("sessions need a store and a key: Engine(store=..., key=...)")
        return Sessions(self)

    def session(self, conversation: str):
        """One conversation."""
        return self.sessions().one(conversation)
