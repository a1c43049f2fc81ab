"""Conversations over several batches: numbers go on, maps and counts are merged, sealed and saved, and texts are restored from them.

All conversations of a batch are done together, by joins; a conversation's map is one value of the store, but its messages never meet it in
one row: they are joined with its entries by key.
"""

from __future__ import annotations

import time
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators import crypto, session
from maskwright.operators.spans import prenormalise
from maskwright.operators.tag import rehydrate, replace_numbered, tags_of
from maskwright.runtime import cut, discard, spread

if TYPE_CHECKING:
    from maskwright.plans.engine import Engine


def _entries(column: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(column)))


class Sessions:
    """Batches of messages of many conversations."""

    def __init__(self, engine: Engine):
        self.engine, self.store, self.key = engine, engine.store, engine.key

    def one(self, conversation: str) -> Session:
        return Session(self, conversation)

    def entries(self, conversations: DataFrame | None = None) -> DataFrame:
        """(conversation_id, key, original) of the stored maps, those of ``conversations`` (conversation_id) only, if given.

        A map that the key does not open is an error.
        """
        stored = self.store.read()
        if conversations is not None:
            stored = stored.join(conversations, "conversation_id", "left_semi")
        opened = cut(stored.select("conversation_id", crypto.decrypt_map(F.struct("ciphertext", "iv", "auth_tag"), self.key).alias("map")))
        closed = opened.where("map IS NULL").select("conversation_id").first()
        if closed:
            raise ValueError(f"the key does not open the stored map of {closed[0]}: use the key that it was sealed with, or delete the conversation")
        return opened.select("conversation_id", F.explode("map").alias("key", "original"))

    def anonymise(self, df: DataFrame, conversation: str, turn: str, key: str, text: str, locale: str | None = None, now: int | None = None) -> DataFrame:
        """``df`` with anonymized_text, entities and entity_count; the maps and counts of its conversations are saved before this returns.

        Messages of a conversation are taken in order of ``turn`` and ``key``, which is unique; the store names them by the text of ``conversation``.
        Messages without a conversation are left out; null texts stay null. Numbers go on from those stored.
        """
        engine, clock = self.engine, int(time.time() * 1000) if now is None else now
        kept = spread(df.where(F.col(conversation).isNotNull()))
        clean = prenormalise(F.col(text))
        found = cut(kept.withColumn("_text", clean).withColumn("_spans", engine.detected(F.col("_text"), F.col(locale) if locale else None)))
        names = found.select(F.col(conversation).cast("string").alias("conversation_id")).distinct()
        before = cut(self.entries(names))
        numbers = before.select("conversation_id", F.regexp_extract("key", "^(.+)_([0-9]+)$", 1).alias("kind"), F.col("original").alias("text"), F.regexp_extract("key", "^(.+)_([0-9]+)$", 2).cast("int").alias("id"))
        spans = found.select(F.col(conversation).cast("string").alias("conversation_id"), F.struct(F.col(turn).alias("turn"), F.col(key).alias("key")).alias("at"), F.explode("_spans").alias("s"))
        rows = spans.select("conversation_id", "at", F.col("s.start").alias("start"), F.col("s.type").alias("kind"), F.col("s.text").alias("text"), "s")
        numbered = cut(session.number_entities(rows, "conversation_id", "at", "start", "kind", "text", engine.policy.reuse_ids, numbers))
        entity = F.struct(*[F.col(f"s.{c}").alias(c) for c in ("type", "start", "end", "confidence", "source", "text", "semantic")], F.col("session_entity_id").alias("id"))
        lists = numbered.select(F.col("at.key").alias("_key"), F.struct("start", entity.alias("e")).alias("e")).groupBy("_key").agg(F.array_sort(F.collect_list("e")).alias("_es")).select("_key", F.col("_es.e").alias("_es"))
        joined = found.join(lists, found[key] == F.col("_key"), "left")
        done = joined.select(
            *df.columns, replace_numbered(F.col("_text"), F.col("_es")).alias("anonymized_text"), F.when(F.col("_text").isNotNull(), F.coalesce("_es", F.array())).alias("entities"), F.coalesce(F.size("_es"), F.lit(0)).alias("entity_count")
        )
        out = cut(done)
        fresh = numbered.select("conversation_id", F.concat_ws("_", "kind", F.col("session_entity_id").cast("string")).alias("key"), F.col("text").alias("original"))
        maps = before.unionByName(fresh).distinct().select("conversation_id", F.struct("key", "original").alias("e")).groupBy("conversation_id").agg(_entries("e").alias("map"))
        old = self.store.read().join(names, "conversation_id", "left_semi").select("conversation_id", F.explode("entity_counts").alias("kind", "n"))
        counts = old.unionByName(numbered.groupBy("conversation_id", "kind").agg(F.count(F.lit(1)).alias("n"))).groupBy("conversation_id", "kind").agg(F.sum("n").alias("n"))
        counts = counts.select("conversation_id", F.struct("kind", "n").alias("e")).groupBy("conversation_id").agg(_entries("e").alias("entity_counts"))
        all_of = names.join(maps, "conversation_id", "left").join(counts, "conversation_id", "left")
        sealed = all_of.withColumn("sealed", crypto.encrypt_map(F.coalesce("map", F.create_map().cast("map<string,string>")), self.key))
        fields = [F.col(f"sealed.{c}").alias(c) for c in ("ciphertext", "iv", "auth_tag")]
        model = F.lit(engine.model.version).alias("model_version")
        self.store.save(sealed.select("conversation_id", *fields, F.col("entity_counts").cast("map<string,bigint>").alias("entity_counts"), model, F.lit(None).cast("bigint").alias("created_at")), clock)
        discard(found)
        discard(numbered)
        return out

    def rehydrate(self, df: DataFrame, conversation: str, key: str, text: str, into: str = "restored") -> DataFrame:
        """``df`` with the originals of its conversations' tags put back; null where the conversation has no stored map. ``key`` is unique."""
        tagged = df.withColumn("_tags", tags_of(F.col(text)))
        read = cut(tagged.withColumn("_name", F.col(conversation).cast("string")))
        used = read.select(F.col("_name").alias("conversation_id"), F.col(key).alias("_key"), F.explode("_tags").alias("t"))
        used = used.select("conversation_id", "_key", F.concat_ws("_", "t.type", F.col("t.id").cast("string")).alias("key")).distinct()
        names = read.select(F.col("_name").alias("conversation_id")).distinct()
        originals = used.join(self.entries(names), ["conversation_id", "key"]).select("_key", F.struct("key", "original").alias("e")).groupBy("_key").agg(_entries("e").alias("_map"))
        there = self.store.read().select(F.col("conversation_id").alias("_name"), F.lit(True).alias("_there"))
        rows = read.join(originals, read[key] == F.col("_key"), "left").join(there, "_name", "left")
        return rows.select(*df.columns, rehydrate(F.when(F.col("_there"), F.col(text)), F.col("_map")).alias(into))


class Session:
    """One conversation of the store."""

    def __init__(self, sessions: Sessions, conversation: str):
        self.sessions, self.conversation = sessions, conversation

    def _mine(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_conversation", F.lit(self.conversation))

    def anonymise(self, df: DataFrame, turn: str, key: str, text: str, locale: str | None = None, now: int | None = None) -> DataFrame:
        return self.sessions.anonymise(self._mine(df), "_conversation", turn, key, text, locale, now).drop("_conversation")

    def rehydrate(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """An error where nothing is stored for the conversation."""
        if not self.exists():
            raise ValueError(f"nothing is stored for {self.conversation}: anonymise comes first")
        return self.sessions.rehydrate(self._mine(df), "_conversation", key, text).drop("_conversation")

    def load(self) -> DataFrame:
        return self.sessions.store.load(self.conversation)

    def exists(self) -> bool:
        return self.sessions.store.exists(self.conversation)

    def delete(self) -> bool:
        return self.sessions.store.delete(self.conversation)
