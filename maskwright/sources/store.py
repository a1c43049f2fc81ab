"""Store of encrypted maps, one row a conversation, as snapshots of a Parquet table.

Every change writes a new snapshot and then moves the pointer to it, so that a reader always sees a whole table and a failed
write leaves the old one. Times are milliseconds since 1970 and passed in.
"""

from __future__ import annotations

import posixpath
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.runtime import cut, discard

SCHEMA = "conversation_id string, ciphertext string, iv string, auth_tag string, entity_counts map<string,bigint>, model_version string, created_at bigint, updated_at bigint"


def upsert(old: DataFrame, new: DataFrame, now: int | Column) -> DataFrame:
    """``old`` with the rows of ``new`` (unique conversation_id, the same columns but updated_at) put in.

    created_at is the old row's, else the given one, else now; counts and version are the given ones, else the old row's.
    """
    clock = F.lit(now).cast("bigint") if isinstance(now, int) else now
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.conversation_id") == F.col("n.conversation_id"), "full")
    there = F.col("n.conversation_id").isNotNull()
    pick = lambda c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    either = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return both.select(
        F.coalesce(F.col("n.conversation_id"), F.col("o.conversation_id")).alias("conversation_id"),
        *map(pick, ("ciphertext", "iv", "auth_tag")),
        either("entity_counts"),
        either("model_version"),
        F.coalesce(F.col("o.created_at"), F.col("n.created_at"), clock).alias("created_at"),
        F.when(there, clock).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def listing(store: DataFrame, limit: int | None = None, older_than: int | None = None) -> DataFrame:
    """Conversations, the newest first; ``limit`` of zero or less is none."""
    rows = store if older_than is None else store.where(F.col("created_at") < older_than)
    ordered = rows.orderBy(F.desc("created_at"), "conversation_id")
    return ordered.limit(limit) if limit and limit > 0 else ordered


def without_older(store: DataFrame, older_than: int) -> DataFrame:
    return store.where((F.col("created_at") >= older_than) | F.col("created_at").isNull())


class Store(Protocol):
    """What a store of encrypted maps offers; ``rows`` have the columns of ``SCHEMA`` but for updated_at."""

    def read(self) -> DataFrame: ...
    def save(self, rows: DataFrame, now: int) -> None: ...
    def load(self, conversation: str) -> DataFrame: ...
    def exists(self, conversation: str) -> bool: ...
    def delete(self, conversation: str) -> bool: ...
    def list(self, limit: int | None = None, older_than: int | None = None) -> DataFrame: ...
    def cleanup(self, older_than: int) -> int: ...


class MapStore:
    """A store in a folder that all executors reach, for one writer at a time.

    A snapshot lives until two newer ones are written, so that a reader that holds it can end.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(posixpath.join(self.path, *parts))

    def _version(self) -> int:
        if not self._fs.exists(self._path()):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(n, "_SUCCESS"))), default=0)

    def read(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(SCHEMA).parquet(posixpath.join(self.path, f"v{version}")) if version else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        version = self._version()
        if self._fs.exists(self._path(f"v{version + 1}")):
            raise RuntimeError(f"{self.path} is being written, or a writer failed: remove v{version + 1} if none is at work")
        rows.write.mode("errorifexists").parquet(posixpath.join(self.path, f"v{version + 1}"))
        if version > 1:
            self._fs.delete(self._path(f"v{version - 1}"), True)

    def save(self, rows: DataFrame, now: int) -> None:
        """Rows put in; of several rows for a conversation none is taken for the right one: an error."""
        rows = cut(rows)
        twice = rows.groupBy("conversation_id").count().where("count > 1 OR conversation_id IS NULL").select("conversation_id").first()
        if twice:
            raise ValueError(f"no row or several rows for the conversation {twice[0]}")
        self._write(upsert(self.read(), rows, now))
        discard(rows)

    def load(self, conversation: str) -> DataFrame:
        return self.read().where(F.col("conversation_id") == conversation)

    def exists(self, conversation: str) -> bool:
        return not self.load(conversation).isEmpty()

    def delete(self, conversation: str) -> bool:
        found = self.exists(conversation)
        if found:
            self._write(self.read().where(F.col("conversation_id") != conversation))
        return found

    def list(self, limit: int | None = None, older_than: int | None = None) -> DataFrame:
        return listing(self.read(), limit, older_than)

    def cleanup(self, older_than: int) -> int:
        rows = self.read()
        gone = rows.where(F.col("created_at") < older_than).count()
        if gone:
            self._write(without_older(rows, older_than))
        return gone

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))

    def size(self) -> int:
        return self.read().count()
