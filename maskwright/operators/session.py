"""Numbers that stay the same for a value through all messages of a conversation, as windows over long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.runtime import cut


def number_entities(rows: DataFrame, session: str, turn: str, start: str, kind: str, text: str, reuse: bool = False, known: DataFrame | None = None) -> DataFrame:
    """``rows`` (one an entity) with ``session_entity_id``.

    A value seen in an earlier message keeps its number; within the message in which it is new every occurrence gets one of its own, unless ``reuse``, and
    later messages take the last of them. Sessions with a third of all rows are numbered without gathering them in a task: messages are summed first,
    and only these sums, one a message, are put in order within the session. ``known`` has the numbers given before, as columns of the same names for
    session, kind and text, and ``id``: they are kept, and new ones go on behind the highest of the session.

    Null sessions are a session of their own; equal positions are ordered by type and text.
    """
    value = [session, kind, text]
    firsts = rows.groupBy(*value).agg(F.min(turn).alias("_first_turn"))
    joined = _with(rows, firsts, value)
    first = F.col(turn) == F.col("_first_turn")
    if known is not None:
        joined = _with(joined, known.groupBy(*value).agg(F.max("id").alias("_known")), value)
        joined = _with(joined, known.groupBy(session).agg(F.max("id").alias("_base")), [session])
        first = first & F.col("_known").isNull()
    if reuse:
        first = first & (F.row_number().over(Window.partitionBy(session, turn, kind, text).orderBy(start)) == 1)
    at = Window.partitionBy(session, turn).orderBy(start, kind, text)
    marked = cut(joined.withColumn("_new", first).withColumn("_within", F.sum(F.col("_new").cast("int")).over(at)))
    per_turn = marked.groupBy(session, turn).agg(F.sum(F.col("_new").cast("int")).alias("_count"))
    before = per_turn.withColumn("_before", F.coalesce(F.sum("_count").over(Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_count")
    base, given = (F.coalesce("_base", F.lit(0)), F.col("_known")) if known is not None else (F.lit(0), F.lit(None))
    numbered = _with(marked, before, [session, turn]).withColumn("_id", F.col("_within") + F.col("_before") + base)
    latest = numbered.where("_new").groupBy(*value).agg(F.max("_id").alias("_latest"))
    out = _with(numbered, latest, value)
    return out.select(*rows.columns, F.when(F.col("_new"), F.col("_id")).otherwise(F.coalesce(given, F.col("_latest"))).cast("int").alias("session_entity_id"))


def _with(rows: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """A left join on columns that may be null; the columns of ``on`` are those of ``rows``."""
    a, b = rows.alias("a"), more.alias("b")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return a.join(b, same, "left").select("a.*", *[F.col(f"b.`{c}`") for c in more.columns if c not in on])


def session_map(numbered: DataFrame, session: str, kind: str, text: str) -> DataFrame:
    """(session, key, original) of numbered entities."""
    return numbered.select(F.col(session), F.concat_ws("_", kind, F.col("session_entity_id").cast("string")).alias("key"), F.col(text).alias("original")).distinct()


def session_counts(numbered: DataFrame, session: str, kind: str) -> DataFrame:
    return numbered.groupBy(session, kind).agg(F.count(F.lit(1)).alias("n"))
