"""Span algebra on columns and on arrays of structs with ``start`` and ``end``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskwright.operators.resolve import sort_spans
from maskwright.runtime import once


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (a_end >= b_end)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Text between two positions of code points."""
    return F.substring(text, start + 1, end - start)


def no_overlaps(spans: Column) -> Column:
    """True if, in order, no span begins before the one before it ends."""
    ordered = sort_spans(spans)
    return F.coalesce(F.forall(F.transform(ordered, lambda s, i: (i == 0) | (s.start >= F.try_element_at(ordered, i).end)), lambda ok: ok), F.lit(True))


def remove_overlapping(spans: Column, element: str, prefer: Callable[[Column, Column], Column]) -> Column:
    """Greedy by position; ``prefer(new, old)`` decides between a span and the first kept one that it meets."""

    def step(kept: Column, span: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: (span.start < k.end) & (k.start < span.end)), True)
        placed = F.transform(kept, lambda k, i: F.when((i + 1 == at) & prefer(span, k), span).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(span))).otherwise(placed)

    return sort_spans(F.aggregate(sort_spans(spans), F.array().cast(f"array<{element}>"), step))


def overlap_pairs(spans: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """(group, key_a, key_b) of spans of a group that overlap, key_a before key_b by (start, key).

    A span meets only spans that begin before its end: spans are cut into the buckets that they touch, so that the join is one on
    equality and a long group is spread over its buckets; a pair is kept in the first bucket that both touch.
    """
    width = 256
    rows = spans.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e")).where("g IS NOT NULL AND s < e")
    cut = rows.withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    a, b = cut.alias("a"), cut.select(*[F.col(c).alias(f"{c}2") for c in ("g", "k", "s", "e", "b")])
    first = F.floor(F.greatest("s", "s2") / width)
    ordered = (F.col("s") < F.col("s2")) | ((F.col("s") == F.col("s2")) & (F.col("k") < F.col("k2")))
    met = a.join(b, (F.col("g") == F.col("g2")) & (F.col("b") == F.col("b2")) & (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e")) & ordered & (F.col("b") == first))
    return met.select(F.col("g").alias(group), F.col("k").alias("key_a"), F.col("k2").alias("key_b"))


def offset_adjustments(spans: DataFrame, group: str, start: str, end: str, new_length: Column) -> DataFrame:
    """Positions after replacing each span by text of ``new_length``: a running sum of the differences within the group."""
    change = new_length - (F.col(end) - F.col(start))
    before = F.coalesce(F.sum(change).over(Window.partitionBy(group).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("new_start", F.col(start) + before).withColumn("new_end", F.col(start) + before + new_length).withColumn("delta", before + change)


def prenormalise(text: Column, line_ends: bool = True, trim: bool = False) -> Column:
    """One kind of line end; optionally without white space at the ends. (Compatibility forms: see ``nfkc``.)"""
    from maskwright.functions.patterns import SPACE

    out = F.regexp_replace(text, "\r\n?", "\n") if line_ends else text
    return F.regexp_replace(out, f"^[{SPACE}]+|[{SPACE}]+$", "") if trim else out


@once
@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility forms of Unicode; null for null."""
    return pa.array([t and unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def to_normalised_offset(text: Column, offset: Column) -> Column:
    """Where ``offset`` of a text with CRLF line ends lies after they became LF."""
    return offset - F.regexp_count(F.substring(text, 1, offset + 1), F.lit("\r\n"))


def to_original_offset(text: Column, offset: Column) -> Column:
    """About where ``offset`` of the text with LF line ends lies in ``text`` with CRLF ones; null for null.

    A greedy walk over the line ends, as the contract has it: it counts a line end as long as the place reached so far and the
    line end's place, less those counted, do not go beyond the offset.
    """
    sizes = F.transform(F.split(text, "\r\n"), F.length)
    ends = F.transform(F.slice(sizes, 1, F.size(sizes) - 1), lambda _, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b) + 2 * i)
    state = F.struct(F.lit(0).alias("counted"), F.lit(0).alias("at"), F.lit(True).alias("going"))

    def step(s: Column, end: Column) -> Column:
        go = s.going & (s.at + end - s.counted <= offset)
        return F.struct((s.counted + go.cast("int")).alias("counted"), F.when(go, end - s.counted).otherwise(s.at).alias("at"), go.alias("going"))

    return offset + F.aggregate(ends, state, step, lambda s: s.counted)


def utf16_offset(text: Column, offset: Column) -> Column:
    """A position in code points as one in UTF-16 units."""
    return offset + F.regexp_count(F.substring(text, 1, offset), F.lit("[\\x{10000}-\\x{10FFFF}]"))
