"""Problem 5: cutting oversized texts at natural places.

A text over its limit is taken apart into atoms (words with the white space behind them; words too long for a piece are cut
between characters, never inside a line break or before a combining mark unless a single cluster is too long itself). The boundary between two
neighbours has a strength: end of paragraph, end of line, end of sentence, end of clause, blank, none. All boundaries lie in
a heap, the weakest on top; it is removed, merging its two sides, if the merged size plus the overlap fits the limit, and else
stays as a cut. The pieces are what is left, each begun by the last ``overlap`` characters before its cut. Positions and
sizes are code points.

Defined results: null has no pieces (null); a text within its limit, the empty one included, is one piece; a missing, zero
or negative limit means no limit; an overlap below zero counts as zero and one of the limit or more as limit - 1.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.runtime import once

PARAGRAPH, LINE, SENTENCE, CLAUSE, BLANK, NONE = 5, 4, 3, 2, 1, 0
_ATOM = re.compile(r"\s*\S+\s*|\s+")
_CLOSERS = "\"'»”’)]}›"


def _hard_cuts(text: str, start: int, end: int, size: int) -> list[int]:
    """Ends of parts of text[start:end], each at most ``size`` long."""
    ends = []
    while end - start > size:
        cut = start + size
        while cut > start and (unicodedata.combining(text[cut]) or text[cut] == "‍" or text[cut - 1] == "‍" or text[cut - 1 : cut + 1] == "\r\n"):
            cut -= 1
        start = cut if cut > start else start + size
        ends.append(start)
    return [*ends, end]


def _strength(text: str, start: int, end: int) -> int:
    """Strength of the boundary behind the atom text[start:end]."""
    word = text[start:end].rstrip()
    space = text[start + len(word) : end]
    lines = space.replace("\r\n", "\n").replace("\r", "\n").count("\n")
    if lines:
        return PARAGRAPH if lines > 1 else LINE
    last = word.rstrip(_CLOSERS)[-1:]
    if last and last in ".!?…" and space:
        return SENTENCE
    if last and last in ",;:–—" and space:
        return CLAUSE
    return BLANK if space else NONE


def cut_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``."""
    if limit <= 0 or len(text) <= limit:
        return [(0, len(text))]
    overlap = min(max(overlap, 0), limit - 1)
    size = limit - overlap
    ends: list[int] = []
    for atom in _ATOM.finditer(text):
        ends += _hard_cuts(text, atom.start(), atom.end(), size)
    starts = [0, *ends[:-1]]
    last = len(ends) - 1
    heap = [(_strength(text, starts[i], ends[i]), starts[i + 1], i) for i in range(last)]
    heapq.heapify(heap)
    # The atom i stands for the run that ends in it; before[i] is its first atom, after[j] the last atom of the run that begins in j.
    before, after = list(range(last + 1)), list(range(last + 1))
    cut = [True] * (last + 1)
    while heap:
        _, _, i = heapq.heappop(heap)
        first, final = before[i], after[i + 1]
        if ends[final] - starts[first] <= size:
            cut[i] = False
            after[first], before[final] = final, first
    pieces, start = [], 0
    for i in range(last + 1):
        if cut[i]:
            pieces.append((max(0, start - overlap), ends[i]))
            start = ends[i]
    return pieces


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


@once
@F.arrow_udf(_SPANS)
def _cut_arrow(texts: pa.Array, limits: pa.Array, overlaps: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), limits.to_pylist(), overlaps.to_pylist(), strict=True)
    spans = [None if t is None else [{"start": a, "end": b} for a, b in cut_text(t, n, o)] for t, n, o in rows]
    return pa.array(spans, _ARROW_SPANS)


def piece_spans(text: Column, limit: Column, overlap: Column) -> Column:
    """Array of (start, end); only texts over their limit are sent to Python."""
    over = (limit > 0) & (F.length(text) > limit)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end")))
    cut = _cut_arrow(F.when(over, text), limit.cast("int"), F.coalesce(overlap, F.lit(0)).cast("int"))
    return F.when(text.isNull(), None).otherwise(F.coalesce(cut, whole))


def with_limits(df: DataFrame, config: DataFrame, key: str, limit: str, overlap: str, default: str) -> DataFrame:
    """``df`` with ``piece_limit`` and ``piece_overlap``, joined from a configuration table by the column ``key`` that both have.

    Keys that are null or not listed have the default row's values; of several rows for a key, or several default rows, the smallest limit counts.
    """
    first = F.min(F.struct(F.col(limit).isNull(), F.col(limit).cast("int").alias("n"), F.col(overlap).cast("int").alias("o")))
    listed = config.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(first.alias("_own"))
    standard = config.where(F.col(default)).agg(first.alias("_standard"))  # one row
    joined = df.join(listed, df[key] == F.col("_key"), "left").join(F.broadcast(standard), F.lit(True), "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("_own.n", "_standard.n").alias("piece_limit"), F.coalesce("_own.o", "_standard.o").alias("piece_overlap"))


def split_oversized(df: DataFrame, text: str, limit: Column, overlap: Column, keep: list[str]) -> DataFrame:
    """A row for each piece: the columns ``keep``, piece_no from 1, start, end and piece. Rows with null text have none."""
    spans = df.select(*keep, F.col(text).alias("_text"), F.posexplode(piece_spans(F.col(text), limit, overlap)).alias("_no", "_span"))
    return spans.select(
        *keep,
        (F.col("_no") + 1).alias("piece_no"),
        F.col("_span.start").alias("start"),
        F.col("_span.end").alias("end"),
        F.substring(F.col("_text"), F.col("_span.start") + 1, F.col("_span.end") - F.col("_span.start")).alias("piece"),
    )
