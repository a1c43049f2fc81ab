"""Problem 9: texts that were decoded with the wrong character encoding.

Every distinct word of the corpus that holds a character outside ASCII is garbled under all encoding chains, and the
garbled forms are hash-joined with the words themselves: a word that is the garbled form of another one, better known to
the corpus, is an error with a known original. The documents' words are then joined with this table and substituted.

A word is a run of ASCII letters and characters outside ASCII; single-byte encodings share the ASCII half, so that garbling keeps
the borders of words. A match is

* strong, if bytes of UTF-8 are visible in it (chains over UTF-8 make longer words or replacement characters), or if it holds at
  least one ASCII letter beside three characters in all and the original occurs in ``MANY`` times as many documents;
* weak otherwise: a lone symbol may well be meant. It counts if most documents of the corpus that hold it have strong
  matches too, and it is substituted in documents with a strong match of the same chain.

Defined results: null and empty texts are clean; a word with several originals of similar frequency (lost characters) is found
but not restored; repeated rows count each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.runtime import bounded, cut, discard, once

#: How many times as frequent an original must be where the form alone does not show the error.
MANY = 5
#: How many times as frequent an original must be as the next one to be restored.
CLEAR = 10
#: Share of documents with strong matches from which a weak match counts by itself.
COMPANY = 0.5
#: Encodings that texts are taken for by mistake.
SINGLE_BYTE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman")
#: Encodings in which such texts were written, and those that a double error passes.
WRITTEN = ("cp1252", "mac_roman", "cp850")
TWICE = ("cp1252", "latin-1")

#: As _WORD; it starts at the beginning of words only and never goes back.
WORD = r"(?<![A-Za-z])[A-Za-z]*+[^\x00-\x7F][A-Za-z\x{80}-\x{10FFFF}]*+"
_WORD = re.compile("[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")
_C1 = re.compile("[\x80-\xa0]")  # controls, and the no-break space that became a blank


@lru_cache(None)
def _decoder(name: str) -> tuple[str, ...]:
    """A character for each byte; bytes that the encoding leaves out stand for themselves, as lenient decoders have it."""
    return tuple(bytes([b]).decode(name, "ignore") or chr(b) for b in range(256))


@lru_cache(None)
def _encoder(name: str) -> dict[str, int]:
    return {ch: b for b, ch in reversed(list(enumerate(_decoder(name))))}


def _misread(word: str, name: str) -> str:
    table = _decoder(name)
    return "".join([table[b] for b in word.encode("utf-8", "replace")])


def _known_parts(word: str, name: str) -> list[str]:
    """The parts of ``word`` that the encoding can write; what lies between became question marks."""
    known = _encoder(name)
    parts = "".join(ch if ch in known else "\0" for ch in word).split("\0")
    return [p for p in parts if p and not p.isascii()]


def garbled_forms(word: str) -> Iterator[tuple[str, str, str]]:
    """(garbled form, what it stands for, chain) of ``word`` under every chain; the two differ."""
    for name in SINGLE_BYTE:
        once = _misread(word, name)
        yield from _with_lost_controls(once, word, f"utf-8>{name}")
        if name in TWICE:
            for again in TWICE:
                yield from _with_lost_controls(_misread(once, again), word, f"utf-8>{name}>utf-8>{again}")
    for written in WRITTEN:
        codes = _encoder(written)
        for part in _known_parts(word, written):
            raw = bytes([codes[ch] for ch in part])
            for name in SINGLE_BYTE:
                form = "".join([_decoder(name)[b] for b in raw])
                if name != written and form != part:
                    yield form, part, f"{written}>{name}"
            form = raw.decode("utf-8", "replace")
            if "\ufffd" in form:  # what is valid UTF-8 would be repaired by this, not garbled
                yield form, part, f"{written}>utf-8"


def _with_lost_controls(form: str, word: str, chain: str) -> Iterator[tuple[str, str, str]]:
    yield form, word, chain
    if _C1.search(form):
        yield _C1.sub("", form), word, f"{chain}, controls lost"


_FORMS = "form string, original string, chain string, original_docs long"


def _garble_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*found, n) for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for found in garbled_forms(word)]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["form", "original", "chain", "original_docs"])


def words_of(text: Column) -> Column:
    """The distinct words of ``text`` that hold a character outside ASCII."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0))


def error_table(words: DataFrame) -> DataFrame:
    """(word, original, chain, strong, docs): the words of the corpus that are garbled forms of others, from a row for each word of each document.

    ``original`` is null where several words could be meant. The distinct words are counted with map-side partial sums and
    joined with their garbled forms by shuffle, as both grow with the corpus.
    """
    vocabulary = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("docs")))
    forms = vocabulary.mapInArrow(_garble_batches, _FORMS)
    found = vocabulary.hint("merge").join(forms.hint("merge"), vocabulary.word == forms.form).where("word <> original")
    lost = F.col("chain").endswith("controls lost")  # such forms may be ordinary words
    visible = (F.col("chain").startswith("utf-8>") & ~lost) | F.col("chain").endswith(">utf-8")
    plausible = found.withColumn("visible", visible).where("visible OR original_docs > docs")
    by_original = plausible.groupBy("word", "docs", "original").agg(F.max("original_docs").alias("n"), F.max("visible").alias("visible"), F.min_by("chain", F.struct(~F.col("visible"), F.length("chain"), "chain")).alias("chain"))
    ranked = by_original.groupBy("word", "docs").agg(
        F.max_by(F.struct("original", "chain", "n"), F.struct("n", "original")).alias("best"),
        F.max("visible").alias("visible"),
        F.array_sort(F.collect_list("n")).alias("counts"),  # as many as there are chains, at most
    )
    second = F.coalesce(F.try_element_at("counts", F.lit(-2)), F.lit(0))
    spelled = F.col("word").rlike("[A-Za-z]") & (F.length("word") >= 3) & (F.col("best.n") >= MANY * F.col("docs"))
    clear = F.col("best.n") >= CLEAR * second
    return ranked.select("word", F.when(clear, F.col("best.original")).alias("original"), F.col("best.chain").alias("chain"), (F.col("visible") | spelled).alias("strong"), "docs")


def find_garbled(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, errors): the garbled rows, each with an array of its wrong words (word, original, chain)."""
    marked = documents.where(F.octet_length(text_column) != F.length(text_column))  # every character outside ASCII is part of a word
    lists = cut(marked.select(F.col(id_column).alias("_id"), words_of(F.col(text_column)).alias("words")))  # the texts are read once
    words = lists.select("_id", F.explode("words").alias("word"))
    errors = cut(error_table(words))
    matches = words.join(bounded(errors), "word")
    entry = F.struct("word", "original", "chain", "strong", "docs")
    rows = cut(matches.groupBy("_id").agg(F.collect_list(entry).alias("errors"), F.max("strong").alias("sure")))
    discard(lists)
    weak = rows.select("sure", F.explode(F.filter("errors", lambda e: ~e.strong)).alias("e")).groupBy("e.word")
    trusted = weak.agg(F.avg(F.col("sure").cast("int")).alias("company")).where(F.col("company") >= COMPANY).select("word")
    only_weak = rows.where("NOT sure").select("_id", F.explode("errors").alias("e")).select("_id", "e.word")
    also = only_weak.join(bounded(cut(trusted)), "word", "left_semi").select("_id").distinct().withColumn("also", F.lit(True))
    found = rows.join(also, "_id", "left").where("sure OR also")
    sure_chains = F.transform(F.filter("errors", lambda e: e.strong), lambda e: e.chain)
    kept = F.filter("errors", lambda e: e.strong | F.col("also") | F.array_contains("_chains", e.chain))
    return found.withColumn("_chains", sure_chains).select(F.col("_id").alias(id_column), F.transform(kept, lambda e: F.struct(e.word.alias("word"), e.original.alias("original"), e.chain.alias("chain"))).alias("errors"))


@once
@F.arrow_udf(T.StringType())
def _substitute(texts: pa.Array, words: pa.Array, originals: pa.Array) -> pa.Array:
    out = []
    for text, wrong, right in zip(texts.to_pylist(), words.to_pylist(), originals.to_pylist(), strict=True):
        table = {w: o for w, o in zip(wrong or (), right or (), strict=True) if o is not None}
        out.append(_WORD.sub(lambda m, table=table: table.get(m[0], m[0]), text) if text and table else text)
    return pa.array(out, pa.string())


def repair(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The garbled rows: (id, text as restored, unresolved: wrong words whose original is not known)."""
    found = find_garbled(documents, id_column, text_column)
    rows = documents.select(id_column, text_column).join(found, id_column)
    restored = _substitute(F.col(text_column), F.col("errors.word"), F.col("errors.original"))
    return rows.select(id_column, restored.alias(text_column), F.size(F.filter("errors", lambda e: e.original.isNull())).alias("unresolved"))
