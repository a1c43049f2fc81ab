"""Problem 7: token ids of whole texts by a public byte-level vocabulary.

The vocabulary file (token bytes and ranks) is serialised as a sentencepiece model: every token becomes a piece whose bytes
are written as printable characters, its score is the negative rank, normalisation is the identity. Texts are cut into
pre-tokens by the vocabulary's own pattern, each distinct pre-token is encoded once per worker process and kept as packed
integers, so that a text's ids are one join of byte strings. Decoding maps ids back to bytes.

Defined results: the empty text and null both have the empty list of ids; special tokens are never made; strings that spell
a special token are ordinary text. Texts that are no valid Unicode (lone surrogates cannot occur in Arrow strings) are not expected.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.runtime import once

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker keeps; beyond it the table starts anew, which changes no result.
KEPT = 1 << 20
#: Fixed value: the pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def printable_bytes() -> tuple[str, ...]:
    """A printable character for each byte: itself where it is printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return tuple(chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


def read_ranks(path: str) -> dict[bytes, int]:
    return parse_ranks(Path(path).read_bytes())


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with the pieces of ``ranks`` under their ranks, and an unknown piece behind them."""
    text = printable_bytes()
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in ordered] != list(range(len(ordered))):
        raise ValueError("the ranks must run from 0 without gaps")
    unknown = len(ordered)
    pieces = b"".join(_field(1, _field(1, "".join(text[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for token, rank in ordered)
    pieces += _field(1, _field(1, b"<unk>") + _field(2, float(-unknown)) + _field(3, 2))
    no_id = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, no_id) + _field(42, no_id) + _field(43, no_id)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class _Encoded(dict):
    """Packed ids of pre-tokens, encoded where they are missing."""

    def __init__(self, ranks: dict[bytes, int]):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self._text = printable_bytes()

    def __missing__(self, piece: str) -> bytes:
        text = self._text
        ids = self._model.encode("".join([text[b] for b in piece.encode()]))
        packed = np.asarray(ids, np.int32).tobytes()
        if len(self) >= KEPT:
            self.clear()
        self[piece] = packed
        return packed


class _Chunks(dict):
    """Packed ids of what follows a blank, up to the next one."""

    def __init__(self, join):
        self._join = join

    def __missing__(self, rest: str) -> bytes:
        packed = self._join(" " + rest)
        if len(self) >= KEPT:
            self.clear()
        self[rest] = packed
        return packed


class ByteEncoder:
    """Encoder and decoder of one vocabulary, given as its tokens and their ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self._pieces = regex.compile(PATTERN).findall
        self._encoded = _Encoded(ranks)
        self._chunks = _Chunks(self._join)
        self._runs = re.compile(r" (?:\s|$)").search  # a superset of the pattern's white space
        self._tokens = sorted(ranks, key=ranks.__getitem__)

    def _join(self, text: str) -> bytes:
        return b"".join(map(self._encoded.__getitem__, self._pieces(text)))

    def packed(self, text: str | None) -> bytes:
        """The ids as packed 32-bit integers.

        A single blank before visible text always begins a pre-token, so the text is cut there and whole chunks are looked
        up; texts with runs of white space, where that does not hold, are cut by the pattern.
        """
        if not text:
            return b""
        if self._runs(text):
            return self._join(text)
        first, *rest = text.split(" ")
        return self._join(first) + b"".join(map(self._chunks.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ``ids``; null for null. Bytes that are no UTF-8 become the replacement character."""
        if ids is None:
            return None
        return b"".join([self._tokens[i] for i in ids]).decode(errors="replace")


@lru_cache(4)
def encoder(path: str = DEFAULT_VOCABULARY) -> ByteEncoder:
    return ByteEncoder(read_ranks(path))


_encoders: dict[str, ByteEncoder] = {}


def shipped_encoder(spark: SparkSession, path: str) -> Callable[[], ByteEncoder]:
    """For use in tasks: the encoder, built once in each worker from the file's bytes, which the driver reads and broadcasts."""
    content = spark.sparkContext.broadcast(Path(path).read_bytes())

    def of() -> ByteEncoder:
        if path not in _encoders:
            _encoders[path] = ByteEncoder(parse_ranks(content.value))
        return _encoders[path]

    return of


def _lists(packed: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode_texts(df: DataFrame, id_column: str, text_column: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids) of every row, one list per row and repeated rows each; no shuffle."""
    of = shipped_encoder(df.sparkSession, path)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = of().packed
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([packed(x) for x in texts])], [id_column, "ids"])

    kind = df.schema[id_column].dataType
    schema = T.StructType([T.StructField(id_column, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_column, text_column).mapInArrow(ids, schema)


def token_count(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Number of tokens of ``text``; 0 for the empty text and null."""
    of = shipped_encoder(SparkSession.active(), path)

    @once
    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        packed = of().packed
        return pa.array([len(packed(x)) // 4 for x in texts.to_pylist()], pa.int64())

    return count(text)


def decode_ids(ids: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The text that ``ids`` stand for."""
    of = shipped_encoder(SparkSession.active(), path)

    @once
    @F.arrow_udf(T.StringType())
    def decode(lists: pa.Array) -> pa.Array:
        back = of().decode
        return pa.array([back(x) for x in lists.to_pylist()], pa.string())

    return decode(ids)
