"""Named-entity models: tokeniser, decoding of labels, spans; the model itself is a function that is passed in."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from maskwright.operators.recognise import ARROW_SPANS
from maskwright.policy import NER, SPANS, Policy, Span, label_type
from maskwright.runtime import once

DEFAULT_LABELS = ("O", "B-DATE", "I-DATE", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC")
SPECIAL = frozenset(("[PAD]", "[CLS]", "[SEP]", "<pad>", "<s>", "</s>"))
WORD_START = "▁"


class Token(NamedTuple):
    id: int
    text: str
    start: int
    end: int
    continues: bool
    special: bool


def read_vocabulary(content: str) -> dict[str, int]:
    """Tokens and ids of a vocabulary: one token a line, or a tokeniser's JSON with a list or a map of tokens."""
    if not content.lstrip().startswith("{"):
        return {t.strip(): i for i, t in enumerate(content.splitlines()) if t.strip()}
    try:
        data = json.loads(content)
    except ValueError as e:
        raise ValueError(f"the vocabulary is no valid JSON: {e}") from e
    vocabulary = {t["content"]: t["id"] for t in data.get("added_tokens", ())}
    model = data.get("model", {}).get("vocab", {})
    return vocabulary | ({entry[0]: i for i, entry in enumerate(model)} if isinstance(model, list) else dict(model))


def load_vocabulary(path: str) -> dict[str, int]:
    """``read_vocabulary`` of a file; ship its result, not the path, to the workers."""
    with open(path, encoding="utf-8") as file:
        return read_vocabulary(file.read())


def test_vocabulary() -> dict[str, int]:
    """A vocabulary for tests: the frame tokens, and the signs of ASCII, each with and without the mark of a word's start."""
    letters = [chr(c) for c in range(33, 127)]
    return {t: i for i, t in enumerate(["<s>", "<pad>", "</s>", "<unk>", *[WORD_START + c for c in letters], *letters])}


test_vocabulary.__test__ = False


class Tokeniser:
    """Greedy longest match over a trie-like set of known lengths; words begin with the mark ``▁`` where the vocabulary has it."""

    def __init__(self, vocabulary: dict[str, int], most: int = 512, lower: bool = False):
        self.vocabulary, self.most, self.lower = vocabulary, most, lower
        self.tokens = {i: t for t, i in vocabulary.items()}
        self.longest = max((len(t) for t in vocabulary), default=1)
        pick = lambda *names: next((vocabulary[n] for n in names if n in vocabulary), 0)
        self.begin, self.finish, self.unknown = pick("<s>", "[CLS]"), pick("</s>", "[SEP]"), pick("<unk>", "[UNK]")

    def _match(self, text: str, at: int, starts: bool) -> tuple[int, str, int]:
        """(id, token, length in the text) of the longest known token at a position; one character at least."""
        for size in range(min(self.longest, len(text) - at), 0, -1):
            piece = text[at : at + size]
            if starts and (token := WORD_START + piece) in self.vocabulary:
                return self.vocabulary[token], token, size
            if piece in self.vocabulary:
                return self.vocabulary[piece], piece, size
        return self.unknown, text[at], 1

    def tokenise(self, text: str) -> list[Token]:
        """Tokens with positions between the two frame tokens; what does not fit ``most`` is left out."""
        source = text.lower() if self.lower else text
        source = source if len(source) == len(text) else text
        out = [Token(self.begin, "<s>", 0, 0, False, True)]
        at, starts = 0, True
        while at < len(text) and len(out) < self.most - 1:
            if text[at].isspace():
                at, starts = at + 1, True
                continue
            number, token, size = self._match(source, at, starts)
            out.append(Token(number, token, at, at + size, not starts, False))
            at, starts = at + size, False
        return [*out, Token(self.finish, "</s>", len(text), len(text), False, True)]

    def token(self, number: int) -> str | None:
        return self.tokens.get(number)

    def number(self, token: str) -> int:
        """The id of a token, that of the unknown one if it is not known."""
        return self.vocabulary.get(token, self.unknown)

    def decode(self, ids: Sequence[int]) -> str:
        return "".join(self.tokens.get(i, "") for i in ids if self.tokens.get(i) not in SPECIAL).replace(WORD_START, " ").strip()


def softmax_best(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best label of each row, the first of equal ones, and its probability."""
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    p = e / e.sum(axis=-1, keepdims=True)
    best = p.argmax(axis=-1)
    return best, np.take_along_axis(p, best[..., None], axis=-1)[..., 0]


def split_label(label: str) -> tuple[str, str | None]:
    """(B, I or O; entity label)."""
    parts = label.split("-")
    return (parts[0], parts[1]) if len(parts) == 2 and parts[0] in "BI" else ("O", None)


@dataclass
class _Open:
    label: str
    start: int
    end: int
    confidence: float
    size: int


def decode_labels(tokens: Sequence[Token], labels: Sequence[str], confidences: Sequence[float]) -> list[tuple[str, int, int, float]]:
    """(label, start, end, mean confidence) of the entities; an I without its B begins one."""
    out: list[_Open] = []
    current: _Open | None = None
    for token, label, confidence in zip(tokens, labels, confidences, strict=True):
        mark, kind = ("O", None) if token.special else split_label(label)
        if kind is None:
            current = None
        elif mark == "I" and current and current.label == kind:
            current.end, current.size = token.end, current.size + 1
            current.confidence += (confidence - current.confidence) / current.size
        else:
            current = _Open(kind, token.start, token.end, confidence, 1)
            out.append(current)
    return [(o.label, o.start, o.end, o.confidence) for o in out]


def entity_spans(entities: Sequence[tuple[str, int, int, float]], text: str, least: float = 0.5) -> list[Span]:
    return [Span(kind, a, b, c, NER, text[a:b]) for label, a, b, c in entities if c >= least and (kind := label_type(label))]


def trim_span(span: Span) -> Span:
    """The span without blanks, and for persons and firms without signs, at its ends; unchanged if nothing were left."""
    strip = ".,;:!?'\"()" if span.type in ("PERSON", "ORG") else ""
    front = next((i for i, ch in enumerate(span.text) if not (ch.isspace() or ch in strip)), None)
    if front is None:
        return span
    back = next(i for i, ch in enumerate(reversed(span.text)) if not (ch.isspace() or ch in strip))
    return replace(span, start=span.start + front, end=span.end - back, text=span.text[front : len(span.text) - back])


def merge_adjacent(spans: Sequence[Span], text: str, most: int = 1) -> list[Span]:
    """Spans of a type with only blanks, at most ``most``, between them are one; its confidence is the mean of the two."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: s.start):
        if out and out[-1].type == s.type and 0 <= s.start - out[-1].end <= most and not text[out[-1].end : s.start].strip():
            last = out[-1]
            out[-1] = replace(last, end=s.end, confidence=(last.confidence + s.confidence) / 2, text=text[last.start : s.end])
        else:
            out.append(s)
    return out


@dataclass(frozen=True)
class ModelInfo:
    """A model that a registry offers: labels of its outputs and the files that its folder must have."""

    name: str
    files: tuple[str, ...] = ("model.onnx",)
    labels: tuple[str, ...] = DEFAULT_LABELS


#: Models by kind; the files are put in place by the caller.
MODELS = {kind: ModelInfo(f"multilingual, {kind}") for kind in ("standard", "quantized")}


Predictor = Callable[[list[list[int]]], list[np.ndarray]]


class Model:
    """Spans of texts by a predictor of logits; without one there are none."""

    def __init__(self, tokeniser: Tokeniser | None = None, predictor: Predictor | None = None, labels: Sequence[str] = DEFAULT_LABELS, version: str = "stub-1.0.0", batch: int = 16):
        self.tokeniser, self.predictor, self.labels, self.version, self.batch = tokeniser, predictor, tuple(labels), version, batch

    def predict(self, text: str, policy: Policy) -> list[Span]:
        return self.predict_all([text], policy)[0]

    def predict_all(self, texts: Sequence[str], policy: Policy) -> list[list[Span]]:
        """Spans of each text; ``batch`` texts of similar length go to the model at a time."""
        wanted = policy.enabled & policy.ner_enabled
        out: list[list[Span]] = [[] for _ in texts]
        if not (self.tokeniser and self.predictor and wanted):
            return out
        tokens = [self.tokeniser.tokenise(t) if t else [] for t in texts]
        order = sorted((k for k, t in enumerate(texts) if t), key=lambda k: len(tokens[k]))
        for first in range(0, len(order), self.batch):
            some = order[first : first + self.batch]
            for k, logits in zip(some, self.predictor([[t.id for t in tokens[k]] for k in some]), strict=True):
                out[k] = self._spans(texts[k], tokens[k], np.asarray(logits), wanted, policy)
        return out

    def _spans(self, text: str, tokens: Sequence[Token], logits: np.ndarray, wanted: frozenset[str], policy: Policy) -> list[Span]:
        best, sure = softmax_best(logits)
        labels = [self.labels[i] if i < len(self.labels) else "O" for i in best]
        least = min((policy.thresholds.get(t, 0.5) for t in wanted), default=1.0)
        spans = [trim_span(s) for s in entity_spans(decode_labels(tokens, labels, sure.tolist()), text, least)]
        return [s for s in merge_adjacent(spans, text) if s.type in wanted and s.confidence >= policy.thresholds.get(s.type, 0.5)]


def onnx_predictor(path: str, threads: int = 1, padding: int = 1) -> Predictor:
    """Predictor of a model file, opened once in each worker process; texts of a batch are padded to the longest."""
    state: dict = {}

    def predict(batches: list[list[int]]) -> list[np.ndarray]:
        if "session" not in state:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = threads
            state["session"] = onnxruntime.InferenceSession(path, options)
        session = state["session"]
        size = max(map(len, batches), default=0)
        padded = np.array([[*ids, *[padding] * (size - len(ids))] for ids in batches], np.int64)
        mask = np.array([[1] * len(ids) + [0] * (size - len(ids)) for ids in batches], np.int64)
        feeds = {"input_ids": padded, "attention_mask": mask, "token_type_ids": np.zeros_like(padded)}
        logits = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
        return [row[: len(ids)] for row, ids in zip(logits, batches, strict=True)]

    return predict


def detect_named(text: Column, model: Model, policy: Policy) -> Column:
    """Spans of the model as an array column; one Arrow crossing."""

    @once
    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        found = model.predict_all([t or "" for t in given], policy)
        return pa.array([None if t is None else [s.row() for s in spans] for t, spans in zip(given, found, strict=True)], ARROW_SPANS)

    return find(text)


def decode_labels_frame(tokens: DataFrame, group: str, order: str, label: str, start: str, end: str, confidence: str) -> DataFrame:
    """Entities of a table of labelled tokens: gaps and islands within the group. (group, entity_no, label, start, end, confidence)"""
    w = Window.partitionBy(group).orderBy(order)
    kind = F.nullif(F.regexp_extract(label, "^[BI]-([^-]+)$", 1), F.lit(""))
    rows = tokens.withColumn("_kind", kind).withColumn("_begins", F.when(kind.isNull(), False).otherwise(F.col(label).startswith("B-") | ~F.lag(kind).over(w).eqNullSafe(kind)))
    rows = rows.withColumn("_island", F.sum(F.col("_begins").cast("int")).over(w)).where("_kind IS NOT NULL")
    found = rows.groupBy(group, F.col("_island").alias("entity_no")).agg(F.first("_kind").alias("label"), F.min(start).alias("start"), F.max(end).alias("end"), F.avg(confidence).alias("confidence"))
    return found
