"""Problem 4: language of texts and of the segments of mixed texts.

Each language has probabilities of the pieces of a fixed public vocabulary, learnt by expectation-maximisation from labelled
rows; no piece crosses a word. A word's probability in a language is the sum over all its segmentations into pieces (forward
algorithm), a sentence's that of its words. The sentences of a text form a chain whose language seldom changes: the best
path gives the segments. To find the path, what one word may count is bounded; a segment's confidence is the posterior of its
language by the likelihoods as they are, all languages being equally likely before, and its evidence the bounded margin over the next one.

Only words that begin with a small letter are scored, so that names, headings and formulas have no say; neither have particles of
names alone. Sentences without scored words belong to the segment before them (or after, at the start). In a text without any
scored words the sentences of at least ``CAPITAL_WORDS`` words that are written in capitals throughout are scored instead.

Learning takes at most ``SAMPLE`` labelled rows of each label and table, those with the smallest hash of their id; labels may
be wrong, so sentences are relabelled by the first model and the final one is learnt from what it agrees with.

Defined results: null, empty and wordless texts have no segments; a text that says little has one, of low confidence and evidence; a label is compared without case and without what follows
``-`` or ``_``; repeated rows count each. Positions are code points.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskwright.runtime import once

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled rows to learn from, for each label and table.
SAMPLE = 400
#: Cost, in nats, of a change of language between two sentences.
CHANGE = 7.0
#: A text in one language needs this much evidence, in nats, over the next language to be held against its label.
EVIDENCE = 2.5
#: Words that a sentence in capitals needs to be scored.
CAPITAL_WORDS = 5
#: What one word may count for one language over another, in nats; so two odd names make no segment.
WORD_EVIDENCE = 3.0
#: Probability that is spread evenly over all pieces, the same in each language, so that no language favours unknown words.
SMOOTHING = 0.02
#: Evidence, in nats, at which a sentence of the sample is taken to have another label than its row.
RELABEL = 8.0
#: Tokens that a worker keeps scores of; beyond it the table starts anew, which changes no result.
KEPT = 1 << 18

#: Particles that names hold in any language; the first ones count for none, the others bear no sentence.
NAME_PARTICLES = frozenset("von van di zu y e".split())
PARTICLES = NAME_PARTICLES | frozenset("de di von van der den del della la le du des da dos y e und et zu bd rue via calle piso".split())
_UNIT = re.compile(r"(?<=[.!?…])[\"»”’)\]]*\s+|[\r\n]+")
_WORDS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[@=\d_/<>\\{}|+*#~^\[\]]|\w\.\w|^\((?:at|dot)\)$")


@lru_cache(2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """The pieces of the vocabulary that can stand in words, and the length of the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    usable = {p: i for i, p in enumerate(p for p in pieces if _WORDS.fullmatch(p.lstrip("▁") or "a") and "▁" not in p[1:])}
    return usable, max(map(len, usable))


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of ``text``."""
    found, start = [], 0
    for gap in _UNIT.finditer(text):
        if gap.start() > start:
            found.append((start, gap.end()))
        start = gap.end()
    if start < len(text):
        found.append((start, len(text)))
    return found


def scored_words(token: str) -> list[str]:
    """The words of a token between blanks that count: small initial, no digits, signs or addresses in the token."""
    if _ODD.search(token):
        return []
    return [w for w in _WORDS.findall(token) if w[0].islower()]


def _lattice(word: str, pieces: dict[str, int], longest: int) -> list[list[tuple[int, int]]]:
    """For each end in the marked word, the (start, piece) that end there; characters without a piece have piece -1."""
    marked = "▁" + word
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(marked) + 1)]
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - longest), end):
            if (piece := pieces.get(marked[start:end])) is not None:
                ends[end].append((start, piece))
        if not ends[end]:
            ends[end].append((end - 1, -1))
    return ends


_FOREIGN = math.exp(-12)  # probability of a character without a piece, the same in all languages


def forward(word: str, probabilities: np.ndarray, pieces: dict[str, int], longest: int) -> np.ndarray:
    """Log probability of ``word`` in each language: the sum over all segmentations."""
    ends = _lattice(word, pieces, longest)
    alpha = np.zeros((len(ends), probabilities.shape[1]))
    alpha[0] = 1
    for end in range(1, len(ends)):
        for start, piece in ends[end]:
            alpha[end] += alpha[start] * (probabilities[piece] if piece >= 0 else _FOREIGN)
    return np.log(np.maximum(alpha[-1], 1e-290))


class _Lattices:
    """The lattices of many words, their edges ordered by the position they end at."""

    def __init__(self, words: Sequence[str], path: str):
        pieces, longest = vocabulary(path)
        edges = [(end, w, start, piece) for w, word in enumerate(words) for end, into in enumerate(_lattice(word, pieces, longest)) for start, piece in into]
        table = np.array(sorted(edges) or np.zeros((0, 4)), np.int64)
        self.n_pieces, self.n_words = len(pieces), len(words)
        self.last = np.array([len(w) + 1 for w in words], np.int64)
        self.by_end = [table[table[:, 0] == end, 1:] for end in range(1, int(self.last.max(initial=0)) + 1)]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces, the words counting ``weight`` times each."""
        p = np.append(p, _FOREIGN)  # piece -1
        size = len(self.by_end) + 1
        alpha, beta = np.zeros((self.n_words, size)), np.zeros((self.n_words, size))
        alpha[:, 0] = 1
        for end, e in enumerate(self.by_end, 1):
            alpha[:, end] = np.bincount(e[:, 0], alpha[e[:, 0], e[:, 1]] * p[e[:, 2]], self.n_words)
        rows = np.arange(self.n_words)
        total = np.maximum(alpha[rows, self.last], 1e-290)
        beta[rows, self.last] = weight / total
        out = np.zeros(self.n_pieces + 1)
        for end in range(size - 1, 0, -1):
            e = self.by_end[end - 1]
            flow = p[e[:, 2]] * beta[e[:, 0], end]
            np.add.at(beta, (e[:, 0], e[:, 1]), flow)
            out += np.bincount(np.where(e[:, 2] < 0, self.n_pieces, e[:, 2]), flow * alpha[e[:, 0], e[:, 1]], self.n_pieces + 1)
        return out[:-1]


def learn(counts: Sequence[Counter], path: str, rounds: int = 4) -> np.ndarray:
    """Piece probabilities (pieces x languages) from the word counts of each language, by expectation-maximisation."""
    words = sorted(set().union(*counts))
    lattice = _Lattices(words, path)
    columns = []
    for c in counts:
        weight, p = np.array([float(c[w]) for w in words]), np.full(lattice.n_pieces, 1 / lattice.n_pieces)
        for _ in range(rounds):
            p = lattice.expected(p, weight)
            p = (1 - SMOOTHING) * p / max(p.sum(), 1e-9) + SMOOTHING / lattice.n_pieces
        columns.append(p)
    return np.stack(columns, axis=1)


class _TokenIds(dict):
    """Row numbers of tokens, scored where they are missing."""

    def __init__(self, score):
        self._score = score

    def __missing__(self, token: str) -> int:
        self[token] = row = self._score(token)
        return row


class LanguageModel:
    """Scores and segments of texts; ``langs`` are the columns of ``probabilities``. It carries its vocabulary to the workers."""

    def __init__(self, langs: Sequence[str], probabilities: np.ndarray, path: str = DEFAULT_VOCABULARY, pieces: tuple[dict[str, int], int] | None = None):
        self.langs, self.probabilities, self.path, self.pieces = tuple(langs), probabilities, path, pieces or vocabulary(path)
        self._reset()

    def _reset(self) -> None:
        self._words: dict[str, np.ndarray] = {}
        self._ids = _TokenIds(self._token)
        self._table = np.zeros((1024, 2 * len(self.langs) + 1))  # row 0: tokens that have no say
        self._used = 1

    def __getstate__(self):
        return self.langs, self.probabilities, self.path, self.pieces

    def __setstate__(self, state):
        self.__init__(*state)

    def _token(self, token: str) -> int:
        """Row of the table: bounded scores, scores as they are, number of words that bear a sentence."""
        n = len(self.langs)
        row = np.zeros(2 * n + 1)
        for word in scored_words(token):
            if (score := self._words.get(word)) is None:
                score = np.zeros(n) if word in NAME_PARTICLES else forward(word, self.probabilities, *self.pieces)
                score = score - score.max()
                score = self._words[word] = np.concatenate([np.maximum(score, -WORD_EVIDENCE), score])
            row[:-1] += score
            row[-1] += word not in PARTICLES
        if not row.any():
            return 0
        if self._used == len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        self._table[self._used] = row
        self._used += 1
        return self._used - 1

    def unit_scores(self, parts: list[str]) -> np.ndarray:
        """Of each part: bounded log scores by language, the log probabilities as they are, and the number of words that bear it."""
        if len(self._ids) > KEPT:
            self._reset()
        ids: list[int] = []
        ends = [0]
        known = self._ids.__getitem__
        for part in parts:
            ids.extend(map(known, part.split()))
            ends.append(len(ids))
        sizes = np.diff(ends)
        sums = np.zeros((len(parts), 2 * len(self.langs) + 1))
        filled = sizes > 0
        if filled.any():
            sums[filled] = np.add.reduceat(self._table[ids], np.array(ends[:-1])[filled], axis=0)
        sums[sums[:, -1] == 0] = 0
        return sums

    def segments(self, text: str | None, allowed: Sequence[str] | None = None) -> list[tuple[str, int, int, float, float]]:
        """(language, start, end, confidence, evidence) of the longest runs of sentences in one language."""
        if not text:
            return []
        bounds = units(text)
        parts = [text[a:b] for a, b in bounds]
        scores = self.unit_scores(parts)
        if not scores[:, -1].any():
            capitals = [p.lower() if p.isupper() and len(_WORDS.findall(p)) >= CAPITAL_WORDS else "" for p in parts]
            if not any(capitals):
                return []
            scores = self.unit_scores(capitals)
        n = len(self.langs)
        keep = [i for i, l in enumerate(self.langs) if allowed is None or l in allowed]
        used = np.flatnonzero(scores[:, -1])
        if not len(used):
            return []
        ll, true = scores[used][:, keep], scores[used][:, [n + i for i in keep]]
        best = ll.argmax(1)
        path = best.tolist() if (best == best[0]).all() else self._best_path(ll)
        runs: list[list[int]] = []
        for k, lang in enumerate(path):
            if runs and runs[-1][0] == lang:
                runs[-1][2] = k + 1
            else:
                runs.append([lang, k, k + 1])
        out = []
        for at, (lang, a, b) in enumerate(runs):
            margins, true_margins = (np.delete(x[lang] - x, lang) for x in (ll[a:b].sum(0), true[a:b].sum(0)))
            confidence = 1 / (1 + float(np.exp(-np.clip(true_margins, -700, 700)).sum()))
            start = 0 if at == 0 else bounds[used[a]][0]
            end = len(text) if at == len(runs) - 1 else bounds[used[runs[at + 1][1]]][0]
            out.append((self.langs[keep[lang]], start, end, confidence, float(margins.min(initial=np.inf))))
        return out

    @staticmethod
    def _best_path(ll: np.ndarray) -> list[int]:
        n, k = ll.shape
        value, back = ll[0].copy(), np.zeros((n, k), np.int8)
        for t in range(1, n):
            top = int(value.argmax())
            change = value[top] - CHANGE
            stay = value >= change
            back[t] = np.where(stay, np.arange(k), top)
            value = np.where(stay, value, change) + ll[t]
        path = [int(value.argmax())]
        for t in range(n - 1, 0, -1):
            path.append(int(back[t][path[-1]]))
        return path[::-1]


def label_of(column: Column, langs: Sequence[str]) -> Column:
    """The language that a label names, or null where it names none of ``langs``."""
    name = F.lower(F.regexp_replace(F.trim(column), "[-_].*", ""))
    return F.when(name.isin(*langs), name)


def fit(samples: Sequence[tuple[DataFrame, str, str, str]], langs: Sequence[str], path: str = DEFAULT_VOCABULARY, sample: int = SAMPLE) -> LanguageModel:
    """Learn from (table, id, text, label) tuples: at most ``sample`` rows of each label and table reach the driver."""
    labelled: list[tuple[str, str, int]] = []
    for at, (df, key, text, label) in enumerate(samples):
        named = df.select(label_of(F.col(label), langs).alias("lang"), F.col(key).alias("id"), F.xxhash64(F.col(key)).alias("h")).where("lang IS NOT NULL")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
        chosen = named.withColumn("n", rank).where(F.col("n") <= sample).select("id", "lang").collect()  # without the texts, bounded
        ids = df.sparkSession.createDataFrame(chosen, named.select("id", "lang").schema).dropDuplicates(["id"])
        rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(ids), "id")
        texts = sorted((r.lang, r.text) for r in rows.select("lang", "text").collect())
        labelled += [(lang, t[a:b], at) for lang, t in texts for a, b in units(t)]
    if not labelled:
        raise ValueError("no labelled rows to learn from")
    words = [[w for token in t.split() for w in scored_words(token)] for _, t, _ in labelled]

    def counts(of: Sequence[str | None]) -> list[Counter]:
        """Word counts of each language, every table of a language counting the same."""
        by_table = {(lang, at): Counter() for lang in langs for at in range(len(samples))}
        for lang, found, (_, _, at) in zip(of, words, labelled, strict=True):
            if lang is not None:
                by_table[lang, at].update(found)
        out = []
        for lang in langs:
            joined: Counter = Counter()
            for at in range(len(samples)):
                total = sum(by_table[lang, at].values())
                for w, n in by_table[lang, at].items():
                    joined[w] += n / total
            out.append(joined)
        return out

    given = [lang for lang, _, _ in labelled]
    rows = np.array([langs.index(lang) for lang in given])
    for _ in range(2):
        model = LanguageModel(langs, learn(counts(given), path), path)
        scores = model.unit_scores([t for _, t, _ in labelled])
        ll, some = scores[:, : len(langs)], scores[:, -1] > 0
        best = ll.argmax(1)
        sure = ll[np.arange(len(ll)), best] - ll[np.arange(len(ll)), rows] > RELABEL
        given = [langs[b if s else r] if n else None for b, s, r, n in zip(best, sure, rows, some, strict=True)]
    return LanguageModel(langs, learn(counts(given), path), path)


SEGMENTS = T.ArrayType(T.StructType([*(T.StructField(n, t) for n, t in (("lang", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("confidence", T.DoubleType()), ("evidence", T.DoubleType())))]))
_ARROW = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("evidence", pa.float64())]))


def segments_of(spark: SparkSession, model: LanguageModel, text: Column, allowed: Sequence[str] | None = None) -> Column:
    """The segments of ``text`` as an array; the model, whose size the vocabulary bounds, is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @once
    @F.arrow_udf(SEGMENTS)
    def find(texts: pa.Array) -> pa.Array:
        of = shared.value.segments
        rows = [[{"lang": l, "start": a, "end": b, "confidence": c, "evidence": e} for l, a, b, c, e in of(t, allowed)] for t in texts.to_pylist()]
        return pa.array(rows, _ARROW)

    return find(text)


def identify(spark: SparkSession, model: LanguageModel, df: DataFrame, key: str, text: str, label: str, allowed: Sequence[str], source: str) -> DataFrame:
    """(source_table, row_id, seg_no, lang, start, end, confidence, evidence, known_label, n_segments) of every text with words."""
    rows = df.select(F.col(key).alias("row_id"), label_of(F.col(label), allowed).alias("known_label"), segments_of(spark, model, F.col(text), allowed).alias("segments"))
    flat = rows.select("row_id", "known_label", F.size("segments").alias("n_segments"), F.posexplode("segments").alias("n", "s"))
    return flat.select(F.lit(source).alias("source_table"), "row_id", (F.col("n") + 1).alias("seg_no"), "s.*", "known_label", "n_segments")


def relabel_cases(found: DataFrame) -> DataFrame:
    """The segments of texts whose label is missing, names another language, or which are in several languages.

    A text in one language counts from ``EVIDENCE`` on.
    """
    return found.where(f"n_segments > 1 OR (evidence >= {EVIDENCE} AND (known_label IS NULL OR known_label <> lang))")
