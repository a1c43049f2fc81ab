"""Problem 8: mixing sources to target shares of the total size in tokens.

Every document has a membership in the domains (sources): the posterior given its label where it has one, which is certainty, else the posterior of a
classifier trained on labelled rows. It counts for one domain, drawn from its membership. The total size is the largest at which every
domain that has documents can still reach its share with no document used more often than its domain allows. Nonnegative rates of the documents
are then fitted by projected-gradient least squares, so that the expected tokens of each domain match its target. An iteration is one pass over
the documents where they lie: a document's rate follows from its membership and the steps so far, a number a domain each, and only the sums of
expected tokens by domain reach the driver. At last the rates of each domain are scaled to what the drawn domains ask for.

A document's copies are the whole part of its rate and one more for those at which the running sum of the rests, in order of size, passes a
whole number (systematic rounding); so the tokens of a domain are off by about one document. The running sums go over bins of sizes first, so
that a domain with a third of all rows is not gathered in a task.

Defined results: null and empty texts have no tokens and are not used; documents of a source without a target are not used; sources with a
target but no documents stay at a share of zero and the others keep their ratios; null or zero repeats mean that a source is not used.
Repeated rows are documents of their own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from maskwright.llm.encode import DEFAULT_VOCABULARY, token_count
from maskwright.runtime import bounded, cut, once

#: Labelled rows of each source that the classifier learns from, those with the smallest hash of their id.
SAMPLE = 300
BUCKETS = 1024
#: Passes of the least squares at most, and the change of a domain's expected share of its goal at which they end.
ROUNDS, CLOSE = 60, 1e-4
#: Passes in which rates are scaled to the drawn domains, at most.
SCALINGS = 20
#: Parts of a copy in which rests are summed, and groups into which the documents of a size are cut.
UNIT, SALTS = 1 << 20, 16
#: Fixed value: what counts as a word.
_WORD = re.compile(r"[^\W\d_]{2,}")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def features(text: str | None, labels: Sequence[object]) -> np.ndarray:
    """Hashed words, normalised to length 1, the signs and blanks that occur, and the values of other columns."""
    x = np.zeros(BUCKETS)
    text = text or ""
    for word in set(_WORD.findall(text.casefold())):
        x[_bucket("w" + word)] += 1
    if n := np.linalg.norm(x):
        x /= n
    for sign in {ch for ch in set(text) if not ch.isalnum()}:
        x[_bucket("s" + sign)] += 0.5
    for k, value in enumerate(labels):
        x[_bucket(f"c{k}={value}")] += 0.5
    return x


@dataclass
class DomainClassifier:
    """Softmax regression on hashed features."""

    domains: tuple[str, ...]
    weights: np.ndarray

    @classmethod
    def fit(cls, domains: Sequence[str], x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> DomainClassifier:
        x = np.hstack([x, np.ones((len(x), 1))])
        weights, momentum = np.zeros((x.shape[1], len(domains))), 0.0
        goal = np.eye(len(domains))[y]
        for _ in range(rounds):
            momentum = 0.9 * momentum + x.T @ (_softmax(x @ weights) - goal) / len(x) + decay * weights
            weights = weights - rate * 0.1 * momentum
        return cls(tuple(domains), weights)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.hstack([x, np.ones((len(x), 1))]) @ self.weights)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _learn(labelled: DataFrame, key: str, text: str, source: str, others: Sequence[str], domains: Sequence[str], sample: int) -> DomainClassifier | None:
    hashed = labelled.where(F.col(source).isin(*domains)).select(F.col(key).alias("id"), F.col(source).alias("s"), F.xxhash64(key).alias("h"))
    chosen = hashed.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy("h", "id"))).where(F.col("n") <= sample).select(F.col("id").alias("_chosen")).distinct()
    rows = labelled.join(F.broadcast(chosen), F.col(key) == F.col("_chosen"), "left_semi").where(F.col(source).isin(*domains)).select(text, source, *others).collect()  # at most sample rows a source
    if not rows:
        return None
    x = np.stack([features(r[0], r[2:]) for r in rows])
    return DomainClassifier.fit(domains, x, np.array([list(domains).index(r[1]) for r in rows]))


def rates_after(members: np.ndarray, limits: np.ndarray, steps: Sequence[np.ndarray]) -> np.ndarray:
    """The documents' rates after the given gradient steps from zero, each projected on [0, limit]."""
    rates = np.zeros(len(members))
    for step in steps:
        rates = np.clip(rates - members @ step, 0, limits)
    return rates


def _columns(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    members, tokens, limits = (batch.column(c) for c in ("membership", "tokens", "most"))
    return np.asarray(members.flatten(), float).reshape(-1, n), np.asarray(tokens, float), np.asarray(limits, float)


def fit_rates(sized: DataFrame, goals: np.ndarray, rounds: int = ROUNDS, close: float = CLOSE) -> list[np.ndarray]:
    """Gradient steps after which the expected tokens of (membership, tokens, most) rows by domain come closest to ``goals``.

    Projected gradient on 1/2 sum_d (expected_d - goal_d)^2 / available_d, in the metric of the documents' tokens; a pass over the rows each.
    """
    n = len(goals)

    def totals(steps: list[np.ndarray] | None) -> np.ndarray:
        """Expected tokens by domain after ``steps``, or all that are available."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                members, tokens, most = _columns(batch, n)
                total += members.T @ (tokens if steps is None else tokens * rates_after(members, most, steps))
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total)], ["d", "x"])

        out = np.zeros(n)
        for r in sized.select("membership", "tokens", "most").mapInArrow(sums, "d int, x double").groupBy("d").agg(F.sum("x").alias("x")).collect():  # one row a domain
            out[r.d] = r.x
        return out

    available = np.maximum(totals(None), 1e-9)
    steps = [-goals / available]
    before = np.zeros(n)
    for _ in range(rounds):
        expected = totals(steps)
        if np.abs(expected - before).max() <= close * max(goals.max(), 1e-9):
            break
        before = expected
        steps.append((expected - goals) / available)
    return steps


def mix(documents: DataFrame, targets: DataFrame, key: str, text: str, source: str, others: Sequence[str] = (), path: str = DEFAULT_VOCABULARY, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """The mixture (key, source, domain, tokens, rate, copies) and the report (source, target_share, ..., actual_share).

    ``domain`` is the label, or a domain drawn from the membership of a document without one. ``targets`` has source, target_share and max_repeat; it is
    the list of the classifier's classes and read as a whole. Of repeated sources the first in order of share counts.
    """
    spark = documents.sparkSession
    rows = targets.where("source IS NOT NULL").orderBy("source", "target_share", "max_repeat").collect()  # one row a class of the model
    goals = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeat"] or 0)) for r in reversed(rows)}
    names = [n for n, (share, most) in sorted(goals.items()) if share > 0 and most > 0]
    model = _learn(documents, key, text, source, others, names, sample) if names else None
    known = list(model.domains) if model else []

    @once
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def soft(texts: pa.Array, *columns: pa.Array) -> pa.Array:
        values = [c.to_pylist() for c in columns]
        given = texts.to_pylist()
        out: list = [None] * len(given)
        at = [k for k, t in enumerate(given) if t is not None and model is not None]
        if at:
            for k, p in zip(at, model.posteriors(np.stack([features(given[k], [v[k] for v in values]) for k in at])).tolist(), strict=True):
                out[k] = p
        return pa.array(out, pa.list_(pa.float64()))

    label = F.col(source)
    one_hot = F.array(*[F.when(label == n, F.lit(1.0)).otherwise(F.lit(0.0)) for n in known]) if known else F.lit(None).cast("array<double>")
    guess = soft(F.when(label.isNull() & (F.length(text) > 0), F.col(text)), *[F.col(c) for c in others])
    read = documents.where(label.isNull() | label.isin(*names)).select(
        F.col(key).alias("id"), label.alias("source"), token_count(F.col(text), path).alias("tokens"), F.when(label.isNull(), guess).otherwise(one_hot).alias("membership")
    )
    # a document counts for one domain, drawn from its membership
    drawn = F.pmod(F.xxhash64("id", F.lit("domain")), F.lit(UNIT)) / F.lit(float(UNIT))
    reached = F.transform("membership", lambda _, i: F.aggregate(F.slice("membership", 1, i + 1), F.lit(0.0), lambda a, b: a + b))
    place = F.least(F.size(F.filter(reached, lambda c: c <= drawn)) + 1, F.lit(max(len(known), 1)))
    domain = F.coalesce("source", F.try_element_at(F.array(*map(F.lit, known)), place)) if known else F.lit(None).cast("string")
    most = F.coalesce(*[F.when(F.col("domain") == n, F.lit(float(goals[n][1]))) for n in known], F.lit(0.0))
    sized = cut(read.where("tokens > 0 AND membership IS NOT NULL").withColumn("domain", domain).withColumn("most", most))

    by_domain = {r.domain: r.reach for r in sized.groupBy("domain").agg(F.sum(F.col("tokens") * F.col("most")).alias("reach")).collect()}
    share, reach = np.array([goals[n][0] for n in known]), np.array([float(by_domain.get(n) or 0) for n in known])
    there = reach > 0
    total = float((reach[there] / share[there]).min()) * share[there].sum() if there.any() else 0.0
    wanted = np.where(there, share / max(share[there].sum(), 1e-12) * total, 0.0)
    steps = fit_rates(sized, wanted) if there.any() else []

    @once
    @F.arrow_udf(T.DoubleType())
    def rate(members: pa.Array, limits: pa.Array) -> pa.Array:
        return pa.array(rates_after(np.asarray(members.flatten(), float).reshape(len(members), -1), np.asarray(limits, float), steps))

    rated = cut(sized.withColumn("rate", rate(F.col("membership"), F.col("most"))).drop("membership"))
    factors = dict.fromkeys(known, 1.0)
    scaled = lambda: F.least("most", F.col("rate") * F.coalesce(*[F.when(F.col("domain") == n, F.lit(f)) for n, f in factors.items()], F.lit(0.0)))
    for _ in range(SCALINGS if there.any() else 0):
        capped = F.col("rate") * F.coalesce(*[F.when(F.col("domain") == n, F.lit(f)) for n, f in factors.items()]) >= F.col("most")
        sums = rated.groupBy("domain").agg(F.sum(scaled() * F.col("tokens")).alias("all"), F.sum(F.when(capped, F.col("most") * F.col("tokens")).otherwise(0.0)).alias("capped")).collect()  # one row a domain
        got = {r.domain: (r["all"], r["all"] - r.capped, w) for n, w in zip(known, wanted, strict=True) for r in sums if r.domain == n and w > 0}
        if all(abs(x / w - 1) < CLOSE for x, _, w in got.values()):
            break
        stuck = [x / w for x, free, w in got.values() if x < w and free < CLOSE * w]
        if stuck:  # nothing is left to scale up in a domain: all others follow it
            wanted = wanted * min(stuck)
            continue
        factors |= {n: factors[n] * (w - x + free) / free for n, (x, free, w) in got.items() if free > CLOSE * w and w > x - free}
        factors |= {n: factors[n] * w / x for n, (x, free, w) in got.items() if w <= x - free}

    parts = rated.withColumn("rate", scaled()).withColumn("whole", F.floor("rate")).withColumn("rest", F.round((F.col("rate") - F.col("whole")) * UNIT).cast("long"))
    binned = parts.withColumn("bin", F.floor(F.log2("tokens") * 16)).withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)))
    group = ["domain", "bin", "salt"]
    sums = binned.groupBy(*group).agg(F.sum("rest").alias("sum"))  # as many rows a domain as there are bins and salts
    earlier = F.coalesce(F.sum("sum").over(Window.partitionBy("domain").orderBy("bin", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = bounded(cut(sums.select(*group, earlier.alias("before"))))
    running = F.col("before") + F.sum("rest").over(Window.partitionBy(*group).orderBy("tokens", "id").rowsBetween(Window.unboundedPreceding, 0)) + UNIT // 2
    extra = F.floor(running / UNIT) - F.floor((running - F.col("rest")) / UNIT)
    used = binned.join(begun, group).select("id", "source", "domain", "tokens", "rate", (F.col("whole") + extra).cast("int").alias("copies")).where("copies > 0")
    mixture = used.withColumnRenamed("id", key)
    counted = used.groupBy("domain").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    report = spark.createDataFrame([(n, s, m) for n, (s, m) in sorted(goals.items())], "source string, target_share double, max_repeat int").join(counted.withColumnRenamed("domain", "source"), "source", "left")
    whole = report.agg(F.sum("tokens").alias("whole"))
    report = report.join(F.broadcast(whole), F.lit(True)).select(
        "source", "target_share", "max_repeat", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_copies")], F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share")
    )
    return mixture, report
