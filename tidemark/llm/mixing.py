"""Document rates that give each domain its target share of tokens, with soft membership.

A classifier learnt from a labelled table gives every document a posterior over the domains. Rates x >= 0 (how often a
document is to be used) are chosen so that the expected tokens per domain, sum of x * tokens * posterior, match target
totals: least squares, each domain's error relative to its tokens at x = 1, by projected gradient from there with
momentum. In that scale the step size is one and few steps are needed. Rates stay in the tasks: the gradient of a row
needs only its posterior and the domains' current errors, so a step is one sum over a compact table, and a row's rate
is found by replaying the errors of the steps so far.

The classifier is a softmax regression over the presence of hashed words. Only words count whose spread over the
domains is no accident (likelihood-ratio test), at most ``MOST_FEATURES`` of them. It is learnt from a bounded sample:
at most ``SAMPLE_ROWS`` labelled documents per domain, the first in the order of a hash of their ids. Everything else
covers all documents.

Defined results: a null or empty text has no tokens; its posterior is the share of each domain among the labels and
its rate follows from it. Rows with null or contradictory labels are not learnt from. Without labels all posteriors
are equal. A domain that no document can supply stays short of its target. Repeated rows get equal rates. Targets are
scaled to sum to one. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, carrying, saved

BUCKETS = 1 << 18
SAMPLE_ROWS = 4000
#: Least likelihood-ratio statistic of a word that counts, and how many may.
LEAST_RATIO = 25.0
MOST_FEATURES = 4096
#: Steps and ridge of the regression.
ROUNDS = 150
RIDGE = 1e-4
STEPS = 100
TOLERANCE = 1e-4


class Hashed:
    """Bucket of each word; words seen before are kept."""

    def __init__(self, most: int = 100_000) -> None:
        self.known: dict[str, int] = {}
        self.most = most

    def buckets(self, text: str) -> tuple[np.ndarray, int]:
        """The different buckets of the words of a text, and its number of words."""
        if len(self.known) > self.most:
            self.known.clear()
        words = text.lower().split()
        seen = set(words)
        for w in seen:
            if w not in self.known:
                self.known[w] = xxhash.xxh64_intdigest(w) % BUCKETS
        return np.unique(np.fromiter(map(self.known.__getitem__, seen), np.int64, len(seen))), len(words)


@dataclass(frozen=True)
class Classifier:
    """Row of each bucket in ``weights`` (feature, domain), -1 for those that do not count, and a bias per domain."""

    place: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def features(self, buckets: np.ndarray) -> np.ndarray:
        at = self.place[buckets]
        return at[at >= 0]

    def posterior(self, buckets: np.ndarray) -> np.ndarray:
        score = self.bias + self.weights[self.features(buckets)].sum(axis=0)
        p = np.exp(score - score.max())
        return p / p.sum()


def softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def regress(rows: list[np.ndarray], y: np.ndarray, features: int, domains: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression on rows of feature numbers, by Adam steps over all rows."""
    size = np.array([len(r) for r in rows])
    flat = np.concatenate([*rows, np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(rows)), size)
    wanted = np.eye(domains)[y]
    table = np.zeros((features + 1, domains))  # the last row is the bias
    mean, square = np.zeros_like(table), np.zeros_like(table)
    for step in range(1, ROUNDS + 1):
        score = np.stack([np.bincount(owner, table[flat, k], len(rows)) for k in range(domains)], axis=1) + table[-1]
        off = (softmax(score) - wanted) / len(rows)
        slope = np.empty_like(table)
        for k in range(domains):
            slope[:-1, k] = np.bincount(flat, off[owner, k], features)
        slope[-1] = off.sum(axis=0)
        slope[:-1] += RIDGE * table[:-1]
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        table -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return table[:-1], table[-1]


def sample_of(docs: DataFrame, labelled: DataFrame, domains: int, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(domain, text) of the sampled labelled documents, and how many labelled rows each domain has."""
    known = labelled.select(labelled["doc_id"], labelled["domain"]).dropna()
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("_most")).where("domain = _most")
    seen = np.zeros(domains)
    for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect():  # one per domain
        seen[r["domain"]] = r["n"]
    ids = []
    for d in range(domains):
        ids += known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["domain"]) for r in ids], "doc_id long, domain int")
    rows = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(chosen), "doc_id")  # domains x sample_rows ids at most
    return saved(rows.select("domain", "text"), "domain-sample"), seen


def learnt(rows: DataFrame, seen: np.ndarray) -> Classifier:
    """The classifier from the sampled texts; ``seen`` holds the number of labels of each domain."""
    domains = len(seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Hashed(), np.zeros((domains, BUCKETS), np.int32)
        for whole in batches:
            for batch in batches_of(whole, "text"):
                for domain, text in zip(batch.column("domain").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    total[domain, hashed.buckets(text or "")[0]] += 1
        d, b = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"domain": pa.array(d.astype(np.int32)), "bucket": pa.array(b.astype(np.int32)), "n": pa.array(total[d, b].astype(np.int64))})

    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    of = np.array([sizes.get(d, 0) for d in range(domains)], float)
    priors = np.log((seen + 1) / (seen + 1).sum())
    place = np.full(BUCKETS, -1, np.int64)
    if not of.sum():
        return Classifier(place, np.zeros((0, domains)), priors)
    counted = rows.mapInArrow(count, "domain int, bucket int, n long").groupBy("bucket")
    counted = counted.agg(*(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{d}") for d in range(domains)))
    every = sum((F.col(f"n{d}") for d in range(1, domains)), F.col("n0"))

    def part(seen_: Column, expected: Column) -> Column:
        return F.when((seen_ > 0) & (expected > 0), seen_ * F.log(seen_ / expected)).otherwise(F.lit(0.0))

    ratio = F.lit(0.0)
    for d in range(domains):
        expected = every * (of[d] / of.sum())
        ratio = ratio + 2 * (part(F.col(f"n{d}"), expected) + part(of[d] - F.col(f"n{d}"), of[d] - expected))
    chosen = counted.withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "bucket")
    kept = chosen.limit(MOST_FEATURES).collect()
    place[[r["bucket"] for r in kept]] = np.arange(len(kept))
    bare = Classifier(place, np.zeros((len(kept), domains)), priors)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for whole in batches:
            for batch in batches_of(whole, "text"):
                at = [bare.features(hashed.buckets(t or "")[0]).tolist() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(at, pa.list_(pa.int32()))], names=["domain", "at"])

    sample = rows.mapInArrow(found, "domain int, at array<int>").collect()  # the bounded sample, at most MOST_FEATURES numbers each
    sample.sort(key=lambda r: (r["domain"], r["at"]))
    y = np.array([r["domain"] for r in sample])
    weights, bias = regress([np.array(r["at"], np.int64) for r in sample], y, len(kept), domains)
    # the sample holds as many of each domain as there are, up to its bound: back to the shares among all labels
    bias = bias + priors - np.log((of + 1) / (of + 1).sum())
    return Classifier(place, weights, bias)


def memberships(docs: DataFrame, model: Classifier, *carried: str) -> DataFrame:
    """(carried columns, tokens, p): blank-separated words and posterior of each whole text."""
    chosen, kinds = carrying(docs, carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for whole in batches:
            for batch in batches_of(whole, "text"):
                tokens, p = [], []
                for text in batch.column("text").to_pylist():
                    buckets, n = hashed.buckets(text or "")
                    tokens.append(n)
                    p.append(model.posterior(buckets).tolist())
                names = [f.name for f in kinds]
                columns = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=[*names, "tokens", "p"])

    out = T.StructType([*kinds, T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    return chosen.mapInArrow(run, out).toDF(*carried, "tokens", "p")


Steps = Sequence[tuple[np.ndarray, float]]


def replay(p: np.ndarray, steps: Steps, size: float, ahead: bool = False) -> np.ndarray:
    """Rates after one projected step per (error, momentum), from rate 1; ``ahead`` gives the point of the next gradient."""
    before = now = point = np.ones(len(p))
    for error, momentum in steps:
        before, now = now, np.maximum(0.0, point - size * (p @ error))
        point = now + momentum * (now - before)
    return point if ahead else now


def _matrix(batch: pa.RecordBatch, domains: int) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)


def solve(members: DataFrame, weights: Sequence[float], total: float | None = None) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Error and momentum of each projected-gradient step, and the step size: what ``replay`` needs for any row's rate.

    ``members`` holds tokens and p; ``total`` is the number of tokens to reach, by default as many as there are.
    """
    k = len(weights)
    share = np.array(weights, float) / sum(weights)

    def sums(steps: list, size: float, moments: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got, square = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    p, t = _matrix(batch, k), batch.column("tokens").to_numpy().astype(float)
                    got += (replay(p, steps, size, ahead=True) * t) @ p
                    if moments:
                        square += (p * t[:, None]).T @ p
            flat = np.concatenate([got, square.ravel()]) if moments else got
            yield pa.RecordBatch.from_pydict({"i": list(range(len(flat))), "s": flat})

        found = {r["i"]: r["s"] for r in members.select("tokens", "p").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
        return np.array([found.get(i, 0.0) for i in range(k + k * k * moments)])

    first = sums([], 0.0, True)
    got, square = first[:k], first[k:].reshape(k, k)
    if not got.sum():
        return [], 0.0
    goal = share * (total if total is not None else got.sum())
    scale = np.where(got > 0, got, got.sum())
    root = 1 / np.sqrt(scale)
    size = 1 / np.linalg.eigvalsh(square * root[:, None] * root[None, :])[-1]
    steps: list[tuple[np.ndarray, float]] = []
    pace, worst = 1.0, np.inf
    for _ in range(STEPS):
        error = (got - goal) / scale
        loss = float((error**2 * scale).sum())
        if np.abs(error).max() <= TOLERANCE or (steps and np.abs(error - steps[-1][0]).max() <= TOLERANCE / 100):
            break
        if loss > worst:  # the momentum carried too far: start it anew
            pace = 1.0
        worst, later = loss, (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        steps.append((error, (pace - 1) / later))
        pace = later
        got = sums(steps, size, False)
    return steps, size


def rates(members: DataFrame, steps: Steps, size: float, domains: int) -> DataFrame:
    """``members`` with a column ``rate``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = replay(_matrix(batch, domains), steps, size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    return members.mapInArrow(run, T.StructType([*members.schema, T.StructField("rate", T.DoubleType())]))


def fitted(docs: DataFrame, labelled: DataFrame, weights: Sequence[float], *carried: str) -> DataFrame:
    """(carried columns, tokens, p, rate) for every document."""
    sample, seen = sample_of(docs, labelled, len(weights))
    members = saved(memberships(docs, learnt(sample, seen), *carried), "memberships")
    steps, size = solve(members, weights)
    return rates(members, steps, size, len(weights))


def mixed(docs: DataFrame, labelled: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``docs`` with each row as often as its rate says: the whole part, and once more for the fraction by a hash of
    the id (of the text where the id is null)."""
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at = {c: F.col(f"c{columns.index(c)}").alias(c) for c in ("doc_id", "text")}
    own = plain.select(*plain.columns, *at.values())
    sample, seen = sample_of(docs, labelled, len(weights))
    model = learnt(sample, seen)
    compact = saved(memberships(docs, model), "memberships")
    steps, size = solve(compact, weights)
    rated = rates(memberships(own, model, *plain.columns, "doc_id"), steps, size, len(weights))
    chance = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col(f"c{columns.index('text')}"))), F.lit(1 << 20)) / (1 << 20)
    times = F.floor(F.col("rate") + chance).cast("int")
    kept = rated.where(times > 0).withColumn("_nth", F.explode(F.sequence(F.lit(1), times)))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
