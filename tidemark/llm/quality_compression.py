"""Quality by compression: a text that shrinks more with the good dictionary than with the bad one is good.

Two zstandard dictionaries are built from a bounded sample of good and of bad labelled texts. Each whole text is
compressed with each of them and with none; the size difference over the plain size, with how far the text shrinks
by itself, becomes a probability by a logistic curve fitted to labelled texts that are not in the dictionaries.

Bounds (parameters): ``sample_rows`` labelled texts per class for the dictionaries and as many to calibrate, the
first in the order of a hash of their ids; ``dictionary_bytes`` per dictionary, to which every sampled text gives an
even share (short ones all they have) in passages of about ``passage_bytes`` spread over the whole text. Scores cover every row and the whole text.

Defined results: a null text counts as empty; an empty text has no evidence and gets the share of good labels.
Without labels of both classes every score is the share of good labels (0.5 if there are none). Labels that are null,
that contradict each other or whose id is null are not used. Repeated rows get the same score.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, carrying, saved, texts

SAMPLE_ROWS = 2000
DICTIONARY_BYTES = 512 << 10
PASSAGE_BYTES = 128
LEVEL = 3
RIDGE = 1e-2
#: The largest part of the gradient, for each row, at which the curve counts as fitted.
STEEP = 1e-9


@dataclass(frozen=True)
class Model:
    """Dictionaries of both classes (None without labels) and the weights of the logistic curve."""

    good: bytes | None
    bad: bytes | None
    weights: tuple[float, ...]
    prior: float


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Excerpts of the samples, as many as fit; the nearest the end are cheapest to refer to."""
    picked, held = [], 0
    for x in samples:
        if held + len(x) > size:
            break
        picked.append(x)
        held += len(x)
    return b"\n".join(reversed(picked))[-size:]


def row_share(lengths: list[int], size: int) -> int:
    """The most bytes of a row with which all rows together fill about ``size`` bytes and no more."""
    left, rest = size, sorted(lengths)
    for i, n in enumerate(rest):
        share = left // (len(rest) - i)
        if n > share:
            return max(1, share)
        left -= n
    return rest[-1] if rest else 1


def passages(text: bytes, most: int, passage_bytes: int) -> bytes:
    """At most ``most`` bytes of a text, in passages that are spread evenly over the whole of it."""
    if len(text) <= most:
        return text
    count = max(1, round(most / passage_bytes))
    wide = most // count
    stretch = len(text) / count
    shift = zlib.crc32(text) / 2**32 * (stretch - wide)  # not all texts' first bytes
    return b"".join(text[(at := int(i * stretch + shift)) : at + wide] for i in range(count))


def excerpts(rows: DataFrame, most: dict[int, int], passage_bytes: int) -> DataFrame:
    """(doc_id, y, x) of rows (doc_id, y, text): passages of each text, at most ``most[y]`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                pairs = zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("y").to_pylist(), strict=True)
                found = pa.array([passages(t, most[y], passage_bytes) for t, y in pairs], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), found], names=["doc_id", "y", "x"])

    return rows.select("doc_id", "y", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, x binary")


class Sizes:
    """Compressed sizes with the good dictionary, the bad one and none."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.coders = []
        for content in (good, bad):
            kept = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=kept, **plain))
        self.coders.append(zstandard.ZstdCompressor(**plain))

    def features(self, text: bytes) -> tuple[float, ...]:
        good, bad, plain = (len(c.compress(text)) for c in self.coders)
        return (bad - good) / plain, (bad - good) / max(len(text), 1), math.log(plain / max(len(text), 1)), 1 / math.sqrt(len(text) + 1)


def design(features: np.ndarray) -> np.ndarray:
    """Columns of the logistic curve: constant, both normalised differences, own shrinking and its square, shortness."""
    d, e, s, r = features.T
    return np.column_stack([np.ones(len(d)), d, e * 10, s, s * s, r])


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> float:
    z = x @ w
    return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * w @ w)


def slope(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the loss, and the probabilities."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
    return x.T @ (p - y) + ridge * w, p


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 100) -> np.ndarray:
    """Logistic regression by Newton steps, halved until the loss falls; a small ridge keeps separable samples finite.

    The loss is strictly convex, so this ends at its least value. ArithmeticError if the gradient is still above
    ``STEEP`` (relative to the rows) after all rounds.
    """
    w = np.zeros(x.shape[1])
    now = loss(x, y, w, ridge)
    for _ in range(rounds):
        gradient, p = slope(x, y, w, ridge)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        share = 1.0
        while share > 1e-12 and not (ahead := loss(x, y, w - share * step, ridge)) <= now:
            share /= 2
        if share <= 1e-12:
            break
        w, now = w - share * step, ahead
        if np.abs(step).max() < 1e-10 * (1 + np.abs(w).max()):
            break
    if not np.abs(slope(x, y, w, ridge)[0]).max() <= STEEP * max(1, len(x)):
        raise ArithmeticError("the curve of the quality classifier has not converged")
    return w


def clean_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of ids with one non-null value."""
    chosen = labels.select(labels["doc_id"], labels["quality"]).dropna()
    return chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, passage_bytes: int = PASSAGE_BYTES) -> Model:
    """Fit on labelled rows whose crc32(id) mod 3 is 0 (dictionaries) or 2 (calibration); 1 is held out."""
    spark = docs.sparkSession
    known = clean_labels(labels).withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 3).where("fold <> 1")
    counts = {(r["quality"] == 1): r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = (counts.get(True, 0) + 1) / (total + 2)
    if len(counts) < 2:
        return Model(None, None, (), prior)
    ids = []
    for fold in (0, 2):
        for is_good in (True, False):
            of = known.where((F.col("fold") == fold) & ((F.col("quality") == 1) == F.lit(is_good)))
            ids += of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()  # at most 4 x sample_rows ids
    chosen = spark.createDataFrame([(r["doc_id"], int(r["quality"] == 1), int(r["fold"])) for r in ids], "doc_id long, y int, fold int")
    body = texts(docs, "doc_id", "text")
    sample = saved(body.join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0), "quality-sample")
    rows = sample.where("fold = 0").groupBy("y", "doc_id").agg(F.max("text").alias("text"))  # repeated rows once
    lengths: dict[int, list[int]] = {1: [], 0: []}
    for r in rows.select("y", F.octet_length("text").alias("n")).collect():  # at most 2 x sample_rows numbers
        lengths[r["y"]].append(r["n"])
    size = min(dictionary_bytes, *(sum(x) for x in lengths.values()))
    if not size:
        return Model(None, None, (), prior)
    most = {y: row_share(x, size) for y, x in lengths.items()}
    kept = {y: [] for y in lengths}
    for r in excerpts(rows, most, passage_bytes).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # 2 x dictionary_bytes
        kept[r["y"]].append(bytes(r["x"]))
    good, bad = (dictionary(kept[y], size) for y in (1, 0))
    measured = measure(sample.where("fold = 2"), good, bad, "y").limit(2 * sample_rows).collect()
    y = np.array([r["y"] for r in measured], float)
    if not 0 < y.sum() < len(y):
        return Model(None, None, (), prior)
    w = fit(design(np.array([r["features"] for r in measured])), y)
    # the sample holds as many of both classes as there are; go back to the share of good ones among all labels
    w[0] += math.log(prior / (1 - prior)) - math.log(y.mean() / (1 - y.mean()))
    return Model(good, bad, tuple(w), prior)


def measure(docs: DataFrame, good: bytes, bad: bytes, *carried: str) -> DataFrame:
    """(carried columns, features) of every whole text."""
    chosen, kinds = carrying(docs, carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for whole in batches:
            for batch in batches_of(whole, "text"):
                found = [sizes.features(t or b"") if t else (0.0,) * 4 for t in batch.column("text").cast(pa.binary()).to_pylist()]
                names = [f.name for f in kinds]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "features"])

    out = T.StructType([*kinds, T.StructField("features", T.ArrayType(T.DoubleType()))])
    return chosen.mapInArrow(run, out).toDF(*carried, "features")


def scored(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """(carried columns, score): the probability that the whole text is good."""
    chosen, kinds = carrying(docs, carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.good is not None else None
        w = np.array(model.weights)
        for whole in batches:
            for batch in batches_of(whole, "text"):
                bodies = batch.column("text").cast(pa.binary()).to_pylist()
                score = np.full(len(bodies), model.prior)
                if sizes is not None and (at := [i for i, t in enumerate(bodies) if t]):
                    x = design(np.array([sizes.features(bodies[i]) for i in at]))
                    score[at] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                names = [f.name for f in kinds]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    return chosen.mapInArrow(run, T.StructType([*kinds, T.StructField("score", T.DoubleType())])).toDF(*carried, "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are likelier good than not, with all their columns; the others go."""
    model = train(docs, labels)
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    named = plain.select(*plain.columns, plain[f"c{columns.index('text')}"].alias("text"))
    kept = scored(named, model, *plain.columns).where("score >= 0.5")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
