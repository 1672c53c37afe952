"""Document fingerprints: 64-bit SimHash of weighted terms, and a search over permuted block tables.

Terms are the blank-separated words in lower case. A term votes on each bit with the sign of its hash there; its
weight is 1 + ln(count) times the square of its length up to eight characters, so short function words, which all
texts of a language share, weigh little. A text without words votes as one term, an empty one has fingerprint zero.

``near`` finds all fingerprints within a Hamming radius r of a query: the bits are cut into r + 3 blocks, of which at
least three agree. For each choice of three blocks there is a table keyed by them (the permuted sort order's prefix);
a pair is compared in every table it meets in and kept in the first, so none is missed and none comes twice.

``edited_pairs`` walks the documents in descending order of their ids, each task over one range of ids; the first
document of the next range is sent to it as well.

Defined results: a null text counts as empty. Documents that share an id are ordered by a hash of the text; null ids
come last. A single document follows itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut_points, parts_of, range_number, saved

#: Terms kept with their votes in one Python worker.
CACHE_TERMS = 200_000
FULL_LENGTH = 8


class Votes:
    """Fingerprints of texts; the votes of terms seen before are kept."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.signs = np.empty((4096, 64), np.int8)
        self.weight = np.empty(4096, np.float32)

    def _learn(self, terms: list[str]) -> None:
        first = len(self.place)
        if first + len(terms) > len(self.weight):
            size = 2 * (first + len(terms))
            self.signs = np.resize(self.signs, (size, 64))
            self.weight = np.resize(self.weight, size)
        hashes = np.array([xxhash.xxh64_intdigest(t) for t in terms], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.signs[first : first + len(terms)] = bits.astype(np.int8) * 2 - 1
        self.weight[first : first + len(terms)] = [min(len(t), FULL_LENGTH) ** 2 for t in terms]
        self.place.update(zip(terms, range(first, first + len(terms)), strict=True))

    def fingerprint(self, text: str) -> int:
        if not text:
            return 0
        if len(self.place) > CACHE_TERMS:
            self.place.clear()
        counts = Counter(text.lower().split()) or Counter([text])
        if new := [t for t in counts if t not in self.place]:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, counts), np.int64, len(counts))
        weight = self.weight[at] * (1 + np.log(np.fromiter(counts.values(), np.float32, len(counts))))
        total = np.zeros(64, np.float64)
        order = np.argsort(at, kind="stable")
        for i in range(0, len(at), 16_384):
            part = order[i : i + 16_384]
            total += weight[part].astype(np.float64) @ self.signs[at[part]]
        return int.from_bytes(np.packbits(total > 0, bitorder="little").tobytes(), "little")


def fingerprint(text: str) -> int:
    return Votes().fingerprint(text)


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / 64


def edited(text: str, after: str) -> str:
    """The text with its last third (rounded down) replaced by as many characters from the start of ``after``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + after[:cut]


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how alike they and the next document's are."""
    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    parts = parts_of(docs.sparkSession)
    cuts = cut_points(chosen, "doc_id", parts)
    ranged = chosen.withColumn("part", range_number(F.col("doc_id"), cuts)).withColumn("guest", F.lit(False))
    # the first document (in descending order) of each range follows the last one of the next higher range
    tops = sorted((r["part"], r["top"]) for r in ranged.groupBy("part").agg(F.max("doc_id").alias("top")).collect())  # one per range
    guests = []
    if tops:
        host = {p: tops[(i + 1) % len(tops)][0] for i, (p, _) in enumerate(tops)}
        named = [t for _, t in tops if t is not None]
        rows = chosen.where(F.col("doc_id").isin(named)) if named else chosen.where("false")
        if any(t is None for _, t in tops):
            rows = chosen.where(F.col("doc_id").isNull()).unionAll(rows)
        moved = F.create_map(*(F.lit(x) for pair in host.items() for x in pair))
        guests = [rows.withColumn("part", moved[range_number(F.col("doc_id"), cuts)]).withColumn("guest", F.lit(True))]
    dealt = ranged
    for g in guests:
        dealt = dealt.unionAll(g)
    order = ["part", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text").desc()]
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes()
        before: tuple[int | None, str, int] | None = None
        ended = False
        for whole in batches:
            for batch in batches_of(whole, "text"):
                out: list[tuple] = []
                for doc, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
                    if ended:
                        break
                    text = text or ""
                    own = votes.fingerprint(text)
                    if before is not None:
                        out.append(compared(votes, *before, text, own))
                    ended = guest  # further guests share the first one's id
                    before = (doc, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=NAMES)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
    return ordered.mapInArrow(_typed(run), kinds)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]


def _typed(run):
    kinds = pa.schema(list(zip(NAMES, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)))

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.cast(kinds)

    return cast


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def compared(votes: Votes, doc: int | None, text: str, own: int, after: str, after_fp: int) -> tuple:
    changed = edited(text, after)
    fp = votes.fingerprint(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return doc, len(text), digest, signed(own), signed(fp), likeness(own, fp), likeness(own, after_fp)


def block_widths(radius: int) -> list[int]:
    blocks = radius + 3
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def tables(radius: int) -> list[int]:
    """For each table the mask of the bits that key it: three of the ``radius`` + 3 blocks."""
    masks, at = [], 0
    for w in block_widths(radius):
        masks.append(((1 << w) - 1) << at)
        at += w
    return [a | b | c for a, b, c in combinations(masks, 3)]


def near(queries: DataFrame, fps: DataFrame, radius: int = 3) -> DataFrame:
    """(q, fp, distance): each distinct ``q`` of the queries with every distinct ``fp`` at most ``radius`` bits away."""
    masks = [signed(m) for m in tables(radius)]

    def keyed(df: DataFrame, c: str) -> DataFrame:
        rows = F.array(*(F.struct(F.lit(i).alias("t"), F.col(c).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
        return df.select(c, F.inline(rows))

    # merge joins: neither side has a size bound
    met = keyed(queries.select("q").distinct(), "q").join(keyed(fps.select("fp").distinct(), "fp").hint("merge"), ["t", "k"])
    differing = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*(F.when(differing.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)))
    return met.where((F.bit_count(differing) <= radius) & (first == F.col("t"))).select("q", "fp", F.bit_count(differing).alias("distance"))


def neighbours(marks: DataFrame, asked: str = "doc_id % 20 = 0", radius: int = 3) -> DataFrame:
    """``marks`` (doc_id, fp, ...) with ``near_docs``: how many other rows have a fingerprint within the radius.

    Counted for the rows that meet ``asked``, against all rows; null for the others. Equal fingerprints are looked up
    once and counted as often as they occur, so a group of copies makes no pairs.
    """
    sizes = saved(marks.groupBy("fp").agg(F.count("*").alias("n")), "fingerprints")
    chosen = F.coalesce(F.expr(asked), F.lit(False))
    queries = marks.where(chosen)
    found = near(queries.select(F.col("fp").alias("q")), sizes, radius).join(sizes.hint("merge"), "fp")
    total = found.groupBy("q").agg((F.sum("n") - 1).alias("near_docs"))
    counted = queries.join(total.hint("merge"), F.col("fp") == F.col("q")).drop("q")
    return counted.unionByName(marks.where(~chosen).withColumn("near_docs", F.lit(None).cast("long")))
