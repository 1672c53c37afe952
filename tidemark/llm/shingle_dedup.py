"""Near-duplicates by the exact Jaccard similarity of five-word shingles.

Texts with equal shingle sets are one node. The self-join of the fingerprint trie (see :mod:`simhash_dedup`) over the SimHash
of the same shingles proposes links between nodes whose fingerprints differ in at most ``RADIUS`` bits. A pair of
similarity 0.8 differs in ten bits on average, and with such a radius the walk prunes nothing and compares all pairs; what
lies beyond ``RADIUS`` is therefore proposed by MinHash bands as well: two nodes of similarity 0.8 miss each other in
all bands with a probability of about 5e-6. The members of a band, or of a fingerprint, are linked to its least node only, so n
nodes give n - 1 links, and all pairs of a band lie in one candidate group. Inside a candidate group every pair of
different components is compared exactly: a group of at most ``cell_rows`` nodes and ``CELL_BYTES`` bytes is one cell, a larger one is cut into
parts and every pair of parts is a cell. A cell keeps a union-find, so pairs that are already connected are skipped.

Defined results: texts of fewer than five words are one shingle; null texts and those without words are one group.
One row of each group stays, that with the smallest id; a row with a null id stays only if no row of its group has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, saved, texts
from .simhash_dedup import Forest, components, links, majority, shingle_hashes

WORDS = 5
LEAST_SIMILARITY = 0.8
#: Bits in which two fingerprints that the trie's self-join links may differ.
RADIUS = 3
BANDS, BAND_ROWS = 40, 6
#: Nodes, and bytes of their texts, in one side of a cell, at most about.
CELL_ROWS = 4096
CELL_BYTES = 8 << 20
#: Shingles that are hashed at once.
CHUNK = 2048

_random = np.random.default_rng(42)
FACTORS = _random.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    return np.unique(shingle_hashes(text, words))


def band_keys(shingles: np.ndarray) -> list[int]:
    """One signed long for each band; none for an empty set."""
    if not len(shingles):
        return []
    low = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for first in range(0, len(short), CHUNK):
        np.minimum(low, (FACTORS * short[None, first : first + CHUNK] + SHIFTS).min(axis=1), out=low)
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(low.reshape(BANDS, BAND_ROWS))]


def near_links(sets: list[np.ndarray], side: np.ndarray | None = None, least: float = LEAST_SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is ``least`` or more.

    With ``side`` (0 or 1 for each set) only pairs across the sides count.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    starts = np.concatenate([[0], np.cumsum(size)])
    words = np.concatenate([sets[i] for i in order]) if len(sets) else np.empty(0, np.uint64)
    names, flat = np.unique(words, return_inverse=True)
    flat = flat.ravel()
    marked = np.zeros(len(names), bool)
    forest = Forest(len(sets))
    sides = None if side is None else np.asarray(side)[order]
    for i in range(len(sets)):
        if not size[i]:
            continue
        # sets that are larger, or as large and later: similarity is at most the ratio of the sizes
        end = int(np.searchsorted(size, size[i] / least + 1e-9, "right"))
        other = np.arange(i + 1, end)
        if sides is not None:
            other = other[sides[other] != sides[i]]
        other = other[forest.root[other] != forest.root[i]]
        if not len(other):
            continue
        own = flat[starts[i] : starts[i + 1]]
        marked[own] = True
        for part in np.array_split(other, max(1, int(size[other].sum()) // 4_000_000)):
            width = size[part]
            ends = np.cumsum(width)
            at = np.arange(ends[-1]) + np.repeat(starts[part] - (ends - width), width)
            shared = np.add.reduceat(marked[flat[at]].astype(np.int64), ends - width)
            near = part[shared >= least * (size[i] + width - shared) - 1e-9]
            forest.join(np.full(len(near), i), near)
        marked[own] = False
    moved = np.flatnonzero(forest.root != np.arange(len(sets)))
    return order[moved], order[forest.root[moved]]


def marks_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, mark, fp, bands) of every row: ``mark`` names the shingle set, ``text_key`` the text, ``fp`` is the
    fingerprint of the set, so that rows of a mark share it."""
    chosen = texts(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                sets = [shingle_set(t or b"", words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                marks = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("text_key"),
                        pa.array(marks, pa.int64()),
                        pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)),
                        pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "mark", "fp", "bands"],
                )

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, text_key long, mark long, fp long, bands array<bigint>")


def exact_links(members: DataFrame, least: float, words: int, cell_rows: int) -> DataFrame:
    """(u, v): links of the near pairs among ``members`` (mark, root, text), for each candidate group ``root``."""
    held = F.greatest(F.count("*") / cell_rows, F.sum(F.coalesce(F.octet_length("text"), F.lit(0))) / CELL_BYTES)
    sizes = members.groupBy("root").agg(F.ceil(held).alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1)))
    dealt = members.join(sizes, "root").withColumn("part", F.pmod(F.col("mark"), F.col("parts")))
    # part p meets every part q: cell (least, most) of both
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = cells.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "mark", "text")

    def compare(table: pa.Table) -> pa.Table:
        first = {m: k for k, m in reversed(list(enumerate(table.column("mark").to_pylist())))}
        rows = sorted(first.values())
        table = table.take(pa.array(rows, pa.int64()))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        sets = [shingle_set(t or b"", words) for t in table.column("text").cast(pa.binary()).to_pylist()]
        side = None if low == high else (table.column("part").to_numpy() == high).astype(np.int64)
        a, b = near_links(sets, side, least)
        marks = table.column("mark").to_numpy()
        return pa.table({"u": marks[a], "v": marks[b]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    # rows lie by root after the join, which would do for the grouping: deal the cells out
    spread = cells.repartition("root", "low", "high")
    return spread.groupBy("root", "low", "high").applyInArrow(compare, "u long, v long")


def fingerprint_stars(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between the marks of ``nodes`` (mark, fp) whose fingerprints the trie's self-join links."""
    heads = saved(nodes.groupBy("fp").agg(F.min("mark").alias("head")), "shingle-fingerprints")
    equal = nodes.join(heads, "fp").where("mark <> head").select(F.col("mark").alias("u"), F.col("head").alias("v"))
    near = saved(links(heads, radius), "shingle-trie")
    first = heads.select(F.col("fp").alias("u"), F.col("head").alias("a"))
    second = heads.select(F.col("fp").alias("v"), F.col("head").alias("b"))
    return equal.unionAll(near.join(first, "u").join(second, "v").select(F.col("a").alias("u"), F.col("b").alias("v")))


def grouped(docs: DataFrame, least: float = LEAST_SIMILARITY, words: int = WORDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, text_key, root) of every row: rows of one ``root`` are connected by near pairs."""
    marks = saved(marks_of(docs, words), "shingles")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_key")).alias("one")
    nodes = saved(marks.groupBy("mark").agg(one, F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "shingle-sets")
    bands = nodes.select("mark", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("mark").alias("head"), F.count("*").alias("n")).where("n > 1")
    stars = bands.join(heads, "band").where("mark <> head").select(F.col("mark").alias("u"), F.col("head").alias("v"))
    candidates = components(fingerprint_stars(nodes.select("mark", "fp")).unionAll(stars).distinct(), "shingle-candidates")
    # components() names no root among its own u: each group's root is a member as well
    member = candidates.select(F.col("u").alias("mark"), "root").unionAll(candidates.select(F.col("root").alias("mark"), "root")).distinct()
    asked = nodes.join(member, "mark").select("mark", "root", F.col("one.doc_id").alias("id"), F.col("one.text_key").alias("key"))
    body = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_key"), docs["text"].alias("text"))
    members = body.join(asked, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("mark", "root", "text")
    links = exact_links(saved(members, "shingle-members"), least, words, cell_rows)
    roots = components(links, "shingle-links").select(F.col("u").alias("mark"), "root")
    named = marks.select("doc_id", "text_key", "mark").join(roots, "mark", "left")
    return named.select("doc_id", "text_key", F.coalesce("root", "mark").alias("root"))


def unique_documents(docs: DataFrame, least: float = LEAST_SIMILARITY, words: int = WORDS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row of each group of near texts, with all its columns."""
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    own, text = plain[f"c{columns.index('doc_id')}"], plain[f"c{columns.index('text')}"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_key")).alias("one")
    kept = grouped(docs, least, words, cell_rows).groupBy("root").agg(first)
    kept = kept.select(F.col("one.doc_id").alias("kept_id"), F.col("one.text_key").alias("kept_key"), "root")
    keyed = plain.withColumn("text_key", F.xxhash64(text))
    chosen = keyed.join(kept, (F.col("text_key") == F.col("kept_key")) & own.eqNullSafe(F.col("kept_id")))
    one = Window.partitionBy("root").orderBy(F.xxhash64(*plain.columns))
    return chosen.withColumn("nth", F.row_number().over(one)).where("nth = 1").select(*plain.columns).toDF(*columns)
