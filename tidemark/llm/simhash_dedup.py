"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

``fingerprints`` gives each text a 64-bit majority vote of its word shingles. ``links`` walks pairs of trie nodes
together: a pair carries the number of bits in which the two paths differ and is left as soon as that exceeds the
radius. The upper levels of the trie are walked when the rows are dealt: a fingerprint goes to every pair of top nodes
that can still hold a partner, so each cell of the join is a bounded pair of subtrees. Top nodes with many
fingerprints are cut into parts, and every pair of parts is a cell of its own. Inside a cell a union-find keeps a
spanning forest, so a group of n fingerprints leaves at most n - 1 links and never all its pairs.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other. Rows
with a null id take part; they never name a component, and a component of null ids only has a null ``component_id``.
Repeated rows share their fingerprint, hence their component. An empty table gives an empty result. Columns besides
the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, saved, texts

SEED = 42
#: Fingerprints in one side of a cell of the join, about.
CELL_ROWS = 8192
MOST_PREFIX_BITS = 12
#: Fingerprints that a task deals at a time.
DEAL_ROWS = 8192
#: Node pairs of at most this many fingerprint pairs are compared at once.
LEAF_PAIRS = 32
#: Node pairs walked at once: bounds the memory of a task.
FRONTIER = 50_000


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; fewer words make one run, none makes none."""
    found = text.lower().split()  # of bytes: lower-cases A-Z and splits at space and 0x09-0x0D, no more
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    runs = map(line.__getitem__, map(slice, starts, ends[words - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64 bits, each set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 65_536):
        part = np.ascontiguousarray(hashes[first : first + 65_536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """(``id_column``, fp): the fingerprint of every row's whole text as a signed long."""
    chosen = texts(docs, id_column, text_column).toDF("id", "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                found = [majority(shingle_hashes(t or b"", words)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"]
                )

    kind = chosen.schema["id"].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return chosen.mapInArrow(vote, out).withColumnRenamed("id", id_column)


class Forest:
    """Union-find over ``n`` numbered nodes that takes whole arrays of links."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _middle(values: np.ndarray, low: np.ndarray, bit: int) -> np.ndarray:
    """Where the right child of each node starts: the node's path with the next bit set."""
    path = values[low] & np.uint64((0xFFFFFFFFFFFFFFFF << (bit + 1)) & 0xFFFFFFFFFFFFFFFF)
    return np.searchsorted(values, path | np.uint64(1 << bit))


def walk(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted arrays of distinct fingerprints that differ in at most ``radius`` bits.

    ``b`` None joins ``a`` with itself: each pair once. Arrays of pairs are yielded as the walk goes on.
    """
    alone = b is None
    b = a if alone else b
    if not len(a) or not len(b):
        return
    start = [np.array([x]) for x in (0, len(a), 0, len(b), 0)]
    todo = [(63, start)]
    while todo:
        bit, (alo, ahi, blo, bhi, err) = todo.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            todo += [(bit, [x[:half] for x in (alo, ahi, blo, bhi, err)]), (bit, [x[half:] for x in (alo, ahi, blo, bhi, err)])]
            continue
        small = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            wide = (bhi - blo)[small]
            count = (ahi - alo)[small] * wide
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide = np.repeat(wide, count)
            i, j = np.repeat(alo[small], count) + at // wide, np.repeat(blo[small], count) + at % wide
            near = np.bitwise_count(a[i] ^ b[j]) <= radius
            if alone:
                near &= i < j
            yield i[near], j[near]
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        am, bm = _middle(a, alo, bit), _middle(b, blo, bit)
        same = (alo == blo) if alone else np.zeros(len(alo), bool)
        pairs = [
            (alo, am, blo, bm, err, None),
            (am, ahi, bm, bhi, err, None),
            (alo, am, bm, bhi, err + 1, None),
            (am, ahi, blo, bm, err + 1, ~same),
        ]
        grown = []
        for al, ah, bl, bh, e, keep in pairs:
            stay = (al < ah) & (bl < bh) & (e <= radius)
            if keep is not None:
                stay &= keep
            grown.append([x[stay] for x in (al, ah, bl, bh, e)])
        todo.append((bit - 1, [np.concatenate(x) for x in zip(*grown, strict=True)]))


def forest_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the fingerprints of one cell."""
    nodes = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    forest = Forest(len(nodes))
    for i, j in walk(a, b, radius):
        forest.join(i, j + shift)
    moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
    return nodes[moved], nodes[forest.root[moved]]


def top_nodes(counts: dict[int, int], bits: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each prefix: number of its first node and how many nodes (parts of at most ``cell_rows``, about) it has."""
    parts = np.ones(1 << bits, np.int64)
    for prefix, n in counts.items():
        parts[prefix] = max(1, -(-n // (2 * cell_rows)))
    return np.cumsum(parts) - parts, parts


def links(fps: DataFrame, radius: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(u, v): links that connect exactly the distinct fingerprints ``fp`` which chains of near ones connect."""
    total = fps.count()
    bits = min(MOST_PREFIX_BITS, max(0, (max(total, 1) - 1) // cell_rows).bit_length())
    prefix = F.shiftrightunsigned("fp", 64 - bits).cast("int") if bits else F.lit(0)
    counts = {r["p"]: r["n"] for r in fps.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect()}  # 2 ** bits rows
    first, parts = top_nodes(counts, bits, cell_rows)
    masks = np.array([sum(1 << i for i in on) for r in range(radius + 1) for on in combinations(range(bits), r)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False))
            if sum(map(len, held)) >= DEAL_ROWS:
                yield packed(np.concatenate(held))
                held = []
        if held:
            yield packed(np.concatenate(held))

    def packed(fp: np.ndarray) -> pa.RecordBatch:
        """One row per cell and side: its fingerprints among these, as bytes."""
        bare = fp.view(np.uint64)
        own = (bare >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fp), np.int64)
        part = (bare * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[own]
        node = first[own] + part
        other = (own[:, None] ^ masks[None, :]).ravel()
        many = parts[other]
        at_row = np.repeat(np.repeat(np.arange(len(fp)), len(masks)), many)
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        there, here = np.repeat(first[other], many) + offset, node[at_row]
        key = ((np.minimum(here, there) << 31 | np.maximum(here, there)) << 1) | (here <= there)
        order = np.argsort(key, kind="stable")
        key, flat = key[order], bare[at_row[order]]
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1 if len(key) else np.empty(0, np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        rows = [flat[i:j].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=False)]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[starts[: len(ends)]] >> 1), pa.array((key[starts[: len(ends)]] & 1).astype(bool)), pa.array(rows, pa.binary())], names=["cell", "low", "fps"]
        )

    def join(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        sides: dict[bool, list[bytes]] = {True: [], False: []}
        for low, data in zip(table.column("low").to_pylist(), table.column("fps").to_pylist(), strict=True):
            sides[low].append(data)
        a, b = (np.sort(np.frombuffer(b"".join(x), np.uint64)) for x in (sides[True], sides[False]))
        u, v = forest_links(a, None if cell >> 31 == cell & 0x7FFFFFFF else b, radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    dealt = fps.select("fp").mapInArrow(deal, "cell long, low boolean, fps binary")
    return dealt.groupBy("cell").applyInArrow(join, "u long, v long")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, root) for every node that has a link: ``root`` is the smallest node reachable.

    Alternates large and small stars until nothing changes; each round is written to the shared folder.
    """

    def both(x: DataFrame) -> DataFrame:
        return x.select("u", "v").union(x.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_000_007))).first())

    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    was = mark(now)
    while was[0]:
        around = both(now)
        low = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = saved(small.union(least.select("u", F.col("m").alias("v"))).distinct(), label)
        mark_now = mark(now)
        if mark_now == was:
            break
        was = mark_now
    return now.select("u", F.col("v").alias("root"))


def near_components(docs: DataFrame, radius: int = 3, words: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest id reachable over near fingerprints)."""
    marks = saved(fingerprints(docs, words=words), "simhash")
    fps = saved(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps, radius, cell_rows), "simhash-links")
    grouped = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def unique_documents(docs: DataFrame, radius: int = 3, words: int = 3) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns.

    Rows that repeat an id count as one document. Rows with a null id cannot be named by a component; all stay.
    """
    columns = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    own = plain[f"c{columns.index('doc_id')}"]
    kept = near_components(docs, radius, words).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    one = Window.partitionBy("kept").orderBy(F.xxhash64(*plain.columns))
    chosen = plain.join(kept, own == F.col("kept")).withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return chosen.select(*plain.columns).unionAll(plain.where(own.isNull())).toDF(*columns)
