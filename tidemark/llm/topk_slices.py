"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to floor(256 x). A block of the index holds some thousand rows as bitmaps: one per component and
bit of the component's value above its least value in the block. A query is a sum of index columns with whole-number
weights: its bits choose which slices are added, shifted; a negative weight adds the complement. Slices of one weight
are added with carry-save adders, so the sum is again a list of slices. The top rows are then chosen from the most
significant slice downward; rows that tie at the boundary are resolved by the smaller id.

Every block answers every group of queries; each answer has at most k rows per query, and a ranking per query joins
them. Blocks and groups are rows of bounded size. A block is sent once for each ``STREAM_GROUPS`` groups and meets these one
after the other, so what is shuffled are mostly the groups, which are a fraction of a block's size.

Defined results: vectors that are null, hold a null or a non-finite component, or have a null id take no part. Missing
components of shorter vectors count as zero. Components of any size are sliced by as many bits as they need and scores
are exact; quantised components beyond a long are held to its limits, and so are scores, after ranking. Equal ids are one query (of their least vector) but rows of their own as candidates. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_of, saved

BLOCK_ROWS = 8192
GROUP_QUERIES = 128
STREAM_GROUPS = 64
#: Scores travel as two longs: multiples of this, and the rest.
HALF = 1 << 62


class Slices:
    """A bit-sliced block: ``bits[j]`` holds the slices of component j, lowest first, packed by rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.rows = len(ids)
        self.words = -(-self.rows // 64)
        self.low = values.min(axis=0) if self.rows else np.zeros(values.shape[1], np.int64)
        above = values.astype(np.uint64) - self.low.astype(np.uint64)  # right for any two longs
        self.width = [int(x).bit_length() for x in above.max(axis=0)] if self.rows else []
        one = np.uint64(1)
        self.bits = [np.stack([self.packed((above[:, j] >> np.uint64(b)) & one) for b in range(w)]) if w else None for j, w in enumerate(self.width)]
        self.all = self.packed(np.ones(self.rows, np.int64))

    def stored(self) -> dict[str, bytes]:
        """The block as columns of a row of the index."""
        bits = [b for b in self.bits if b is not None]
        return {
            "ids": self.ids.tobytes(),
            "low": self.low.astype(np.int64).tobytes(),
            "width": np.array(self.width, np.int64).tobytes(),
            "bits": np.concatenate(bits).tobytes() if bits else b"",
        }

    @classmethod
    def loaded(cls, row: dict[str, bytes]) -> Slices:
        self = cls.__new__(cls)
        self.ids, self.low = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["low"], np.int64)
        self.width = np.frombuffer(row["width"], np.int64).tolist()
        self.rows = len(self.ids)
        self.words = -(-self.rows // 64)
        flat = np.frombuffer(row["bits"], np.uint64).reshape(-1, self.words)
        ends = np.cumsum(self.width)
        self.bits = [flat[e - w : e] if w else None for e, w in zip(ends, self.width, strict=True)]
        self.all = self.packed(np.ones(self.rows, np.int64))
        return self

    def packed(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 64, np.uint8)
        out[: self.rows] = flags
        return np.packbits(out, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of every row's inner product with ``query`` less a constant, and that constant."""
        constant = int(sum(int(q) * int(x) for q, x in zip(query, self.low, strict=True)))
        due: dict[int, list[np.ndarray]] = {}
        for j in np.flatnonzero(query):
            q, w = int(query[j]), self.width[j]
            if not w:
                continue
            slices = self.bits[j]
            if q < 0:  # -v = (2**w - 1 - v) - (2**w - 1)
                slices, q = slices ^ self.all, -q
                constant -= q * ((1 << w) - 1)
            for a in range(q.bit_length()):
                if q >> a & 1:
                    for b in range(w):
                        due.setdefault(a + b, []).append(slices[b])
        total = []
        for place in range(max(due, default=-1) + 1 if due else 0):
            total.append(self._settle(due, place))
        place = len(total)
        while due.get(place):
            total.append(self._settle(due, place))
            place += 1
        return total, constant

    def _settle(self, due: dict[int, list[np.ndarray]], place: int) -> np.ndarray:
        """One slice of the sum: full adders take three bitmaps of a place to one, and one of the next place."""
        held = due.get(place)
        if not held:
            return np.zeros(self.words, np.uint64)
        stack = np.stack(held)
        carried = due.setdefault(place + 1, [])
        while len(stack) > 1:
            if len(stack) == 2:
                carried.append(stack[0] & stack[1])
                return stack[0] ^ stack[1]
            n = len(stack) // 3
            a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
            half = a ^ b
            carried.extend((a & b) | (half & c))
            stack = np.concatenate([half ^ c, stack[3 * n :]])
        return stack[0]

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows, ties to smaller ids, without the query's own id."""
        if not self.rows:
            return []
        slices, constant = self.scores(query)
        even = self.all.copy()
        for i in range(np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")):
            even[i // 64] &= ~np.uint64(1 << (i % 64))
        sure = np.zeros(self.words, np.uint64)
        have, want = 0, min(k, int(np.bitwise_count(even).sum()))
        for s in reversed(slices):
            ahead = even & s
            n = int(np.bitwise_count(ahead).sum())
            if have + n > want:
                even = ahead
            else:
                sure |= ahead
                have += n
                even = even & ~s
                if have == want:
                    break
        chosen = self._rows(sure)
        if have < want:  # rows are in the order of their ids: the first of the boundary rows win
            chosen = np.concatenate([chosen, self._rows(even)[: want - have]])
        score = {int(i): constant + sum(int(s[i // 64] >> np.uint64(i % 64) & np.uint64(1)) << p for p, s in enumerate(slices)) for i in chosen}
        return [(int(self.ids[i]), score[i]) for i in sorted(score, key=lambda i: (-score[i], i))]

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantised(vectors: DataFrame) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    chosen = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["embedding"].cast("array<double>").alias("x"))
    fit = F.col("x").isNotNull() & F.col("id").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform("x", lambda x: F.floor(x * 256))
    return chosen.where(fit).select("id", held.alias("v"))


def _values(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(table.column("id").to_pylist(), np.int64)
    rows = table.column("v").to_pylist()
    size = max(map(len, rows))
    return ids, np.array([x + [0] * (size - len(x)) for x in rows], np.int64).reshape(len(rows), size)


def _block(table: pa.Table) -> pa.Table:
    """The rows of a block as one row of the index."""
    row = Slices(*_values(table)).stored()
    return pa.table({"b": table.column("number").slice(0, 1), **{k: pa.array([x], pa.binary()) for k, x in row.items()}})


def _group(table: pa.Table) -> pa.Table:
    """The queries of a group as one row."""
    ids, values = _values(table)
    return pa.table(
        {"g": table.column("number").slice(0, 1), "q_ids": [ids.tobytes()], "q_size": pa.array([values.shape[1]], pa.int32()), "q_v": [values.tobytes()]}
    )


def dealt(rows: DataFrame, count: int, size: int) -> tuple[DataFrame, int]:
    """Rows with the number of a group of about ``size`` rows by a hash, and how many groups there are."""
    groups = max(1, -(-count // size))
    return rows.withColumn("number", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int")), groups


def top_rows(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``."""
    rows = saved(quantised(vectors), "vectors")
    asked = quantised(queries).groupBy("id").agg(F.min("v").alias("v"))
    block_of, n_blocks = dealt(rows, rows.count(), block_rows)
    group_of, n_groups = dealt(asked, asked.count(), group_queries)
    index = saved(block_of.groupBy("number").applyInArrow(_block, "b int, ids binary, low binary, width binary, bits binary"), "slices")
    groups = group_of.groupBy("number").applyInArrow(_group, "g int, q_ids binary, q_size int, q_v binary")
    # a block and the groups of one stream meet under the pair of their numbers, the block first
    streams = -(-n_groups // STREAM_GROUPS)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("q_ids", "binary"), ("q_size", "int"), ("q_v", "binary"))]
    absent = [F.lit(None).cast("binary").alias(n) for n in ("ids", "low", "width", "bits")]
    stream = F.explode(F.sequence(F.lit(0), F.lit(streams - 1))).alias("h")
    left = index.select("b", stream, F.lit(-1).alias("g"), "ids", "low", "width", "bits", *nothing)
    block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b")
    right = groups.select(block, F.floor(F.col("g") / STREAM_GROUPS).cast("int").alias("h"), "g", *absent, "q_ids", "q_size", "q_v")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()
                if r["g"] < 0:
                    last, block = (r["b"], r["h"]), Slices.loaded(r)
                    continue
                if last != (r["b"], r["h"]):  # a number of a block that no row hashes to
                    continue
                q_ids = np.frombuffer(r["q_ids"], np.int64)
                weights = np.frombuffer(r["q_v"], np.int64).reshape(len(q_ids), r["q_size"])
                size = len(block.low)
                weights = np.pad(weights, ((0, 0), (0, max(0, size - weights.shape[1]))))[:, :size]
                found = [(int(q), i, s // HALF, s % HALF) for q, w in zip(q_ids, weights, strict=True) for i, s in block.top(w, int(q), k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[c] for x in found], pa.int64()) for c in range(4)], names=["query_id", "vec_id", "high", "rest"]
                )

    # a number of its own: the rows are few and small for the work that they stand for, and would be put together
    parts = min(parts_of(vectors.sparkSession), n_blocks * streams)
    dealt_rows = left.unionAll(right).repartition(parts, "b", "h").sortWithinPartitions("b", "h", "g")
    met = dealt_rows.mapInArrow(answer, "query_id long, vec_id long, high long, rest long")
    best = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("rest"), "vec_id")
    score = F.when(F.col("high") > 1, F.lit((1 << 63) - 1)).when(F.col("high") < -2, F.lit(-(1 << 63))).otherwise(F.col("high") * HALF + F.col("rest"))
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))
