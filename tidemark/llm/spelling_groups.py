"""Spelling variants: words one inserted, deleted or replaced letter apart, found by blocked Gram matrices.

Words are dealt to blocks of adjacent lengths: block row l compares words of l letters with those of l and of l + 1. One
edit leaves two of three pieces of a word alone (counted from its start before the edit, from its end after it), so
block row l is cut by each pair of pieces; words that share none can't be near. A block with more than ``CELL_ROWS``
rows is cut into parts, and every pair of parts is a cell, so no task holds more than some thousand rows of a block,
however frequent its letters are.

In a cell a word is a vector of letter counts. The Gram matrix of the vectors gives all squared distances at once; one
edit moves them by at most two. What is that close is verified letter by letter. Small cells share one matrix. A pair is
kept in the first of the pieces that it shares, so each comes once.

A word's form is its near word of largest count (of equal ones the first in code-point order), if that has at least
``RATIO`` times its count; else it has none. The root follows the forms to the last one; counts grow by ``RATIO`` with
each step, so the chains are short, and doubling the steps ends after a few joins.

Defined results: null texts hold no words. Counts cover all rows, repeated ones as well. An empty table gives an empty
result. A null id is spelled as an empty one. Letters other than a-z and U+00C0 to U+00FF may occur in words that are given
as a table; some of them share one count, which loses no pair. Very long texts and words take linear time.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, saved

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One occurrence in so many (by a hash of document and word) has a letter deleted.
DAMAGE = 31
LETTERS = re.compile("[a-zÀ-ÿ]+")
#: Different words counted in Python before they go on to Spark's own sums.
HELD_WORDS = 100_000
CELL_ROWS = 1024
TILE_ROWS = 512
LONGEST = 1 << 22  # of squared letter counts that float32 holds exactly

#: The column of each letter: a-z, U+00C0 to U+00FF, and six for all others.
PLACES = 26 + 64 + 6
PLACE = 90 + np.arange(256) % 6
PLACE[ord("a") : ord("z") + 1] = np.arange(26)
PLACE[0xC0:] = 26 + np.arange(64)


def damaged(doc_id: int | None, word: str, every: int) -> str:
    """The word, or, for one of ``every`` pairs of document and word, the word without one letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, every: int = DAMAGE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of the whole texts by their occurrences, A-Z in lower case, after the damage of ``damaged``."""
    chosen = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for whole in batches:
            for batch in batches_of(whole, "text"):
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if not text:
                        continue
                    # bytes: only A-Z change
                    for word, n in Counter(LETTERS.findall(text.lower().decode())).items():
                        if len(word) >= least_letters and len(made := damaged(doc, word, every)) >= least_letters:
                            held[made] += n
                    if len(held) > HELD_WORDS:
                        yield out()
        if held:
            yield out()

    counted = chosen.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def pieces(letters: int) -> tuple[int, int]:
    """Letters of the first and of the last of three pieces."""
    return letters // 3, letters // 3


def blocks(words: DataFrame) -> DataFrame:
    """(block, side, longer, word, n): each word in the blocks of its length and, as the longer one, of the length below."""
    length = F.length("word")
    rows = []
    for longer in (False, True):
        short = length - 1 if longer else length
        end = F.floor(short / 3).cast("int")
        head, tail = F.substring("word", F.lit(1), end), F.substring("word", length - end + 1, end)
        intact = [F.substring("word", length - (short - end) + 1, short - end), F.concat(head, F.lit("\0"), tail), F.substring("word", F.lit(1), short - end)]
        for side, text in enumerate(intact):
            key = F.xxhash64(short, F.lit(side), text)
            rows.append(F.struct(key.alias("block"), F.lit(side).cast("byte").alias("side"), F.lit(longer).alias("longer")))
    return words.select("word", "n", F.inline(F.array(*rows)))


def cells(words: DataFrame, cell_rows: int) -> DataFrame:
    """The rows of ``blocks`` that can have a partner, with their part of the block and the cell (low, high) of parts."""
    rows = blocks(words)
    sizes = rows.groupBy("block").agg(F.count("*").alias("rows"), F.min("longer").alias("bare"))
    # a block without a word of its own length compares nothing
    parts = sizes.where("rows > 1 and not bare").select("block", F.ceil(F.col("rows") / cell_rows).cast("int").alias("parts"))
    dealt = rows.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("block", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "side", "longer", "word", "n")


def one_edit(short: str, long: str) -> bool:
    """Whether one letter replaced, or one inserted into ``short``, makes ``long``."""
    if short == long or not len(short) <= len(long) <= len(short) + 1:
        return False
    i = next((i for i, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    return short[i + (len(short) == len(long)) :] == long[i + 1 :]


def first_side(short: str, long: str) -> int:
    """The first of the three pairs of pieces that both words share."""
    n = len(short)
    head, tail = pieces(n)
    if short[head:] == long[len(long) - (n - head) :]:
        return 0
    if short[:head] == long[:head] and short[n - tail :] == long[len(long) - tail :]:
        return 1
    return 2


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts for each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    place = PLACE[np.minimum(codes, 255)]
    place = np.where(codes > 255, 90 + codes % 6, place)
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(row * PLACES + place, minlength=len(words) * PLACES).reshape(len(words), PLACES)


def near_pairs(cell: np.ndarray, part: np.ndarray, crossing: np.ndarray, longer: np.ndarray, words: list[str], sides: np.ndarray) -> list[tuple[int, int]]:
    """Places (shorter or as long, other) of the near words of each cell; in a crossing cell only of different parts."""
    counts = letter_counts(words)
    square = (counts * counts).sum(axis=1)
    exact = np.float32 if int(square.max(initial=0)) < LONGEST else np.float64
    x, square = counts.astype(exact), square.astype(exact)
    own = np.flatnonzero(~longer)
    found = []
    for rows in np.array_split(own, max(1, -(-len(own) // TILE_ROWS))):
        distance = square[rows, None] + square[None, :] - 2 * (x[rows] @ x.T)
        a, b = np.nonzero((distance <= 2) & (cell[rows, None] == cell[None, :]))
        a = rows[a]
        met = (longer[b] | (a < b)) & (~crossing[a] | (part[a] != part[b]))
        for i, j in zip(a[met].tolist(), b[met].tolist(), strict=True):
            if one_edit(words[i], words[j]) and first_side(words[i], words[j]) == sides[i]:
                found.append((i, j))
    return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of rows that come ordered by cell."""

    def compared(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole cells, as many at once as make a tile; ``edges``: where cells begin, and the end."""
        first = 0
        while first < len(edges) - 1:
            last = max(first + 1, int(np.searchsorted(edges, edges[first] + TILE_ROWS, "right")) - 1)
            tile = table.slice(edges[first], edges[last] - edges[first])
            words, n = tile.column("word").to_pylist(), tile.column("n").to_pylist()
            cell = np.repeat(np.arange(last - first), np.diff(edges[first : last + 1]))
            part, low, high, side = (tile.column(c).to_numpy() for c in ("part", "low", "high", "side"))
            pairs = near_pairs(cell, part, low != high, tile.column("longer").to_numpy(zero_copy_only=False).astype(bool), words, side)
            both = pairs + [(j, i) for i, j in pairs]
            if both:
                columns = [pa.array([words[i] for i, _ in both]), pa.array([words[j] for _, j in both]), pa.array([n[j] for _, j in both], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "near", "near_n"])
            first = last

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        keys = [held.column(c).to_numpy() for c in ("block", "low", "high")]
        new = np.zeros(held.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        edges = np.concatenate([[0], np.flatnonzero(new)])
        yield from compared(held, edges)  # the last cell may go on in the next batch
        held = held.slice(edges[-1])
    if held is not None and held.num_rows:
        yield from compared(held, np.array([0, held.num_rows]))


def near_words(words: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart, once. ``words``: (word, n), each word once."""
    dealt = cells(words, cell_rows).repartition("block", "low", "high").sortWithinPartitions("block", "low", "high")
    return dealt.mapInArrow(_compare, "word string, near string, near_n long")


def grouped(words: DataFrame, ratio: int = RATIO, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n)."""
    words = saved(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    judged = words.join(near_words(words, cell_rows).groupBy("word").agg(F.count("*").alias("n_near"), best), "word", "left")
    fits = -F.col("best.n") >= ratio * F.col("n")
    named = saved(
        judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")),
        "forms",
    )
    steps = named.where("form is not null").select("word", F.col("form").alias("root"))
    most = named.agg(F.max("n")).first()[0] or 1
    # each step multiplies the count by the ratio or more; a round doubles the steps taken
    for _ in range(math.ceil(math.log2(1 + math.log(most, max(2, ratio))))):
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = saved(steps.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    found = named.join(steps, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
