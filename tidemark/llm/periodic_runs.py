"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of length
max(``least``, 2 q) or more, that no neighbouring word extends.

The dictionary names, for each power of two, the stretches of that many words: equal ones have equal names, made by
ranking pairs of names of half the length. Stretches that occur once in their text need no name at any greater length,
so the work shrinks quickly in texts without repetition. For each power u the occurrences of one name are put in order:
neighbours at most u / 2 apart form arithmetic progressions (their step is the stretch's own period), and of two
progressions whose gap is below 2 u, at most three steps on in the order, every distance between members in [u, 2 u)
is proposed as a period. A run of period q in [u, 2 u) holds its first u words again q words later, so its period is among
those. Periods below the first such power come from the distances of neighbours alone: there, the next occurrence of a
stretch as long as the period is exactly one period away. Proposals of one stretch of equal words are joined, extended
both ways by comparing names from the longest down, and deduplicated to the smallest period of each (start, end).

Many short texts share one array, with a separator between them that equals no word; no run can hold one.

Defined results: a null text counts as empty and has no runs. Words are divided by blanks and the characters 9 to 13.
Repeated rows are treated one by one. A very long text is one array of its own: memory is a few machine words per word and
doubling, time n log n. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, carrying

LEAST = 12
#: Texts that are searched together hold about so many bytes.
CHUNK_BYTES = 2 << 20


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys, and whether each occurs more than once."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, np.bincount(rank, minlength=1)[rank] > 1


def dictionary(words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words at each place; -1 where a stretch occurs once in its text.

    ``words`` holds numbers from 0 on, separators as different negative numbers; ``text`` is the number of each place's text.
    """
    n = len(words)
    names = [words]
    at = np.flatnonzero((words[:-1] >= 0) & (words[1:] >= 0)) if n else np.empty(0, np.int64)
    wide = int(words.max(initial=0)) + 1
    width = 1
    while len(at):
        if width == 1:
            keys = text[at] * wide + words[at]  # from here on names differ between texts
            if (int(text[-1]) + 1) * wide * wide >= 1 << 62:
                keys = dense(keys)[0]
            keys = keys * wide + words[at + 1]
        else:
            keys = names[-1][at].astype(np.int64) * len(names[-1]) + names[-1][at + width]
        rank, often = dense(keys)
        at, rank = at[often], rank[often]
        if not len(at):
            break
        level = np.full(n, -1, np.int32)
        level[at] = rank
        names.append(level)
        width *= 2
        at = at[at + width < n]
        at = at[level[at + width] >= 0]
    return names


def proposals(level: np.ndarray, width: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): the stretch of ``width`` words there occurs again a period later."""
    at = np.flatnonzero(level >= 0)
    keys = np.sort(level[at].astype(np.int64) * len(level) + at)
    name, place = np.divmod(keys, len(level))
    chained = (name[1:] == name[:-1]) & (np.diff(place) <= width // 2)
    heads = np.flatnonzero(np.concatenate([[True], ~chained]))  # of the progressions
    tails = np.concatenate([heads[1:], [len(place)]]) - 1
    members = tails - heads + 1
    step = np.where(members > 1, place[np.minimum(heads + 1, len(place) - 1)] - place[heads], 0)
    places, periods = [], []
    if first:
        inside = members > 1
        places.append(place[heads[inside]])
        periods.append(step[inside])
    for ahead in (1, 2, 3):
        a, b = np.arange(len(heads) - ahead), np.arange(ahead, len(heads))
        gap = place[heads[b]] - place[tails[a]]
        met = (name[heads[a]] == name[heads[b]]) & (gap < 2 * width)
        a, b, gap = a[met], b[met], gap[met]
        if first and ahead == 1:
            short = gap < width
            places.append(place[tails[a[short]]])
            periods.append(gap[short])
        # distances gap, gap + step, ... between members of both, as far as they lie in [width, 2 width)
        by = np.maximum(np.maximum(step[a], step[b]), 1)
        low = np.maximum(0, -((gap - width) // by))
        high = np.minimum(members[a] + members[b] - 2, (2 * width - 1 - gap) // by)
        many = np.maximum(0, high - low + 1)
        of = np.repeat(np.arange(len(a)), many)
        j = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
        places.append(place[tails[a[of]]] - by[of] * np.minimum(j, members[a[of]] - 1))
        periods.append(gap[of] + by[of] * j)
    return np.concatenate(places), np.concatenate(periods)


def joined(place: np.ndarray, period: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One proposal of each stretch: with one period, places at most ``width`` apart lie in the same one."""
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.concatenate([[True], (np.diff(period) != 0) | (np.diff(place) > width)])[: len(place)]
    return place[new], period[new]


def equal_ahead(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How many words from i on equal those from j on; with ``back`` those before i and before j."""
    n = len(names[0])
    length = np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        width = 1 << k
        a, b = (i - length - width, j - length - width) if back else (i + length, j + length)
        inside = (a >= 0) & (b + width <= n)
        x, y = names[k][np.where(inside, a, 0)], names[k][np.where(inside, b, 0)]
        length += np.where(inside & (x == y) & (x >= 0), width, 0)
    return length


def runs(words: np.ndarray, text: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of every run, by start and period."""
    names = dictionary(words, text)
    first = max(0, (least + 1).bit_length() - 2)  # least >= 2 ** (first + 1) - 1
    found = []
    for k in range(first, len(names)):
        place, period = proposals(names[k], 1 << k, k == first)
        if len(place):
            found.append(joined(place, period, 1 << k))
    if not found:
        return np.empty((0, 3), np.int64)
    place, period = (np.concatenate(x) for x in zip(*found, strict=True))
    start = place - equal_ahead(names, place, place + period, True)
    end = place + period + equal_ahead(names, place, place + period, False)
    kept = end - start >= np.maximum(least, 2 * period)
    rows = np.column_stack([start, end - start, period])[kept]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)  # a multiple of a period is none of its own
    new[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def searched(bodies: list[bytes], least: int = LEAST) -> list[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs, text without what repeats) of each text."""
    split = [b.split() for b in bodies]
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = np.empty(int((sizes + 1).sum()), np.int64)
    for s, w in zip(starts, split, strict=True):
        words[s : s + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
    words[starts + sizes] = -1 - np.arange(len(split))
    text = np.repeat(np.arange(len(split)), sizes + 1)
    rows = runs(words, text, least)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 0] + rows[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    cuts = np.searchsorted(rows[:, 0], np.append(starts, len(words)))
    out = []
    for k, (s, w) in enumerate(zip(starts, split, strict=True)):
        own = rows[cuts[k] : cuts[k + 1]]
        stay = w if not len(own) else compress(w, kept[s : s + len(w)].tolist())
        out.append((len(w), own - [s, 0, 0], b" ".join(stay)))
    return out


RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def run_lists(found: list[np.ndarray]) -> pa.Array:
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    ends = np.cumsum([0, *map(len, found)])
    fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields).cast(ARROW_RUNS)


def periodic_runs(docs: DataFrame, *carried: str, least: int = LEAST) -> DataFrame:
    """(carried columns, n_words, runs, collapsed) of each whole text.

    ``runs`` holds (start, length, period) by start and period; ``collapsed`` is the words that lie in no run after its
    first period, joined by one blank.
    """
    chosen, kinds = carrying(docs, carried)
    names = [f.name for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", CHUNK_BYTES):
                found = searched([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()], least)
                size, rows, body = zip(*found, strict=True)
                columns = [pa.array(size, pa.int64()), run_lists(list(rows)), pa.array(body, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, "n_words", "runs", "collapsed"])

    more = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    return chosen.mapInArrow(run, T.StructType([*kinds, *more])).toDF(*carried, "n_words", "runs", "collapsed")


def looped(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text (by a hash of its id) made periodic from some word on, as the report defines it."""
    h = F.crc32(docs["doc_id"].cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(docs["text"], "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def looping(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))
        return F.array_join(F.transform(place, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # the split words stand in a lambda variable, so they are made once for a text
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, looping(w)).otherwise("")), 1)
    return docs.select(docs["doc_id"], F.when((h % 10 == 0) & docs["text"].isNotNull(), made).otherwise(docs["text"]).alias("text"))
