"""Spelling variants against a plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

from tidemark.llm import spelling_groups as sg
from tidemark.llm.queries import QUERIES


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=10):
    words, out = sorted(counts), {}
    links = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and near(w, v)] for w in words}
    for w in words:
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        out[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = {}
    for w in words:
        root = w
        while out[root] is not None:
            root = out[root]
        rows[w] = (out[w], root, counts[w], len(links[w]), counts.get(out[w]))
    return rows


def got(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def vocabulary(rnd, count, letters="abcé"):
    counts = {}
    while len(counts) < count:
        word = "".join(rnd.choices(letters, k=rnd.randint(1, 9)))
        for _ in range(rnd.randint(1, 6)):
            counts[word] = rnd.choice([2, 3, 5, 30, 300, 3000])
            i = rnd.randrange(len(word) + 1)
            word = word[:i] + rnd.choice(["", rnd.choice(letters)]) + word[i + rnd.randint(0, 1) :] or "a"
    return counts


def test_groups_equal_plain_ones(spark):
    rnd = random.Random(6)
    counts = vocabulary(rnd, 700) | {"straße": 50, "strasse": 3, "Éa": 2, "éa": 20, "\u4e00\u4e8c": 40, "\u4e00": 3, "aaaaaaaaaaaa": 9, "aaaaaaaaaaa": 90, "a" * 3000: 5, "a" * 2999 + "b": 50}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(sg.grouped(df)) == plain(counts)
    assert got(sg.grouped(df, cell_rows=7)) == plain(counts)  # every larger block is cut


def test_every_pair_once(spark):
    rnd = random.Random(9)
    counts = vocabulary(rnd, 400, "ab")
    pairs = sorted((r["word"], r["near"]) for r in sg.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), 16).collect())
    assert pairs == sorted((a, b) for a in counts for b in counts if near(a, b))


def plain_counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            if len(word) >= 7:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 2}


def test_query_equals_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = plain(plain_counts(rows))
    assert got(QUERIES["op13_spelling_groups"](spark, "/root/testdata/sf0.001")) == want and len(want) > 100


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 ... short"), (4, "ÀÉÎÕÜßÿ÷× ABCDEFGH abcdefgh"), (4, "ÀÉÎÕÜßÿ÷× ABCDEFGH abcdefgh"), (5, "q" * 200_000), (6, "q" * 200_000), (7, "langwort " * 100_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    counted = {r["word"]: r["n"] for r in sg.word_counts(df).collect()}
    assert counted == plain_counts(rows)
    empty = df.where("false")
    assert sg.word_counts(empty).count() == 0 and sg.grouped(sg.word_counts(empty)).count() == 0
    unnamed = spark.createDataFrame([(None, "nullword nullword")], "doc_id long, text string")
    assert sum(r["n"] for r in sg.word_counts(unnamed).collect()) == 2
