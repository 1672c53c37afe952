"""Runs of words against a plain search."""

import hashlib
import random
import time
import zlib

import numpy as np

from tidemark.llm import periodic_runs as pr
from tidemark.llm.queries import QUERIES


def plain_runs(words, least=12):
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts_of(rnd, count):
    for _ in range(count):
        kind, n = rnd.random(), rnd.randint(0, 70)
        letters = "ab" if kind < 0.5 else "abc"
        if kind < 0.3:  # powers with small faults
            root = rnd.choices(letters, k=rnd.randint(1, 9))
            words = (root * 30)[:n]
            for _ in range(rnd.randint(0, 2)):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice("abd")
        elif kind < 0.6:  # words of the Fibonacci kind, full of nested squares
            a, b = ["a"], ["a", "b"]
            while len(b) < n:
                a, b = b, b + a
            at = rnd.randint(0, len(b) - n) if len(b) > n else 0
            words = b[at : at + n]
        else:
            words = rnd.choices(letters, k=n)
        yield words


def test_runs_equal_plain_ones():
    rnd = random.Random(1)
    texts = list(texts_of(rnd, 1500)) + [["ab"] * 40, ["a", "b"] * 5 + ["a"] + ["a", "b"] * 5 + ["a"]]
    # squares of (ab)^m a that touch, cut out of longer ones
    texts += [(list("ab") * a + list("abababa") * 2 + list("ba") * b) for a in range(4) for b in range(4)]
    for least in (12, 2, 5):
        for first in range(0, len(texts), 50):
            part = texts[first : first + 50]
            for words, (n, rows, kept) in zip(part, pr.searched([" ".join(w).encode() for w in part], least), strict=True):
                assert n == len(words) and list(map(tuple, rows.tolist())) == plain_runs(words, least), (least, words)
                assert kept.decode() == plain_kept(words, plain_runs(words, least))


def test_texts_do_not_meet():
    rows = [r for _, r, _ in pr.searched([b"a b c d e f"] * 8)]
    assert all(len(r) == 0 for r in rows)


def test_odd_rows(spark):
    again = "x y z " * 9
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n ", 7), (4, again, 7), (4, again, 7), (None, again, None), (5, "one\u00a0word " * 12, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = pr.periodic_runs(df, "doc_id", "runs").toDF("doc_id", "more", "n_words", "runs", "collapsed").collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["collapsed"] == "" and by[1]["runs"] == []
    assert by[None]["collapsed"] == "x y z" and by[4]["runs"][0].asDict() == {"start": 0, "length": 27, "period": 3}
    assert by[5]["n_words"] == 12 and by[5]["collapsed"] == "one\u00a0word"
    assert pr.periodic_runs(df.where("false"), "doc_id").count() == 0


def test_long_texts():
    rnd = random.Random(3)
    began = time.time()
    n = 400_000
    (one,) = pr.searched([b"a " * n])
    assert one[1].tolist() == [[0, n, 1]] and one[2] == b"a"
    root = " ".join(str(rnd.randrange(1000)) for _ in range(30_000)).encode()
    (two,) = pr.searched([b" ".join([root] * 5)])
    assert [0, 150_000, 30_000] in two[1].tolist()
    a, b = b"a", b"a b"
    while len(b) < 600_000:
        a, b = b, b + b" " + a
    (three,) = pr.searched([b])
    assert len(three[1]) > 50_000  # nested squares of all sizes
    assert time.time() - began < 60


def looped(doc, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for w in words if w]
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_equals_plain_version(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rnd = random.Random(8)
    more = [(100_000 + i, " \t\n".join(w), "en", "s", 1) for i, w in enumerate(texts_of(rnd, 300))] + [(200_000, None, "en", "s", 0)]
    docs.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    text_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    assert set(got) == set(text_of)
    changed = 0
    for doc, text in text_of.items():
        words = looped(doc, text)
        if len(words) > 600:
            continue
        runs = plain_runs(words)
        changed += bool(runs)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or [None] * 4))
        r = got[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda x: (x[0], x[2]))).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_kept(words, runs).encode()).hexdigest()
    assert changed > 30


def test_names_are_equal_exactly_for_equal_stretches():
    rnd = np.random.default_rng(5)
    words = rnd.integers(0, 3, 200)
    names = pr.dictionary(np.append(words, -1), np.zeros(201, np.int64))
    for k, level in enumerate(names):
        width = 1 << k
        for i in range(200 - width):
            for j in range(i + 1, 201 - width):
                same = (words[i : i + width] == words[j : j + width]).all()
                assert same == (level[i] == level[j] and level[i] >= 0)
