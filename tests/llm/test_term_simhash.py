"""Fingerprints, edited texts and the permuted tables against plain versions."""

import hashlib
import math
import random

import xxhash

from tidemark.llm import term_simhash as th


def plain_fingerprint(text):
    if not text:
        return 0
    words = text.lower().split() or [text]
    total = [0.0] * 64
    for w in set(words):
        weight = (1 + math.log(words.count(w))) * min(len(w), 8) ** 2
        h = xxhash.xxh64_intdigest(w)
        for b in range(64):
            total[b] += weight if h >> b & 1 else -weight
    return sum(1 << b for b in range(64) if total[b] > 1e-3)


def table(spark, rows):
    return spark.createDataFrame([(d, t, 0, True) for d, t in rows], "doc_id long, text string, part int, guest boolean")


def plain(rows):
    ordered = [r for r in sorted((r for r in rows if r[0] is not None), reverse=True)] + [r for r in rows if r[0] is None]
    out = []
    for k, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest()))
    return sorted(out, key=str)


def test_pairs(spark):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices(["alpha", "Beta", "γάμμα", "d", "epsilon🎉"], k=rnd.randint(0, 50))) for _ in range(80)]
    rows = [(i * 13 % 997, t) for i, t in enumerate(texts + [None, "", " \n", "ab", "long " * 40_000])] + [(None, "no id")]
    got = th.edited_pairs(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == plain(rows)
    text_of = dict(rows)
    ids = sorted((d for d in text_of if d is not None), reverse=True) + [None]
    for r in got:
        own, after = text_of[r["doc_id"]] or "", text_of[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]] or ""
        fps = [th.fingerprint(own), th.fingerprint(th.edited(own, after)), th.fingerprint(after)]
        assert [r["fp"] % (1 << 64), r["edited_fp"] % (1 << 64)] == fps[:2]
        assert r["near_edited"] == th.likeness(*fps[:2]) and r["near_next"] == th.likeness(fps[0], fps[2])


def test_small_tables(spark):
    assert th.edited_pairs(table(spark, [])).count() == 0
    (one,) = th.edited_pairs(table(spark, [(5, "only one document")])).collect()
    assert one["near_next"] == 1.0
    twice = th.edited_pairs(table(spark, [(5, "same text here"), (5, "same text here")])).collect()
    assert len(twice) == 2 and {r["fp"] for r in twice} == {one["fp"] * 0 + th.signed(th.fingerprint("same text here"))}


def test_fingerprint_is_the_weighted_vote():
    rnd = random.Random(3)
    votes = th.Votes()
    for _ in range(200):
        text = " ".join(rnd.choices(["a", "be", "see", "delta", "Epsilon", "zetazetazeta", "naïve"], k=rnd.randint(1, 40)))
        assert (votes.fingerprint(text) ^ plain_fingerprint(text)).bit_count() <= 1  # sums at zero may round either way
        assert votes.fingerprint(text) == th.fingerprint(text)


def test_tables_find_every_near_fingerprint(spark):
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(10)} | {0, (1 << 64) - 1}
    signed = [th.signed(x) for x in fps]
    queries = signed[::4]
    for radius in (1, 3):
        got = th.near(spark.createDataFrame([(q,) for q in queries], "q long"), spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
        want = sorted((q, f, ((q ^ f) % (1 << 64)).bit_count()) for q in queries for f in signed if ((q ^ f) % (1 << 64)).bit_count() <= radius)
        assert sorted((r["q"], r["fp"], r["distance"]) for r in got) == want


def test_neighbours_of_every_asked_row(spark):
    rnd = random.Random(12)
    base = [rnd.getrandbits(64) for _ in range(8)]
    rows = [(i, th.signed(rnd.choice(base) ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3))))) for i in range(300)] + [(None, 5)]
    got = {r["doc_id"]: r["near_docs"] for r in th.neighbours(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    assert len(got) == len(rows)
    for i, fp in rows:
        near = sum(((fp ^ other) % (1 << 64)).bit_count() <= 3 for _, other in rows) - 1
        assert got[i] == (near if i is not None and i % 20 == 0 else None)
