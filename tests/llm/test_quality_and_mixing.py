"""The compression classifier on held-out rows, and mixing rates against a direct solution."""

import random
import zlib

import numpy as np

from tidemark.llm import mixing, quality_compression as qc

SF = "/root/testdata/sf0.1"


def docs_and_labels(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = docs_and_labels(spark)
    model = qc.train(docs, labels)
    rows = qc.scored(docs, model, "doc_id").join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [(r["score"] >= 0.5) == (r["quality"] == 1) for r in held]
    assert np.mean(right) >= 0.97
    good = [r["score"] >= 0.5 for r in held if r["quality"] == 1]
    assert np.mean(good) >= 0.99
    # calibrated: the mean score is near the share of good ones
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["quality"] for r in held])) < 0.03


def descent(x, y, ridge, rounds=4000):
    """The curve by accelerated gradient steps alone, over columns brought to one scale."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-12)
    a = x / scale
    step = 1 / (np.linalg.eigvalsh(a.T @ a)[-1] / 4 + ridge / scale.min() ** 2)
    w = before = np.zeros(x.shape[1])
    best = np.inf
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -500, 500)))
        before, w = w, ahead - step * (a.T @ (p - y) + ridge * ahead / scale**2)
        best = min(best, qc.loss(x, y, w / scale, ridge))
    return best


def test_curve_converges_on_every_resample(spark):
    docs, labels = docs_and_labels(spark)
    model = qc.train(docs, labels)
    known = qc.clean_labels(labels).where("crc32(cast(doc_id as string)) % 3 = 2")
    rows = qc.measure(docs.join(known, "doc_id"), model.good, model.bad, "doc_id", "quality").orderBy("doc_id").collect()
    x, y = qc.design(np.array([r["features"] for r in rows])), np.array([r["quality"] for r in rows], float)
    for seed in range(24):
        rnd = np.random.default_rng(seed)
        at = rnd.permutation(len(y))[: int(len(y) * 0.9)]
        w = qc.fit(x[at], y[at])
        gradient, p = qc.slope(x[at], y[at], w, qc.RIDGE)
        assert np.abs(gradient).max() < 1e-6
        assert np.mean((p >= 0.5) == (y[at] == 1)) > 0.96 and np.mean(p[y[at] == 0] < 0.5) > 0.85
        if seed < 3:
            assert qc.loss(x[at], y[at], w, qc.RIDGE) <= descent(x[at], y[at], qc.RIDGE) + 1e-9


def test_curve_of_separable_and_of_steep_rows():
    x = np.column_stack([np.ones(40), np.repeat([-1e3, 1e3], 20)])
    w = qc.fit(x, np.repeat([0.0, 1.0], 20))
    assert ((x @ w > 0) == (np.arange(40) >= 20)).all() and np.isfinite(w).all()


def test_odd_rows(spark):
    rnd = random.Random(1)
    clean = [" ".join(rnd.choices("the river runs along hills and past old stone mills".split(), k=60)) for _ in range(90)]
    junk = [" ".join(w + "!!" for w in rnd.choices("BUY NOW FREE WIN CASH".split(), k=60)) for _ in range(60)]
    rows = [(i, t, 0.0) for i, t in enumerate(clean + junk)] + [(900, None, 0.0), (901, "", 0.0), (None, clean[0], 0.0), (902, "word " * 200_000, 0.0), (3, clean[3], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = [(i, int(i < 90), 0) for i in range(150)] + [(3, 0, 0), (None, 1, 0), (5, None, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = qc.train(docs, labels)
    out = qc.scored(docs, model, "doc_id").collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert np.mean([(by[i] >= 0.5) == (i < 90) for i in range(150)]) > 0.95
    assert by[900] == by[901] == model.prior
    kept = qc.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id between 90 and 149").count() <= 5
    nobody = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in qc.scored(docs, qc.train(docs, nobody)).collect()} == {0.5}
    assert qc.keep_good(docs.where("false"), labels).count() == 0


def plain_rates(p, t, goal, scale, rounds=20_000):
    """Projected gradient in plain numpy, to the end."""
    root = 1 / np.sqrt(scale)
    step = 1 / np.linalg.eigvalsh(((p * t[:, None]).T @ p) * root[:, None] * root[None, :])[-1]
    x = np.ones(len(p))
    for _ in range(rounds):
        x = np.maximum(0, x - step * (p @ (((x * t) @ p - goal) / scale)))
    return x


def members(spark, p, t):
    return spark.createDataFrame([(i, int(n), [float(v) for v in row]) for i, (row, n) in enumerate(zip(p, t, strict=True))], "doc_id long, tokens long, p array<double>")


def test_rates_meet_the_targets(spark):
    rnd = np.random.default_rng(3)
    p, t = rnd.dirichlet([0.3, 0.3, 0.3], 400), rnd.integers(0, 900, 400)
    table = members(spark, p, t).repartition(5)
    weights = (0.6, 0.3, 0.1)
    errors, step = mixing.solve(table, weights)
    got = {r["doc_id"]: r["rate"] for r in mixing.rates(table, errors, step, 3).collect()}
    x = np.array([got[i] for i in range(400)])
    goal = np.array(weights) * t.sum()
    assert (x >= 0).all() and np.allclose((x * t) @ p, goal, rtol=1e-3)
    assert np.allclose(x, plain_rates(p, t, goal, t @ p), atol=5e-2)


def test_targets_out_of_reach_are_neared(spark):
    p, t = np.array([[0.9, 0.1], [0.8, 0.2]]), np.array([100, 100])
    errors, step = mixing.solve(members(spark, p, t), (0.1, 0.9))
    x = np.array([r["rate"] for r in mixing.rates(members(spark, p, t), errors, step, 2).orderBy("doc_id").collect()])
    goal = np.array([20.0, 180.0])
    def loss(x):
        return ((((x * t) @ p - goal) ** 2) / (t @ p)).sum()

    assert (x >= 0).all() and loss(x) <= loss(plain_rates(p, t, goal, t @ p)) * 1.01 + 1e-9


def test_mixing_odd_rows(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(("red crimson", "blue azure")[i % 2].split() + ["the"], k=40)) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)] + [(500, None, "en", 1), (501, "", "en", 1), (None, texts[0], "en", 1), (7, texts[7], "en", 1)], "doc_id long, text string, p string, rate int")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (9, None)], "doc_id long, domain int")
    out = mixing.fitted(docs, labelled, (0.75, 0.25), "doc_id").collect()
    assert len(out) == 124
    got = np.array([r["p"] for r in out]).T @ np.array([r["rate"] * r["tokens"] for r in out])
    assert np.allclose(got / got.sum(), [0.75, 0.25], atol=0.01)
    mixed = mixing.mixed(docs, labelled, (0.75, 0.25))
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    rates = {r["doc_id"]: r["rate"] for r in out}
    assert mixed.columns == docs.columns and all(abs(counts.get(i, 0) - rates[i]) < 1 for i in range(120) if i != 7)
    assert mixing.fitted(docs.where("false"), labelled, (0.5, 0.5), "doc_id").count() == 0
    assert mixing.fitted(docs, labelled.where("false"), (0.5, 0.5), "doc_id").count() == 124


def test_dictionaries_learn_from_whole_texts_of_every_sampled_row():
    head, tail = b"clean opening " * 300, b"JUNK!" * 800
    got = qc.passages(head + tail, 1024, qc.PASSAGE_BYTES)
    assert len(got) <= 1024 and b"JUNK" in got and b"clean" in got
    assert qc.passages(b"short", 1024, qc.PASSAGE_BYTES) == b"short"
    lengths = [10] * 50 + [5000] * 1950
    share = qc.row_share(lengths, qc.DICTIONARY_BYTES)
    texts = [bytes([i % 250]) * n for i, n in enumerate(lengths)]
    cut = [qc.passages(t, share, qc.PASSAGE_BYTES) for t in texts]
    assert 0.99 * qc.DICTIONARY_BYTES < sum(map(len, cut)) <= qc.DICTIONARY_BYTES
    assert len(qc.dictionary(cut, qc.DICTIONARY_BYTES).split(b"\n")) >= 1990
