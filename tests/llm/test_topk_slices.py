"""The bit-sliced index against plain integer inner products."""

import math
import random

from tidemark.llm import topk_slices as ts


def plain(rows, queries, k):
    def fit(i, v):
        return i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)

    def q(v):
        return [math.floor(256 * x) for x in v]

    chosen = [(i, q(v)) for i, v in rows if fit(i, v)]
    asked = {}
    for i, v in queries:
        if fit(i, v):
            asked[i] = min(asked.get(i, q(v)), q(v))
    out = []
    for i, v in asked.items():
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in chosen if j != i))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, number int, ids string")


def compared(spark, rows, queries, k=5, **sizes):
    got = ts.top_rows(vectors(spark, rows), vectors(spark, queries), k, **sizes)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties across blocks
    queries = [r for r in rows if r[0] % 10 == 0]
    assert compared(spark, rows, queries, block_rows=50, group_queries=7) == plain(rows, queries, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [0.5]), (7, []), (8, [0.0, 0.0]), (9, [-1.0, 3.0]), (9, [-1.0, 3.0])]
    assert compared(spark, rows, rows, 5) == plain(rows, rows, 5)


def test_wide_values(spark):
    rows = [(i, [x, -x]) for i, x in enumerate((1000.0, -3.25, 0.001, 250_000.0, -250_000.0))]
    assert compared(spark, rows, rows, 2) == plain(rows, rows, 2)


def test_components_of_any_size(spark):
    rows = [(1, [1e6]), (2, [2e6]), (3, [1e6]), (4, [-3e6])]
    assert compared(spark, rows, rows, 3) == plain(rows, rows, 3)
    rows = [(i, [x, y]) for i, (x, y) in enumerate([(2e9, 0.0), (-2e9, 0.5), (0.01, 2e9), (0.02, -2e9), (1e9, 0.25), (0.0, 0.0)])]
    small = [(i, [x, y]) for i, (x, y) in enumerate([(0.5, 0.25), (-0.75, 2.0), (1e4, -1e4)])]
    assert compared(spark, rows, small, 5, group_queries=1) == plain(rows, small, 5)


def test_scores_beyond_a_long_are_ranked_and_then_held(spark):
    rows = [(i, [x]) for i, x in enumerate((1e15, 3e15, -2e15, 2e15))]
    want = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in plain(rows, rows, 3)]
    assert compared(spark, rows, rows, 3) == want and [w[2] for w in want if w[0] == 0] == [1, 3, 2]


def test_empty_and_single(spark):
    assert compared(spark, [], []) == []
    assert compared(spark, [(1, [1.0])], [(1, [1.0])]) == []
