"""SimHash near-duplicates against a plain version of the definition."""

import random

import numpy as np
import xxhash

from tidemark.llm import simhash_dedup as sd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string, kept int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in rows], SCHEMA)


def plain_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    found = [w for w in lower.split(" ") if w]
    if not found:
        return 0
    runs = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((doc, fps[i], least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def texts(seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.randint(4, 400))) for _ in range(60)]
    rows = list(base)
    for t in base[:25]:
        parts = t.split(" ")
        parts[rnd.randrange(len(parts))] = "changed"
        rows += [t, " ".join(parts), t.upper() if rnd.random() < 0.5 else t.replace(" ", "\n")]
    rows += ["", None, " \t\n", "one", "One two", "é x y", "long " * 30_000]
    rnd.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def test_components_equal_brute_force(spark):
    rows = texts()
    got = sd.near_components(table(spark, rows), cell_rows=8).collect()
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == plain_components(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, "only here, nowhere else at all")]
    got = sd.near_components(table(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=str) == plain_components(rows)
    kept = sd.unique_documents(table(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["5", "None", "None"]


def test_empty_table(spark):
    assert sd.near_components(table(spark, [])).count() == 0
    assert sd.unique_documents(table(spark, [])).columns == SCHEMA.replace(",", "").split()[::2]


def test_unique_documents_keep_the_smallest_of_each_component(spark):
    rows = texts(5)
    kept = sorted(r["doc_id"] for r in sd.unique_documents(table(spark, rows)).collect())
    assert kept == sorted({c for _, _, c in plain_components(rows)})


def test_walk_finds_every_pair_once():
    rnd = np.random.default_rng(1)
    seeds = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [s ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for s in seeds for b, c in rnd.integers(0, 64, (30, 2))]
    values = np.unique(np.array([*seeds, *near, 0, 1, (1 << 64) - 1], np.uint64))
    pairs = [p for i, j in sd.walk(values, None, 3) for p in zip(i.tolist(), j.tolist())]
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 3}
    assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == want
    a, b = values[::2], values[1::2]
    across = {p for i, j in sd.walk(a, b, 3) for p in zip(i.tolist(), j.tolist())}
    assert across == {(i, j) for i in range(len(a)) for j in range(len(b)) if int(a[i] ^ b[j]).bit_count() <= 3}


def test_long_chain_is_one_component(spark):
    chain = [(1 << i) - 1 for i in range(0, 63, 3)]
    edges = sd.links(spark.createDataFrame([(x,) for x in chain], "fp long"), 3, cell_rows=2)
    roots = {r["root"] for r in sd.components(edges).collect()}
    assert roots == {0}
