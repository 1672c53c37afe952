"""Near-duplicates of the pipeline against plain sets of five-word shingles."""

import random

import corpus_pipeline
from tidemark.llm import shingle_dedup as sh

SCHEMA = "doc_id long, text string, lang string, root string, n_chars long, kept_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], SCHEMA)


def plain_set(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def plain_kept(rows):
    """Indexes are joined by pairs of Jaccard similarity 0.8 or more; the smallest id of each group, None for bare ones."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)


def rows_with_edits(seed=4):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(40):
        base = rnd.choices(words, k=rnd.randint(60, 300))
        rows.append(" ".join(base))
        for edits in (0, 1, 2, 4, 6, 10):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), edits):
                copy[at] = rnd.choice(words)
            rows.append(" ".join(copy))
    rows += ["", None, " \n", "one two", "One  two", "one three"]
    rnd.shuffle(rows)
    return [(i * 3 if i % 11 else None, t) for i, t in enumerate(rows)]


def test_one_row_of_each_group_of_near_texts(spark):
    rows = rows_with_edits()
    want = plain_kept(rows)
    for cell_rows in (4096, 3):
        got = sh.unique_documents(table(spark, rows), cell_rows=cell_rows)
        assert got.columns == table(spark, []).columns
        assert sorted((r["doc_id"] for r in got.collect()), key=str) == want


def test_stage_drops_a_near_copy_that_the_fingerprints_miss(spark):
    rnd = random.Random(2)
    base = rnd.choices([f"w{i}" for i in range(500)], k=120)
    copy = base[:40] + ["changed"] + base[41:90] + ["changed"] + base[91:]
    docs = table(spark, [(2, " ".join(copy)), (1, " ".join(base)), (None, "alone here, with words of its own"), (None, "alone here, with words of its own")])
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [1, None]


def test_the_fingerprint_trie_proposes_the_pairs_within_its_radius(spark):
    docs = table(spark, rows_with_edits())
    nodes = sh.marks_of(docs).select("mark", "fp").distinct().cache()
    fps = {r["mark"]: r["fp"] for r in nodes.collect()}

    def parts(pairs):
        root = {m: m for m in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for m in fps:
            groups.setdefault(find(m), set()).add(m)
        return {frozenset(g) for g in groups.values()}

    near = [(a, b) for a in fps for b in fps if a < b and bin((fps[a] ^ fps[b]) & (1 << 64) - 1).count("1") <= sh.RADIUS]
    assert len(near) > 10
    assert parts(near) == parts([(r["u"], r["v"]) for r in sh.fingerprint_stars(nodes).collect()])
