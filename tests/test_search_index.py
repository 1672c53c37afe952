"""The word index against the scan, through changes, deletes and unfinished generations."""

import random

import pytest

from tidemark.operators import search_index as si, tasks as tk

COLUMNS = "id bigint, title string, assignee string, description string, source_subject string"
WORDS = ["audit", "Audits", "aud-it", "Über", "uber", "user1", "user12", "x", "İstanbul", "日本語", "a_b", "42", "4", "re:", "", "  "]
QUERIES = ["aud", "AUD user1", "über", "uber x", "日本", "istanbul", "4 42", "a_b", "nothing", " - ", "user1 aud 42", "re", None, " "]


def text(rnd):
    return rnd.choice([None, "", " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(4)))])


def rows(rnd, ids):
    return [(i, text(rnd), rnd.choice(WORDS), text(rnd), text(rnd)) for i in ids]


def found(df):
    return sorted(r["id"] for r in df.collect())


def files_read(df):
    df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    counts = [scans.apply(i).metrics().get("numFiles") for i in range(scans.size())]
    return sum(c.get().value() for c in counts if c.isDefined())


def check(df, path):
    for query in QUERIES:
        assert found(si.search(df, path, query)) == found(tk.filter_tasks(df, search=query)), query


def test_index_equals_scan_through_changes(spark, tmp_path):
    rnd = random.Random(5)
    state = {r[0]: r for r in rows(rnd, range(300))}
    path = f"{tmp_path}/index"
    si.store(spark.createDataFrame(list(state.values()), COLUMNS), path, 50)
    check(spark.createDataFrame(list(state.values()), COLUMNS), path)
    for generation in (1, 2):
        changes = rows(rnd, rnd.sample(range(350), 80))
        batch = [(*r, rnd.choice([False, False, True, None])) for r in changes]
        for *row, deleted in batch:
            state.pop(row[0], None)
            if not deleted:
                state[row[0]] = tuple(row)
        df = spark.createDataFrame(batch, COLUMNS + ", deleted boolean")
        si.update(df, path, generation, 50)
        si.update(df, path, generation, 50)  # a batch that is run again replaces itself
    now = spark.createDataFrame(list(state.values()), COLUMNS)
    check(now, path)
    si.compact(spark, path, f"{tmp_path}/compact", 50)
    check(now, f"{tmp_path}/compact")


def test_unfinished_generation_does_not_count(spark, tmp_path):
    df = spark.createDataFrame([(1, "audit", None, None, None), (2, "other", None, None, None)], COLUMNS)
    path = f"{tmp_path}/index"
    si.store(df, path)
    spark.createDataFrame([("audit", 2, 0)], "term string, id bigint, part int").write.partitionBy("part").parquet(f"{path}/postings/gen=1")
    spark.createDataFrame([(0, "audit", "audit")], "part int, low string, high string").write.parquet(f"{path}/ranges/gen=1")
    spark.createDataFrame([(1,)], "id bigint").write.parquet(f"{path}/changed/gen=1")
    check(df, path)


def test_a_search_reads_its_ranges_only(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "concat('w', lpad(id, 6, '0'), ' common') AS title", "'a' AS assignee", "CAST(NULL AS string) AS description", "'s' AS source_subject")
    path = f"{tmp_path}/index"
    si.store(df, path, 2_000)
    assert found(si.search(df, path, "w012345")) == [12_345]
    assert files_read(si.hits(spark, path, ["w012345"])) == 1
    assert 10 <= files_read(si.hits(spark, path, ["common"])) <= 12  # a frequent word lies in ranges of ids, not in one
    assert files_read(si.hits(spark, path, ["zz"])) == 0


def test_empty_and_odd(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    si.store(none, f"{tmp_path}/none")
    assert found(si.search(none, f"{tmp_path}/none", "aud")) == []
    df = spark.createDataFrame([(None, "audit", "", None, None), (3, None, None, None, None), (4, "audit audit", "audit", None, None)], COLUMNS)
    si.store(df, f"{tmp_path}/odd")
    assert found(si.search(df, f"{tmp_path}/odd", "audit")) == [4]  # a row without id cannot be named
    with pytest.raises(ValueError):
        si.update(df, f"{tmp_path}/odd", 0)
