"""The registered queries over the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, normal
from tidemark.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ROWS = {"documents": 200, "pages": 50}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = normal(QUERIES[name](spark, FOLDER).toPandas()), normal(con.execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and got.values.tolist() == want.values.tolist()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_one_row_per_document_page_or_word(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    if "spelling" in name:  # a row per word
        assert len({r["word"] for r in rows}) == len(rows) > 100
    else:
        assert len(rows) == ROWS["pages" if "main_text" in name else "documents"]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, FOLDER).collect()}
    assert 0 < len(kept) < docs.count()
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in out} <= kept and all(len(r["ids"]) == r["n_pieces"] for r in out)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
