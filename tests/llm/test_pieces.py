"""Pieces against the library's own encoder, whatever the chunks."""

import random

import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABETS = ["ab c", "the andion ", "a", "éß漢字 \n\tx▁ 🎉", "  the", ["inter", "nation", "al", "ized", "hello", "world"]]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def table(spark, texts):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, number int, row string, c0 int")


def chunked(text, chunk):
    """The ids of one text through cut, transfer, scan and trace, without Spark."""
    batch = pa.RecordBatch.from_pydict({"c0": [1], "text": [text], "row": ["r"]})
    parts = list(pieces._cut(PATH, chunk)(iter([batch])))
    states = pieces._scan(pa.Table.from_batches(list(pieces._transfers(PATH, chunk)(iter(parts))))).to_pylist()
    ids = []
    for part, s in zip(parts, states, strict=True):
        told = part.append_column("enter", pa.array([s["enter"]], pa.int32())).append_column("leave", pa.array([s["leave"]], pa.int32()))
        ids += next(pieces._trace(PATH, chunk)(iter([told]))).to_pydict()["ids"][0]
    return ids


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_any_chunking_gives_the_library_result(library, alphabet):
    rnd = random.Random(str(alphabet))
    for _ in range(25):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(100, 350)))
        assert chunked(text, rnd.choice([40, 64, 99])) == library.encode(text)


def test_product_is_associative():
    import numpy as np

    rnd = np.random.default_rng(0)
    a, b, c = (np.where(rnd.random(s) < 0.4, 0.0, pieces.NEVER) for s in ((3, 5), (5, 4), (4, 6)))
    left = pieces.product(pieces.product(a, b), c)
    right = pieces.product(a, pieces.product(b, c))
    assert (left == right).all()


def test_whole_table_and_round_trip(spark, library):
    rnd = random.Random(8)
    texts = ["", None, " ", "<s> [INST]", "giant " * 5000, "y" * 3000, "\n" * 2500, "".join(rnd.choices("ab é漢\n", k=9000)), "short", "short"]
    coded = pieces.decode(pieces.encode(table(spark, texts), PATH, "doc_id", "c0", chunk=1000), PATH)
    got = {r["doc_id"]: r for r in coded.collect()}
    assert coded.columns == ["doc_id", "c0", "ids", "decoded"] and len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or "") and got[i]["decoded"] == (t or "") and got[i]["c0"] == 1


def test_null_and_repeated_ids_stay_apart(spark, library):
    rows = [(None, "null one " * 300), (None, "null two " * 300), (4, "same " * 500), (4, "same " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["ids"]) for r in pieces.encode(docs, PATH, "doc_id", chunk=500).collect()), key=str)
    assert got == sorted(((d, library.encode(t)) for d, t in rows), key=str)


def test_empty_table(spark):
    assert pieces.decode(pieces.encode(table(spark, []), PATH, "doc_id"), PATH).count() == 0


def test_lists_of_slices_nulls_and_empty_columns():
    rows = [[1, 2], [], [3], [4, 5, 6]]
    whole = pa.array(rows, pa.list_(pa.int32()))
    assert pieces.lists_of(whole) == rows
    assert pieces.lists_of(whole.slice(1, 2)) == rows[1:3]
    assert pieces.lists_of(whole.slice(0, 0)) == []
    assert pieces.lists_of(pa.array([[1], None, [2]], pa.list_(pa.int32()))) == [[1], [], [2]]
