"""Token files: exact round trip, and the ids against the library's own."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_blocks as tb

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  ", "a  b", " a b ", "a\n b", "a \nb", "x y z", "tab\t here", "<|endoftext|> a", "é 漢字 🎉 b", "it's we'll", "a  b", "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(rows, library):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, part string, start int")


def found(spark, rows):
    got = tb.round_trip(table(spark, rows), PATH, 2).collect()
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1])


def test_documents(spark, library):
    rnd = random.Random(4)
    texts = ODD + [" ".join(rnd.choices(["the", "and", "ingly", "Xé", "42", "..."], k=rnd.randint(1, 300))) for _ in range(150)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, "null id")]
    rnd.shuffle(rows)
    assert found(spark, rows) == plain(rows, library)


def test_repeated_rows_and_empty_table(spark, library):
    rows = [(3, "same text"), (3, "same text"), (1, "first")]
    assert found(spark, rows) == plain(rows, library)
    assert found(spark, []) == []


def test_words_as_the_library_has_them(library):
    coder = tb.WordEncoder(PATH)
    rnd = random.Random(9)
    texts = ["".join(rnd.choices("ab é\n\t '1.　\u001c", k=40)) for _ in range(3000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_blocks_come_back(seed):
    rnd = np.random.default_rng(seed)
    size = int(rnd.integers(1, 1025))
    values = rnd.integers(0, 1 << int(rnd.integers(1, 33)), size, dtype=np.uint64).astype(np.uint32)
    values[rnd.random(size) < 0.7] %= 50
    data = tb.pack(values)
    assert (tb.unpack(memoryview(data), 0) == values).all()
    assert (tb.unpack(memoryview(tb.pack(values[:1] * 0)), 0) == 0).all()


def test_outliers_are_exceptions_and_blocks_are_indexed():
    values = np.arange(1024, dtype=np.uint32) % 16
    values[[5, 900]] = 1 << 30
    assert len(tb.pack(values)) < 1024 * 4 // 8 + 64
    data = tb.segment(3, 0, 10, [1, None], [values.tobytes(), values[:7].tobytes()]) + b"\n"
    ((partition, before, names, ids),) = tb.read_segments(data)
    assert (partition, before, names) == (3, 10, [1, None])
    assert [x.tolist() for x in ids] == [values.tolist(), values[:7].tolist()]
