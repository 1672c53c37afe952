"""SentencePiece encoding and decoding; giant documents by a max-plus scan over their chunks.

A sequence of pieces is the encoder's own result exactly if every part of it is: no merge ever crosses a border between
two final pieces. So a chunk needs to know nothing but the piece that lies across its border. For each border the
possible states are the pieces that match the text across it; a chunk's transfer matrix holds, for each state at its
start and each at its end, 0 if the encoder turns the text between into pieces that begin with the one and end with the
other, and minus infinity if not. Max-plus products of the matrices are associative; products from the left and from
the right leave one state per border. Then every chunk encodes the text between its two border pieces on its own.

Texts of at most ``chunk`` characters are one chunk without inner borders and go to the encoder as they are.

Defined results: a null or empty text has no pieces. The model writes blanks as U+2581, so a text that holds that
character comes back with a blank in its place; every other text comes back as it was. Repeated rows are encoded one
by one, rows with a null id as well. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, saved

CHUNK = 65_536
BLANK = "▁"
NEVER = -np.inf


class Encoder:
    """The library's encoder without its leading blank, and what is known of the pieces' text."""

    def __init__(self, path: str) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        proto.normalizer_spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        special = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)
        ids = range(self.model.get_piece_size())
        self.pieces = {self.model.id_to_piece(i) for i in ids if not special(i)}
        self.letters = frozenset("".join(self.pieces))
        self.most = max(map(len, self.pieces))
        # characters that each id adds; of the bytes of one character only the first adds one
        self.adds = [
            int(int(self.model.id_to_piece(i)[3:5], 16) & 0xC0 != 0x80) if self.model.is_byte(i) else len(self.model.id_to_piece(i))
            for i in ids
        ]

    def spans(self, text: str) -> list[int]:
        """Ends of the pieces of ``text`` (in characters); a character outside the vocabulary is one piece."""
        return list(accumulate(n for i in self.model.encode(text) if (n := self.adds[i])))

    def border(self, text: str, at: int) -> bool:
        """True if no piece can lie across ``at``."""
        a, b = text[at - 1], text[at]
        return a not in self.letters or b not in self.letters or (b == BLANK and a != BLANK)

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """(start, end) of every piece that holds the character before ``at``: a piece ends at ``at`` or lies across."""
        found = []
        for start in range(max(0, at - self.most), at):
            for end in range(at, min(len(text), start + self.most) + 1):
                if text[start:end] in self.pieces or end - start == 1:
                    found.append((start, end))
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _plain(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def transfer(coder: Encoder, text: str, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> np.ndarray:
    """Max-plus matrix from each piece in ``left`` to each in ``right``: 0 if the encoder joins them, else -inf.

    The text is cut at the first and the last place that no piece can cross, so that only the words at the two ends
    are encoded for each state; without such a place the whole stretch is.
    """
    matrix = np.full((len(left), len(right)), NEVER)
    first_end, last_start = max(e for _, e in left), min(s for s, _ in right)
    cut = next((i for i in range(first_end, last_start + 1) if 0 < i < len(text) and coder.border(text, i)), None)
    if cut is not None:
        back = next(i for i in range(last_start, cut - 1, -1) if 0 < i < len(text) and coder.border(text, i))
        starts = [_begins(coder, text[s:cut], e - s) for s, e in left]
        ends = [_finishes(coder, text[back:e], e - s) for s, e in right]
        matrix[np.ix_(np.flatnonzero(starts), np.flatnonzero(ends))] = 0
        return matrix
    for i, (s, e) in enumerate(left):
        for j, (s2, e2) in enumerate(right):
            if (s, e) == (s2, e2):
                matrix[i, j] = 0
            elif s2 >= e:
                part = text[s:e2]
                if _begins(coder, part, e - s) and _finishes(coder, part, e2 - s2):
                    matrix[i, j] = 0
    return matrix


def _begins(coder: Encoder, text: str, size: int) -> bool:
    ends = coder.spans(text)
    return bool(ends) and ends[0] == size


def _finishes(coder: Encoder, text: str, size: int) -> bool:
    ends = [0, *coder.spans(text)]
    return len(ends) > 1 and ends[-1] - ends[-2] == size


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chosen_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each inner border that lies on the best path through all chunks.

    Running products from both ends; the first matrix has one row and the last one column.
    """
    before, after = [matrices[0]], [matrices[-1]]
    for m in matrices[1:-1]:
        before.append(product(before[-1], m))
    for m in matrices[-2:0:-1]:
        after.append(product(m, after[-1]))
    return [int(np.argmax(f[0] + b[:, 0])) for f, b in zip(before, reversed(after), strict=True)]


def window(coder_most: int, text: str, number: int, chunk: int) -> tuple[int, int]:
    """The stretch of a text that chunk ``number`` must see: its own and a piece's length on both sides."""
    return max(0, number * chunk - coder_most), min(len(text), (number + 1) * chunk + coder_most)


def encode(docs: DataFrame, model: str, *carried: str, chunk: int = CHUNK) -> DataFrame:
    """(carried columns, ids array<int>): the pieces of each whole text, as the library's own encoder gives them."""
    columns = list(carried)
    chosen = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(columns)), docs["text"].alias("text"))
    kinds = [chosen.schema[f"c{i}"] for i in range(len(columns))]
    short = chosen.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk)
    whole = short.mapInArrow(_whole(model), T.StructType([*kinds, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    giant = chosen.where(F.length("text") > chunk)
    # one row per giant text, numbered: ids need not be unique
    parts = giant.withColumn("row", F.expr("uuid()")).mapInArrow(
        _cut(model, chunk), T.StructType([*kinds, *(T.StructField(n, k) for n, k in _CUT)])
    )
    parts = saved(parts, "pieces-chunks")
    matrices = parts.select("row", "number", "last", "low", "part").repartition("row", "number").mapInArrow(
        _transfers(model, chunk), "row string, number int, size int, width int, matrix binary"
    )
    states = matrices.groupBy("row").applyInArrow(_scan, "row string, number int, enter int, leave int")
    encoded = parts.join(states, ["row", "number"]).mapInArrow(
        _trace(model, chunk),
        T.StructType([*kinds, T.StructField("row", T.StringType()), T.StructField("number", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]),
    )
    joined = encoded.groupBy("row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("number", "ids"))), lambda x: x["ids"])).alias("ids"),
        *(F.max(F.when(F.col("number") == 0, F.struct(f"c{i}"))).alias(f"s{i}") for i in range(len(columns))),
    )
    joined = joined.select(*(F.col(f"s{i}")[f"c{i}"].alias(f"c{i}") for i in range(len(columns))), "ids")
    return whole.unionAll(joined).toDF(*columns, "ids")


_CUT = (("row", T.StringType()), ("number", T.IntegerType()), ("last", T.BooleanType()), ("low", T.LongType()), ("part", T.StringType()))


def escaped(text: str) -> str:
    """The text as the encoder sees it: a leading blank, and blanks as U+2581."""
    return (BLANK + text).replace(" ", BLANK) if text else ""


def _whole(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _plain(model)
        for big in batches:
            for batch in batches_of(big, "text", 1 << 20):
                ids = coder.encode([t or "" for t in batch.column("text").to_pylist()], num_threads=1)
                columns = [batch.column(i) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "ids"])

    return run


def _cut(model: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = encoder(model).most
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                text = escaped(one.column("text")[0].as_py())
                count = -(-len(text) // chunk)
                if count > 1 and len(text) - (count - 1) * chunk < 2 * most:
                    count -= 1  # no chunk shorter than the pieces across its borders
                for k in range(count):
                    low, high = window(most, text, k, chunk)
                    high = len(text) if k == count - 1 else high
                    kept = [c for c, n in zip(one.columns, one.schema.names, strict=True) if n not in ("text", "row")]
                    names = [n for n in one.schema.names if n not in ("text", "row")]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, one.column("row"), pa.array([k], pa.int32()), pa.array([k == count - 1]), pa.array([low], pa.int64()), pa.array([text[low:high]])],
                        names=[*names, *(n for n, _ in _CUT)],
                    )

    return run


def _ends(coder: Encoder, text: str, number: int, last: bool, low: int, chunk: int) -> tuple[list, list]:
    """States at both borders of a chunk, in places of its window; the document's ends have one empty state."""
    left = [(0, 0)] if number == 0 else coder.states(text, number * chunk - low)
    right = [(len(text), len(text))] if last else coder.states(text, (number + 1) * chunk - low)
    return left, right


def chunk_matrix(coder: Encoder, text: str, number: int, last: bool, low: int, chunk: int) -> np.ndarray:
    left, right = _ends(coder, text, number, last, low, chunk)
    opened = number == 0
    # an empty state at the document's ends: any piece may come first or last
    if opened or last:
        return _open_ended(coder, text, left, right, opened, last)
    return transfer(coder, text, left, right)


def _open_ended(coder: Encoder, text: str, left: list, right: list, opened: bool, last: bool) -> np.ndarray:
    if opened and last:
        return np.zeros((1, 1))
    matrix = np.full((len(left), len(right)), NEVER)
    if opened:
        back = next((i for i in range(min(s for s, _ in right), 0, -1) if i < len(text) and coder.border(text, i)), 0)
        for j, (s, e) in enumerate(right):
            matrix[0, j] = 0 if _finishes(coder, text[back:e], e - s) else NEVER
    else:
        stop = next((i for i in range(max(e for _, e in left), len(text)) if coder.border(text, i)), len(text))
        for i, (s, e) in enumerate(left):
            matrix[i, 0] = 0 if _begins(coder, text[s:stop], e - s) else NEVER
    return matrix


def _transfers(model: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for r in batch.to_pylist():
                m = chunk_matrix(coder, r["part"], r["number"], r["last"], r["low"], chunk)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": [r["row"]],
                        "number": pa.array([r["number"]], pa.int32()),
                        "size": pa.array([m.shape[0]], pa.int32()),
                        "width": pa.array([m.shape[1]], pa.int32()),
                        "matrix": [np.packbits(m == 0).tobytes()],
                    }
                )

    return run


def _scan(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["number"])
    matrices = []
    for r in rows:
        bits = np.unpackbits(np.frombuffer(r["matrix"], np.uint8), count=r["size"] * r["width"]).reshape(r["size"], r["width"])
        matrices.append(np.where(bits == 1, 0.0, NEVER))
    inner = chosen_states(matrices) if len(matrices) > 1 else []
    return pa.table(
        {
            "row": [r["row"] for r in rows],
            "number": pa.array([r["number"] for r in rows], pa.int32()),
            "enter": pa.array([0, *inner], pa.int32()),
            "leave": pa.array([*inner, 0], pa.int32()),
        }
    )


def _trace(model: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                number, last, low, text, enter, leave = (
                    one.column(n)[0].as_py() for n in ("number", "last", "low", "part", "enter", "leave")
                )
                left, right = _ends(coder, text, number, last, low, chunk)
                ids = coder.model.encode(text[left[enter][1] : right[leave][1]])
                names = [n for n in one.schema.names if n[0] == "c" and n[1:].isdigit()]
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(n) for n in names), one.column("row"), one.column("number"), pa.array([ids], pa.list_(pa.int32()))],
                    names=[*names, "row", "number", "ids"],
                )

    return run


def lists_of(column: pa.ListArray) -> list[list[int]]:
    """The lists of an Arrow column, nulls as empty ones: numbers are turned into Python's all at once instead of one by one."""
    if column.null_count or column.values.null_count:
        return [x or [] for x in column.to_pylist()]
    ends = column.offsets.to_pylist()
    low = ends[0]
    flat = column.values.slice(low, ends[-1] - low).to_numpy().tolist()
    return [flat[a - low : b - low] for a, b in zip(ends, ends[1:])]


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of each row's ``ids``; no ids give the empty text."""
    columns = encoded.columns
    plain = encoded.toDF(*(f"c{i}" for i in range(len(columns))))
    at = columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _plain(model)
        for big in batches:
            for first in range(0, big.num_rows, 256):
                batch = big.slice(first, 256)
                text = coder.decode(lists_of(batch.column(at)), num_threads=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])

    out = T.StructType([*plain.schema, T.StructField("decoded", T.StringType())])
    return plain.mapInArrow(run, out).toDF(*columns, "decoded")
