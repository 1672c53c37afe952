"""Token ids in binary files of patched frame-of-reference blocks.

A file is a row of segments. A segment holds whole documents: a header, the documents' ids and lengths, the byte
offset of every block, then the blocks, then one line feed. A block stores up to ``BLOCK`` ids: its minimum, a bit
width, the differences to the minimum packed at that width, and an exception list (places and high parts) for those
that do not fit. The width is that of the ``PERCENTILE`` of the block's differences. Block starts allow one block to
be read without those before it.

Documents are dealt to tasks by ranges of their ids and sorted inside them, so the files hold them in ascending order;
where documents share an id, a hash of the text orders them. Null ids come first. Each task writes its own files.

Defined results: a null text is encoded as the empty text; every document ends with the end id, so none is empty.
Repeated rows are written one by one. An empty table gives no segments and an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, cut_points, parts_of, range_number, saved, scratch_path

BLOCK = 1024
PERCENTILE = 95
SEGMENT_IDS = 1 << 20
SEGMENTS_PER_FILE = 16
MAGIC = b"PFR1"
#: partition, segment, ids before it in the partition, documents, ids, blocks, bytes of blocks
HEADER = struct.Struct("<4sIIqIQII")
#: minimum, width, ids, exceptions
BLOCK_HEADER = struct.Struct("<IBHH")
#: Words kept with their ids in one Python worker; words beyond are learnt for one batch only.
CACHE_WORDS = 800_000


class Words(dict):
    """Place of each word in ``ids``; a word that is asked for in vain gets a place and is noted as new."""

    def __init__(self) -> None:
        self.ids: list[bytes | None] = []  # None: not to be cut out
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self.ids)
        self.ids.append(None)
        self.new.append(word)
        return place

    def forget(self, words: list[str]) -> None:
        """Take out the words that came last."""
        for w in words:
            del self[w]
        del self.ids[len(self.ids) - len(words) :]


class WordEncoder:
    """Ids of whole texts, each different word sent to the library once.

    The vocabulary's splitting rule never joins a character with a single blank after it, so a text may be cut before
    every blank that stands alone between two other characters; the ids of the parts are those of the whole. New words
    go to the library in one text, whose ids are dealt out by the bytes that they stand for. Texts with other blanks
    next to one another, or with a special token, go to the library as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # a character of a token stands for a byte
        self.known = Words()  # words after a blank

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = [" " + w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        if plain:
            (data,) = self.whole(["".join(plain)])
            ends = np.cumsum(self.bytes_of[np.frombuffer(data, "<u4")])
            cuts = np.searchsorted(ends, np.cumsum([len(w.encode()) for w in plain])) + 1
            first = 0
            for w, last in zip(plain, (4 * cuts).tolist(), strict=True):
                self.known.ids[self.known[w[1:]]] = data[first:last]
                first = last

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        heads, rests = [], []
        place = self.known.__getitem__
        for text in texts:
            head, *rest = text.split(" ")
            heads.append(head)
            rests.append(list(map(place, rest)))
        new, self.known.new = self.known.new, []
        self._learn(new)
        out: list[bytes | None] = []
        for text, head, ids, rest in zip(texts, heads, self.whole(heads), rests, strict=True):
            odd = rest and (not head or head[-1].isspace()) or any(s in text for s in self.special)
            try:
                out.append(None if odd else ids + b"".join(map(self.known.ids.__getitem__, rest)))
            except TypeError:  # a word that is not to be cut out
                out.append(None)
        if at := [i for i, x in enumerate(out) if x is None]:
            for i, x in zip(at, self.whole([texts[i] for i in at]), strict=True):
                out[i] = x
        if len(self.known) > CACHE_WORDS:
            self.known.forget(new)
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of unsigned 32-bit values."""
    low = int(values.min())
    off = (values - np.uint32(low)).astype("<u4")
    rank = -(-int(percentile * (len(off) - 1)) // 100)
    width = int(np.partition(off, rank)[rank]).bit_length()
    late = np.flatnonzero(off >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = np.unpackbits(off.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    body = np.packbits(bits, bitorder="little").tobytes()
    high = (off[late] >> np.uint32(width)).astype("<u4") if len(late) else np.empty(0, "<u4")
    return BLOCK_HEADER.pack(low, width, len(values), len(late)) + body + late.astype("<u2").tobytes() + high.tobytes()


def unpack(data: memoryview, at: int) -> np.ndarray:
    """The values of the block that starts at byte ``at``."""
    low, width, count, late = BLOCK_HEADER.unpack_from(data, at)
    at += BLOCK_HEADER.size
    size = (count * width + 7) // 8
    bits = np.zeros((count, 32), np.uint8)
    packed = np.frombuffer(data, np.uint8, size, at)
    bits[:, :width] = np.unpackbits(packed, count=count * width, bitorder="little").reshape(count, width)
    values = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
    at += size
    if late:
        places = np.frombuffer(data, "<u2", late, at)
        values[places] |= np.frombuffer(data, "<u4", late, at + 2 * late) << np.uint32(width)
    return values + np.uint32(low)


def segment(partition: int, number: int, before: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """The bytes of one segment without its line feed."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    blocks = [pack(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u4")
    head = HEADER.pack(MAGIC, partition, number, before, len(ids), len(flat), len(blocks), sum(map(len, blocks)))
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    sizes = np.array([len(x) // 4 for x in ids], "<u8").tobytes()
    return b"".join([head, names, sizes, starts.tobytes(), *blocks])


def read_segments(data: bytes) -> Iterator[tuple[int, int, list[int | None], list[np.ndarray]]]:
    """(partition, ids before it in the partition, document ids, ids of each document) of each segment of a file."""
    view, at = memoryview(data), 0
    while at < len(data):
        magic, partition, _, before, docs, count, blocks, size = HEADER.unpack_from(view, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += HEADER.size
        names = np.frombuffer(view, "<i8", docs, at).tolist()
        nulls = view[at + 8 * docs : at + 9 * docs]
        at += 9 * docs
        sizes = np.frombuffer(view, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        starts = np.frombuffer(view, "<u4", blocks, at).tolist()
        at += 4 * blocks
        flat = np.concatenate([unpack(view, at + s) for s in starts]) if blocks else np.empty(0, np.uint32)
        at += size + 1
        yield partition, before, [None if z else x for x, z in zip(names, nulls, strict=True)], np.split(flat, np.cumsum(sizes)[:-1])


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text and write the files below ``path``."""
    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    parts = parts_of(docs.sparkSession)
    cuts = cut_points(chosen, "doc_id", parts)
    dealt = chosen.withColumn("part", range_number(F.col("doc_id"), cuts)).repartitionById(parts, "part")
    ordered = dealt.sortWithinPartitions("part", F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = before = number = 0
        part = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, before, number
            data = segment(part, number, before, [d for d, _ in held], [x for _, x in held])
            before, number, held, size = before + size, number + 1, [], 0
            return pa.RecordBatch.from_pydict({"data": pa.array([data], pa.binary())})

        for whole in batches:
            for batch in batches_of(whole, "text", 2 << 20):
                found = coder.ids([t or "" for t in batch.column("text").to_pylist()])
                for doc, ids, p in zip(batch.column("doc_id").to_pylist(), found, batch.column("part").to_pylist(), strict=True):
                    part = p
                    held.append((doc, ids + end))
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield close()
        if held:
            yield close()

    data = ordered.mapInArrow(run, "data binary")
    # a text file whose lines are the segments: the bytes go out as they are
    data.select(F.col("data").cast("string")).write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                for partition, before, names, ids in read_segments(data.as_py()):
                    sizes = np.array([len(x) for x in ids], np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([partition] * len(ids), pa.int32()),
                            "inner": pa.array(before + np.cumsum(sizes) - sizes),
                            "doc_id": pa.array(names, pa.int64()),
                            "n_tokens": pa.array(sizes),
                            "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        }
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    found = saved(files.mapInArrow(run, "part int, inner long, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    totals = sorted((r["part"], r["n"]) for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one per task
    starts, seen = [], 0
    for part, n in totals:
        starts.append((part, seen))
        seen += n
    offsets = spark.createDataFrame(starts, "part int, offset long")  # as many rows as tasks wrote
    joined = found.join(F.broadcast(offsets), "part")
    return joined.select("doc_id", (F.col("offset") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-blocks")
    write(docs, tokenizer, path, end_id)
    return read(docs.sparkSession, path)
