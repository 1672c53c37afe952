"""WARC archives: writing captures and assembling them again.

``write`` turns each page into three records: a request, a response (or a revisit of an equal payload) and a metadata
record; request and metadata name the response in WARC-Concurrent-To. ``records`` parses the files; ``captures`` joins
the three records through those identifiers into one nested row per capture.

Payloads are equal if their SHA-1 and length are. Of equal payloads of at least ``least_bytes`` bytes the row with the
largest page id is the response and the others revisit it; where rows share that id one of them is the response.

Every record is a gzip member of its own, as usual for archives. Each task packs members into pieces of some megabytes
and writes them as the lines of a text file. What the writer puts after a line is the end of an empty gzip member whose
header ends the piece, so the file is a sequence of gzip members byte for byte.

Defined results: a null html is an empty payload, a null url an absent target. Null page ids are smaller than all
others. Repeated rows are captures of their own. An empty table gives no records and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, scratch_path

PIECE_BYTES = 4 << 20
PIECES_PER_FILE = 8
#: An empty gzip member in two parts: its header closes a piece, the rest is the writer's line end.
EMPTY_HEAD = bytes((0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF))
EMPTY_REST = bytes((3, 0, 0, 0, 0, 0, 0, 0, 0, 0))
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record, compressed, with its closing CR LF CR LF; headers without a value are left out."""
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def _line(value: str) -> str:
    """A header value keeps to its line."""
    return value.replace("\\", "\\\\").replace("\r", "\\r").replace("\n", "\\n")


def _value(line: str) -> str:
    out, at = [], 0
    while (i := line.find("\\", at)) >= 0:
        out += [line[at:i], {"r": "\r", "n": "\n"}.get(line[i + 1 : i + 2], line[i + 1 : i + 2])]
        at = i + 2
    return "".join([*out, line[at:]])


def urn(page: int | None, row: int, kind: str) -> str:
    return f"<urn:capture:{'' if page is None else page}:{row}:{kind}>"


def page_of(urn_: str | None) -> int | None:
    """The page id in a record id."""
    if urn_ is None:
        return None
    page = urn_.split(":")[2]
    return int(page) if page else None


def capture(page: int | None, row: int, url: str | None, payload: bytes, first_page: int | None, first_row: int | None) -> bytes:
    """The three records of a page; ``first_row`` names the response that a revisit refers to, None for a response."""
    own, digest = urn(page, row, "response"), "sha1:" + base32_sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = first_row is not None
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url)]
    main = record(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", own),
            *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", urn(first_page, first_row, "response") if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        head if revisit else head + payload,
    )
    asked = record(
        [("WARC-Type", "request"), ("WARC-Record-ID", urn(page, row, "request")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/http; msgtype=request")],
        f"GET {_line(url or '/')} HTTP/1.1\r\n\r\n".encode(),
    )
    told = record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", urn(page, row, "metadata")), ("WARC-Concurrent-To", own), *common, ("Content-Type", "application/warc-fields")],
        f"page-id: {'' if page is None else page}\r\n".encode(),
    )
    return asked + main + told


def planned(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Pages with a row number of their own and, for revisits, the page and row of the response."""
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    own = own.withColumn("row", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("html"))
    own = own.withColumn("mark", F.concat_ws(":", F.sha1("html"), F.col("bytes").cast("string")))
    # nulls are smallest in a struct's order
    first = own.where(F.col("bytes") >= least_bytes).groupBy("mark").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n"))
    return own.join(first.where("n > 1").select("mark", "first"), "mark", "left").select(
        "page_id", "row", "url", "html", *(F.when(F.col("first.row") != F.col("row"), F.col(f"first.{c}")).alias(f"first_{c}") for c in ("page_id", "row"))
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write the archives below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def piece() -> pa.RecordBatch:
            nonlocal held, size
            data = b"".join(held)
            held, size = [], 0
            return pa.RecordBatch.from_pydict({"data": pa.array([data + EMPTY_HEAD], pa.binary())})

        for whole in batches:
            for batch in batches_of(whole, "html"):
                payloads = batch.column("html").cast(pa.binary()).to_pylist()
                columns = (batch.column(c).to_pylist() for c in ("page_id", "row", "url", "first_page_id", "first_row"))
                for (page, row, url, first_page, first_row), payload in zip(zip(*columns, strict=True), payloads, strict=True):
                    held.append(capture(page, row, url, payload, first_page, first_row))
                    size += len(held[-1])
                    if size >= PIECE_BYTES:
                        yield piece()
        if held:
            yield piece()

    data = planned(pages, least_bytes).mapInArrow(run, "data binary")
    lines = data.select(F.col("data").cast("string")).write.option("lineSep", EMPTY_REST.decode())
    lines.option("maxRecordsPerFile", PIECES_PER_FILE).text(path)


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What each gzip member of a file holds."""
    view, at = memoryview(data), 0
    while at < len(data):
        one, parts = zlib.decompressobj(wbits=31), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            piece = view[at : at + step]
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers, block) of each record of a file, compressed or not; header names in lower case."""
    for data in members(data) if data[:2] == EMPTY_HEAD[:2] else [data]:
        at, view = 0, memoryview(data)
        while at < len(data):
            stop = data.index(b"\r\n\r\n", at)
            first, *lines = data[at:stop].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no record at byte {at}")
            headers = {k.lower(): _value(v) for k, _, v in (x.partition(": ") for x in lines)}
            size = int(headers["content-length"])
            yield headers, view[stop + 4 : stop + 4 + size]
            at = stop + 4 + size + 4


RECORD = "record_id string, kind string, concurrent_to string, target_uri string, refers_to string, payload_digest string, payload_bytes long, fields string"


def records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record below ``path``. The digest and length of a response are taken from its payload, those of a revisit
    from its headers, which describe the payload that it leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                out = []
                for h, block in parse(data.as_py()):
                    kind, digest, size, fields, payload = h["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        head, _, rest = bytes(block).partition(b"\r\n\r\n")
                        if kind == "response":
                            payload, digest, size = rest, base32_sha1(rest), len(rest)
                        else:
                            lines = (x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                            digest = h["warc-payload-digest"].removeprefix("sha1:")
                            size = next(int(v) for k, v in lines if k == "Content-Length")
                    else:
                        fields = bytes(block).decode()
                    row = [h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, fields]
                    out.append((*row, payload) if with_payload else row)
                if out:
                    names = [f.name for f in schema]
                    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, kinds.get(n, pa.string())) for x, n in zip(zip(*out, strict=True), names, strict=True)], names=names
                    )

    schema = T._parse_datatype_string(RECORD + ", payload binary" * with_payload)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, schema)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with its request and metadata records."""
    columns = [c for c in found.columns if c != "concurrent_to"]
    main = found.where(F.col("kind").isin("response", "revisit"))
    main = main.select("record_id", F.struct(*columns).alias("response"))
    beside = found.where(F.col("concurrent_to").isNotNull())
    asked, told = (
        beside.where(F.col("kind") == kind).select(
            F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), "target_uri", "fields").alias(kind)
        )
        for kind in ("request", "metadata")
    )
    joined = main.join(asked, "record_id", "left").join(told, "record_id", "left")
    return joined.select("request", "response", "metadata")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back: one nested row per page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least_bytes)
    return captures(records(spark, path))
