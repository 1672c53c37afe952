"""Archives: written, read back and joined to captures."""

import base64
import hashlib

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, mark string, first string, row int, bytes int"


def table(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", "y", 1, 2) for p, u, h in rows], SCHEMA)


def found(spark, rows, least=0):
    got = warc.round_trip(table(spark, rows), least).collect()
    return sorted(
        ((warc.page_of(r["response"]["record_id"]), r["response"]["payload_bytes"], r["response"]["payload_digest"], r["response"]["kind"], warc.page_of(r["response"]["refers_to"]), r["response"]["target_uri"], r["request"]["target_uri"], r["metadata"]["fields"]) for r in got),
        key=str,
    )


def plain(rows, least=0):
    out = []
    taken = {}
    for p, u, h in rows:
        body = (h or "").encode()
        if len(body) >= least:
            taken[body] = max(taken.get(body, -1), -1 if p is None else p)
    done = set()
    for p, u, h in rows:
        body = (h or "").encode()
        first = taken.get(body)
        response = first is None or (first == (-1 if p is None else p) and body not in done)
        if response and first is not None:
            done.add(body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((p, len(body), digest, "response" if response else "revisit", None if response or first == -1 else first, u, u, f"page-id: {'' if p is None else p}\r\n"))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/\r\nWARC-Type: x\\n", "<p>one</p>"),
    (7, None, "<p>one</p>"),
    (3, "http://c/", ""),
    (4, "http://d/", None),
    (5, "http://e/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "http://f/é", "ünï\n\r\n\r\n "),
    (None, "http://g/", "lonely"),
    (8, "http://h/", "x" * 3_000_000),
    (9, "http://i/", "x" * 3_000_000),
    (9, "http://i/", "x" * 3_000_000),
]


def test_captures(spark):
    assert found(spark, ROWS) == plain(ROWS)


def test_small_payloads_are_all_responses(spark):
    assert found(spark, ROWS, 20) == plain(ROWS, 20)


def test_payloads_come_back(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(table(spark, ROWS), path)
    got = {r["record_id"]: r for r in warc.records(spark, path, with_payload=True).collect()}
    assert len(got) == 3 * len(ROWS)
    for p, _, html in ROWS:
        mine = [r for r in got.values() if r["kind"] in ("response", "revisit") and warc.page_of(r["record_id"]) == p]
        for r in mine:
            body = r["payload"] if r["kind"] == "response" else got[r["refers_to"]]["payload"]
            assert bytes(body) == (html or "").encode()


def test_empty_table(spark):
    assert found(spark, []) == []
