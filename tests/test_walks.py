"""Page walks: allowance, resuming, late delta links and expired tokens."""

import random
from datetime import datetime

import pytest

from tidemark.operators import walks

BOUNDARY = datetime(2024, 1, 10)
TABLE = f"link string, {walks.ANSWER}"


def message(ident, received="2024-01-11T00:00:00Z", removed=False):
    return {"id": ident, "receivedDateTime": received, "@removed": {"reason": "deleted"} if removed else None}


def page(mailbox, link, ids=(), next_link=None, delta_link=None, status=200):
    return (link, mailbox, status, [message(i) for i in ids], next_link, delta_link)


def run(spark, pages, mailboxes, links=(), cap=5, commit=None):
    table = spark.createDataFrame([tuple(p) for p in pages], TABLE)
    boxes = spark.createDataFrame([(m,) for m in mailboxes], "mailbox_user_id string")
    state = spark.createDataFrame(list(links), walks.LINKS)
    nothing = spark.createDataFrame([], "mailbox_user_id string, message_id string")
    read, rows = walks.walk(boxes, state, walks.fetch_from(table), cap, commit)
    keys = sorted((r.mailbox_user_id, r.message_id) for r in walks.found(read, BOUNDARY, nothing).collect() if not r.removed)
    return keys, {r.mailbox_user_id: r for r in rows.collect()}


def links_of(rows):
    return [(r.mailbox_user_id, r.delta_link, r.next_link) for r in rows.values()]


def test_all_pages_are_read_before_the_delta_link_moves(spark):
    seen = []
    pages = [page("u1", None, ["m1"], "n1"), page("u1", "n1", ["m2"], None, "d1")]
    keys, rows = run(spark, pages, ["u1"], commit=lambda p, r: seen.append((p.count(), r.first().delta_link, r.first().next_link)))
    assert keys == [("u1", "m1"), ("u1", "m2")]
    assert seen == [(1, None, "n1"), (1, "d1", None)]
    assert (rows["u1"].outcome, rows["u1"].pages) == ("ADVANCED", 2)


def test_a_failure_leaves_the_safe_link_and_the_next_run_resumes(spark):
    broken = [page("u1", "safe", ["m1"], "next"), page("u1", "next", status=503)]
    keys, rows = run(spark, broken, ["u1"], [("u1", "safe", None)])
    r = rows["u1"]
    assert keys == [("u1", "m1")]
    assert (r.outcome, r.delta_link, r.next_link, r.error) == ("FAILED", "safe", "next", "status 503")
    keys, rows = run(spark, [page("u1", "next", ["m2"], None, "new")], ["u1"], links_of(rows))
    assert keys == [("u1", "m2")]
    assert (rows["u1"].outcome, rows["u1"].delta_link, rows["u1"].next_link) == ("ADVANCED", "new", None)


def test_an_expired_token_starts_again_once(spark):
    pages = [page("u1", "old", status=410), page("u1", None, ["m1"], None, "fresh")]
    keys, rows = run(spark, pages, ["u1"], [("u1", "old", None)])
    assert keys == [("u1", "m1")]
    assert (rows["u1"].outcome, rows["u1"].resets, rows["u1"].delta_link) == ("ADVANCED", 1, "fresh")
    again = [page("u1", "old", status=410), page("u1", None, ["m1"], "n1"), page("u1", "n1", status=410)]
    keys, rows = run(spark, again, ["u1"], [("u1", "old", None)])
    assert keys == [("u1", "m1")]
    r = rows["u1"]
    assert (r.outcome, r.resets, r.delta_link, r.next_link) == ("FAILED", 1, None, "n1")


def test_allowance_and_odd_input(spark):
    chain = [page("u1", f"n{i}" if i else None, [f"m{i}"], f"n{i + 1}") for i in range(7)]
    chain += [page("u2", None), page("u3", None, ["x", " "], " ", "d"), page("u3", None, ["x", " "], " ", "d")]
    keys, rows = run(spark, chain, ["u1", "u1", "u2", "u3", "u4", None, " "], [("u1", " ", ""), ("u9", "d", "n")])
    assert [k for k in keys if k[0] == "u1"] == [("u1", f"m{i}") for i in range(5)]
    assert (rows["u1"].outcome, rows["u1"].next_link, rows["u1"].pages) == ("CUT", "n5", 5)
    assert (rows["u2"].outcome, rows["u2"].error) == ("FAILED", "last page without a delta link")
    assert (rows["u3"].outcome, rows["u3"].delta_link) == ("ADVANCED", "d") and ("u3", "x") in keys
    assert rows["u4"].error == "no answer" and rows[None].error == rows[" "].error == "no mailbox"
    assert "u9" not in rows and len(rows) == 6
    assert run(spark, chain, []) == ([], {})
    assert run(spark, chain, [None])[0] == []


def test_messages_come_and_go_in_order(spark):
    first = [message("a"), message("b", removed=True), message("old", "2024-01-09T00:00:00Z"), message("never", None), message("s", removed=True)]
    then = [message("a", removed=True), message("b"), message("s"), message("a"), message("t"), message("gone", removed=True)]
    table = spark.createDataFrame([(None, "u", 200, first, "n", None), ("n", "u", 200, then, None, "d")], TABLE)
    boxes = spark.createDataFrame([("u",)], "mailbox_user_id string")
    read, _ = walks.walk(boxes, spark.createDataFrame([], walks.LINKS), walks.fetch_from(table))
    stored = spark.createDataFrame([("u", "s"), ("u", "t")], "mailbox_user_id string, message_id string")
    got = sorted((r.message_id, r.removed) for r in walks.found(read, BOUNDARY, stored).collect())
    assert got == [("a", False), ("a", True), ("b", False), ("s", True)]


def one_by_one(book, mailbox, delta, nxt, cap):
    """A plain walker of one mailbox."""
    keys, pages, resets, walked = set(), 0, 0, 0
    while True:
        status, ids, next_link, delta_link = book.get((mailbox, nxt or delta), (None, (), None, None))
        if status == 410 and not resets:
            delta = nxt = None
            resets, walked = 1, 0
            continue
        if status != 200:
            return keys, ("FAILED", delta, nxt, pages, resets)
        keys |= {(mailbox, i) for i in ids}
        pages, walked = pages + 1, walked + 1
        if next_link:
            nxt = next_link
            if walked >= cap:
                return keys, ("CUT", delta, nxt, pages, resets)
        elif delta_link:
            return keys, ("ADVANCED", delta_link, None, pages, resets)
        else:
            return keys, ("FAILED", delta, nxt, pages, resets)


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_a_plain_walker(spark, seed):
    rnd = random.Random(seed)
    names = [None, "a", "b", "c", "d", "e"]
    boxes = [f"u{i}" for i in range(40)]
    book, links = {}, {}
    for m in boxes:
        for n in names:
            if rnd.random() < 0.95:
                status = rnd.choices([200, 410, 500], [12, 2, 1])[0]
                nxt = rnd.choice(names[1:]) if rnd.random() < 0.75 else None  # links may run in circles
                book[m, n] = (status, [f"m{rnd.randrange(30)}" for _ in range(2)], nxt, rnd.choice([None, "a", "b", "e", "e"]))
        links[m] = (rnd.choice(names), rnd.choice([None, None, *names]))
    pages = [page(m, n, ids, nxt, d, s) for (m, n), (s, ids, nxt, d) in book.items()]
    cap = 3
    for _ in range(2):
        keys, rows = run(spark, pages, boxes, [(m, *l) for m, l in links.items()], cap)
        want = {m: one_by_one(book, m, *links[m], cap) for m in boxes}
        assert keys == sorted(set().union(*(k for k, _ in want.values())))
        got = {m: (r.outcome, r.delta_link, r.next_link, r.pages, r.resets) for m, r in rows.items()}
        assert got == {m: w for m, (_, w) in want.items()}
        links = {m: (r.delta_link, r.next_link) for m, r in rows.items()}
