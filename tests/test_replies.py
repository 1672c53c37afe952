"""Reply matching against a one-by-one replay, on random small mailboxes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sla

START = datetime(2026, 8, 26, 10)
SLA = "sla_id string, mailbox_user_id string, message_id string, conversation_id string, customer_email string, received_at timestamp"
SENT = "reply_id string, mailbox string, conversation_id string, sent_at timestamp, recipients array<string>"


def replay(slas, replies):
    answered = {}
    for reply_id, mailbox, conversation, sent, recipients in sorted(replies, key=lambda r: (r[3], r[0])):
        named = {a.strip().lower() for a in recipients or [] if a and a.strip()}
        present = [s for s in slas if s[5] <= sent and s[0] not in answered]
        talk = [s for s in present if conversation and conversation.strip() and s[3] == conversation]
        if talk:
            hits = [s for s in talk if s[1] == mailbox and s[5] < sent and s[4].strip().lower() in named]
        else:
            found = {s[2]: s for s in sorted(present, key=lambda s: (s[5], s[0])) if s[5] < sent and s[4].lower() in named}
            hits = list(found.values()) if len(found) == 1 else []
        for s in hits:
            answered[s[0]] = (sent, reply_id, mailbox, not talk)
    return answered


def matched(spark, slas, replies):
    a = spark.createDataFrame(slas, SLA)
    b = spark.createDataFrame(replies, SENT)
    rows = sla.match_replies(a, b).collect()
    return {r.sla_id: (r.first_response_at, r.response_message_id, r.responded_by, r.fallback) for r in rows}


def mailboxes(seed, customers, talks, n):
    rng = random.Random(seed)
    slas, replies = [], []
    for i in range(n):
        moment = START + timedelta(minutes=rng.randrange(n * 3))
        box = f"b{rng.randrange(2)}"
        talk = rng.choice([None, " ", *[f"c{t}" for t in range(talks)], f"own{i}"])
        if rng.random() < 0.45:
            slas.append((f"{box}/m{i}", box, f"m{i}", talk, f"Cust{rng.randrange(customers)}@X.example", moment))
        else:
            named = [rng.choice(["cust{}@x.example", " CUST{}@x.example"]).format(rng.randrange(customers)) for _ in range(rng.randrange(1, 4))]
            replies.append((f"r{i:03d}", box, talk, moment, [*named, None, ""]))
    return slas, replies


@pytest.mark.parametrize("seed, customers, talks, n", [(1, 3, 2, 60), (2, 6, 4, 150), (3, 25, 3, 150)])
def test_equals_replay(spark, seed, customers, talks, n):
    slas, replies = mailboxes(seed, customers, talks, n)
    assert matched(spark, slas, replies) == replay(slas, replies)


@pytest.mark.parametrize("seed, customers, talks, n", [(4, 2, 1, 120), (6, 60, 40, 260), (7, 40, 3, 260), (8, 4, 6, 200)])
def test_copies_in_several_mailboxes_equal_replay(spark, seed, customers, talks, n):
    slas, replies = mailboxes(seed, customers, talks, n)
    rng = random.Random(seed)
    copies = []
    for _, box, message, talk, customer, moment in slas:
        if rng.random() < 0.4:
            other = f"b{rng.randrange(2, 4)}"
            copies.append((f"{other}/{message}", other, message, rng.choice([talk, None]), customer, moment + timedelta(minutes=rng.choice([0, 0, 7]))))
    assert matched(spark, slas + copies, replies) == replay(slas + copies, replies)


def test_open_copy_is_answered_after_the_closed_one(spark):
    slas = [("b0/m", "b0", "m", None, "a@x", START), ("b1/m", "b1", "m", "c1", "a@x", START + timedelta(minutes=1))]
    replies = [("r1", "b1", "c1", START + timedelta(hours=1), ["a@x"]), ("r2", "b0", None, START + timedelta(hours=2), ["a@x"])]
    assert matched(spark, slas, replies) == replay(slas, replies)
    assert matched(spark, slas, replies)["b0/m"][1] == "r2"


@pytest.mark.parametrize("pairs", [2, 200])
def test_long_histories_take_as_many_rounds_as_short_ones(spark, monkeypatch, pairs):
    rounds = []
    real = sla._elsewhere
    monkeypatch.setattr(sla, "_elsewhere", lambda *a: (rounds.append(1), real(*a))[1])
    slas, replies = [], []
    for k in range(pairs):
        for c in range(2):
            slas.append((f"b0/m{k}-{c}", "b0", f"m{k}-{c}", None, f"cust{c}@x", START + timedelta(minutes=2 * k)))
            replies.append((f"r{k:04d}-{c}", "b0", None, START + timedelta(minutes=2 * k + 1), [f"cust{c}@x"]))
    assert matched(spark, slas, replies) == replay(slas, replies)
    assert len(rounds) == 1


def hot_mailbox(seed, n, never):
    """Nine rows in ten of one customer; ``never``: share of messages outside any conversation that answers them."""
    rng = random.Random(seed)
    slas, replies = [], []
    for i in range(n):
        who = 0 if rng.random() < 0.9 else rng.randrange(1, 4)
        moment = START + timedelta(minutes=10 * i)
        talk = rng.choice([None, f"own{i}", f"c{rng.randrange(3)}"])
        slas.append((f"b0/m{i}", "b0", f"m{i}", talk, f"cust{who}@x", moment))
        if rng.random() >= never:
            replies.append((f"r{i}", "b0", rng.choice([talk, talk, None]), moment + timedelta(minutes=rng.choice([0, 3, 8, 25])), [f"cust{who}@x"] + ([f"cust{rng.randrange(4)}@x"] if rng.random() < 0.3 else [])))
        elif rng.random() < 0.5:
            replies.append((f"r{i}", "b1", rng.choice([None, "c0", "c1"]), moment + timedelta(minutes=rng.choice([0, 4])), [f"cust{who}@x", "cust1@x"]))
    return slas, replies


@pytest.mark.parametrize("seed, never", [(22, 0.05), (23, 0.5)])
def test_hot_customer_is_many_pieces(spark, monkeypatch, seed, never):
    sizes = []
    real = sla._segments

    def seen(events):
        found = real(events)
        sizes.extend(r["count"] for r in found.groupBy("lookup", "segment").count().collect())
        return found

    monkeypatch.setattr(sla, "_segments", seen)
    slas, replies = hot_mailbox(seed, 300, never)
    assert matched(spark, slas, replies) == replay(slas, replies)
    assert max(sizes) < 0.15 * (len(slas) + len(replies))


def test_a_reply_at_the_moment_of_the_second_message_may_answer_the_first(spark):
    later = START + timedelta(hours=1)
    slas = [("b0/m", "b0", "m", None, "a@x", START), ("b0/n", "b0", "n", None, "a@x", later), ("b0/o", "b0", "o", None, "a@x", later + timedelta(hours=1))]
    replies = [("r1", "b0", None, later, ["a@x"]), ("r2", "b0", None, later + timedelta(minutes=1), ["a@x"]), ("r3", "b0", None, later + timedelta(hours=2), ["a@x"])]
    got = matched(spark, slas, replies)
    assert got == replay(slas, replies) and len(got) == 3


def test_order_of_rows_does_not_matter(spark):
    slas, replies = mailboxes(5, 4, 2, 80)
    expected = matched(spark, slas, replies)
    random.Random(0).shuffle(slas)
    random.Random(1).shuffle(replies)
    assert matched(spark, slas, replies) == expected


def one(spark, reply, received=START, customer="customer@external.com", talk="c1"):
    slas = [("b0/m", "b0", "m", talk, customer, received)]
    return matched(spark, slas, [reply])


def test_life_cycle(spark):
    to = ["customer@external.com"]
    later = START + timedelta(hours=23)
    assert one(spark, ("r", "b0", "c1", later, to))["b0/m"][1] == "r"
    assert one(spark, ("r", "b1", "c1", later, to)) == {}  # another mailbox in the conversation
    assert one(spark, ("r", "b0", "c1", later, ["else@x"])) == {}
    assert one(spark, ("r", "b1", "c9", later, [" CUSTOMER@external.com"]))["b0/m"][3] is True
    assert one(spark, ("r", "b0", "c1", START, to)) == {}  # not after the message
    two = [("b0/m", "b0", "m", "c1", to[0], START), ("b0/n", "b0", "n", "c2", to[0], START)]
    assert matched(spark, two, [("r", "b0", "c9", later, to)]) == {}


def test_copies_of_one_message_are_one_candidate(spark):
    copies = [("b0/m", "b0", "m", None, "a@x", START), ("b1/m", "b1", "m", None, "a@x", START)]
    assert len(matched(spark, copies, [("r", "b0", None, START + timedelta(hours=1), ["a@x"])])) == 1


def test_states(spark):
    deadline = START + timedelta(days=2)
    rows = [("a", None, deadline), ("b", deadline, deadline), ("c", deadline + timedelta(seconds=1), deadline), ("d", None, deadline + timedelta(days=9))]
    df = spark.createDataFrame(rows, "id string, first_response_at timestamp, sla_deadline_at timestamp")
    status = sla.sla_status(F.lit(deadline + timedelta(days=1)))
    assert [r[0] for r in df.orderBy("id").select(status).collect()] == ["BREACHED", "COMPLETED", "BREACHED", "WAITING"]


def test_eligibility(spark):
    people = spark.createDataFrame([("e@contoso.com", "ms-1"), ("e@other.com", None)], "email string, microsoft_user_id string")
    domains = sla.own_domains(people, ["contoso.onmicrosoft.com"])
    mail = spark.createDataFrame(
        [("1", "a@external.com", False), ("2", "a@contoso.onmicrosoft.com", True), ("3", "a@contoso.com", True),
         ("4", "nobody", True), ("5", "customer@external.com", True), ("6", "a@other.com", True)],
        "id string, sender_email string, response_required boolean",
    )
    assert sorted(r.id for r in sla.eligible(mail, domains).collect()) == ["5", "6"]


def test_rounds_share_what_they_do_not_change(spark, monkeypatch):
    given = []
    real = sla._elsewhere
    monkeypatch.setattr(sla, "_elsewhere", lambda *a: (given.append(a), real(*a))[1])
    slas, replies = mailboxes(7, 40, 3, 260)
    assert matched(spark, slas, replies) == replay(slas, replies)
    assert len(given) > 1
    assert len({id(a[2]) for a in given}) == 1  # the replies of shared conversations are found once, not in every round
