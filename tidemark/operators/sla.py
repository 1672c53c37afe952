"""Response deadlines: eligibility, opening, reply matching, states, sweeps and reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import address_set, domain_of, sender_domain
from ..functions.calendar import WorkingHours, deadline
from ..functions.parsing import parse_instant, round1, whole_minutes
from ..functions.text import blank_to_null, is_blank, strip
from ..session import cut_lineage
from .tasks import calendar, clamp
from .timeline import first_per_key, hour_of, next_value, running_totals

KEY = ("mailbox_user_id", "message_id")


# -- opening ------------------------------------------------------------------------------------------------------


def own_domains(employees: DataFrame, configured: Sequence[str] = ()) -> DataFrame:
    """Configured domains and the domains of people known to the directory."""
    known = (
        employees.filter(F.col("microsoft_user_id").isNotNull())
        .select(strip(domain_of(F.col("email"), missing=None)).alias("domain"))
        .filter("domain IS NOT NULL")
        .distinct()
    )
    listed = sorted({d.strip().lower() for d in configured if d.strip()})
    if not listed:
        return known
    given = employees.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in listed])).alias("domain"))
    return known.union(given).distinct()


def eligible(mail: DataFrame, domains: DataFrame) -> DataFrame:
    """Mail that needs an answer and comes from a known domain that is not ours; adds ``customer_domain``."""
    given = F.col("sender_domain") if "sender_domain" in mail.columns else F.lit(None).cast("string")
    return (
        mail.withColumn("customer_domain", sender_domain(given, F.col("sender_email")))
        .filter(F.col("response_required") & (F.col("customer_domain") != "unknown"))
        .join(domains.select(F.col("domain").alias("customer_domain")), "customer_domain", "left_anti")
    )


def intelligence(mail: DataFrame, ingested_at: datetime) -> DataFrame:
    """One record per message; an unreadable time becomes the ingestion time."""
    first = first_per_key(mail, KEY, [F.asc("position")])
    return first.select(
        *KEY,
        "conversation_id",
        F.coalesce(parse_instant(F.col("received")), F.lit(ingested_at)).alias("received_at"),
        "sender_name",
        "sender_email",
        "sender_domain",
        "subject",
        F.coalesce("response_required", F.lit(False)).alias("response_required"),
        F.coalesce("requires_action", F.lit(False)).alias("requires_action"),
    )


def open_slas(
    mail: DataFrame, domains: DataFrame, existing: DataFrame | None = None, hours: WorkingHours = WorkingHours()
) -> DataFrame:
    """New WAITING rows for eligible messages that have no row yet."""
    received = mail.withColumn("received_at", parse_instant(F.col("received"))).filter("received_at IS NOT NULL")
    fresh = first_per_key(eligible(received, domains), KEY, [F.asc("position")])
    if existing is not None:
        fresh = fresh.join(existing.select(*KEY), list(KEY), "left_anti")
    return fresh.select(
        F.concat_ws("/", *KEY).alias("sla_id"),
        *KEY,
        "conversation_id",
        F.col("sender_email").alias("customer_email"),
        "customer_domain",
        "subject",
        "received_at",
        deadline(F.col("received_at"), hours).alias("sla_deadline_at"),
    )


# -- reply matching -----------------------------------------------------------------------------------------------


def _primary(slas: DataFrame, replies: DataFrame, bucket: Column) -> DataFrame:
    """Earliest reply in the message's conversation and mailbox that names the customer, per SLA.

    An as-of join looking forward over (conversation, mailbox, address): no pairs of messages and replies arise.
    """
    keys = ["conversation_id", "mailbox", "address"]
    none = F.lit(None).cast("string")
    waiting = slas.select(
        "conversation_id",
        F.col("mailbox_user_id").alias("mailbox"),
        F.lower(strip(F.col("customer_email"))).alias("address"),
        F.col("received_at").alias("moment"),
        F.lit(1).alias("phase"),
        "sla_id",
        none.alias("reply_id"),
    )
    answers = replies.select(
        "conversation_id",
        "mailbox",
        F.explode("recipients").alias("address"),
        F.col("sent_at").alias("moment"),
        F.lit(0).alias("phase"),  # a reply at the very moment of the message does not answer it
        none.alias("sla_id"),
        "reply_id",
    )
    timeline = waiting.unionByName(answers).dropna(subset=keys)
    reply = F.when(
        F.col("reply_id").isNotNull(),
        F.struct(F.col("moment").alias("sent_at"), "reply_id", F.col("mailbox").alias("responded_by")),
    )
    found = next_value(timeline, keys, bucket, ["moment", "phase", "reply_id"], reply, "answer")
    return found.filter("sla_id IS NOT NULL AND answer IS NOT NULL").select("sla_id", F.col("answer").alias("primary"))


_ORDER = ("us", "phase", "by", "step")
_FIELDS = ("lookup", "segment", "us", "phase", "by", "step", "sla_id", "conversation_id", "message_id", "mailbox")
_LOOK = "reply_id string, lookup string, us bigint, mailbox string, own_open bigint, own_talk bigint, sla_id string"


def _events(slas: DataFrame, replies: DataFrame) -> DataFrame:
    """Every customer's timeline: openings, closings by the conversation's own answer, and replies that name them.

    At one moment openings come first, then each reply followed by what it closes.
    """
    known = slas.filter("lookup IS NOT NULL")
    about = ["sla_id", "conversation_id", "message_id"]
    nothing = [F.lit(None).cast("string").alias(c) for c in about]
    opened = known.select(
        "lookup", F.unix_micros("received_at").alias("us"), F.lit(0).alias("phase"), F.lit("").alias("by"), F.lit(0).alias("step"),
        *about, F.lit(None).cast("string").alias("mailbox"),
    )
    closed = known.filter("primary IS NOT NULL").select(
        "lookup", F.unix_micros("primary.sent_at").alias("us"), F.lit(1).alias("phase"), F.col("primary.reply_id").alias("by"),
        F.lit(1).alias("step"), *about, F.lit(None).cast("string").alias("mailbox"),
    )
    asked = replies.select(
        F.explode("recipients").alias("lookup"), F.unix_micros("sent_at").alias("us"), F.lit(1).alias("phase"),
        F.col("reply_id").alias("by"), F.lit(0).alias("step"), nothing[0], "conversation_id", nothing[2], "mailbox",
    )
    return opened.unionByName(closed).unionByName(asked)


def _crowded(fixed: DataFrame, events: DataFrame) -> DataFrame:
    """(lookup, crowded): the moment after which a customer has two or more messages open for good.

    A message that its conversation never answers is closed by a fallback only, and that needs to be the only open one. So
    two such messages with no reply to the customer from the first up to the second stay open for ever.
    """
    never = fixed.filter("lookup IS NOT NULL AND primary IS NULL")
    points = never.select("lookup", F.unix_micros("received_at").alias("us"), F.lit(1).alias("opens"), "message_id").unionByName(
        events.filter("phase = 1 AND step = 0").select("lookup", "us", F.lit(0).alias("opens"), F.lit(None).cast("string").alias("message_id"))
    )
    ahead = next_value(points, ["lookup"], _hour("us"), ["us", "opens", "message_id"], F.struct("us", "opens", "message_id"), "ahead")
    pairs = ahead.filter("opens = 1 AND ahead.opens = 1 AND ahead.message_id <> message_id")
    return pairs.groupBy("lookup").agg(F.min("ahead.us").alias("crowded"))


def _hour(us: str) -> Column:
    return F.floor(F.col(us) / 3_600_000_000).cast("bigint")


def _segments(events: DataFrame) -> DataFrame:
    """Number the stretches of every customer's timeline between the moments when nothing can be open.

    Whatever fallbacks do, an SLA is open no longer than to its conversation's own answer. Where openings less these
    closings are zero, the replay starts afresh: the stretches are independent, and a busy customer is many of them.
    """
    order = [F.asc(c) for c in (*_ORDER, "sla_id")]
    change = F.when(F.col("phase") == 0, 1).when(F.col("step") == 1, -1).otherwise(0).cast("bigint")
    counted = running_totals(events, ["lookup"], _hour("us"), order, sums={"_open": change})
    clear = (F.col("_open") == 0).cast("bigint")
    numbered = running_totals(counted, ["lookup"], _hour("us"), order, sums={"_clear": clear})
    return numbered.withColumn("segment", F.col("_clear") - clear).drop("_open", "_clear")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay the timelines, one stretch after the other, holding only the open messages of the current one.

    A reply may use the fallback if no open SLA shares its conversation, and then answers the only open message of all
    customers it names, if there is exactly one. What others have open at that moment comes with the reply.
    """
    stretch: tuple[str, int] | None = None
    waiting: dict[str, tuple] = {}  # open SLA: (received, conversation, message)
    talks: dict[str | None, int] = {}
    messages: dict[str, int] = {}

    def add(table: dict, key, change: int) -> None:
        left = table.get(key, 0) + change
        if left:
            table[key] = left
        else:
            table.pop(key, None)

    def close(sla_id: str) -> None:
        if (held := waiting.pop(sla_id, None)) is not None:
            add(talks, held[1], -1)
            add(messages, held[2], -1)

    for batch in batches:
        out = []
        columns = (batch.column(c).to_pylist() for c in (*_FIELDS, "other_open", "other_talk"))
        for who, segment, us, phase, by, step, sla_id, talk, message, mailbox, other_open, other_talk in zip(*columns, strict=True):
            if (who, segment) != stretch:
                stretch = who, segment
                for table in (waiting, talks, messages):
                    table.clear()
            if phase == 0:
                waiting[sla_id] = (us, talk, message)
                add(talks, talk, 1)
                add(messages, message, 1)
            elif step == 1:
                close(sla_id)
            else:
                # messages of this very moment are open for the conversation but cannot be answered yet
                fresh = [v[2] for v in waiting.values() if v[0] >= us] if len(messages) <= 2 else []
                old = {m for m in messages if messages[m] > fresh.count(m)} if fresh else messages
                own_open, own_talk = len(old), talks.get(talk, 0) if talk is not None else 0
                hit = None
                if own_open == 1 and not other_open and not own_talk and not other_talk:
                    (only,) = old
                    hit = max((v[0], k) for k, v in waiting.items() if v[2] == only and v[0] < us)[1]
                    close(hit)
                out.append((by, who, us, mailbox, own_open, own_talk, hit))
        if out:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["reply_id", "lookup", "us", "mailbox", "own_open", "own_talk", "sla_id"],
            )


def _shared(fixed: DataFrame, replies: DataFrame) -> DataFrame:
    """Conversations that are not one customer's alone: only they can hold somebody else's message."""
    talked = fixed.select("conversation_id", "lookup").unionByName(replies.select("conversation_id", F.explode("recipients").alias("lookup")))
    return (
        talked.dropna(subset=["conversation_id"])
        .groupBy("conversation_id")
        .agg(F.min(F.coalesce("lookup", F.lit(""))).alias("a"), F.max(F.coalesce("lookup", F.lit(""))).alias("b"))
        .filter("a <> b")
        .select("conversation_id")
    )


def _elsewhere(
    looks: DataFrame, known: DataFrame, answers: DataFrame, crowd: DataFrame | None = None, late: DataFrame | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """(by, lookup, other_open, other_talk): what else is open at each reply, given the closings of this round.

    ``other_open`` counts the messages of the other customers it names, ``other_talk`` the SLAs of others in its
    conversation: the conversation's running count, in hourly buckets, less the customer's own. ``known`` and ``answers`` are the
    SLAs and replies of shared conversations. ``crowd`` names the customers some of whose replies, ``late``, come without their
    own part of the conversation; ``asked`` are those of them in a shared one.
    """
    everyone = looks if late is None else looks.unionByName(late)
    named = everyone.groupBy("reply_id").agg(F.sum("own_open").alias("all_open"), F.count(F.lit(1)).alias("n"))
    keys = ["conversation_id"]
    nobody = F.lit(None).cast("string")

    def point(rows: DataFrame, moment: str, phase: int, by: Column, step: int, change: int, reply: Column) -> DataFrame:
        return rows.select(
            *keys, F.col(moment).alias("moment"), F.lit(phase).alias("phase"), by.alias("by"), F.lit(step).alias("step"),
            F.lit(change).cast("bigint").alias("change"), reply.alias("reply_id"),
        )

    events = (
        point(known, "received_at", 0, F.lit(""), 0, 1, nobody)
        .unionByName(point(known.filter("closed IS NOT NULL"), "closed.sent_at", 1, F.col("closed.reply_id"), 1, -1, nobody))
        .unionByName(point(answers, "sent_at", 1, F.col("reply_id"), 0, 0, F.col("reply_id")))
    )
    order = [F.asc(c) for c in ("moment", "phase", "by", "step")]
    counted = running_totals(events, keys, hour_of(F.col("moment")), order, sums={"all_talk": F.col("change")})
    talk = counted.filter("reply_id IS NOT NULL").select("reply_id", "all_talk")
    if crowd is not None:  # replies to crowded customers were not replayed: their own part of the conversation is counted here
        own = known.join(crowd, "lookup")
        parts = {
            "received_at": (own, 0, F.lit(""), 0, 1, nobody),
            "closed.sent_at": (own.filter("closed IS NOT NULL"), 1, F.col("closed.reply_id"), 1, -1, nobody),
            "sent_at": (asked, 1, F.col("reply_id"), 0, 0, F.col("reply_id")),
        }
        keys = [*keys, "lookup"]
        mine = reduce(lambda a, b: a.unionByName(b), [point(rows, moment, *rest) for moment, (rows, *rest) in parts.items()])
        alone = running_totals(mine, keys, hour_of(F.col("moment")), order, sums={"mine": F.col("change")}).filter("reply_id IS NOT NULL")
        late = late.join(alone.select("reply_id", "lookup", "mine"), ["reply_id", "lookup"], "left")
        late = late.withColumn("own_talk", F.coalesce("own_talk", "mine", F.lit(0))).drop("mine")
        everyone = looks.unionByName(late)
    joined = everyone.join(named.filter("n > 1"), "reply_id", "left").join(talk, "reply_id", "left")
    other_open = F.coalesce(F.col("all_open") - F.col("own_open"), F.lit(0))
    other_talk = F.coalesce(F.col("all_talk") - F.col("own_talk"), F.lit(0))
    return joined.select(F.col("reply_id").alias("by"), "lookup", other_open.alias("other_open"), other_talk.alias("other_talk"))


def match_replies(slas: DataFrame, replies: DataFrame) -> DataFrame:
    """First answer of every SLA, exactly as if replies were handled one by one in the order they were sent.

    Columns: ``sla_id, first_response_at, response_message_id, responded_by, fallback``. Answers within a message's own
    conversation are an as-of lookup. A fallback answer changes which messages later replies find open: each customer's
    timeline is replayed in one pass, so chains of messages and answers settle at once however long they are. A timeline
    is cut wherever nothing can be open, and ends where two messages are open for good, so that a busy customer is many
    small pieces of work; only a customer that never answers and is never crowded has long ones. What one
    customer's replies depend on elsewhere (other customers named in them, or others' messages in the conversation) is
    taken from the round before; rounds end when that no longer changes, so their number follows the chains that cross
    customers, not the length of anyone's history. Each round is written to the shared folder.
    """
    cleaned = replies.select(
        "reply_id",
        "mailbox",
        blank_to_null(F.col("conversation_id")).alias("conversation_id"),
        "sent_at",
        address_set(F.col("recipients")).alias("recipients"),
    ).filter("sent_at IS NOT NULL")
    base = slas.select(
        "sla_id",
        "message_id",
        "mailbox_user_id",
        blank_to_null(F.col("conversation_id")).alias("conversation_id"),
        F.lower("customer_email").alias("lookup"),
        "customer_email",
        "received_at",
    )
    cleaned, base = cut_lineage(cleaned), cut_lineage(base)
    fixed = cut_lineage(base.join(_primary(base, cleaned, hour_of(F.col("moment"))), "sla_id", "left").drop("customer_email"))
    timeline = cut_lineage(_events(fixed, cleaned))
    crowd = cut_lineage(_crowded(fixed, timeline))
    shared = cut_lineage(_shared(fixed, cleaned))
    # what rounds do not change is joined together once
    known = cut_lineage(fixed.join(shared, "conversation_id", "left_semi").select("sla_id", "conversation_id", "lookup", "received_at", "primary"))
    answers = cut_lineage(cleaned.join(shared, "conversation_id", "left_semi").select("reply_id", "conversation_id", "sent_at"))
    late = asked = None
    if crowd.isEmpty():
        crowd, events = None, timeline
    else:
        # beyond that moment no fallback is possible and other customers need to know only that something is open
        marked = timeline.join(crowd, "lookup", "left")
        events = marked.filter("crowded IS NULL OR us <= crowded").drop("crowded")
        two, none = F.lit(2).cast("bigint"), F.lit(None)
        beyond = marked.filter("us > crowded AND phase = 1 AND step = 0").select(
            F.col("by").alias("reply_id"), "lookup", "us", "mailbox", two.alias("own_open"), none.cast("bigint").alias("own_talk"), none.cast("string").alias("sla_id")
        )
        late = cut_lineage(beyond)
        asked = cut_lineage(late.select("reply_id", "lookup").join(answers, "reply_id"))
        crowd = crowd.select("lookup")
    events = cut_lineage(_segments(events))
    elsewhere, before = None, _marks()
    while True:
        if elsewhere is None:
            told = events.withColumns({"other_open": F.lit(0).cast("bigint"), "other_talk": F.lit(0).cast("bigint")})
        else:
            busy = elsewhere.filter("other_open <> 0 OR other_talk <> 0")
            told = events.join(busy, ["by", "lookup"], "left").na.fill(0, ["other_open", "other_talk"])
        ordered = told.repartition("lookup", "segment").sortWithinPartitions("lookup", "segment", *_ORDER)
        looks = cut_lineage(ordered.select(*_FIELDS, "other_open", "other_talk").mapInArrow(_fold, _LOOK))
        answer = F.struct(F.timestamp_micros("us").alias("sent_at"), "reply_id", F.col("mailbox").alias("responded_by"))
        hits = looks.filter("sla_id IS NOT NULL").groupBy("sla_id").agg(F.min(answer).alias("fallback"))
        closed = F.least("primary", "fallback")
        elsewhere = cut_lineage(_elsewhere(looks, known.join(hits, "sla_id", "left").withColumn("closed", closed), answers, crowd, late, asked))
        if (now := _marks(elsewhere)) == before:
            break
        before = now
    state = fixed.join(hits, "sla_id", "left").withColumn("closed", closed)
    first = F.col("closed")
    return state.filter(first.isNotNull()).select(
        "sla_id",
        first["sent_at"].alias("first_response_at"),
        first["reply_id"].alias("response_message_id"),
        first["responded_by"].alias("responded_by"),
        F.coalesce(F.col("primary").isNull() | (F.col("fallback") < F.col("primary")), F.lit(False)).alias("fallback"),
    )


def _marks(elsewhere: DataFrame | None = None) -> tuple:
    """Count and sum of hashes of what a round finds open elsewhere; nothing open is the same as not being there."""
    if elsewhere is None:
        return 0, None
    kept = elsewhere.filter("other_open <> 0 OR other_talk <> 0")
    return tuple(kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*kept.columns).cast("decimal(38,0)"))).first())


# -- states -------------------------------------------------------------------------------------------------------


def sla_status(as_of: Column) -> Column:
    """State as a function of event times. An answer at the deadline is in time; a late one stays BREACHED."""
    answered, due = F.col("first_response_at"), F.col("sla_deadline_at")
    return (
        F.when(answered.isNull(), F.when(due < as_of, "BREACHED").otherwise("WAITING"))
        .when(answered > due, "BREACHED")
        .otherwise("COMPLETED")
    )


def with_answers(slas: DataFrame, answers: DataFrame, as_of: datetime) -> DataFrame:
    found = answers.select("sla_id", "first_response_at", "response_message_id", "responded_by")
    return slas.join(found, "sla_id", "left").withColumn("status", sla_status(F.lit(as_of)))


def sweep_breaches(slas: DataFrame, as_of: datetime) -> DataFrame:
    """WAITING rows past their deadline, now BREACHED."""
    return slas.filter((F.col("status") == "WAITING") & (F.col("sla_deadline_at") < F.lit(as_of))).withColumn(
        "status", F.lit("BREACHED")
    )


def record_first_response(slas: DataFrame, responses: DataFrame) -> DataFrame:
    """Stored rows after a batch of answers: only a first answer counts and a breach is never undone."""
    first = responses.groupBy("sla_id").agg(
        F.min(F.struct("sent_at", "reply_id", "responded_by")).alias("_answer")
    )
    joined = slas.join(first, "sla_id", "left")
    now = F.col("_answer").isNotNull() & F.col("first_response_at").isNull()
    late = F.col("_answer.sent_at") > F.col("sla_deadline_at")
    return joined.withColumns(
        {
            "status": F.when(
                now, F.when((F.col("status") == "BREACHED") | late, "BREACHED").otherwise("COMPLETED")
            ).otherwise(F.col("status")),
            "response_message_id": F.when(now, F.col("_answer.reply_id")).otherwise(F.col("response_message_id")),
            "responded_by": F.when(now, F.col("_answer.responded_by")).otherwise(F.col("responded_by")),
            "first_response_at": F.when(now, F.col("_answer.sent_at")).otherwise(F.col("first_response_at")),
        }
    ).drop("_answer")


# -- reports ------------------------------------------------------------------------------------------------------


def _counts() -> list[Column]:
    s = F.col("status")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "COMPLETED").alias("completed"),
        F.count_if(s == "WAITING").alias("waiting"),
        F.count_if(s == "BREACHED").alias("breached"),
    ]


def _between(first: date, last: date) -> Column:
    low = datetime.combine(first, datetime.min.time())
    high = datetime.combine(last + timedelta(days=1), datetime.min.time())
    return (F.col("received_at") >= F.lit(low)) & (F.col("received_at") < F.lit(high))


def sla_summary(slas: DataFrame, day: date) -> DataFrame:
    rate = F.when(F.col("total") > 0, round1(F.col("completed") * 100.0 / F.col("total")))
    return (
        slas.filter(_between(day, day))
        .agg(*_counts())
        .select(F.lit(day).alias("day"), "*", rate.alias("compliance_rate"))
    )


def sla_trend(slas: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    days = clamp(days, 1, 90)
    counted = (
        slas.filter(_between(as_of - timedelta(days=days - 1), as_of))
        .groupBy(F.to_date("received_at").alias("day"))
        .agg(*_counts())
    )
    names = ("total", "completed", "waiting", "breached")
    return (
        calendar(slas.sparkSession, as_of, days)
        .join(counted, "day", "left")
        .select("day", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])
    )


def delay_minutes() -> Column:
    return whole_minutes(F.col("sla_deadline_at"), F.col("first_response_at"))


def breached(slas: DataFrame, first: date | None = None, last: date | None = None, mailbox: str | None = None) -> DataFrame:
    rows = slas.filter("status = 'BREACHED'")
    if first is not None:
        rows = rows.filter(F.col("received_at") >= F.lit(datetime.combine(first, datetime.min.time())))
    if last is not None:
        rows = rows.filter(F.col("received_at") < F.lit(datetime.combine(last + timedelta(days=1), datetime.min.time())))
    if mailbox is not None and mailbox.strip():
        rows = rows.filter(F.col("mailbox_user_id") == mailbox.strip())
    return rows.select(
        "sla_id", "customer_email", "customer_domain", "subject", "received_at", "sla_deadline_at", "first_response_at",
        delay_minutes().alias("delay_minutes"), "status", "responded_by",
    ).orderBy(F.desc("received_at"), F.asc("sla_id"))


# -- customer domains ---------------------------------------------------------------------------------------------


def customer_domains(commands: DataFrame) -> DataFrame:
    """Domain list folded from its commands (``add``, ``remove``): the last one decides; blank domains are refused."""
    domain = F.lower(F.trim("domain"))
    last = (
        commands.filter(~is_blank(F.col("domain")))
        .groupBy(domain.alias("domain"))
        .agg(
            F.max_by("action", F.struct("at", "id")).alias("_action"),
            F.count_if(F.col("action") == "add").alias("_added"),
        )
        .filter("_added > 0")  # removing what was never added does nothing
    )
    return last.select("domain", (F.col("_action") == "add").alias("active"))


def from_active_domains(mail: DataFrame, domains: DataFrame) -> DataFrame:
    listed = domains.filter("active").select(F.col("domain").alias("_domain"))
    return mail.withColumn("_domain", F.lower(F.trim("sender_domain"))).join(listed, "_domain", "left_semi").drop("_domain")
