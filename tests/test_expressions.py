"""Golden values of the scalar rules."""

from datetime import datetime, time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import addresses as ad
from tidemark.functions import calendar as cal
from tidemark.functions import parsing as ps
from tidemark.functions import text as tx
from tidemark.functions import vectors as vec


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_sender_and_name(spark):
    assert column(spark, ["  Alice@Company.com  ", "Bob.Smith+Tasks@Company.com", None, "   "], ad.normalize_sender) == [
        "alice@company.com", "bob.smith+tasks@company.com", None, None,
    ]
    given = ["merchant1@group.example", "  merchant2@group.example  ", "NotAnEmail", None, " ", "@x"]
    assert column(spark, given, ad.name_from_email) == ["merchant1", "merchant2", "notanemail", None, None, "@x"]


def test_domains(spark):
    given = ["a@B.Com", "a@", "nobody", "", None, "a@b@C.d"]
    assert column(spark, given, ad.domain_of) == ["b.com", "unknown", "unknown", "unknown", "unknown", "c.d"]
    assert column(spark, given, lambda c: ad.domain_of(c, missing=None)) == ["b.com", None, None, None, None, "c.d"]
    assert column(spark, given, lambda c: ad.domain_of(c, keep_empty=True))[1] == ""


def test_source_types(spark):
    given = ["own.com", "Gmail.com", "live.com", "else.org", None]
    assert column(spark, given, lambda c: ad.source_class(c, "OWN.com")) == [
        "INTERNAL", "GMAIL", "MICROSOFT", "EXTERNAL", "EXTERNAL",
    ]
    assert column(spark, [" internal ", "External", "GMAIL", None], ad.parse_source_type) == [
        "INTERNAL", "EXTERNAL", None, None,
    ]


def test_automated_senders(spark):
    given = [" No-Reply@x", "me@x", "a.notifications@x", "sam-account-security@x", None]
    assert column(spark, given, ad.is_automated_sender) == [True, False, True, True, False]


def test_recipients(spark):
    df = spark.sql(
        "SELECT array(named_struct('name', 'A', 'address', 'a@x'), named_struct('name', ' ', 'address', 'b@x'),"
        " named_struct('name', 'C', 'address', '')) AS r, array(' A@x', 'a@X ', '', NULL) AS s"
    )
    row = df.select(ad.recipient_display(F.col("r")).alias("r"), ad.address_set(F.col("s")).alias("s")).first()
    assert row.r == ["A <a@x>", "b@x"] and row.s == ["a@x"]


@pytest.mark.parametrize(
    "received, expected",
    [
        ("2026-08-26T10:00:00Z", "2026-08-28 16:00:00"),
        ("2026-08-24T20:00:00Z", "2026-08-27 15:00:00"),
        ("2026-08-22T12:00:00Z", "2026-08-26 15:00:00"),
        ("2026-08-26T09:00:00Z", "2026-08-28 15:00:00"),
        ("2026-08-26T18:00:00Z", "2026-08-31 15:00:00"),
        ("2026-08-26T10:00:30Z", "2026-08-28 16:01:00"),
    ],
)
def test_deadline(spark, received, expected):
    assert column(spark, [received], lambda c: cal.deadline(ps.parse_instant(c)).cast("string")) == [expected]


def walked_deadline(start, hours):
    """Minute-exact walk over the working days, as a check on the arithmetic."""
    from datetime import timedelta

    def roll(c):
        while True:
            if c.weekday() not in hours.weekdays or c.time() >= hours.end:
                c = datetime.combine(c.date() + timedelta(days=1), hours.start)
            elif c.time() < hours.start:
                c = datetime.combine(c.date(), hours.start)
            else:
                return c

    c, rest = roll(start), hours.duration_hours * 60
    while rest:
        left = int((datetime.combine(c.date(), hours.end) - c).total_seconds() // 60)
        if left >= rest:
            return c + timedelta(minutes=rest)
        rest -= left
        c = roll(datetime.combine(c.date() + timedelta(days=1), hours.start))
    return c


@pytest.mark.parametrize(
    "hours",
    [
        cal.WorkingHours(),
        cal.WorkingHours(days=("SUN", "TUESDAY", "Thur"), start=time(8, 30), end=time(12, 15), duration_hours=7),
        cal.WorkingHours(days=("MON", "SAT"), start=time(0), end=time(23, 59), duration_hours=2),
        cal.WorkingHours(days=("WED",), start=time(9), end=time(10), duration_hours=1),
    ],
)
def test_deadline_equals_walk(spark, hours):
    import random
    from datetime import timedelta

    rng = random.Random(7)
    starts = [datetime(2023, 12, 25) + timedelta(seconds=rng.randrange(40 * 86400)) for _ in range(300)]
    starts += [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(0, 200)] + [datetime(1960, 2, 29, 10, 0, 1)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "i int, x timestamp_ntz")
    got = df.orderBy("i").select(cal.deadline(F.col("x").cast("timestamp"), hours).cast("timestamp_ntz")).collect()
    assert [r[0] for r in got] == [walked_deadline(s, hours) for s in starts]


def test_deadline_in_zone(spark):
    hours = cal.WorkingHours(zone="Asia/Kolkata", duration_hours=1)
    got = column(spark, ["2026-08-26T12:00:00Z"], lambda c: cal.deadline(ps.parse_instant(c), hours).cast("string"))
    assert got == ["2026-08-27 04:00:00"]  # 17:30 there, so half an hour moves to the next morning


def test_working_hours_are_checked():
    assert [cal.parse_working_day(d) for d in ("mon", " THURSDAY", "Thur")] == [0, 3, 3]
    for wrong in (dict(days=()), dict(start=time(9), end=time(9)), dict(days=("XYZ",))):
        with pytest.raises(ValueError):
            cal.WorkingHours(**wrong)


def test_times_and_dates(spark):
    given = ["2024-01-02T03:04:05.123456Z", "2024-01-02T03:04+02:00", "2024-01-02T03:04:05", "nonsense", " ", None]
    got = column(spark, given, lambda c: ps.parse_instant(c).cast("string"))
    assert got == ["2024-01-02 03:04:05.123456", "2024-01-02 01:04:00", None, None, None, None]
    boundary = F.lit(datetime(2024, 1, 2, 1, 4)).cast("timestamp")
    assert column(spark, given, lambda c: ps.is_after(c, boundary)) == [True, False, False, False, False, False]
    assert column(spark, ["2026-02-28", "2026-13-01", "2026-2-1", "null"], lambda c: ps.strict_date(c).cast("string")) == [
        "2026-02-28", None, None, None,
    ]
    assert column(spark, ["high", " Critical ", "soon", None], ps.priority_or_medium) == ["HIGH", "CRITICAL", "MEDIUM", "MEDIUM"]
    assert column(spark, [" x ", "NULL", " ", None], ps.text_or_null) == ["x", None, None, None]


def test_delay_minutes(spark):
    pairs = [(0, 119_500_000), (119_500_000, 0), (0, -60_500_000), (0, 59_999_999)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    rows = df.select(ps.whole_minutes(F.timestamp_micros("a"), F.timestamp_micros("b"))).collect()
    assert [r[0] for r in rows] == [1, -2, -1, 0]


def test_fingerprint_keeps_empty_parts(spark):
    import hashlib

    df = spark.sql("SELECT ' Do   IT ' AS title, CAST(NULL AS STRING) AS description, DATE '2024-05-06' AS due_date,"
                   " 'HIGH' AS priority, CAST(NULL AS STRING) AS assignee, ' A@x ' AS assignee_email")
    got = df.select(tx.task_fingerprint()).first()[0]
    assert got == hashlib.md5(b"do it||2024-05-06|HIGH||a@x").hexdigest()


def test_search_tokens():
    assert tx.search_tokens("  Audit, audit x_yz Ünï 42!") == ["audit", "yz", "ünï", "42"]
    assert tx.search_tokens(" - a ") == [] and tx.search_tokens("  ") is None


def test_clean_reply(spark):
    given = ["```json\n{\"a\":1}\n```", "Sure [1] ok", "{\"a\":", "```\nhi\n```", " plain "]
    assert column(spark, given, ps.clean_reply) == ['{"a":1}', "[1]", '{"a":', "hi", "plain"]


def test_verdicts(spark):
    given = [
        '{"result":"SAME","reason":"same intent"}', '```json\n{"result":" ambiguous "}\n```', "this is not json at all {{{",
        '{"reason":"x"}', '{"result":"MAYBE"}', " ",
    ]
    got = column(spark, given, lambda c: ps.read_verdict(c, F.lit("stop")))
    assert [(r.outcome, r.verdict) for r in got] == [
        ("VERDICT", "SAME"), ("VERDICT", "AMBIGUOUS"), ("MALFORMED", None), ("MALFORMED", None), ("MALFORMED", None),
        ("UNAVAILABLE", None),
    ]
    assert got[0].reason == "same intent"
    assert column(spark, given[:1], lambda c: ps.read_verdict(c, F.lit("length")))[0].outcome == "MALFORMED"


@pytest.mark.parametrize(
    "kind, http, message, expected",
    [
        ("http", 404, "no healthy deployment", "NON_RETRYABLE"),
        ("http", 429, "slow down", "TRANSIENT"),
        ("http", 429, "No Fallback Model Group Found", "UNAVAILABLE"),
        ("http", 503, None, "TRANSIENT"),
        (None, None, None, "TRANSIENT"),
        ("verification_malformed", None, "all deployments unhealthy", "NON_RETRYABLE"),
        ("provider_unavailable", 404, "x", "UNAVAILABLE"),
    ],
)
def test_failure_category(spark, kind, http, message, expected):
    df = spark.createDataFrame([(kind, http, message)], "k string, h int, m string")
    assert df.select(ps.failure_category(F.col("k"), F.col("h"), F.col("m"))).first()[0] == expected


def test_retry_after(spark):
    assert column(spark, [" 120 ", "0", "-4", "Wed, 21 Oct", None], ps.retry_after_seconds) == [120, None, None, None, None]


def test_cosine(spark):
    df = spark.sql("SELECT array(1.0D, 0.0D) a, array(1.0D, 1.0D) b, array(0.0D, 0.0D) z, array(1.0D) s")
    row = df.select(vec.cosine(F.col("a"), F.col("b")).alias("x"), vec.cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert abs(row.x - 0.5**0.5) < 1e-12 and row.y == 0.0
    assert df.select(vec.cosine(F.col("a"), F.col("s"))).first()[0] is None
    with pytest.raises(Exception, match="differ in size"):
        df.select(vec.cosine(F.col("a"), F.col("s"), strict=True)).collect()


def test_html(spark):
    html = "<html><head><title>t</title></head><body><p>a<b>b</b></p>c&nbsp;&amp;lt;<script>x</script><!-- y --></body>"
    assert column(spark, [html], tx.html_to_text) == ["ab c &lt;"]
    kept = column(spark, ['<p class="x" onclick="y">a<img src="z"><a id="q" href="u">l</a></p>'], tx.html_allow_list)
    assert kept == ['<p>a<a href="u">l</a></p>']


def test_clipping(spark):
    assert column(spark, ["x" * 20], lambda c: tx.clip_body(c, 5)) == ["xxxxx" + tx.BODY_MARKER]
    assert column(spark, ["x" * 20, " ", None], lambda c: tx.clip_error(c, F.lit("Kind"), 3)) == ["xxx", "Kin", "Kin"]


PAGES = {
    "<ul><li>one<li>two</ul><p>three</p>": ("one two three", "<ul><li>one<li>two</ul><p>three</p>"),
    "<SCRIPT type='x'>if (a<b) {}</SCRIPT>shown<style>p{}</style>": ("shown", "shown"),
    "a<span class=\"c\">b</span>c &lt;d&gt; &amp;amp;": ("abc <d> &amp;", "a<span>b</span>c &lt;d&gt; &amp;amp;"),
    "x<!-- <p>gone</p> -->y": ("xy", "xy"),
    "<div>first<div>second</div>third</div>": ("first second third", None),
    "line<br>break": ("line break", None),
    "": ("", ""),
}


def test_golden_pages(spark):
    pages = list(PAGES)
    assert column(spark, pages, tx.html_to_text) == [t for t, _ in PAGES.values()]
    cleaned = column(spark, pages, tx.html_allow_list)
    for got, (_, want) in zip(cleaned, PAGES.values()):
        assert want is None or got == want
