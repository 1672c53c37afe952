"""The chain of decisions over a batch against a replay that takes one task after the other."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import dedup
from tidemark.operators.timeline import hour_of

NOW = datetime(2024, 5, 1, 9)
COLUMNS = "id bigint, source_email_id string, source_mailbox string, normalized_sender string, assignee_key string, task_fingerprint string, status string, created_at timestamp"
BLOCK = ["source_mailbox", "normalized_sender", "assignee_key"]


def answer(new, other):
    n = new * 31 + other * 17
    return ("UNAVAILABLE", "MALFORMED", "VERDICT", "VERDICT", "VERDICT", "VERDICT")[n % 6], ("SAME", "DIFFERENT", "AMBIGUOUS")[n % 3], f"because {n}"


def verdicts(scored):
    n = F.col("new_id") * 31 + F.col("candidate_id") * 17
    outcomes = F.array(*map(F.lit, ("UNAVAILABLE", "MALFORMED", "VERDICT", "VERDICT", "VERDICT", "VERDICT")))
    names = F.array(*map(F.lit, ("SAME", "DIFFERENT", "AMBIGUOUS")))
    return scored.select(
        "new_id", "candidate_id", F.get(outcomes, (n % 6).cast("int")).alias("outcome"), F.get(names, (n % 3).cast("int")).alias("verdict"), F.concat(F.lit("because "), n).alias("reason")
    )


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return None
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def replay(old, new, vector):
    """(id -> decision, task, reason), one row after the other."""
    active = [r for r in old if r["status"] != "ARCHIVED" and r["normalized_sender"] is not None]
    made, out = [], {}

    def scope(r):
        return r["source_mailbox"], r["normalized_sender"], r["task_fingerprint"]

    for r in sorted(new, key=lambda r: (r["created_at"], r["id"])):

        def first(rows):
            return min(((x["created_at"], x["id"]) for x in rows), default=(None, None))[1]

        def message(x, r=r):
            return r["source_email_id"] is not None and (x["source_email_id"], x["task_fingerprint"]) == (r["source_email_id"], r["task_fingerprint"])

        known = first(filter(message, old)) or first(filter(message, made))
        scoped = r["source_mailbox"] is not None and r["normalized_sender"] is not None
        held = scoped and (first(x for x in active if scope(x) == scope(r)) or first(x for x in made if scope(x) == scope(r)))
        if known:
            out[r["id"]] = ("KNOWN", known, None)
            continue
        if held:
            out[r["id"]] = ("EXACT", held, None)
            continue
        key = tuple(r[c] for c in BLOCK)
        near = []
        if None not in key:
            near = [((x["created_at"], 1, x["id"]), x) for x in active if tuple(x[c] for c in BLOCK) == key and x["created_at"] < r["created_at"]]
            near += [((x["created_at"], 0, x["id"]), x) for x in made if tuple(x[c] for c in BLOCK) == key]
        asked = []
        for _, x in sorted(near, key=lambda p: p[0], reverse=True)[:3]:
            score = cosine(vector[r["id"]], vector[x["id"]])
            if score is None or score >= 0.75:
                asked.append((x["id"], *answer(r["id"], x["id"])))
        same = [a for a in asked if a[1] == "VERDICT" and a[2] == "SAME"]
        away, bad = ([a for a in asked if a[1] == kind] for kind in ("UNAVAILABLE", "MALFORMED"))
        unsure = [a for a in asked if a[1] == "VERDICT" and a[2] == "AMBIGUOUS"]
        for rows, name in ((same, "SEMANTIC_SAME"), (away, "DEFER_UNAVAILABLE"), (bad, "DEFER_MALFORMED"), (unsure, "CREATE_AMBIGUOUS")):
            if rows:
                out[r["id"]] = (name, r["id"] if name == "CREATE_AMBIGUOUS" else rows[0][0], rows[0][3])
                break
        else:
            out[r["id"]] = ("CREATED", r["id"], None)
        if out[r["id"]][0] in ("CREATED", "CREATE_AMBIGUOUS"):
            made.append(r)
    return out


def batch(rnd, count, blocks, first_id, start):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = []
    for i in range(count):
        hot = rnd.random() < 0.5
        b = 0 if hot else rnd.randrange(blocks)
        values = (
            first_id + i,
            rnd.choice([None, f"m{rnd.randrange(9)}"]),
            rnd.choice(["box"] * 9 + [None]),
            rnd.choice([f"s{b}"] * 9 + [None]),
            rnd.choice([f"a{b}"] * 9 + [None]),
            f"h{rnd.randrange(count // 2)}",
            rnd.choice(["NEW", "NEW", "ARCHIVED"]) if first_id == 1 else "NEW",
            start + timedelta(minutes=rnd.randrange(count)),
        )
        rows.append(dict(zip(names, values, strict=True)))
    return rows


def decided(spark, old, new, vector, answers=verdicts):
    def table(rows):
        return spark.createDataFrame([tuple(r.values()) for r in rows], COLUMNS)

    vectors = spark.createDataFrame(list(vector.items()), "id bigint, vector array<double>")
    got = dedup.decide_tasks(table(old), table(new), vectors, answers, BLOCK, hour_of(F.col("created_at"))).collect()
    assert len(got) == len(new)
    return {r["id"]: (r["decision"], r["task_id"], r["match_reason"]) for r in got}


def test_batch_equals_replay(spark):
    rnd = random.Random(1)
    old, new = batch(rnd, 60, 3, 1, NOW), batch(rnd, 110, 3, 1000, NOW + timedelta(minutes=30))
    kinds = [[1.0, 0.0], [0.9, 0.2], [0.0, 1.0], [1.0], None]
    vector = {r["id"]: rnd.choice(kinds) for r in old + new}
    got, want = decided(spark, old, new, vector), replay(old, new, vector)
    assert got == want
    assert len({d for d, _, _ in want.values()}) == 7
    ids = {r["id"] for r in new}
    assert any(d == "SEMANTIC_SAME" and t in ids for d, t, _ in want.values())  # found inside the batch


def test_given_verdicts_and_a_task_that_is_not_created(spark):
    def row(i, mail, h, minute):
        return dict(zip([c.split()[0] for c in COLUMNS.split(", ")], (i, mail, "box", "s", "a", h, "NEW", NOW + timedelta(minutes=minute)), strict=True))

    # 2 is the same as 1, so 3 (as 2 word by word) is no exact copy of a task; 4 waits for the verifier and 5 does not see it
    new = [row(1, "m1", "h1", 1), row(2, "m2", "h2", 2), row(3, "m3", "h2", 3), row(4, "m4", "h4", 4), row(5, "m5", "h4", 5)]
    vector = {i: [1.0, 0.0] for i in range(1, 6)}
    rows = [(2, 1, "VERDICT", "SAME", "r"), (3, 1, "VERDICT", "DIFFERENT", "r"), (4, 3, "UNAVAILABLE", None, "r"), (4, 1, "VERDICT", "DIFFERENT", "r"), (5, 3, "VERDICT", "AMBIGUOUS", "r"), (5, 1, "VERDICT", "DIFFERENT", "r")]
    given = spark.createDataFrame(rows, "new_id bigint, candidate_id bigint, outcome string, verdict string, reason string")
    assert decided(spark, [], new, vector, given) == {
        1: ("CREATED", 1, None), 2: ("SEMANTIC_SAME", 1, "r"), 3: ("CREATED", 3, None), 4: ("DEFER_UNAVAILABLE", 3, "r"), 5: ("CREATE_AMBIGUOUS", 5, "r"),
    }


def test_empty_batch(spark):
    old = batch(random.Random(3), 10, 2, 1, NOW)
    assert decided(spark, old, [], {1: [1.0]}) == {}


def test_rounds_carry_numbers_instead_of_keys(spark, monkeypatch):
    written, cut = [], dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: written.append(df.schema) or cut(df))
    rnd = random.Random(4)
    new = batch(rnd, 40, 2, 1000, NOW)
    got = decided(spark, [], new, {r["id"]: [1.0, 0.0] for r in new})
    assert got == replay([], new, {r["id"]: [1.0, 0.0] for r in new})
    rounds = [s for s in written if "_made" in s.names or "_now" in s.names]
    assert rounds
    for schema in rounds:
        assert {schema[k].dataType.typeName() for k in ("_message", "_scope", "_block")} == {"long"}
        assert not {"source_email_id", "task_fingerprint", "normalized_sender"} & set(schema.names)
