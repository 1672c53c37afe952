"""Task de-duplication: exact by content hash, then by similarity, with an audit trail."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import task_fingerprint
from ..functions.vectors import cosine, norm
from ..session import cut_lineage
from .timeline import first_per_key, running_totals

SCOPE = ("source_mailbox", "normalized_sender")
GROUP = ("task_fingerprint", *SCOPE)  # the near-unique part first: sorts compare it first
SIMILARITY_THRESHOLD = 0.75
CANDIDATES = 3


def _oldest() -> list[Column]:
    return [F.asc("created_at"), F.asc("id")]


def with_current_hash(tasks: DataFrame) -> DataFrame:
    """Replace the stored hash by the one the current rule gives."""
    return tasks.withColumn("task_fingerprint", task_fingerprint())


def scoped_active(tasks: DataFrame) -> DataFrame:
    return tasks.filter((F.col("status") != "ARCHIVED") & F.col("normalized_sender").isNotNull())


def duplicate_groups(tasks: DataFrame) -> DataFrame:
    """One row per group of active duplicates. Group members stay rows: see :func:`duplicate_members`."""
    return (
        scoped_active(tasks)
        .groupBy(*GROUP)
        .agg(
            F.count(F.lit(1)).alias("active_duplicate_count"),
            F.min("created_at").alias("first_seen_at"),
            F.max("created_at").alias("last_seen_at"),
            F.min_by("id", F.struct("created_at", "id")).alias("oldest_id"),
        )
        .filter("active_duplicate_count > 1")
    )


def duplicate_members(tasks: DataFrame) -> DataFrame:
    """Every member of every duplicate group with what happens to it: the oldest stays, the others are archived."""
    groups = duplicate_groups(tasks).select(*(F.col(c).alias(f"_{c}") for c in GROUP), "active_duplicate_count", "oldest_id")
    action = F.when(F.col("id") == F.col("oldest_id"), "KEEP ACTIVE (oldest)").otherwise("WILL BE ARCHIVED")
    members = scoped_active(tasks).select("id", *GROUP, "title", "status", "created_at")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in GROUP]  # groups of a null mailbox have members as well
    return members.join(groups, same).withColumn("action", action).drop("oldest_id", *(f"_{c}" for c in GROUP))


def archive_duplicates(tasks: DataFrame, as_of) -> DataFrame:
    """All tasks, with every active duplicate but the oldest of its group archived."""
    keep = first_per_key(scoped_active(tasks).select("id", "created_at", *GROUP), GROUP, _oldest()).select(
        "id", F.lit(True).alias("_keep")
    )
    # joined on the id, which no group can make hot
    judged = tasks.join(keep, "id", "left")
    surplus = (F.col("status") != "ARCHIVED") & F.col("normalized_sender").isNotNull() & F.col("_keep").isNull()
    return judged.withColumns(
        {
            "status": F.when(surplus, "ARCHIVED").otherwise(F.col("status")),
            "updated_at": F.when(surplus, F.lit(as_of)).otherwise(F.col("updated_at")),
        }
    ).drop("_keep")


def active_exact_matches(tasks: DataFrame, probes: DataFrame) -> DataFrame:
    """Oldest active task with the probe's mailbox, sender and hash; probes need ``probe_id`` and those columns."""
    oldest = (
        scoped_active(tasks)
        .groupBy(*GROUP)
        .agg(F.min_by("id", F.struct("created_at", "id")).alias("matched_task_id"))
    )
    return probes.join(oldest, list(GROUP)).select("probe_id", "matched_task_id")


def resolve_exact(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Decide for every extracted task whether it is new, as if they came one by one in the order of ``(created_at, id)``.

    decision: KNOWN (the message has already produced a stored task with this hash; no audit), EXACT (an active task of
    the same mailbox and sender has the hash; audited) or CREATED. The message is looked up first, whatever the scope,
    so no (message, hash) is created twice. Rows without mailbox or sender are only checked against their own message.

    Messages of stored tasks are settled in one pass. The other rows form rounds: a row that is the first undecided one both of
    its message and of its scope is created and settles later ones of either; few rows are left after the first round,
    and each round is written to the shared folder.
    """
    columns = ["id", "source_email_id", *GROUP, "created_at"]
    stored = existing.select(*columns, F.lit(True).alias("_old"), (F.col("status") != "ARCHIVED").alias("_active"))
    asked = fresh.select(*columns, F.lit(False).alias("_old"), F.lit(True).alias("_active"))
    own = F.concat(F.lit("\u0000"), F.col("_old").cast("string"), F.lit(":"), F.col("id").cast("string"))
    scoped = F.col("source_mailbox").isNotNull() & F.col("normalized_sender").isNotNull()
    tagged = stored.unionAll(asked).withColumns(
        {
            "_at": F.struct("created_at", "id"),
            # rows without message or scope are alone there
            "_message": F.struct(F.coalesce("source_email_id", own).alias("m"), "task_fingerprint"),
            "_scope": F.struct(
                F.when(scoped, F.col("source_mailbox")).otherwise(own).alias("a"), F.when(scoped, F.col("normalized_sender")).alias("b"), "task_fingerprint"
            ),
        }
    )
    by_message, by_scope = Window.partitionBy("_message"), Window.partitionBy("_scope")
    stored_id = F.when(F.col("_old"), F.col("_at"))
    active_id = F.when(F.col("_old") & F.col("_active"), F.col("_at"))
    checked = (
        tagged.withColumn("_known", F.min(stored_id).over(by_message)["id"])
        .withColumn("_held", F.min(active_id).over(by_scope)["id"])
        .filter(~F.col("_old"))
        .drop("_old", "_active")
    )
    now = cut_lineage(checked)
    done = [now.filter("_known IS NOT NULL")]
    left = now.filter("_known IS NULL")
    while not left.isEmpty():
        free = F.col("_held").isNull()
        ranked = left.withColumn("_first", F.min("_at").over(by_message) == F.col("_at"))
        ranked = ranked.withColumn("_creator", free & F.col("_first") & (F.min(F.when(free, F.col("_at"))).over(by_scope) == F.col("_at")))
        made = F.when(F.col("_creator"), F.col("id"))
        told = ranked.withColumn("_held", F.coalesce("_held", F.max(made).over(by_scope)))
        judged = cut_lineage(told.withColumn("_known", F.max(made).over(by_message)))
        # a row that its scope holds may still be known to its message, until the earlier rows of that are settled
        settled = F.col("_known").isNotNull() | (F.col("_held").isNotNull() & F.col("_first"))
        done.append(judged.filter(settled).drop("_first"))
        left = judged.filter(~settled).drop("_creator", "_first")
    decided = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)
    if "_creator" not in decided.columns:
        decided = decided.withColumn("_creator", F.lit(False))
    decision = (
        F.when(F.col("_creator"), "CREATED").when(F.col("_known").isNotNull(), "KNOWN").otherwise("EXACT")
    )
    return decided.select("id", "source_email_id", *GROUP, decision.alias("decision"), F.coalesce("_known", "_held").alias("task_id"))


def exact_audit(decisions: DataFrame) -> DataFrame:
    return decisions.filter("decision = 'EXACT'").select(
        F.lit("EXACT").alias("match_type"),
        F.col("task_id").alias("matched_task_id"),
        F.lit(None).cast("bigint").alias("new_task_id"),
        "source_email_id",
        *SCOPE,
        F.lit("Exact canonical fingerprint match").alias("match_reason"),
    )


def recent_candidates(
    fresh: DataFrame,
    existing: DataFrame,
    block: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    k: int = CANDIDATES,
) -> DataFrame:
    """The ``k`` latest existing rows before each fresh row of the same block.

    Existing rows are numbered per block with a running count, so no pairs beyond the ``k`` per row arise. The count
    runs in buckets, so that no task orders a whole hot block. Both sides carry an ``id``; rows with a null block key
    have no candidates.
    """
    usable = " AND ".join(f"{c} IS NOT NULL" for c in block)
    columns = list(dict.fromkeys(["id", *block, *order]))
    lanes = fresh.select(*columns, F.lit(False).alias("_old")).unionByName(
        existing.select(*columns, F.lit(True).alias("_old"))
    )
    lanes = lanes.filter(usable)
    # at equal order values fresh rows come first: candidates are strictly earlier
    numbered = running_totals(
        lanes,
        block,
        bucket,
        [*[F.asc(c) for c in order], F.asc("_old"), F.asc("id")],
        sums={"_n": F.col("_old").cast("bigint")},
    )
    old = numbered.filter("_old").select(F.col("id").alias("candidate_id"), *block, "_n")
    new = numbered.filter("NOT _old").select(
        F.col("id").alias("new_id"),
        *block,
        F.posexplode(F.sequence(F.col("_n"), F.col("_n") - (k - 1), F.lit(-1))).alias("_p", "_n"),
    )
    return new.join(old, [*block, "_n"]).select("new_id", "candidate_id", (F.col("_p") + 1).alias("candidate_rank"))


def score_candidates(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Add the cosine of both rows' vectors; a missing vector leaves the score null."""
    sized = vectors.select("id", "vector", norm(F.col("vector")).alias("norm"))
    new = sized.select(F.col("id").alias("new_id"), F.col("vector").alias("_a"), F.col("norm").alias("_na"))
    old = sized.select(F.col("id").alias("candidate_id"), F.col("vector").alias("_b"), F.col("norm").alias("_nb"))
    paired = candidates.join(new, "new_id", "left").join(old, "candidate_id", "left")
    score = cosine(F.col("_a"), F.col("_b"), F.col("_na"), F.col("_nb"))
    return paired.withColumn("score", score).drop("_a", "_b", "_na", "_nb")


def decide_similar(
    fresh: DataFrame, scored: DataFrame, verdicts: DataFrame, threshold: float = SIMILARITY_THRESHOLD
) -> DataFrame:
    """One decision per row of ``fresh`` (``id``) from its scored candidates and the verifier's answers.

    A row without candidates is created.

    A candidate below the threshold is skipped; one without score must be verified. In candidate order the first SAME
    wins. Otherwise any missing verdict defers the row (UNAVAILABLE before MALFORMED). Otherwise the row is created,
    with an audit entry for the first AMBIGUOUS candidate.
    """
    checked = scored.join(verdicts, ["new_id", "candidate_id"], "left")
    needed = F.col("score").isNull() | (F.col("score") >= threshold)
    answer = F.coalesce("outcome", F.lit("UNAVAILABLE"))

    def first(condition: Column) -> Column:
        return F.min(F.when(needed & condition, F.struct("candidate_rank", "candidate_id", "reason")))

    ruled = checked.groupBy("new_id").agg(
        first((answer == "VERDICT") & (F.col("verdict") == "SAME")).alias("same"),
        first(answer == "UNAVAILABLE").alias("unavailable"),
        first(answer == "MALFORMED").alias("malformed"),
        first((answer == "VERDICT") & (F.col("verdict") == "AMBIGUOUS")).alias("ambiguous"),
    )
    decision = (
        F.when(F.col("same").isNotNull(), "SEMANTIC_SAME")
        .when(F.col("unavailable").isNotNull(), "DEFER_UNAVAILABLE")
        .when(F.col("malformed").isNotNull(), "DEFER_MALFORMED")
        .when(F.col("ambiguous").isNotNull(), "CREATE_AMBIGUOUS")
        .otherwise("CREATE")
    )
    matched = F.coalesce("same", "unavailable", "malformed", "ambiguous")
    return fresh.select(F.col("id").alias("new_id")).join(ruled, "new_id", "left").select(
        "new_id",
        decision.alias("decision"),
        matched["candidate_id"].alias("matched_task_id"),
        matched["reason"].alias("match_reason"),
    )


CREATED = ("CREATE", "CREATE_AMBIGUOUS")


def _numbers(keys: DataFrame, name: str, least: int = 2) -> DataFrame:
    """A number for every ``_key`` that at least ``least`` rows have, written to the shared folder so that it stays the same."""
    groups = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return cut_lineage(groups.select("_key", F.monotonically_increasing_id().alias(name)))


def _keyed(existing: DataFrame, fresh: DataFrame, block: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Fresh rows with what stored tasks settle (``_known`` and ``_held``), and the active stored tasks of their blocks.

    Rounds compare messages, scopes and blocks, but never look into them, so both tables hold numbers instead. A row that shares
    its message or scope with no other fresh row, or has no block, has a negative number of its own there. The texts
    are dropped as soon as a number stands for them, so that only two shuffles carry a hash and none of the rounds does.
    """
    at = F.struct("created_at", "id")
    own = F.concat(F.lit("\u0000"), F.col("id").cast("string"))
    scoped = F.col("source_mailbox").isNotNull() & F.col("normalized_sender").isNotNull()
    inside = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in block])
    hashed = F.coalesce("task_fingerprint", F.lit("")).alias("f")
    # rows without message, scope or block are alone there
    message = F.struct(F.coalesce("source_email_id", own).alias("m"), hashed).alias("_key")
    scope = F.struct(
        F.when(scoped, F.col("source_mailbox")).otherwise(own).alias("a"),
        F.when(scoped, F.col("normalized_sender")).otherwise("").alias("b"),
        hashed,
    ).alias("_key")

    def in_block(whole: Column) -> Column:
        return F.struct(F.when(whole, F.lit("")).otherwise(own).alias("alone"), *block).alias("_key")

    rows = fresh.select(*dict.fromkeys(["id", "source_email_id", *GROUP, *block, "created_at"])).withColumn("_whole", scoped & inside)
    messages, scopes = _numbers(rows.select(message), "_message"), _numbers(rows.select(scope), "_scope")
    blocks = _numbers(rows.filter("_whole").select(in_block(F.lit(True))), "_block", least=1)
    known = existing.filter("source_email_id IS NOT NULL").groupBy(message).agg(F.min(at)["id"].alias("_known"))
    held = scoped_active(existing).filter("source_mailbox IS NOT NULL").groupBy(scope).agg(F.min(at)["id"].alias("_held"))
    keyed = rows.withColumn("_key", message).drop("source_email_id").join(known, "_key", "left").join(messages, "_key", "left")
    keyed = keyed.withColumn("_key", scope).drop("task_fingerprint").join(held, "_key", "left").join(scopes, "_key", "left")
    keyed = keyed.withColumn("_key", in_block(F.col("_whole"))).join(blocks, "_key", "left")
    alone = -1 - F.monotonically_increasing_id()
    numbers = [F.coalesce(k, alone).alias(k) for k in ("_message", "_scope", "_block")]
    stored = scoped_active(existing).select(*dict.fromkeys(["id", *block, "created_at"])).withColumn("_key", in_block(inside)).join(blocks, "_key")
    return (
        cut_lineage(keyed.select("id", at.alias("_at"), "_whole", *numbers, "_known", "_held")),
        cut_lineage(stored.select("id", "_block", "created_at", F.lit(True).alias("_stored"))),
    )


def _first_made(state: DataFrame, key: str) -> DataFrame:
    """The earliest created row of each message or scope that several rows share."""
    return state.filter(F.col("_made") & (F.col(key) >= 0)).groupBy(key).agg(F.min("_at").alias(f"_first{key}"))


def _reached(state: DataFrame, changed: DataFrame) -> DataFrame:
    """``state`` with ``_again``: whether a row before it in its message, scope or block has changed."""
    for key in ("_message", "_scope", "_block"):
        since = changed.filter(F.col(key) >= 0).groupBy(key).agg(F.min("_at").alias(f"_since{key}"))
        state = state.join(since, key, "left")
    late = [F.coalesce(F.col(f"_since{k}") < F.col("_at"), F.lit(False)) for k in ("_message", "_scope", "_block")]
    return state.withColumn("_again", late[0] | late[1] | late[2]).drop("_since_message", "_since_scope", "_since_block")


def decide_tasks(
    existing: DataFrame,
    fresh: DataFrame,
    vectors: DataFrame,
    verdicts: DataFrame | Callable[[DataFrame], DataFrame],
    block: Sequence[str],
    bucket: Column,
    threshold: float = SIMILARITY_THRESHOLD,
) -> DataFrame:
    """The whole chain for extracted tasks, as if they came one by one in the order of ``(created_at, id)``.

    Each row meets the stored tasks and those that earlier rows of the batch have created: by message and hash (KNOWN), by
    mailbox, sender and hash (EXACT), then by similarity to the latest active tasks of its block. What a row does to
    later ones is only whether it is created, so rounds compute every decision from the flags of the round before,
    until no flag changes. A decision depends on earlier rows alone: the result is that of the replay, and a round settles at
    least one more row of each chain of rows that undo each other. From the second round on only rows are computed again that have
    a changed row before them in their message, scope or block.

    ``verdicts`` holds the verifier's answers (new_id, candidate_id, outcome, verdict, reason), or is asked for those of a
    table of scored pairs, also of some that a later round drops.

    Returns ``id, decision, task_id, match_reason``: KNOWN and EXACT as in :func:`resolve_exact`, else the similarity
    decision, with CREATED for rows that nothing resembles; ``task_id`` is the task the row stands for or waits on,
    its own id where it is created.
    """
    order = ["created_at", "_stored", "id"]  # tasks of the batch are seen in order, stored ones only if they are older
    keyed, stored = _keyed(existing, fresh, block)
    free = keyed.filter("_known IS NULL AND _held IS NULL").withColumn("_made", F.lit(True))
    first = keyed.join(_first_made(free, "_message"), "_message", "left").join(_first_made(free, "_scope"), "_scope", "left")
    alone = (F.col("_first_message") == F.col("_at")) & (F.col("_first_scope") == F.col("_at"))
    guessed = F.col("_known").isNull() & F.col("_held").isNull() & F.coalesce(alone, F.lit(False))
    state = cut_lineage(first.select(*keyed.columns, guessed.alias("_made")))
    settled: DataFrame | None = None  # rows that the round before left as they are
    todo = state
    while True:
        judged = todo.join(_first_made(state, "_message"), "_message", "left").join(_first_made(state, "_scope"), "_scope", "left")
        earlier = {k: F.when(F.col(f"_first{k}") < F.col("_at"), F.col(f"_first{k}")["id"]) for k in ("_message", "_scope")}
        judged = cut_lineage(
            judged.select(
                *keyed.columns,
                "_made",
                F.coalesce("_known", earlier["_message"]).alias("_by_message"),
                F.coalesce("_held", earlier["_scope"]).alias("_by_scope"),
            )
        )
        seen = {"created_at": F.col("_at.created_at"), "_stored": F.lit(False)}
        asking = judged.filter("_by_message IS NULL AND _by_scope IS NULL AND _whole").withColumns(seen)
        made = state.filter("_made AND _whole").withColumns(seen).select(*stored.columns)
        pool = stored.unionByName(made).join(asking.select("_block").distinct(), "_block", "left_semi")
        pairs = recent_candidates(asking, pool, ["_block"], order, bucket)
        asked = vectors
        if settled is not None:  # few pairs are left, and only their vectors are dealt
            pairs = cut_lineage(pairs)
            both = pairs.select(F.col("new_id").alias("id")).union(pairs.select("candidate_id")).distinct()
            asked = vectors.join(both, "id", "left_semi")
        scored = score_candidates(pairs, asked)
        if callable(verdicts):
            scored = cut_lineage(scored)
        answers = verdicts(scored) if callable(verdicts) else verdicts
        similar = decide_similar(asking.select("id"), scored, answers, threshold)
        ruled = judged.join(similar.select(F.col("new_id").alias("id"), F.struct("*").alias("_similar")), "id", "left")
        none = F.col("_by_message").isNull() & F.col("_by_scope").isNull()
        makes = none & F.coalesce(F.col("_similar.decision").isin(*CREATED), F.lit(True))
        ruled = cut_lineage(ruled.withColumn("_now", makes))
        changed = ruled.filter("_now <> _made")
        rows = ruled.withColumn("_made", F.col("_now")).drop("_now")
        decided = rows if settled is None else settled.unionByName(rows)
        if changed.isEmpty():
            break
        state = cut_lineage(_reached(decided, changed))
        settled, todo = state.filter("NOT _again").drop("_again"), state.filter("_again").select(*keyed.columns, "_made")
    decision = (
        F.when(F.col("_by_message").isNotNull(), "KNOWN")
        .when(F.col("_by_scope").isNotNull(), "EXACT")
        .when(F.coalesce(F.col("_similar.decision"), F.lit("CREATE")) == "CREATE", "CREATED")
        .otherwise(F.col("_similar.decision"))
    )
    stands_for = F.when(F.col("_made"), F.col("id")).otherwise(F.coalesce("_by_message", "_by_scope", "_similar.matched_task_id"))
    return decided.select("id", decision.alias("decision"), stands_for.alias("task_id"), F.col("_similar.match_reason").alias("match_reason"))


def similar_audit(decisions: DataFrame) -> DataFrame:
    kept = decisions.filter("decision IN ('SEMANTIC_SAME', 'CREATE_AMBIGUOUS')")
    ambiguous = F.col("decision") == "CREATE_AMBIGUOUS"
    return kept.select(
        F.when(ambiguous, "SEMANTIC_AMBIGUOUS").otherwise("SEMANTIC_SAME").alias("match_type"),
        "matched_task_id",
        F.when(ambiguous, F.col("new_id")).alias("new_task_id"),
        "match_reason",
    )


def audit_summary(decisions: DataFrame) -> DataFrame:
    """Rows processed, created, and matched per type."""
    d = F.col("decision")
    return decisions.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(d.isin("CREATED", "CREATE", "CREATE_AMBIGUOUS")).alias("unique_created"),
        F.count_if(d == "EXACT").alias("exact"),
        F.count_if(d == "SEMANTIC_SAME").alias("semantic_same"),
        F.count_if(d == "CREATE_AMBIGUOUS").alias("semantic_ambiguous"),
    )
