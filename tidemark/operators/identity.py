"""Directory people: resolution of assignees, upserts from the directory feed, merging of duplicate identities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import local_part, name_from_email
from ..functions.text import blank_to_null, is_blank
from ..session import cut_lineage
from .timeline import first_per_key, spread_nulls


def _key(text: Column) -> Column:
    return F.lower(F.trim(text))


def task_counts(employees: DataFrame, tasks: DataFrame) -> DataFrame:
    """Employees with the number of tasks that carry their address."""
    counts = (
        tasks.filter(F.col("assignee_email").isNotNull())
        .groupBy(_key(F.col("assignee_email")).alias("_email"))
        .agg(F.count(F.lit(1)).alias("task_count"))
    )
    return (
        employees.withColumn("_email", _key(F.col("email")))
        .join(counts, "_email", "left")
        .drop("_email")
        .withColumn("task_count", F.coalesce("task_count", F.lit(0)))
    )


def _keyed(employees: DataFrame, tasks: DataFrame) -> DataFrame:
    return task_counts(employees, tasks).withColumn("canonical_key", local_part(F.col("email")))


def _canonical(keyed: DataFrame) -> DataFrame:
    """The row each canonical key keeps: most tasks, then smallest address."""
    best = F.struct((-F.col("task_count")).alias("t"), F.col("email").alias("e"), F.col("id").alias("i"))
    return keyed.groupBy("canonical_key").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.min_by(F.struct("id", "email"), best).alias("canonical"),
    )


def duplicate_identities(employees: DataFrame, tasks: DataFrame) -> DataFrame:
    """Members of canonical-key groups of two or more, with task counts and the planned action."""
    keyed = _keyed(employees, tasks)
    groups = _canonical(keyed).filter("group_size > 1")
    action = F.when(F.col("id") == F.col("canonical.id"), "KEEP").otherwise("MERGE AWAY")
    return keyed.join(groups, "canonical_key").select(
        "canonical_key", "id", "name", "email", "microsoft_user_id", "task_count", action.alias("action")
    )


def merge_plan(employees: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per identity that is merged away, with the identity it becomes."""
    keyed = _keyed(employees, tasks)
    groups = _canonical(keyed).filter("group_size > 1").select("canonical_key", "canonical")
    return (
        keyed.join(groups, "canonical_key")
        .filter(F.col("id") != F.col("canonical.id"))
        .select(
            F.col("id").alias("duplicate_id"),
            F.col("email").alias("duplicate_email"),
            F.col("name").alias("duplicate_name"),
            F.col("canonical.id").alias("canonical_id"),
            F.col("canonical.email").alias("canonical_email"),
            "canonical_key",
        )
    )


def merge_employees(employees: DataFrame, plan: DataFrame) -> DataFrame:
    """Employees after the merge: merged rows gone, kept rows named by their key."""
    renamed = plan.select(F.col("canonical_id").alias("id"), F.col("canonical_key").alias("_name")).distinct()
    return (
        employees.join(plan.select(F.col("duplicate_id").alias("id")), "id", "left_anti")
        .join(renamed, "id", "left")
        .withColumn("name", F.coalesce("_name", "name"))
        .drop("_name")
    )


def reassign_tasks(tasks: DataFrame, plan: DataFrame) -> DataFrame:
    """Point tasks of merged identities at the kept one: by address, else by name where the task has no address."""
    by_email = first_per_key(
        plan.select(_key(F.col("duplicate_email")).alias("_email"), "canonical_key", "canonical_email", "duplicate_id"),
        ["_email"],
        [F.asc("duplicate_id")],
    ).select("_email", F.struct("canonical_key", "canonical_email").alias("_by_email"))
    by_name = first_per_key(
        plan.select(_key(F.col("duplicate_name")).alias("_name"), "canonical_key", "canonical_email", "duplicate_id"),
        ["_name"],
        [F.asc("duplicate_id")],
    ).select("_name", F.struct("canonical_key", "canonical_email").alias("_by_name"))
    joined = (
        tasks.withColumns(
            {
                "_email": spread_nulls(_key(F.col("assignee_email")), tasks),
                "_name": spread_nulls(F.when(F.col("assignee_email").isNull(), _key(F.col("assignee"))), tasks),
            }
        )
        .join(by_email, "_email", "left")
        .join(by_name, "_name", "left")
    )
    target = F.coalesce("_by_email", "_by_name")
    return joined.withColumns(
        {
            "assignee": F.coalesce(target["canonical_key"], F.col("assignee")),
            "assignee_email": F.coalesce(target["canonical_email"], F.col("assignee_email")),
        }
    ).drop("_email", "_name", "_by_email", "_by_name")


def resolve_by_mailbox(rows: DataFrame, employees: DataFrame, mailbox: str = "mailbox") -> DataFrame:
    """Add the mailbox owner: by directory id, else by address without case; else null."""
    owner = F.struct("name", "email")
    by_id = first_per_key(employees.filter("microsoft_user_id IS NOT NULL"), ["microsoft_user_id"], [F.asc("id")]).select(
        F.col("microsoft_user_id").alias("_id"), owner.alias("_by_id")
    )
    by_email = first_per_key(
        employees.filter("email IS NOT NULL").withColumn("_email", F.lower("email")), ["_email"], [F.asc("id")]
    ).select("_email", owner.alias("_by_email"))
    box = blank_to_null(F.col(mailbox))
    found = (
        rows.withColumns({"_id": spread_nulls(box, rows), "_email": spread_nulls(F.lower(box), rows)}).join(by_id, "_id", "left").join(by_email, "_email", "left")
    )
    who = F.coalesce("_by_id", "_by_email")
    return found.withColumns({"assignee": who["name"], "assignee_email": who["email"]}).drop(
        "_id", "_email", "_by_id", "_by_email"
    )


def email_of_name(rows: DataFrame, employees: DataFrame, name: str = "name") -> DataFrame:
    """Add ``assignee_email`` for a name, compared without case."""
    lookup = first_per_key(employees.withColumn("_name", F.lower("name")), ["_name"], [F.asc("id")]).select(
        "_name", F.col("email").alias("assignee_email")
    )
    key = spread_nulls(F.lower(blank_to_null(F.col(name))), rows)
    return rows.withColumn("_name", key).join(lookup, "_name", "left").drop("_name")


def name_of_email(rows: DataFrame, employees: DataFrame, email: str, name: str) -> DataFrame:
    """Add ``name``: the employee's name for an address, else the trimmed address itself."""
    lookup = first_per_key(employees.withColumn("_email", F.lower("email")), ["_email"], [F.asc("id")]).select(
        "_email", blank_to_null(F.col("name")).alias("_found")
    )
    return (
        rows.withColumn("_email", spread_nulls(F.lower(blank_to_null(F.col(email))), rows))
        .join(lookup, "_email", "left")
        .withColumn(name, F.coalesce("_found", F.trim(F.col(email))))
        .drop("_email", "_found")
    )


def directory_members(employees: DataFrame) -> DataFrame:
    return employees.filter(F.col("microsoft_user_id").isNotNull()).select("name", "email").orderBy("name", "email")


_STEP = ("component", "is_user", "place", "user_id", "email", "name")
_SETTLED = "position bigint, employee_id bigint, outcome string"


def _components(rows: DataFrame) -> DataFrame:
    """``rows`` (is_user, place, ...) with ``component``: rows that share a directory id, an address or a name, also over others."""
    keys = F.array(
        *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.lower(c) if c != "user_id" else F.col(c))) for c in ("user_id", "email", "name"))
    )
    node = F.concat(F.col("is_user").cast("string"), F.lit(":"), F.col("place").cast("string"))
    links = cut_lineage(rows.select(node.alias("node"), F.explode(F.array_compact(keys)).alias("key")))
    labels = links.groupBy("node").agg(F.min("key").alias("component"))
    while True:  # as many rounds as the longest chain of rows that share a key
        labels = cut_lineage(labels)
        least = links.join(labels, "node").groupBy("key").agg(F.min("component").alias("component"))
        lower = links.join(least, "key").groupBy("node").agg(F.min("component").alias("_least"))
        told = cut_lineage(labels.join(lower, "node"))
        if told.filter("_least < component").isEmpty():
            break
        labels = told.select("node", F.col("_least").alias("component"))
    return rows.withColumn("node", node).join(labels, "node").drop("node")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the users of each component in order, over its employees as they then stand."""
    component = None
    staff: list[tuple] = []  # (employee id, directory id, address, name)
    held: tuple[dict, dict, dict] = {}, {}, {}  # places in ``staff`` by each of them

    def put(place: int, row: tuple) -> None:
        for table, key in zip(held, staff[place][1:], strict=True) if place < len(staff) else ():
            table.get(key, set()).discard(place)
        staff[place : place + 1] = [row]
        for table, key in zip(held, row[1:], strict=True):
            if key is not None:
                table.setdefault(key, set()).add(place)

    def find(number: int, key: str | None) -> int | None:
        return min(held[number].get(key, ()), default=None)

    for batch in batches:
        out = []
        for own, is_user, place, user, email, name in zip(*(batch.column(c).to_pylist() for c in _STEP), strict=True):
            if own != component:
                component = own
                staff.clear()
                for table in held:
                    table.clear()
            keys = user, email and email.lower(), name and name.lower()
            if not is_user:
                put(len(staff), (place, *keys))
                continue
            hit = find(0, keys[0])
            hit = find(1, keys[1]) if hit is None else hit
            if hit is not None:
                out.append((place, staff[hit][0], "UPDATED"))
                put(hit, (staff[hit][0], *keys))
            elif find(2, keys[2]) is not None:
                out.append((place, None, "SKIPPED"))
            else:
                out.append((place, None, "CREATED"))
                put(len(staff), (None, *keys))
        if out:
            kinds = pa.int64(), pa.int64(), pa.string()
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["position", "employee_id", "outcome"])


def upsert_employees(employees: DataFrame, users: DataFrame) -> DataFrame:
    """Outcome per directory user: CREATED, UPDATED or SKIPPED, with the stored row it concerns.

    Users are taken in the order of ``position`` (unique). One matches the employee of its directory id, else of its address, and gives it
    its id, address and derived name; without a match an employee of the same name is a conflict and the user is
    skipped; else an employee is created, which later users of the feed find as well. ``employee_id`` is null for those.
    Only rows that share an id, an address or a name, also over others, can meet: each such component is taken in order
    by itself, streamed, with its employees in memory.
    """
    address = F.coalesce(blank_to_null(F.col("mail")), blank_to_null(F.col("upn")))
    people = users.select("position", F.trim("id").alias("user_id"), address.alias("email"), name_from_email(address).alias("name"))
    people = cut_lineage(people.withColumn("_usable", ~F.coalesce(is_blank(F.col("user_id")), F.lit(True)) & F.col("email").isNotNull()))
    asked = people.filter("_usable").select(F.lit(True).alias("is_user"), F.col("position").cast("bigint").alias("place"), "user_id", "email", "name")
    stored = employees.select(F.lit(False).alias("is_user"), F.col("id").cast("bigint").alias("place"), F.col("microsoft_user_id").alias("user_id"), "email", "name")
    stored = stored.filter("user_id IS NOT NULL OR email IS NOT NULL OR name IS NOT NULL")
    dealt = _components(asked.unionByName(stored)).repartition("component").sortWithinPartitions("component", "is_user", "place")
    settled = dealt.select(*_STEP).mapInArrow(_settle, _SETTLED)
    joined = people.join(settled.withColumnRenamed("position", "_position"), people["position"] == F.col("_position"), "left")
    return joined.select("position", "user_id", "email", "name", "employee_id", F.coalesce("outcome", F.lit("SKIPPED")).alias("outcome"))
