"""Counts kept by signed deltas against a full recomputation after each batch."""

import random
from datetime import date, timedelta

from tidemark.operators import queue as qu, tasks as tk
from tidemark.streaming import rollups, runner

COLUMNS = "id bigint, " + rollups.TASK_SCHEMA
DAY = date(2024, 1, 5)


def draw(rnd, i):
    due = rnd.choice([None, DAY + timedelta(days=rnd.randrange(-3, 4))])
    return i, rnd.choice(["ann", "bob", "", None, "Unassigned"]), rnd.choice(tk.STATUSES), rnd.choice(["HIGH", "CRITICAL", "LOW", None]), due


def lines(df):
    return sorted(map(str, df.collect()))


def same(counted, df):
    assert lines(rollups.workload(counted, DAY)) == lines(tk.workload(df, DAY))
    assert lines(rollups.summary(counted, DAY)) == lines(tk.summary(df, DAY))
    assert lines(rollups.workload(counted, DAY + timedelta(days=2))) == lines(tk.workload(df, DAY + timedelta(days=2)))


def test_counts_after_each_batch(spark, tmp_path):
    rnd = random.Random(11)
    target, dims, schema = f"{tmp_path}/rollup", rollups.TASK_DIMENSIONS, rollups.TASK_SCHEMA
    state = {i: draw(rnd, i) for i in range(120)}
    frames = [spark.createDataFrame(list(state.values()), COLUMNS)]
    rollups.start(frames[0], target, dims)
    same(rollups.counts(spark, target, schema), frames[0])
    sink = rollups.rollup_sink(target, dims)
    for batch in range(4):
        for i in rnd.sample(range(150), 40):
            if rnd.random() < 0.2:
                state.pop(i, None)
            else:
                state[i] = draw(rnd, i)
        if batch == 3:
            state.clear()
        frames.append(spark.createDataFrame(list(state.values()), COLUMNS))
        events = rollups.changes(frames[-2], frames[-1], dims)
        sink(events, batch)
        sink(events, batch)  # run again after a failure: counts once
        same(rollups.counts(spark, target, schema), frames[-1])
        if batch == 1:
            rollups.compact(spark, target, schema, 1)
            same(rollups.counts(spark, target, schema), frames[-1])
    same(rollups.counts(spark, target, schema, 2), frames[3])
    same(rollups.counts(spark, target, schema, 0), frames[1])  # the newer base is not looked at
    rollups.compact(spark, target, schema, 3)  # nothing left: an empty base
    same(rollups.counts(spark, target, schema), frames[-1])


def test_an_unfinished_base_does_not_count(spark, tmp_path):
    target = f"{tmp_path}/rollup"
    df = spark.createDataFrame([draw(random.Random(1), i) for i in range(9)], COLUMNS)
    rollups.start(df, target, rollups.TASK_DIMENSIONS)
    df.selectExpr(*rollups.TASK_DIMENSIONS, "99L AS n").write.parquet(f"{target}/base/through=0")
    same(rollups.counts(spark, target, rollups.TASK_SCHEMA), df)


def test_stream_in_any_order(spark, tmp_path):
    """An id that changes in several files: the order of the files does not matter, and nor does the batch size."""
    rnd = random.Random(2)
    schema = "id bigint, status string"
    states = [spark.createDataFrame([(i, rnd.choice(qu.STATUSES)) for i in range(60)], schema) for _ in range(4)]
    events = [rollups.changes(a, b, rollups.QUEUE_DIMENSIONS) for a, b in zip(states, states[1:])]
    for name, order in (("up", (0, 1, 2)), ("down", (2, 1, 0))):
        folder, target = f"{tmp_path}/{name}", f"{tmp_path}/{name}-rollup"
        for i in order:
            events[i].coalesce(1).write.mode("append").parquet(folder)
        rollups.start(states[0], target, rollups.QUEUE_DIMENSIONS)
        stream = runner.table_stream(spark, folder, events[0].schema, 1)
        runner.run_available(stream.writeStream.foreachBatch(rollups.rollup_sink(target, rollups.QUEUE_DIMENSIONS)), f"{tmp_path}/{name}-cp")
        counted = rollups.counts(spark, target, rollups.QUEUE_SCHEMA)
        assert lines(rollups.queue_stats(counted)) == lines(qu.stats(states[-1]))
        assert lines(rollups.queue_backlog(counted)) == lines(qu.backlog(states[-1]))


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS)
    rollups.start(none, f"{tmp_path}/none", rollups.TASK_DIMENSIONS)
    same(rollups.counts(spark, f"{tmp_path}/none", rollups.TASK_SCHEMA), none)
