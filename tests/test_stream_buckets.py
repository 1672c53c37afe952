"""Streams whose keys share state by the bucket: state calls follow the buckets, not the ids."""

import pickle
from types import SimpleNamespace

from pyspark.sql import Row

from tidemark.streaming import deadlines, outbox


class Handle:
    """State of one key, and the number of calls."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def counted(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, *_):
        set_value = lambda v: (self.counted(), setattr(self, "value", v))
        return SimpleNamespace(get=lambda: self.counted(self.value), update=set_value, clear=lambda: set_value(None))

    def getMapState(self, *_):
        return SimpleNamespace(
            getValue=lambda k: self.counted(self.map[k]),
            updateValue=lambda k, v: (self.counted(), self.map.update({k: v})),
            removeKey=lambda k: (self.counted(), self.map.pop(k)),
        )

    def registerTimer(self, ms):
        self.counted()
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.counted()
        self.timers.remove(ms)


def expire(tracker, handle, clock):
    [ms] = handle.timers
    out = tracker.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: clock), SimpleNamespace(getExpiryTimeInMs=lambda: ms))
    handle.timers.discard(ms)
    return list(out)


def test_outbox_calls_follow_buckets():
    handle, tracker = Handle(), outbox.Outbox()
    tracker.init(handle)
    rows = [Row(id=f"e{i}", attempt=None, error=None, ms=1000 + i) for i in range(500)]
    told = [Row(id=f"e{i}", attempt=1, error="no" if i % 2 else None, ms=1000 + i) for i in range(400)]
    out = list(tracker.handleInputRows((0,), iter(rows + told), None))
    assert len(out) == 900 and handle.calls <= 5
    handle.calls = 0
    out = expire(tracker, handle, 10_000)  # the failed ones are due again, the others wait for a result
    assert {(r.kind, r.attempt) for r in out} == {("CLAIMED", 2)} and len(out) == 200
    assert all(r.at_ms == 3000 + int(r.id[1:]) for r in out) and handle.calls <= 5
    assert len(handle.timers) == 1
    assert list(tracker.handleInputRows((0,), iter(rows), None)) == []  # those that come again are known
    out = expire(tracker, handle, 130_000)
    assert {(r.kind, r.attempt) for r in out} == {("RECOVERED", 1), ("CLAIMED", 2), ("RECOVERED", 2), ("CLAIMED", 3)}
    done = sum(len(pickle.loads(v[0])) for v in handle.map.values())
    assert done == 200 and len(handle.timers) == 1


def test_deadline_calls_follow_buckets():
    handle, tracker = Handle(), deadlines.AnswerTracker(timers=True)
    tracker.init(handle)

    def row(i, us, sla=None, reply=None):
        return Row(conversation_id=f"c{i}", mailbox="m", address="a", us=us, sla_id=sla, deadline_us=us + 5_000_000 if sla else None, reply_id=reply)

    opened = [row(i, 1_000_000, f"s{i}") for i in range(300)]
    out = list(tracker.handleInputRows((0,), iter(opened + [row(i, 2_000_000, reply=f"r{i}") for i in range(100)]), None))
    assert len(out) == 400 and handle.calls <= 4 and handle.timers == {6001}
    handle.calls = 0
    late = [row(i, 9_000_000, reply=f"r{i}") for i in range(100, 200)]
    assert {(r.kind, r.breach) for r in tracker.handleInputRows((0,), iter(opened + late), None)} == {("ANSWERED", 0), ("BREACHED", 1)}
    out = expire(tracker, handle, 6001)
    assert {r.sla_id for r in out} == {f"s{i}" for i in range(200, 300)} and {r.kind for r in out} == {"BREACHED"}
    assert not handle.timers and handle.calls <= 6
    out = list(tracker.handleInputRows((0,), iter([row(i, 3_000_000, reply=f"q{i}") for i in range(150, 250)]), None))
    assert {(r.kind, r.breach) for r in out} == {("ANSWERED", 0), ("CORRECTED", -1)} and len(out) == 200
