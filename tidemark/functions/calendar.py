"""Business-hours deadlines as plain column arithmetic: no calendar table, no join, no loop."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import int_div

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_DAY = 24 * 60 * MICROS_PER_MINUTE
# Monday long before year 1, so that day numbers counted from it are never negative; 1970-01-01 is a Thursday
DAYS_BEFORE_EPOCH = 7 * 104_000 + 3

# Accepted spellings of the working days, Monday first.
DAY_SPELLINGS = (
    ("MON", "MONDAY"),
    ("TUE", "TUESDAY"),
    ("WED", "WEDNESDAY"),
    ("THU", "THUR", "THURSDAY"),
    ("FRI", "FRIDAY"),
    ("SAT", "SATURDAY"),
    ("SUN", "SUNDAY"),
)


def parse_working_day(text: str) -> int:
    """Weekday number, Monday = 0."""
    word = text.strip().upper()
    for number, spellings in enumerate(DAY_SPELLINGS):
        if word in spellings:
            return number
    raise ValueError(f"unsupported working day: {text}")


@dataclass(frozen=True)
class WorkingHours:
    """Weekly working pattern and the working time an answer may take."""

    zone: str = "UTC"
    days: Sequence[str] = ("MON", "TUE", "WED", "THU", "FRI")
    start: time = time(9)
    end: time = time(18)
    duration_hours: int = 24

    def __post_init__(self) -> None:
        if not self.weekdays:
            raise ValueError("the working week is empty")
        if self.minutes_per_day < 1:
            raise ValueError("working hours must end at least a minute after they start")

    @property
    def weekdays(self) -> list[int]:
        return sorted({parse_working_day(d) for d in self.days if d.strip()})

    @property
    def start_micros(self) -> int:
        return _micros(self.start)

    @property
    def end_micros(self) -> int:
        return _micros(self.end)

    @property
    def minutes_per_day(self) -> int:
        return (self.end_micros - self.start_micros) // MICROS_PER_MINUTE


def _micros(t: time) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond


def _pick(index: Column, values: Sequence[int]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int")).cast("bigint")


def deadline(received: Column, hours: WorkingHours = WorkingHours()) -> Column:
    """Moment at which ``duration_hours`` of working time have passed since ``received``.

    All working minutes are numbered through: ``position`` is the number of the minute at which the clock starts,
    the deadline is the end of minute ``position + duration``. Only whole minutes of the first day count once the
    span leaves that day. Times are wall-clock times of the zone; a clock change inside working hours is not modelled.
    """
    week = hours.weekdays
    per_week = len(week)
    total = hours.duration_hours * 60
    length = hours.minutes_per_day

    local = received if hours.zone.upper() == "UTC" else F.from_utc_timestamp(received, hours.zone)
    micros = F.unix_micros(local) + DAYS_BEFORE_EPOCH * MICROS_PER_DAY
    day = int_div(micros, MICROS_PER_DAY)
    until_end = F.lit(hours.end_micros) - micros % MICROS_PER_DAY
    # minutes still to be worked that day: all before opening, none after closing
    left = F.least(F.lit(length), F.greatest(F.lit(0), F.floor(until_end / MICROS_PER_MINUTE)))
    worked = _pick(day % 7, [int(d in week) for d in range(7)]) * (F.lit(length) - left)
    before = _pick(day % 7, [length * sum(1 for w in week if w < d) for d in range(7)])
    position = int_div(day, 7) * (per_week * length) + before + worked

    last = position + (total - 1)
    index = int_div(last, length)
    end_day = int_div(index, per_week) * 7 + _pick(index % per_week, week) - DAYS_BEFORE_EPOCH
    moment = end_day * MICROS_PER_DAY + hours.start_micros + (last % length + 1) * MICROS_PER_MINUTE
    if total <= length:
        # a span inside one day keeps its seconds
        inside = (_pick(day % 7, [int(d in week) for d in range(7)]) == 1) & (left >= total)
        opened = until_end <= hours.end_micros - hours.start_micros
        moment = F.when(inside & opened, F.unix_micros(local) + total * MICROS_PER_MINUTE).otherwise(moment)
    result = F.timestamp_micros(moment)
    return result if hours.zone.upper() == "UTC" else F.to_utc_timestamp(result, hours.zone)
