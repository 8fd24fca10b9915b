"""Steps of a time grid: fixed ones (``1 day``, ``15 minutes``) and calendar ones (``month end``, ``week tue``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(lo: Column, hi: Column, step: str) -> Column:
    """Array of the grid's times from ``lo`` to ``hi``; calendar steps start at their first anchor."""
    if step == "month end":
        ends = F.transform(F.sequence(F.date_trunc("month", lo), hi, F.expr("interval 1 month")), lambda t: F.last_day(t).cast("timestamp"))
        return F.filter(ends, lambda t: (t >= lo) & (t <= hi))
    if step.startswith("week "):
        first = F.next_day(F.date_sub(lo.cast("date"), 1), step.split()[1]).cast("timestamp")
        return F.when(first <= hi, F.sequence(first, hi, F.expr("interval 7 days"))).otherwise(F.array().cast("array<timestamp>"))
    return F.sequence(lo, hi, F.expr(f"interval {step}"))


def micros(step: str) -> Column | None:
    """Length of a fixed step in microseconds; None for calendar steps."""
    if step == "month end" or step.startswith("week ") or step.split()[-1].rstrip("s") in ("month", "quarter", "year"):
        return None
    return F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {step})")


def bin_start(ts: Column, step: str) -> Column:
    """Start of the left-closed bin of ``ts``: fixed steps from the epoch, or a calendar unit."""
    unit = step.split()[-1].rstrip("s")
    if step.split()[0] == "1" and unit in ("day", "hour", "minute", "week", "month", "quarter", "year"):
        return F.date_trunc(unit, ts)
    return F.window(ts, step)["start"]


def following(ts: Column, n: Column | int, step: str) -> Column:
    """The time ``n`` steps on."""
    n = F.lit(n) if isinstance(n, int) else n
    if step == "month end":
        return F.last_day(F.add_months(ts.cast("date"), n)).cast("timestamp")
    if step.startswith("week "):
        step = "7 days"
    return ts + F.expr(f"interval {step}") * n
