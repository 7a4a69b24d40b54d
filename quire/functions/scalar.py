"""Small numbers, times and labels of the job panel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_timeout(v: Column) -> Column:
    """MTH-1: whole minutes from 10 to 1440, 240 if there is none."""
    return F.least(F.greatest(F.floor(F.coalesce(v, F.lit(240.0)) + 0.5), F.lit(10)), F.lit(1440)).cast("int")


def clamp_shrink(v: Column) -> Column:
    """MTH-1: 0 to 3 in steps of 0.5, 1.5 if there is none."""
    return F.least(F.greatest(F.floor(F.coalesce(v, F.lit(1.5)) * 2 + 0.5) / 2, F.lit(0.0)), F.lit(3.0))


def progress(status: Column, stored: Column, elapsed: Column) -> Column:
    """MTH-2: 1 when done, what is stored when failed, else the stored share below 0.98 or a slow creep."""
    creep = F.least(F.greatest(elapsed / 120000.0, F.lit(0.02)), F.lit(0.15))
    return F.when(status == "done", F.lit(1.0)).when(status == "failed", F.coalesce(stored, F.lit(0.0))).when(stored > 0, F.least(stored, F.lit(0.98))).otherwise(creep)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def millis(ts: Column) -> Column:
    return F.floor(micros(ts) / 1000).cast("long")


def elapsed_ms(created: Column, ended: Column, now: Column) -> Column:
    """DAT-1."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(ended, now) - created)


def beijing(ms: Column) -> Column:
    """DAT-2: MM/dd HH:mm eight hours east."""
    return F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "Asia/Shanghai"), "MM/dd HH:mm")


def elapsed_label(ms: Column) -> Column:
    """DAT-3."""
    s = F.floor(ms / 1000 + 0.5).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))


def context_label(n: Column) -> Column:
    """DAT-4: no signs between thousands."""
    return F.when(n >= 1048576, F.concat(F.translate(F.format_number(n / 1048576, 1), ",", ""), F.lit("M"))).when(n.isNotNull(), F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit("k")))


def stage_share(stage: Column, done: Column, total: Column, before: Column) -> Column:
    """STM-2: the share a stage stands for; others, and steps under 0.005, keep what was."""
    new = F.when(stage == "extract", F.lit(0.03)).when(stage == "translate", 0.05 + 0.87 * F.least(F.lit(1.0), F.when(total > 0, done / total).otherwise(0.0))).when(stage == "render", F.lit(0.95)).otherwise(before)
    return F.when(F.abs(new - before) >= 0.005, new).otherwise(before)
