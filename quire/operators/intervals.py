"""Intervals: merging, complements, windows and packing of lines into them (AGG-F9, LAY-1, LAY-7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(rows: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", slack: float = 0.0) -> DataFrame:
    """AGG-F9: intervals that touch within ``slack`` become one: running maximum, islands, bounds."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(lo) > reach + slack), 1).otherwise(0)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_new", new).withColumn("island", island).groupBy(*keys, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n")).drop("island")


def complement(merged: DataFrame, keys: list[str], first: str, last: str, lo: str = "lo", hi: str = "hi", least: float = 0.0) -> DataFrame:
    """LAY-1: gaps of [first, last] between merged intervals, ``least`` long or more; none if the span is at most 1."""
    w = Window.partitionBy(*keys).orderBy(lo)
    inside = merged.where((F.col(hi) > F.col(first)) & (F.col(lo) < F.col(last)))
    before = inside.select(*keys, F.greatest(F.coalesce(F.lag(hi).over(w), F.col(first)), F.col(first)).alias("lo"), F.least(lo, last).alias("hi"), first, last)
    after = inside.groupBy(*keys).agg(F.greatest(F.max(hi), F.first(first)).alias("lo"), F.first(last).alias("hi"), F.first(first).alias(first), F.first(last).alias(last))
    return before.unionByName(after).where((F.col(last) - F.col(first) > 1) & (F.col("hi") - F.col("lo") >= least) & (F.col("hi") > F.col("lo"))).select(*keys, "lo", "hi")


def pack_lines(windows: DataFrame, keys: list[str], line_height: float, lines: DataFrame) -> DataFrame:
    """LAY-7: place each key's lines into its windows in order, floor(room / line height + 1e-6) a window.

    ``windows`` has the keys, lo and hi; ``lines`` the keys and ``line`` from 0. Gives the window and
    baseline slot of each line; lines beyond the room are left out. Cumulative capacities, no loop.
    """
    w = Window.partitionBy(*keys).orderBy("lo")
    cap = windows.withColumn("cap", F.floor((F.col("hi") - F.col("lo")) / line_height + 1e-6).cast("int")).where("cap > 0")
    cap = cap.withColumn("up", F.sum("cap").over(w)).withColumn("win", F.row_number().over(w) - 1)
    cap = cap.withColumn("down", F.col("up") - F.col("cap"))
    on = [lines[k] == cap[k] for k in keys] + [(lines["line"] >= cap["down"]) & (lines["line"] < cap["up"])]
    return lines.join(cap, on).select(*[lines[k] for k in keys], lines["line"], cap["win"], (cap["lo"] + (lines["line"] - cap["down"]) * line_height).alias("y"))
