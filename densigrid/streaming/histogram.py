"""Histograms of streams: counts are additive, so the state of a stream is the histogram itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.operators.occupancy import binned, histogram
from densigrid.plans.grid import Goal


def stream_histogram(events: DataFrame, goal: Goal, values: dict[str, Column]) -> DataFrame:
    """cell, cnt of a stream so far; write it in update or complete mode."""
    return histogram(binned(events, goal, values), goal)


def windowed_histogram(events: DataFrame, goal: Goal, values: dict[str, Column], time: str, width: str, late: str) -> DataFrame:
    """window, cell, cnt: a histogram for each time window; rows later than ``late`` are left out and their state is dropped."""
    rows = binned(events.withWatermark(time, late), goal, values, [time])
    flat = rows.where("status = 'valid'").select(time, *[F.col("cell")[k].alias(f"b{k}") for k in range(len(goal.axes))])
    names = [f"b{k}" for k in range(len(goal.axes))]
    return flat.groupBy(F.window(time, width).alias("window"), *names).agg(F.count("*").alias("cnt")).select("window", F.array(*names).alias("cell"), "cnt")
