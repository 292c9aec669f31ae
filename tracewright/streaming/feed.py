"""Structured Streaming forms: attempts that keep arriving, and counts by time window with late data.

An unbounded feed can't use the replay plan's windows, so each micro-batch of complete questions goes through it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import split_units


def split_stream(traces: DataFrame, strategy: str = "numbered_or_lines") -> DataFrame:
    """Units of a stream of traces; stateless."""
    return traces.withColumn("units", split_units(F.col("generated_trace"), strategy))


def delivered_once(rows: DataFrame, key: list[str], time: str, lateness: str) -> DataFrame:
    """Drop redelivered rows that come within ``lateness`` of the first."""
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def yield_by_window(rows: DataFrame, time: str, width: str, lateness: str) -> DataFrame:
    """Rows and units per window and depth; windows close after ``lateness``."""
    return (
        rows.withWatermark(time, lateness)
        .groupBy(F.window(time, width).alias("window"), "pruning_depth")
        .agg(F.count("*").alias("rows"), F.sum(F.size("units")).alias("units"))
        .select(F.col("window.start").alias("window_start"), "pruning_depth", "rows", "units")
    )


def replay_batches(plan: Callable[[DataFrame], DataFrame], root: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: run ``plan`` on each batch into a folder of its own, so a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return sink
