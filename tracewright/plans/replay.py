"""Closed form of the construction loop over stored attempts: no iteration, two shuffles on the question key.

``attempts`` has one row per (question_id, depth, attempt) with question, trace and the judge's decision struct. The first
valid attempt at each depth wins; the first depth without one ends the question; accepted units carry forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.decision import unit_count_gate, valid_for
from tracewright.functions.text import split_units, stable_row_id
from tracewright.operators.rows import advance_context, context_delta, format_context, transition_rows, with_units
from tracewright.plans.config import BuildConfig


def split_attempts(attempts: DataFrame, config: BuildConfig) -> DataFrame:
    """Attempts within the limits, with their units."""
    limits = (F.col("attempt") >= 1) & (F.col("attempt") <= config.max_retries_per_depth) & (F.col("depth") >= 0) & (F.col("depth") < config.depths)
    return attempts.where(limits).withColumn("units", split_units(F.col("trace"), config.unit_split_strategy))


def attempt_status(config: BuildConfig) -> Column:
    gate = unit_count_gate(F.col("units"), config.max_units_per_batch)
    return F.when(~gate, "rejected_unit_count").when(~valid_for(F.col("decision"), F.col("units")), "rejected_no_span").otherwise("accepted")


def first_valid_attempt(attempts: DataFrame, config: BuildConfig) -> DataFrame:
    """One row per (question_id, depth) that has a valid attempt: the earliest."""
    valid = split_attempts(attempts, config).where(attempt_status(config) == "accepted")
    payload = F.struct("question", "trace", "units", "decision", "attempt")
    return valid.groupBy("question_id", "depth").agg(F.min_by(payload, "attempt").alias("w")).select("question_id", "depth", "w.*")


def with_contexts(winners: DataFrame) -> DataFrame:
    """Keep the unbroken run of depths from 0 and give each the context its generator saw."""
    by_depth = Window.partitionBy("question_id").orderBy("depth")
    d = F.col("decision")
    delta = context_delta(F.col("units"), d["removed_start_index"], d["removed_end_index"])
    before = F.flatten(F.collect_list(delta).over(by_depth.rowsBetween(Window.unboundedPreceding, -1)))
    asked = F.first("question").over(by_depth)
    return (
        winners.withColumn("rank", F.row_number().over(by_depth) - 1)
        .withColumn("context", format_context(asked, before))
        .withColumn("question", asked)
        .where(F.col("rank") == F.col("depth"))
        .drop("rank")
    )


def replay_rows(attempts: DataFrame, config: BuildConfig, revision: str | None = None, *keep: str) -> DataFrame:
    return transition_rows(
        with_contexts(first_valid_attempt(attempts, config)),
        F.lit(config.round_id), F.lit(str(config.generator["model_id"])), F.lit(revision), F.lit(str(config.decision["model_id"])), *(keep or ("question_id",)),
    )


#: What is told of every attempt, behind question_id.
LOG_DDL = """depth INT, attempt INT, question STRING, context STRING, trace STRING, units ARRAY<STRING>,
decision STRUCT<has_removal BOOLEAN, removed_start_index INT, removed_end_index INT, reason STRING, can_continue_after_skip BOOLEAN>,
status STRING, row_id STRING, next_context STRING, stopped BOOLEAN"""


def logged(tried: DataFrame, config: BuildConfig) -> DataFrame:
    """The log of attempts that have status, stopped and ``accepted``, the units accepted before: an accepted attempt also has the id of
    its row and the context that follows. ``stopped`` marks the attempt after which the question was given up."""
    d = F.col("decision")
    s, e, taken = d["removed_start_index"], d["removed_end_index"], F.col("status") == "accepted"
    follows = format_context(F.col("question"), advance_context(F.col("accepted"), F.col("units"), s, e))
    row = stable_row_id(F.lit(config.round_id), F.col("question"), F.col("depth"), s, e)
    return tried.select(
        "question_id", F.col("depth").cast("int").alias("depth"), F.col("attempt").cast("int").alias("attempt"), "question", "context", "trace", "units", "decision", "status",
        F.when(taken, row).alias("row_id"), F.when(taken, follows).alias("next_context"), "stopped",
    )


def audit(attempts: DataFrame, config: BuildConfig) -> DataFrame:
    """One row per attempt the loop really makes, as ``logged``; attempts after the winner or after a failed depth don't happen."""
    tried = split_attempts(attempts, config).withColumn("status", attempt_status(config))
    d = F.col("decision")
    by_question = Window.partitionBy("question_id").orderBy("depth", "attempt")
    before = by_question.rowsBetween(Window.unboundedPreceding, -1)
    accepted = F.col("status") == "accepted"
    delta = F.when(accepted, context_delta(F.col("units"), d["removed_start_index"], d["removed_end_index"]))
    at_depth = Window.partitionBy("question_id", "depth")
    happened = (
        tried.withColumns({"won_at": F.min(F.when(accepted, F.col("attempt"))).over(at_depth), "last": F.max("attempt").over(at_depth)})
        .where(F.col("won_at").isNull() | (F.col("attempt") <= F.col("won_at")))
        .withColumns({"done": F.coalesce(F.sum(accepted.cast("int")).over(before), F.lit(0)), "accepted": F.flatten(F.collect_list(delta).over(before)), "question": F.first("question").over(by_question)})
        .where(F.col("done") == F.col("depth"))
    )
    told = happened.withColumns({"context": format_context(F.col("question"), F.col("accepted")), "stopped": F.col("won_at").isNull() & (F.col("attempt") == F.col("last"))})
    return logged(told, config)


def round_summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("depth", "status").agg(F.count("*").alias("attempts"), F.countDistinct("question_id").alias("questions"))


def context_breaks(rows: DataFrame, key: str = "question_id", *order: str) -> DataFrame:
    """Rows whose successor's context is not ``input_x``, a line break and ``target_y``; none in a sound table, in which
    ``pruning_depth`` is order enough."""
    follows = F.lead("context_before_generation").over(Window.partitionBy(key).orderBy(*(order or ("pruning_depth",))))
    expected = with_units(F.col("input_x"), F.array("target_y"))
    return rows.withColumn("next_context", follows).where(F.col("next_context").isNotNull() & ~F.col("next_context").eqNullSafe(expected))
