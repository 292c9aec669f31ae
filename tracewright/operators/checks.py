"""Checks of stored transition tables against the row contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.decision import decision_valid
from tracewright.functions.text import split_units
from tracewright.operators.rows import prefix, with_units


def broken_targets(rows: DataFrame) -> DataFrame:
    """Rows whose target isn't the unit after the removed span, with the target expected. Rows without units are left out."""
    expected = F.get("generated_units", F.col("metadata.removed_end_index") + 1)
    return rows.where(F.col("generated_units").isNotNull()).withColumn("expected_target", expected).where(~F.col("target_y").eqNullSafe(F.col("expected_target")))


def depth_gaps(rows: DataFrame, key: str) -> DataFrame:
    """Runs whose depths aren't 0, 1, ... without a gap."""
    out = rows.groupBy(key).agg(F.countDistinct("pruning_depth").alias("depths"), F.max("pruning_depth").alias("deepest"))
    return out.where(F.col("depths") != F.col("deepest") + 1)


def row_contract(rows: DataFrame, strategy: str = "numbered_or_lines") -> DataFrame:
    """Each row with what it breaks: ``bad_target``, ``bad_span``, ``bad_input`` (not context and useful prefix), ``bad_units`` (not the
    split of the trace). Anything null that can't be compared counts as broken, but for units and trace that are both null."""
    m = F.col("metadata")
    s, e, units = m["removed_start_index"], m["removed_end_index"], F.col("generated_units")
    yes = F.lit(True)
    span = decision_valid(yes, s, e, yes, F.size(units))
    return rows.withColumns(
        {
            "bad_target": ~F.coalesce(F.get(units, e + 1) == F.col("target_y"), F.lit(False)),
            "bad_span": ~span,
            "bad_input": ~F.coalesce(F.when(span, with_units(F.col("context_before_generation"), prefix(units, s)) == F.col("input_x")), F.lit(False)),
            "bad_units": ~split_units(F.col("generated_trace"), strategy).eqNullSafe(units),
        }
    )
