"""Builders of contexts, transition rows, training rows and the judge's prompt, as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import stable_row_id, strip
from tracewright.functions.wire import LOCAL_ONLY, SETTING_NAMES

# --- fixed value: how a training prompt ends ---
CONTINUE = "\n\nContinue with the next useful reasoning step:"

CANONICAL_DDL = """id STRING, question STRING, context_before_generation STRING, generated_trace STRING, generated_units ARRAY<STRING>,
input_x STRING, target_y STRING, pruning_depth INT, metadata STRUCT<generator_model STRING, generator_model_revision STRING,
decision_model STRING, removed_span ARRAY<STRING>, removed_start_index INT, removed_end_index INT, decision_reason STRING, retry_attempts INT>"""


def with_units(text: Column, units: Column) -> Column:
    return F.when(F.size(units) > 0, F.concat(text, F.lit("\n"), F.array_join(units, "\n"))).otherwise(text)


def format_context(question: Column, accepted_units: Column) -> Column:
    return with_units(F.concat(F.lit("Question:\n"), question), accepted_units)


def prefix(units: Column, start: Column) -> Column:
    return F.slice(units, F.lit(1), start)


def removed(units: Column, start: Column, end: Column) -> Column:
    return F.slice(units, start + 1, end - start + 1)


def target(units: Column, end: Column) -> Column:
    return F.get(units, end + 1)


def context_delta(units: Column, start: Column, end: Column) -> Column:
    """What one accepted attempt adds to the context: the useful prefix and the unit after the removed span."""
    return F.concat(prefix(units, start), F.array(target(units, end)))


def advance_context(accepted: Column, units: Column, start: Column, end: Column) -> Column:
    return F.concat(accepted, context_delta(units, start, end))


def spectrum_question(context: Column, question: Column, choices: Column) -> Column:
    """Context, question and options joined by blank lines. Only these three columns are read, never an answer.

    A blank context is left out; a null question, label or option text is written ``None``."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    bare = strip(context)
    option = lambda c: F.concat(F.lit("("), word(c["label"]), F.lit(") "), word(c["text"]))
    return F.concat_ws(
        "\n\n",
        F.when(bare != "", bare),
        strip(word(question)),
        F.when(F.size(choices) > 0, F.concat(F.lit("Options:\n"), F.array_join(F.transform(choices, option), "\n"))),
    )


def transition_rows(attempts: DataFrame, round_id: Column, generator_model: Column, revision: Column, decision_model: Column, *keep: str) -> DataFrame:
    """Canonical rows of valid attempts.

    ``attempts`` has question, context, trace, units, depth, attempt and decision; callers keep valid decisions only.
    Columns named in ``keep`` come along in front."""
    d = F.col("decision")
    s, e, units = d["removed_start_index"], d["removed_end_index"], F.col("units")
    text = lambda c: c.cast("string")
    return attempts.select(
        *keep,
        stable_row_id(round_id, F.col("question"), F.col("depth"), s, e).alias("id"),
        "question",
        F.col("context").alias("context_before_generation"),
        F.col("trace").alias("generated_trace"),
        units.alias("generated_units"),
        with_units(F.col("context"), prefix(units, s)).alias("input_x"),
        target(units, e).alias("target_y"),
        F.col("depth").cast("int").alias("pruning_depth"),
        F.struct(
            text(generator_model).alias("generator_model"), text(revision).alias("generator_model_revision"), text(decision_model).alias("decision_model"),
            removed(units, s, e).alias("removed_span"), s.alias("removed_start_index"), e.alias("removed_end_index"),
            d["reason"].alias("decision_reason"), F.col("attempt").cast("int").alias("retry_attempts"),
        ).alias("metadata"),
    )


def prompt_completion(rows: DataFrame) -> DataFrame:
    """Training rows: the canonical row with ``prompt`` and ``completion``."""
    return rows.withColumn("prompt", F.concat("input_x", F.lit(CONTINUE))).withColumn("completion", F.col("target_y"))


def numbered(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u, i: F.concat(i.cast("string"), F.lit(": "), u)), "\n")


def decision_prompt(template: str, **values: Column) -> Column:
    """``template`` with its ``{name}`` fields filled once; braces in the values stay as they are, ``{{`` is a brace."""
    parts: list[Column] = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name not in values or spec or conversion:
            raise ValueError(f"the template has an unknown field: {name}")
        parts.append(values[name])
    return F.concat(*parts) if parts else F.lit("")


def mark_removed_units(units: Column, start: Column, end: Column) -> Column:
    """One line per unit, removed ones marked."""
    line = lambda u, i: F.concat(F.when(i.between(start, end), "  ✗").otherwise("   "), F.lit(" "), i.cast("string"), F.lit(": "), u)
    return F.array_join(F.transform(units, line), "\n")


def camelize_config(config: Column) -> Column:
    """Generation settings as the REST service names them; local-only keys and nulls are left out."""
    names = F.create_map(*[F.lit(x) for pair in SETTING_NAMES.items() for x in pair])
    kept = F.map_filter(config, lambda k, v: ~k.isin(LOCAL_ONLY) & v.isNotNull())
    return F.transform_keys(kept, lambda k, v: F.coalesce(names[k], k))


REPLY_DDL = "candidates ARRAY<STRUCT<content STRUCT<parts ARRAY<STRUCT<text STRING>>>>>"


def reply_text(envelope: Column) -> Column:
    """Text of the first candidate of a REST reply; anything missing gives the empty string."""
    parts = F.get(F.from_json(envelope, REPLY_DDL)["candidates"], F.lit(0))["content"]["parts"]
    return F.coalesce(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit(""))


def error_message(detail: Column) -> Column:
    """``error.message`` of a REST error, or the first 500 characters."""
    message = F.try_variant_get(F.try_parse_json(detail), "$.error.message", "string")
    return F.coalesce(F.nullif(message, F.lit("")), F.substring(detail, 1, 500))


def model_card(model_id: Column, lineage: dict[str, Column], metrics: Column, reason: Column, heading: str = "Lineage") -> Column:
    """A markdown card: lineage fields in the order given, metrics ordered by name (a placeholder if there are none), the reason."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    entry = lambda m: F.concat(F.lit("- "), m["key"], F.lit(": "), word(m["value"]))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(metrics)), entry), "\n")
    fields = [F.concat(F.lit(f"- {name}: "), word(value)) for name, value in lineage.items()]
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), word(model_id)),
        F.lit(f"## {heading}"),
        F.concat_ws("\n", *fields),
        F.lit("## Evaluation Results"),
        F.coalesce(F.nullif(listed, F.lit("")), F.lit("- no evaluation metrics recorded")),
        F.lit("## Acceptance Reason"),
        F.concat(F.coalesce(reason, F.lit("")), F.lit("\n")),
    )
