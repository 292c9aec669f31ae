"""Judge replies: from free text to a validated span, in built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_JSON = "Decision model did not return JSON."
BAD_JSON = "Decision model returned invalid JSON."


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often and in whichever branch ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(value: Column) -> Column:
    return F.when(value.isNull(), "ABSENT").when(F.is_variant_null(value), "NULL").otherwise(F.schema_of_variant(value))


def _truth(value: Column, kind: Column) -> Column:
    """Python truthiness of a JSON value: the string ``"false"`` is true, empty containers are false."""
    text = value.cast("string")
    return F.coalesce(
        F.when(kind.isin("ABSENT", "NULL"), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(text.try_cast("double") != 0),
        F.lit(False),
    )


def _whole(value: Column, kind: Column) -> Column:
    text = value.cast("string")
    return (
        F.when(kind.isin("ABSENT", "NULL"), F.lit(None).cast("int"))
        .when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0))
        .when(kind == "STRING", F.trim(text).try_cast("int"))
        .otherwise(text.try_cast("double").try_cast("int"))
    )


def _index(value: Column, kind: Column, strict: bool) -> Column:
    whole = _whole(value, kind)
    if not strict:
        return whole
    bad = whole.isNull() & ~kind.isin("ABSENT", "NULL")
    return F.when(bad, F.raise_error(F.concat(F.lit("no index: "), value.cast("string"))).cast("int")).otherwise(whole)


def parse_decision(reply: Column, strict: bool = False) -> Column:
    """The judge's reply as a decision struct.

    The text from the first ``{`` to the last ``}`` is read as JSON. A null reply counts as no JSON. An index that is no
    number becomes null (so the attempt is rejected), or raises when ``strict``.
    """
    reply = F.coalesce(reply, F.lit(""))
    none, no = F.lit(None).cast("int"), F.lit(False)

    def struct(removal: Column, start: Column, end: Column, reason: Column, go_on: Column) -> Column:
        return F.struct(
            removal.alias("has_removal"), start.alias("removed_start_index"), end.alias("removed_end_index"),
            reason.alias("reason"), go_on.alias("can_continue_after_skip"),
        )

    def field(parsed: Column, name: str, read: Callable[[Column, Column], Column]) -> Column:
        return let(F.try_variant_get(parsed, f"$.v.{name}", "variant"), lambda value: let(_kind(value), lambda kind: read(value, kind)))

    def read(parsed: Column) -> Column:
        index = lambda v, k: _index(v, k, strict)
        words = lambda v, k: F.when(k == "ABSENT", "").when(k == "NULL", "None").otherwise(v.cast("string"))
        found = struct(
            field(parsed, "has_removal", _truth),
            field(parsed, "removed_start_index", index),
            field(parsed, "removed_end_index", index),
            field(parsed, "reason", words),
            field(parsed, "can_continue_after_skip", _truth),
        )
        return F.when(parsed.isNull(), struct(no, none, none, F.lit(BAD_JSON), no)).otherwise(found)

    def lone(body: Column) -> Column:
        """The parser stops after one value and takes anything behind it. A body whose only closing bracket is its last letter leaves it
        nothing to stop before the end; any other is a lone value if it also parses in brackets of the other kind."""
        wrapped = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
        listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
        plain = (F.instr(body, "}") == F.length(body)) & (F.instr(body, "]") == 0)
        return F.when((body != "") & (plain | listed.isNotNull()), wrapped)

    without = (F.instr(reply, "{") == 0) | (F.instr(reply, "}") == 0)
    return F.when(without, struct(no, none, none, F.lit(NOT_JSON), no)).otherwise(let(F.regexp_extract(reply, r"(?s)\{.*\}", 0), lambda body: let(lone(body), read)))


def decision_valid(has_removal: Column, start: Column, end: Column, can_continue: Column, units: Column) -> Column:
    """Both flags hold, the inclusive 0-based span is in order and a unit follows it; anything null is invalid.

    ``units`` is the number of units."""
    return F.coalesce(has_removal & can_continue & (start >= 0) & (end >= start) & (end.cast("long") + 1 < units), F.lit(False))


def valid_for(decision: Column, units: Column) -> Column:
    return decision_valid(decision["has_removal"], decision["removed_start_index"], decision["removed_end_index"], decision["can_continue_after_skip"], F.size(units))


def unit_count_gate(units: Column, most: int, least: int = 3) -> Column:
    """Attempts outside ``least <= units <= most`` never reach the judge."""
    return F.coalesce(F.size(units).between(least, most), F.lit(False))
