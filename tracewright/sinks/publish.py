"""Sinks: the two published tables, JSON payloads and stage reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.rows import mark_removed_units, numbered, prompt_completion
from tracewright.runtime import store
from tracewright.sources.questions import data_set


def publish(rows: DataFrame, root: str, skip_empty: bool = False, private: bool = False, revision: str | None = None) -> str | None:
    """Write ``canonical/train`` and, from what was written, ``training/train`` under ``root`` (a revision lies beside it); both are
    replaced. ``private`` closes the folder to all but its owner. Who may write is up to the file system's own credentials."""
    if skip_empty and rows.isEmpty():
        return None
    root = data_set(root, revision)
    if private:  # closed before anything is in it
        files, where = store(rows.sparkSession, root)
        owner = rows.sparkSession._jvm.org.apache.hadoop.fs.permission.FsPermission("700")
        files.mkdirs(where)
        files.setPermission(where, owner)
    rows.write.mode("overwrite").parquet(f"{root}/canonical/train")
    stored = rows.sparkSession.read.parquet(f"{root}/canonical/train")
    prompt_completion(stored).write.mode("overwrite").parquet(f"{root}/training/train")
    return root


def json_array(rows: DataFrame, indent: str = "") -> Iterator[str]:
    """``rows`` as an indented JSON array, in pieces: the driver holds one partition at a time."""
    before = "["
    for row in rows.toJSON().toLocalIterator():
        yield before + "".join(f"\n{indent}  {line}" for line in json.dumps(json.loads(row), indent=2, ensure_ascii=False).split("\n"))
        before = ","
    yield "[]" if before == "[" else f"\n{indent}]"


def payload(rows: DataFrame) -> Iterator[str]:
    """Both tables as one indented JSON text, in pieces, for dry runs."""
    for head, table in (('{\n  "canonical": ', rows), (',\n  "training": ', prompt_completion(rows))):
        yield head
        yield from json_array(table, "  ")
    yield "\n}"


def payload_json(rows: DataFrame) -> str:
    return "".join(payload(rows))


def stage_report() -> Column:
    """A readable account of one logged attempt (columns of ``plans.replay.logged``)."""
    d, none = F.col("decision"), F.lit("-")
    part = lambda name, body: F.concat(F.lit(f"{name}:\n"), F.coalesce(F.nullif(body, F.lit("")), none))
    word = lambda c: F.coalesce(c.cast("string"), none)
    taken = F.col("status") == "accepted"
    verdict = F.concat(
        F.lit("removal "), word(d["has_removal"]), F.lit(", units "), word(d["removed_start_index"]), F.lit(" to "), word(d["removed_end_index"]),
        F.lit(", goes on "), word(d["can_continue_after_skip"]), F.lit(", because: "), word(d["reason"]),
    )
    why = F.when(F.col("status") == "rejected_unit_count", F.concat(F.lit("rejected: it has "), word(F.size("units")), F.lit(" units")))
    why = why.when(F.col("status") == "rejected_no_span", "rejected: no span that can go with a unit behind it").otherwise(F.concat(F.lit("accepted as row "), word(F.col("row_id"))))
    return F.concat_ws(
        "\n",
        F.format_string("== depth %d, attempt %d ==", "depth", "attempt"),
        part("question", F.col("question")), part("context", F.col("context")), part("trace", F.col("trace")),
        part("units", F.when(taken, mark_removed_units(F.col("units"), d["removed_start_index"], d["removed_end_index"])).otherwise(numbered(F.col("units")))),
        F.when(d.isNotNull(), part("decision", verdict)), F.concat(F.lit("outcome: "), why),
        F.when(taken, part("target", F.get("units", d["removed_end_index"] + 1))), F.when(taken, part("next context", F.col("next_context"))),
        F.when(F.col("stopped"), F.lit("no attempt left: the question stops at this depth")),
    )
