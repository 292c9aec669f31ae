"""The construction loop with live models: breadth first, one generator and one judge stage per (depth, retry).

Pending questions form a frontier table. Each round asks the generator for the pending ones only, gates, asks the judge for what
passed the gate, and moves accepted questions to the next depth. At most ``depths * retries`` rounds, whatever the number of
questions. Model answers are checkpointed at once, so a lost executor or a second action never repeats a call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.decision import parse_decision, unit_count_gate, valid_for
from tracewright.functions.text import split_units
from tracewright.operators.rows import CANONICAL_DDL, advance_context, format_context, numbered, transition_rows
from tracewright.plans.config import BuildConfig
from tracewright.plans.replay import LOG_DDL, logged
from tracewright.runtime import checkpointed

#: Per task: a function from one row's fields to a text. One with ``concurrent`` set may be called from several threads at once.
#: A client with a method ``answers(rows, out)`` gives all answers as a table instead.
ClientFactory = Callable[[], Callable[[dict], str | None]]


def ask(df: DataFrame, client: ClientFactory, fields: list[str], out: str, calls: int = 1) -> DataFrame:
    """``df`` with the client's answer per row; answers are written to the shared folder at once. One client per task, with ``calls``
    calls under way where it is ``concurrent``."""
    if hasattr(client, "answers"):
        return checkpointed(client.answers(df, out))
    side_by_side = calls if getattr(client, "concurrent", False) else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = client()
        with ThreadPoolExecutor(side_by_side) as pool:
            for batch in batches:
                rows = batch[fields].to_dict("records")
                got = list(pool.map(answer, rows) if side_by_side > 1 else map(answer, rows))
                yield batch.assign(**{out: pd.Series(got, index=batch.index, dtype=object)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {out} string"
    return checkpointed(df.mapInPandas(run, schema))


def build_rows(questions: DataFrame, generator: ClientFactory, judge: ClientFactory, config: BuildConfig, revision: str | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Canonical rows (with question_id) and the log of all attempts, with the columns of ``plans.replay.audit``.

    ``questions`` has question_id and question; ``generator`` sees question_id, depth, attempt, context; ``judge`` sees those and
    question, trace and the numbered units."""
    spark = questions.sparkSession
    tasks = config.parallel_tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    frontier = questions.select("question_id", "question", F.array().cast("array<string>").alias("accepted"))
    rows, log = [], []
    for depth in range(config.depths):
        pending = checkpointed(frontier.withColumn("depth", F.lit(depth)).withColumn("context", format_context(F.col("question"), F.col("accepted"))).repartition(tasks, "question_id"))
        won = []
        for attempt in range(1, config.max_retries_per_depth + 1):
            asked = ask(pending.withColumn("attempt", F.lit(attempt)), generator, ["question_id", "depth", "attempt", "context"], "trace", config.calls_per_task)
            split = asked.withColumn("units", split_units(F.col("trace"), config.unit_split_strategy)).withColumn("reached", unit_count_gate(F.col("units"), config.max_units_per_batch))
            split = split.withColumn("listed", numbered(F.col("units")))
            judged = ask(split.where("reached"), judge, ["question_id", "question", "depth", "attempt", "context", "trace", "listed"], "reply", config.calls_per_task)
            tried = checkpointed(judged.withColumn("decision", parse_decision(F.col("reply"), strict)).withColumn("ok", valid_for(F.col("decision"), F.col("units"))))
            last = F.lit(attempt == config.max_retries_per_depth)
            short = split.where("not reached").withColumns({"decision": F.lit(None).cast(tried.schema["decision"].dataType), "status": F.lit("rejected_unit_count"), "stopped": last})
            seen = tried.withColumns({"status": F.when(F.col("ok"), "accepted").otherwise("rejected_no_span"), "stopped": last & ~F.col("ok")})
            log += [logged(x, config) for x in (short, seen)]
            won.append(tried.where("ok"))
            if attempt < config.max_retries_per_depth:
                pending = checkpointed(pending.join(won[-1].select("question_id"), "question_id", "left_anti"))
                if pending.isEmpty():
                    break
        winners = reduce(DataFrame.unionByName, won)
        rows.append(transition_rows(winners, F.lit(config.round_id), F.lit(str(config.generator["model_id"])), F.lit(revision), F.lit(str(config.decision["model_id"])), "question_id"))
        d = F.col("decision")
        frontier = checkpointed(winners.select("question_id", "question", advance_context(F.col("accepted"), F.col("units"), d["removed_start_index"], d["removed_end_index"]).alias("accepted")))
        if frontier.isEmpty():
            break
    kind = questions.schema["question_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"question_id {kind}, {CANONICAL_DDL}")
    nothing = spark.createDataFrame([], f"question_id {kind}, {LOG_DDL}")
    return reduce(DataFrame.unionByName, rows, empty), reduce(DataFrame.unionByName, log, nothing)
