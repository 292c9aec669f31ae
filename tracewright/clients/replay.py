"""Deterministic stand-ins for the models, for tests and for runs over stored answers."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FixedSpanJudge:
    """Removes units ``start`` to ``end`` of every attempt."""

    start: int = 0
    end: int = 0

    def __call__(self) -> Callable[[dict], str]:
        reply = json.dumps({"has_removal": True, "removed_start_index": self.start, "removed_end_index": self.end, "reason": "filler", "can_continue_after_skip": True})
        return lambda row: reply


@dataclass(frozen=True)
class StoredTraces:
    """Answers from a small dict keyed by (question_id, depth, attempt). For tests: a stored corpus is a ``StoredAnswers``."""

    traces: dict[tuple, str]

    def __call__(self) -> Callable[[dict], str | None]:
        return lambda row: self.traces.get((row["question_id"], row["depth"], row["attempt"]))


@dataclass(frozen=True)
class StoredAnswers:
    """Answers from a table of any size, by a join on question_id, depth and attempt; without a stored answer the answer is null."""

    table: DataFrame
    answer: str

    def answers(self, asked: DataFrame, out: str) -> DataFrame:
        key = ["question_id", "depth", "attempt"]
        return asked.join(self.table.select(*key, F.col(self.answer).alias(out)), key, "left").select(*asked.columns, out)
