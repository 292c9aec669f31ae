"""Text expressions against Python's own string methods and ``re``."""

import hashlib
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import text as T

HARD = [None, "", " ", "\x1c a \x85", "a\r\nb\x0bc d\x1ee", "1. one\n2) two", "- x\n* y", "٣. x", "5 x 4 = 20.", "3.5 liters", "12-15 pages", "10", "1)", "Foo... Bar!? baz",
        "$1.50 is it. ", "a, but b so c; so-called d, and e and f", "ünd so ß so, however Ü", "​x﻿", "a" * 40000, "soß so oḱ so", 'q"\\\n\t\r\b\f\x7f é 😀  ']
LINE = re.compile(r"^\s*(?:[-*]\s+|\d+[\).\s-]+)")
free, comma = "|".join(T.CLAUSE_OPENERS), "|".join(T.CLAUSE_OPENERS_AFTER_COMMA)


def py_lines(x):
    return [u for u in (LINE.sub("", line).strip() for line in x.splitlines()) if u]


def py_sentences(x):
    return [s for m in re.finditer(r"[^.!?]+[.!?]|[^.!?]+$", x) if (s := m[0].strip())]


def py_clauses(x):
    return [p for line in py_lines(x) for c in re.split(rf"(?i)(?:,\s*|\s+)(?=(?:{free})\b)|,\s*(?=(?:{comma})\b)", line) if (p := c.strip())]


EXPECTED = {"lines": py_lines, "sentences": py_sentences, "clauses": py_clauses, "numbered_or_lines": lambda x: u if len(u := py_lines(x)) > 1 else py_sentences(x)}


def run(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expr(F.col("t")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


@pytest.mark.parametrize("strategy", sorted(EXPECTED))
def test_splitters(spark, strategy):
    got = run(spark, HARD, lambda c: T.split_units(c, strategy))
    assert got == [None if x is None else EXPECTED[strategy](x) for x in HARD]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Mn", "Me", "Mc", "Cn", "No"]) | st.sampled_from("\n\r ,.!?-*1 \x1c")), min_size=30, max_size=30))
def test_random_texts(spark, texts):
    for strategy, want in EXPECTED.items():
        assert run(spark, texts, lambda c, s=strategy: T.split_units(c, s)) == [want(x) for x in texts]
    assert run(spark, texts, T.strip) == [x.strip() for x in texts]
    assert run(spark, texts, T.ascii_json_string) == [json.dumps(x) for x in texts]


def test_row_ids(spark):
    def want(q):
        key = {"round_id": "r", "question": q, "depth": 1, "removed_start_index": 0, "removed_end_index": 2}
        return "pt-" + hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:16]

    assert run(spark, HARD, lambda c: T.stable_row_id(F.lit("r"), c, F.lit(1), F.lit(0), F.lit(2))) == [want(x) for x in HARD]


def test_unknown_strategy():
    with pytest.raises(ValueError):
        T.split_units(None, "words")


def test_newlines(spark):
    texts = ["a\nb\nc", "", None, "\n\n"]
    assert run(spark, texts, T.newline_count) == [2, 0, None, 2]
    assert run(spark, texts, lambda c: T.stop_at_newlines(c, 1)) == ["a", "", None, ""]
