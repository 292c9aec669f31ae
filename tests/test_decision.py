import pytest
from pyspark.sql import functions as F

from tracewright.functions.decision import BAD_JSON, NOT_JSON, decision_valid, parse_decision

CASES = {
    None: (False, None, None, NOT_JSON, False),
    "": (False, None, None, NOT_JSON, False),
    "{": (False, None, None, NOT_JSON, False),
    "} {": (False, None, None, BAD_JSON, False),
    "{}": (False, None, None, "", False),
    "x {'has_removal': true} y": (False, None, None, BAD_JSON, False),
    '{"has_removal": 1} {"a": 2}': (False, None, None, BAD_JSON, False),
    '{"a": 1}, {"b": 2}': (False, None, None, BAD_JSON, False),
    '{"has_removal": "false", "removed_start_index": "1", "removed_end_index": 1.7, "reason": null, "can_continue_after_skip": [0]}': (True, 1, 1, "None", True),
    '{"has_removal": "", "removed_start_index": true, "removed_end_index": -1, "reason": "é\\n", "can_continue_after_skip": {}}': (False, 1, -1, "é\n", False),
    '{"has_removal": 0.0, "removed_start_index": "two", "removed_end_index": [1]}': (False, None, None, "", False),
    'Sure: {"has_removal": true, "removed_start_index": 0, "removed_end_index": 0, "reason": "{x}", "can_continue_after_skip": true} done': (True, 0, 0, "{x}", True),
}


def test_replies(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(CASES)], "i int, t string").select("i", parse_decision(F.col("t")).alias("d"))
    assert [tuple(r["d"]) for r in df.orderBy("i").collect()] == list(CASES.values())


def test_strict_raises(spark):
    df = spark.createDataFrame([('{"removed_start_index": "two"}',)], "t string").select(parse_decision(F.col("t"), strict=True).alias("d"))
    with pytest.raises(Exception, match="no index"):
        df.collect()


def test_validity(spark):
    rows = [(True, 0, 0, True, 2, True), (True, 0, 1, True, 2, False), (True, -1, 0, True, 5, False), (True, 2, 1, True, 5, False), (False, 0, 0, True, 5, False), (True, 0, 0, False, 5, False), (None, 0, 0, True, 5, False), (True, None, 0, True, 5, False), (True, 0, None, True, 5, False), (True, 0, 2147483647, True, 5, False)]
    df = spark.createDataFrame(rows, "h boolean, s int, e int, c boolean, n int, want boolean")
    assert df.where(decision_valid(F.col("h"), F.col("s"), F.col("e"), F.col("c"), F.col("n")) != F.col("want")).count() == 0
