"""The replay plan and the live loop against a plain sequential loop."""

import dataclasses
import threading

import pytest
from pyspark.sql import functions as F

from tracewright.clients.replay import FixedSpanJudge, StoredAnswers, StoredTraces
from tracewright.plans import replay as P
from tracewright.plans.config import BuildConfig
from tracewright.plans.live import ask, build_rows
from tracewright.runtime import checkpointed, exists, forget, shared_folder

CONFIG = BuildConfig("r", "-", "-", {"model_id": "g"}, {"model_id": "d"}, max_pruning_depth=3, max_examples_per_question=2, max_retries_per_depth=2, max_units_per_batch=4, unit_split_strategy="lines")
TRACES = {(1, 0, 1): "a\nb", (1, 0, 2): "a\nb\nc", (1, 1, 1): "d\ne\nf\ng", (1, 2, 1): "x\ny\nz", (2, 0, 1): "p\nq\nr", (2, 0, 2): "unused\nunused\nunused",
          (2, 1, 1): None, (2, 1, 2): "1\n2\n3\n4\n5", (3, 1, 1): "a\nb\nc", (4, 0, 1): "", (5, 0, 1): "u\nv\nw"}
QUESTIONS = {1: "one?", 2: "two?", 3: "three?", 4: "", 5: "two?"}


def sequential():
    rows, log = [], []
    for q, text in QUESTIONS.items():
        accepted = []
        for depth in range(2):
            context = "Question:\n" + text + "".join("\n" + u for u in accepted)
            won = None
            for attempt in (1, 2):
                units = [x for x in (TRACES.get((q, depth, attempt)) or "").split("\n") if x]
                ok = 3 <= len(units) <= 4
                log.append((q, depth, attempt, "accepted" if ok else "rejected_unit_count"))
                if ok:
                    won = attempt, units
                    break
            if not won:
                break
            rows.append((q, depth, context, context, won[1][1], won[0]))
            accepted.append(won[1][1])
    return sorted(rows), sorted(log)


def flat(rows):
    return sorted((r.question_id, r.pruning_depth, r.context_before_generation, r.input_x, r.target_y, r.metadata.retry_attempts) for r in rows.collect())


@pytest.fixture(scope="module")
def stored(spark):
    every = [(q, d, a, QUESTIONS[q], TRACES.get((q, d, a))) for q in QUESTIONS for d in range(3) for a in (1, 2)]
    span = F.struct(F.lit(True).alias("has_removal"), F.lit(0).alias("removed_start_index"), F.lit(0).alias("removed_end_index"), F.lit("filler").alias("reason"), F.lit(True).alias("can_continue_after_skip"))
    return spark.createDataFrame(every, "question_id int, depth int, attempt int, question string, trace string").withColumn("decision", span).withColumn("id", F.lit("clash"))


def test_replay_is_the_loop(stored):
    assert flat(P.replay_rows(stored, CONFIG)) == sequential()[0]


def test_live_is_the_loop(spark):
    asked = spark.createDataFrame(list(QUESTIONS.items()), "question_id int, question string")
    rows, log = build_rows(asked, StoredTraces(TRACES), FixedSpanJudge(), dataclasses.replace(CONFIG, parallel_tasks=2))
    want_rows, want_log = sequential()
    assert flat(rows) == want_rows
    assert sorted((r.question_id, r.depth, r.attempt, r.status) for r in log.collect()) == want_log
    assert P.context_breaks(rows).count() == 0


class Together:
    """Answers only once four calls are under way."""

    concurrent = True

    def __call__(self):
        barrier = threading.Barrier(4)
        return lambda row: f"{barrier.wait(30)}"


def test_calls_run_side_by_side(spark):
    asked = spark.range(4).repartition(1)
    assert sorted(r.out for r in ask(asked, Together(), ["id"], "out", 4).collect()) == ["0", "1", "2", "3"]


def test_stored_answers_play_the_models(spark, stored):
    """The live loop over stored attempts tells what the replay tells, also of attempts that the judge refuses."""
    odd = stored.withColumn("decision", F.when(F.col("question_id") == 5, F.col("decision").withField("removed_end_index", F.lit(2))).otherwise(F.col("decision")))
    table = odd.withColumn("reply", F.to_json("decision"))
    asked = spark.createDataFrame(list(QUESTIONS.items()), "question_id int, question string")
    rows, log = build_rows(asked, StoredAnswers(table, "trace"), StoredAnswers(table, "reply"), CONFIG)
    assert flat(rows) == flat(P.replay_rows(odd, CONFIG))
    told = lambda df: sorted(tuple(r[c] for c in ("question_id", "depth", "attempt", "status", "context", "row_id", "next_context", "stopped")) for r in df.collect())
    key = lambda rows: [tuple(str(x) for x in r) for r in rows]
    assert key(told(log)) == key(told(P.audit(odd, CONFIG)))
    assert {r.status for r in log.collect()} == {"accepted", "rejected_unit_count", "rejected_no_span"}
    assert {r.row_id for r in log.where("status = 'accepted'").collect()} == {r.id for r in rows.collect()}


def test_audit(stored):
    assert sorted((r.question_id, r.depth, r.attempt, r.status) for r in P.audit(stored, CONFIG).collect()) == sequential()[1]


def test_empty(spark, stored):
    assert P.replay_rows(stored.limit(0), CONFIG).count() == 0
    rows, log = build_rows(spark.createDataFrame([], "question_id int, question string"), StoredTraces({}), FixedSpanJudge(), CONFIG)
    assert rows.count() == log.count() == 0


def test_context_break_is_found(stored):
    rows = P.replay_rows(stored, CONFIG).withColumn("target_y", F.lit("other"))
    assert [r.question_id for r in P.context_breaks(rows).collect()] == [1]


def test_checkpoint_folder(spark):
    assert shared_folder(spark)
    kept = checkpointed(spark.range(3))
    assert kept.count() == 3
    file = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    assert exists(spark, file)
    forget(kept)
    assert not exists(spark, file)
    with pytest.raises(ValueError):
        forget(spark.range(3))
