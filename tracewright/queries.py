"""One query per operator over the test tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.clients.replay import StoredAnswers
from tracewright.functions import text as T
from tracewright.functions.decision import decision_valid, parse_decision, unit_count_gate
from tracewright.operators import rows as R
from tracewright.operators.checks import broken_targets, depth_gaps, row_contract
from tracewright.plans import replay as P
from tracewright.plans.config import BuildConfig
from tracewright.plans.live import build_rows
from tracewright.runtime import checkpointed
from tracewright.sinks.publish import stage_report
from tracewright.sources import questions as S

CONFIG = BuildConfig(
    round_id="r-test", source_dataset="-", hub_dataset_id="-", generator={"model_id": "gen"}, decision={"model_id": "judge"},
    max_pruning_depth=2, max_examples_per_question=2, max_retries_per_depth=2, max_units_per_batch=6,
)
TEMPLATE = "v={prompt_version} {{json}}\nQ: {question}\nC: {context}\n{reasoning_units}\n"


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _decision(start: Column, end: Column) -> Column:
    return F.struct(
        F.lit(True).alias("has_removal"), start.cast("int").alias("removed_start_index"), end.cast("int").alias("removed_end_index"),
        F.lit("filler").alias("reason"), F.lit(True).alias("can_continue_after_skip"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Stored attempts: a run's traces in order, two attempts a depth, with the run's first question; even runs lose unit 0, odd ones
    units 1 to 3."""
    in_run = Window.partitionBy("run_no").orderBy("pruning_depth", "row_no")
    place = F.row_number().over(in_run) - 1
    odd = F.pmod("run_no", F.lit(2))
    return (
        _read(spark, sf, "transitions")
        .select("run_no", F.first("question").over(in_run).alias("question"), F.col("generated_trace").alias("trace"), place.alias("n"))
        .select(
            F.col("run_no").alias("question_id"), F.floor(F.col("n") / 2).cast("int").alias("depth"), (F.col("n") % 2 + 1).alias("attempt"),
            "question", "trace", _decision(odd, odd * 3).alias("decision"),
        )
    )


def _flat(rows: DataFrame) -> DataFrame:
    """Canonical rows with lists and metadata as scalars."""
    return rows.select(
        "question_id", "id", "question", "context_before_generation", "generated_trace", F.array_join("generated_units", "|").alias("generated_units"),
        "input_x", "target_y", "pruning_depth", F.col("metadata.generator_model").alias("generator_model"), F.col("metadata.decision_model").alias("decision_model"),
        F.array_join("metadata.removed_span", "|").alias("removed_span"), F.col("metadata.removed_start_index").alias("removed_start_index"),
        F.col("metadata.removed_end_index").alias("removed_end_index"), F.col("metadata.decision_reason").alias("decision_reason"),
        F.col("metadata.retry_attempts").alias("retry_attempts"),
    )


def src_text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.text_lines(_read(spark, sf, "documents"), "text", "doc_id")


def source_limit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "questions").select(F.col("question_id").alias("ord"), S.table_questions(_read(spark, sf, "questions").drop("input_mode")).alias("question"))
    asked = rows.where("question <> ''")
    return S.limited(asked, 25).select(F.lit("first").alias("kept"), "ord", "question").unionByName(S.limited(asked, -100).select(F.lit("all_but_last").alias("kept"), "ord", "question"))


def pick_by_index(spark: SparkSession, sf: str) -> DataFrame:
    return S.pick(_read(spark, sf, "questions").select(F.col("question_id").alias("ord"), "question"), 11)


def src_jsonl_field(spark: SparkSession, sf: str) -> DataFrame:
    return S.jsonl_field(_read(spark, sf, "events"), "props", "k").select("event_id", "question")


def spectrum_question(spark: SparkSession, sf: str) -> DataFrame:
    q = _read(spark, sf, "questions")
    return q.select("question_id", S.table_questions(q).alias("body"))


def clean_unit(spark: SparkSession, sf: str) -> DataFrame:
    lines = _read(spark, sf, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.clean_unit(F.col("line")).alias("unit"))


def _split(table: str, key: str, text: str, strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _read(spark, sf, table).select(key, F.posexplode(T.split_units(F.col(text), strategy)).alias("unit_no", "unit"))

    return query


def unit_gate(spark: SparkSession, sf: str) -> DataFrame:
    t = _read(spark, sf, "transitions").select("row_no", T.split_units(F.col("generated_trace")).alias("units"))
    return t.where(unit_count_gate(F.col("units"), 6)).select("row_no", F.size("units").alias("n_units"))


def newline_stop(spark: SparkSession, sf: str) -> DataFrame:
    trace = F.col("generated_trace")
    return _read(spark, sf, "transitions").select("row_no", T.newline_count(trace).alias("newlines"), T.stop_at_newlines(trace, 3).alias("stopped"))


def _reply(prose: bool = True) -> Column:
    """A judge's reply per line item: flags and indices in many spellings, some without JSON or cut."""
    flag = F.when(F.col("l_returnflag") == "R", "true").when(F.col("l_returnflag") == "A", '"false"').otherwise("0")
    index = F.col("l_linenumber") - 2
    start = F.when(index == 0, '"0"').when(index == 1, "1.7").when(index == 5, "null").when(index == 2, '"two"').otherwise(index.cast("string"))
    go_on = F.when(F.col("l_linestatus") == "F", '[1]').otherwise("{}")
    body = F.concat(
        F.lit('{"has_removal": '), flag, F.lit(', "removed_start_index": '), start, F.lit(', "removed_end_index": '), (F.col("l_partkey") % 3).cast("string"),
        F.when(F.col("l_suppkey") % 4 == 0, "").when(F.col("l_suppkey") % 4 == 1, ', "reason": null').otherwise(', "reason": "a \\"b\\""'),
        F.lit(', "can_continue_after_skip": '), go_on, F.lit("}"),
    )
    how = F.col("l_orderkey") % 6
    return F.when(how == 0, body).when(how == 1, F.concat(F.lit("Sure:\n"), body, F.lit(" done"))).when(how == 2, "nothing here").when(how == 3, F.substring_index(body, ",", 2)).when(how == 4, F.concat(body, F.lit(" or "), body)).otherwise(F.concat(F.lit("} "), body))


def parse_decision_query(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parse_decision(_reply()).alias("d"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "d.*")


def decision_valid_query(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem")
    start = F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") - 2)
    ok = decision_valid(F.col("l_returnflag") != "A", start, F.col("l_partkey") % 3, F.col("l_linestatus") == "F", F.col("l_quantity").cast("int"))
    return li.groupBy("l_returnflag", "l_linestatus", "l_linenumber", (F.col("l_partkey") % 3).alias("end_index")).agg(F.sum(ok.cast("int")).alias("valid"), F.count("*").alias("replies"))


def decision_prompt(spark: SparkSession, sf: str) -> DataFrame:
    t = _read(spark, sf, "transitions").withColumn("units", T.split_units(F.col("generated_trace")))
    filled = R.decision_prompt(TEMPLATE, prompt_version=F.lit("t1"), question=F.col("question"), context=F.col("context_before_generation"), reasoning_units=R.numbered(F.col("units")))
    return t.select("row_no", filled.alias("prompt"))


def format_context(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "transitions").select("row_no", R.format_context(F.col("question"), F.col("generated_units")).alias("context"))


def advance_context(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    t = _read(spark, sf, "transitions").where(F.size("generated_units") > m["removed_end_index"] + 1)
    return t.select("row_no", F.array_join(R.advance_context(m["removed_span"], F.col("generated_units"), m["removed_start_index"], m["removed_end_index"]), "|").alias("accepted"))


def _direct(spark: SparkSession, sf: str) -> DataFrame:
    """Rows rebuilt from the stored traces and spans, one per transitions row that has a valid span."""
    m = F.col("metadata")
    t = _read(spark, sf, "transitions").select(
        F.col("row_no").alias("question_id"), "question", F.col("context_before_generation").alias("context"), F.col("generated_trace").alias("trace"),
        F.col("generated_units").alias("units"), F.col("pruning_depth").alias("depth"), m["retry_attempts"].alias("attempt"),
        _decision(m["removed_start_index"], m["removed_end_index"]).alias("decision"), "round_id",
    )
    d = F.col("decision")
    t = t.where(decision_valid(d["has_removal"], d["removed_start_index"], d["removed_end_index"], d["can_continue_after_skip"], F.size("units")))
    return R.transition_rows(t, F.col("round_id"), F.lit("gen"), F.lit(None), F.lit("judge"), "question_id")


def transition_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_direct(spark, sf))


def prompt_completion(spark: SparkSession, sf: str) -> DataFrame:
    return R.prompt_completion(_direct(spark, sf)).select("question_id", "prompt", "completion")


def stable_row_id(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    made = T.stable_row_id(F.col("round_id"), F.col("question"), F.col("pruning_depth"), m["removed_start_index"], m["removed_end_index"])
    return _read(spark, sf, "transitions").select("row_no", made.alias("made_id"))


def broken_targets_query(spark: SparkSession, sf: str) -> DataFrame:
    return broken_targets(_read(spark, sf, "transitions")).select("row_no", "target_y", "expected_target")


def depth_gaps_query(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that lack a depth once the rows without a trace or a target are left out."""
    return depth_gaps(_read(spark, sf, "transitions").where("generated_trace IS NOT NULL AND target_y <> ''"), "run_no")


def row_contract_query(spark: SparkSession, sf: str) -> DataFrame:
    checked = row_contract(_read(spark, sf, "transitions"))
    broken = [F.sum(F.col(c).cast("int")).alias(c) for c in ("bad_target", "bad_span", "bad_input", "bad_units")]
    return checked.groupBy("pruning_depth").agg(F.count("*").alias("n_rows"), *broken)


def first_valid_attempt(spark: SparkSession, sf: str) -> DataFrame:
    won = P.first_valid_attempt(attempts(spark, sf), CONFIG)
    return won.select("question_id", "depth", "attempt", "trace", F.size("units").alias("n_units"))


def replay_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(P.replay_rows(attempts(spark, sf), CONFIG))


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.prompt_completion(P.replay_rows(attempts(spark, sf), CONFIG))
    return rows.select("question_id", "pruning_depth", "prompt", "completion")


def context_invariant(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows whose successor in the run doesn't go on from their target: rows delivered twice show here."""
    stored = _read(spark, sf, "transitions")
    return P.context_breaks(stored, "run_no", "pruning_depth", "row_no").select("run_no", "pruning_depth", "row_no", "next_context")


def audit_status(spark: SparkSession, sf: str) -> DataFrame:
    """The log of the replay; question, trace and units are in other queries."""
    return _log(P.audit(attempts(spark, sf), CONFIG))


def _log(log: DataFrame) -> DataFrame:
    return log.select("question_id", "depth", "attempt", "status", F.coalesce(F.size("units"), F.lit(-1)).alias("n_units"), "context", "row_id", "next_context", "stopped")


def stage_report_query(spark: SparkSession, sf: str) -> DataFrame:
    """A readable account of every attempt."""
    return P.audit(attempts(spark, sf), CONFIG).select("question_id", "depth", "attempt", stage_report().alias("report"))


def round_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.round_summary(P.audit(attempts(spark, sf), CONFIG))


def mark_removed_units(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metadata")
    return _read(spark, sf, "transitions").select("row_no", R.mark_removed_units(F.col("generated_units"), m["removed_start_index"], m["removed_end_index"]).alias("shown"))


def model_card(spark: SparkSession, sf: str) -> DataFrame:
    rounds = _read(spark, sf, "rounds")
    counts = _read(spark, sf, "transitions").groupBy("round_id", "pruning_depth").agg(F.count("*").alias("n")).groupBy("round_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("rows_at_"), F.col("pruning_depth").cast("string")), "n"))).alias("metrics"))
    lineage = {"parent_model_id": F.col("generator_model"), "data_revision": F.col("generator_model_revision"), "judge": F.col("decision_model")}
    return rounds.join(counts, "round_id", "left").select("round_id", R.model_card(F.col("round_id"), lineage, F.coalesce("metrics", F.create_map().cast("map<string,bigint>")), F.lit("accepted")).alias("card"))


def camelize_map(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [F.lit("top_k"), F.col("l_linenumber").cast("string"), F.lit("conservative"), F.lit("true"), F.lit("max_output_tokens"), F.when(F.col("l_linenumber") > 2, F.col("l_partkey").cast("string")), F.lit("temperature"), F.lit("0.5")]
    made = R.camelize_config(F.create_map(*pairs))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(made)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", listed.alias("settings"))


def extract_reply_text(spark: SparkSession, sf: str) -> DataFrame:
    part = F.struct(F.col("completion").alias("text"))
    envelope = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part, part).alias("parts")).alias("content"))).alias("candidates")))
    return _read(spark, sf, "training").select("training_id", R.reply_text(F.when(F.col("training_id") % 7 == 0, '{"candidates": []}').otherwise(envelope)).alias("reply"))


def error_message(spark: SparkSession, sf: str) -> DataFrame:
    detail = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("text").alias("message")).alias("error")))).otherwise(F.col("text"))
    return _read(spark, sf, "documents").select("doc_id", R.error_message(detail).alias("message"))


def _live(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The live loop over every run, its models played by the stored attempts: traces for the generator, decisions for the judge."""
    stored = checkpointed(attempts(spark, sf).withColumn("reply", F.to_json("decision")))
    asked = stored.groupBy("question_id").agg(F.min_by("question", F.struct("depth", "attempt")).alias("question"))
    return build_rows(asked, StoredAnswers(stored, "trace"), StoredAnswers(stored, "reply"), CONFIG)


def frontier_loop(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_live(spark, sf)[0])


def frontier_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every attempt of the live loop: too few or many units, refused by the judge, accepted, given up."""
    return _log(_live(spark, sf)[1])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src_text_lines": src_text_lines,
    "source_limit": source_limit,
    "pick_by_index": pick_by_index,
    "src_jsonl_field": src_jsonl_field,
    "spectrum_question": spectrum_question,
    "clean_unit": clean_unit,
    "split_lines": _split("documents", "doc_id", "text", "lines"),
    "split_sentences": _split("documents", "doc_id", "text", "sentences"),
    "split_clauses": _split("documents", "doc_id", "text", "clauses"),
    "split_numbered_or_lines": _split("transitions", "row_no", "generated_trace", "numbered_or_lines"),
    "unit_count_gate": unit_gate,
    "newline_stop": newline_stop,
    "parse_decision": parse_decision_query,
    "decision_valid": decision_valid_query,
    "decision_prompt": decision_prompt,
    "format_context": format_context,
    "advance_context": advance_context,
    "transition_rows": transition_rows,
    "prompt_completion": prompt_completion,
    "stable_row_id": stable_row_id,
    "broken_targets": broken_targets_query,
    "depth_gaps": depth_gaps_query,
    "row_contract": row_contract_query,
    "first_valid_attempt": first_valid_attempt,
    "replay_rows": replay_rows,
    "training_rows": training_rows,
    "context_invariant": context_invariant,
    "audit_status": audit_status,
    "round_summary": round_summary,
    "mark_removed_units": mark_removed_units,
    "model_card": model_card,
    "camelize_map": camelize_map,
    "extract_reply_text": extract_reply_text,
    "error_message": error_message,
    "frontier_loop": frontier_loop,
    "frontier_log": frontier_log,
    "stage_report": stage_report_query,
}
