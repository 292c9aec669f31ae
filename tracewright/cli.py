"""``python -m tracewright.cli build|inspect|trace --config FILE``: run the construction loop with the configured models.

``build`` publishes the rows, or prints them with ``--dry-run``; ``inspect`` prints the first rows; ``trace`` tells every stage of every
attempt at one question. Without its settings file a command runs on the fallback settings and the environment.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tracewright.clients.registry import generator_from, judge_from
from tracewright.plans.config import FALLBACK, BuildConfig, build_config_or, load_env_file
from tracewright.plans.live import build_rows
from tracewright.runtime import session
from tracewright.sinks.publish import json_array, payload, publish, stage_report
from tracewright.sources.questions import load_questions, pick

#: Options by name; those in ``EVERYWHERE`` belong to all commands.
OPTIONS = {
    "--config": {}, "--prompts-dir": {"default": "prompts"}, "--limit": {"type": int}, "--dry-run": {"action": "store_true"}, "--out": {}, "--question": {},
    "--question-index": {"type": int, "default": 0}, "--max-depth": {"type": int}, "--max-retries": {"type": int},
}
EVERYWHERE = ("--config", "--prompts-dir", "--limit")
Result = tuple[DataFrame, DataFrame]


def _shown(rows: DataFrame, limit: int | None) -> DataFrame:
    """Rows as they are printed: in the order of questions and depths, ``limit`` of them."""
    ordered = rows.orderBy("question_id", "pruning_depth")
    return (ordered if limit is None else ordered.limit(limit)).drop("question_id")


def _build(result: Result, args: argparse.Namespace, config: BuildConfig) -> Iterable[str]:
    rows = result[0]
    if args.dry_run:
        return payload(_shown(rows, args.limit))
    kept = rows.drop("question_id") if args.limit is None else _shown(rows, args.limit)  # a table needs no order
    return [str(publish(kept, args.out or config.hub_dataset_id, private=config.private))]


def _inspect(result: Result, args: argparse.Namespace, config: BuildConfig) -> Iterable[str]:
    return json_array(_shown(result[0], 5 if args.limit is None else args.limit))


def _trace(result: Result, args: argparse.Namespace, config: BuildConfig) -> Iterable[str]:
    for told in result[1].orderBy("question_id", "depth", "attempt").select(stage_report().alias("r")).toLocalIterator():
        yield told["r"] + "\n\n"
    yield from json_array(_shown(result[0], args.limit))


@dataclass(frozen=True)
class Command:
    run: Callable[[Result, argparse.Namespace, BuildConfig], Iterable[str]]
    options: tuple[str, ...] = ()


COMMANDS = {
    "build": Command(_build, ("--dry-run", "--out")),
    "inspect": Command(_inspect),
    "trace": Command(_trace, ("--question", "--question-index", "--max-depth", "--max-retries")),
}


def arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tracewright", description=__doc__)
    chosen = parser.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        sub = chosen.add_parser(name)
        for option in (*EVERYWHERE, *command.options):
            sub.add_argument(option, **OPTIONS[option])
    return parser.parse_args(argv)


def settings(args: argparse.Namespace) -> BuildConfig:
    """The settings of a run; what is asked on the command line wins."""
    config = build_config_or(args.config, FALLBACK)
    if depth := getattr(args, "max_depth", None):
        config = replace(config, max_pruning_depth=depth, max_examples_per_question=depth)
    if retries := getattr(args, "max_retries", None):
        config = replace(config, max_retries_per_depth=retries)
    return config


def questions(spark: SparkSession, args: argparse.Namespace, config: BuildConfig) -> DataFrame:
    if args.command != "trace":
        return load_questions(spark, config)
    if args.question:
        return spark.createDataFrame([(0, args.question)], "ord BIGINT, question STRING")
    return pick(load_questions(spark, config), args.question_index)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    load_env_file(".env")
    args = arguments(argv)
    spark = spark or session("tracewright-cli")
    try:
        config = settings(args)
        models = generator_from(config.generator, config.generation, config.max_units_per_batch), judge_from(config.decision, config.pruning, args.prompts_dir)
        result = build_rows(questions(spark, args, config).withColumnRenamed("ord", "question_id"), *models, config)
        for piece in COMMANDS[args.command].run(result, args, config):
            sys.stdout.write(piece)
        sys.stdout.write("\n")
    except RuntimeError as problem:
        print(problem, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
