"""Question sources. All give ``(ord BIGINT, question STRING)``; order is carried in ``ord``, never assumed of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import lines, strip
from tracewright.operators.rows import spectrum_question
from tracewright.plans.config import BuildConfig
from tracewright.runtime import exists

SCHEMA = "ord BIGINT, question STRING"
Loader = Callable[[SparkSession, BuildConfig], DataFrame]


def text_lines(files: DataFrame, text: str = "value", *keep: str) -> DataFrame:
    """Non-blank stripped lines of each text, with their place among its lines."""
    exploded = files.select(*keep, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
    return exploded.select(*keep, F.col("line_no").cast("long").alias("ord"), strip(F.col("line")).alias("question")).where("question <> ''")


def jsonl_field(rows: DataFrame, line: str, field: str) -> DataFrame:
    """``rows`` with ``question`` from a field of a JSON line: blank lines are skipped, null becomes ``None``, empty texts drop.

    A line that is no JSON object, or lacks the field, raises."""
    parsed = F.parse_json(F.when(strip(F.col(line)) != "", F.col(line)))
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    missing = F.raise_error(F.lit(f"missing {field} field")).cast("string")
    text = F.when(value.isNull(), missing).when(F.is_variant_null(value), "None").otherwise(F.try_variant_get(parsed, f"$.{field}", "string"))
    kept = rows.where(strip(F.col(line)) != "")
    return kept.withColumn("question", strip(text)).where("question <> ''")


def table_questions(rows: DataFrame, field: str = "question") -> Column:
    """The question of a row: assembled where the table has an ``input_mode``, else the field; null becomes ``None``."""
    if "input_mode" in rows.columns:
        return spectrum_question(F.col("context"), F.col("question"), F.col("choices"))
    if field not in rows.columns:
        raise ValueError(f"missing {field} field in the question table")
    return strip(F.coalesce(F.col(field).cast("string"), F.lit("None")))


def limited(rows: DataFrame, limit: int | None, order: str = "ord") -> DataFrame:
    """The first ``limit`` rows by ``order``; a negative limit leaves out that many at the end, none keeps all.

    Of rows that tie at the border as many stay as the limit asks for, no matter which."""
    if limit is None:
        return rows
    if limit >= 0:
        return rows.orderBy(order).limit(limit)
    tail = rows.orderBy(F.col(order).desc()).limit(-limit).groupBy(order).agg(F.count("*").alias("n"))
    edge = tail.orderBy(order).first()  # one row: the border, and how many of its ties go
    if edge is None:
        return rows
    at_edge = F.col(order).eqNullSafe(F.lit(edge[order]))
    before = rows.where(F.coalesce(F.col(order) < F.lit(edge[order]), F.col(order).isNull()) & ~at_edge)
    ties = rows.where(at_edge)
    return before.unionByName(ties.limit(ties.count() - edge["n"]))


def pick(rows: DataFrame, index: int, order: str = "ord") -> DataFrame:
    """The row with 0-based place ``index`` by ``order``; raises when there is none."""
    if index < 0:
        raise RuntimeError(f"no question {index}")
    head = rows.orderBy(order).limit(index + 1)
    found = head.orderBy(F.col(order).desc()).limit(1)
    if head.count() <= index:
        raise RuntimeError(f"no question {index}")
    return found


def _file_questions(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Lines of one file of any size, read in blocks. ``ord`` is the line's number in its block and the byte the block begins at, which
    keeps the order of the file, as a line has a byte at least."""
    read = spark.read.text(path).select(F.explode(lines(F.col("value"))).alias("line"), F.col("_metadata.file_block_start").alias("start"))
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = read.select((F.col("start") + in_task).alias("ord"), "line")
    if path.endswith(".jsonl"):
        return jsonl_field(numbered, "line", field).select("ord", "question")
    return numbered.select("ord", strip(F.col("line")).alias("question")).where("question <> ''")


def data_set(root: str, revision: str | None = None) -> str:
    """Where a revision of a data set lies: beside the plain one, as ``<root>@<revision>``."""
    return f"{root}@{revision}" if revision else root


def parquet_loader(spark: SparkSession, config: BuildConfig) -> DataFrame:
    """A published data set on any file system: ``<dataset>[@<revision>][/<subset>]/<split>``, or one Parquet path without subsets and splits."""
    root = data_set(config.source_dataset, config.source_dataset_revision)
    split = "/".join([root, *([config.source_subset] if config.source_subset else []), config.source_split])
    if exists(spark, split):
        return spark.read.parquet(split)
    if config.source_subset or not exists(spark, root):
        raise RuntimeError(f"there is no data set at {split}, and no other loader was given")
    return spark.read.parquet(root)


def load_questions(spark: SparkSession, config: BuildConfig, loader: Loader | None = None) -> DataFrame:
    """Questions of the configured source. A missing local file gives none; an unknown source raises before planning.

    A table source needs an ``ord`` column for a defined order; without one, rows are numbered as they are read."""
    if config.source_type == "local_file":
        path = config.source_questions_path
        if path is None or not exists(spark, path):
            return spark.createDataFrame([], SCHEMA)
        return limited(_file_questions(spark, path, config.source_question_field), config.source_limit)
    if config.source_type == "hf_dataset":
        rows = (loader or parquet_loader)(spark, config)
        place = F.col("ord").cast("long") if "ord" in rows.columns else F.monotonically_increasing_id()
        asked = rows.select(place.alias("ord"), table_questions(rows, config.source_question_field).alias("question")).where("question <> ''")
        return limited(asked, config.source_limit)
    raise ValueError(f"unknown source_type: {config.source_type}")


def training_rows(spark: SparkSession, root: str, revision: str | None = None) -> DataFrame:
    """Published training rows, of a revision if one is named."""
    return spark.read.parquet(f"{data_set(root, revision)}/training/train")
