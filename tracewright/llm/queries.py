"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language, leakage, mixing, packing, pairs, repetition, splits, truncation
from tracewright.oracle import W
from tracewright.runtime import checkpointed, shared_folder


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.same_questions(_read(spark, sf, "questions"))


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Split rows with ``batch`` and ``was``, the split a row's component had after the first batch; and the component table.

    All records come in two batches, as they would in two months: questions and transitions of the earlier half of the time, then the
    rest, against the table that the first left in the shared folder."""
    questions, transitions = _read(spark, sf, "questions"), _read(spark, sf, "transitions")
    records = splits.question_records(questions, transitions)
    times = questions.select(F.lit("questions").alias("table_name"), F.col("question_id").alias("record_id"), F.col("created_at").alias("at"))
    times = times.unionByName(transitions.select(F.lit("transitions").alias("table_name"), F.col("row_no").alias("record_id"), F.col("ingested_at").alias("at")))
    span = times.agg(F.min("at").cast("double").alias("a"), F.max("at").cast("double").alias("b")).first()
    middle = F.lit(((span["a"] or 0) + (span["b"] or 0)) / 2)
    early = times.select("table_name", "record_id", F.coalesce(F.col("at").cast("double") <= middle, F.lit(True)).alias("early"))
    every = checkpointed(records.join(early, ["table_name", "record_id"]).withColumn("counts", F.col("table_name") == "transitions"))
    targets = {r["split_name"]: r["target_share"] for r in _read(spark, sf, "split_targets").collect()}
    folder = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    first = splits.split_into(every.where("early"), targets, folder, "counts")
    before = checkpointed(first.select("table_name", "record_id", F.col("split").alias("was"), F.col("keys")[0].alias("_key")))
    later = splits.split_into(every.where("NOT early"), targets, folder, "counts")
    stored = splits.stored_components(spark, folder)
    now = checkpointed(stored.table())
    again = splits.spread(before, now.withColumnRenamed("node", "_key"), "_key").select("table_name", "record_id", "component", "split", "was", F.lit(1).alias("batch"))
    return again.unionByName(later.select("table_name", "record_id", "component", "split", F.lit(None).cast("string").alias("was"), F.lit(2).alias("batch"))), now


def _split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _batches(spark, sf)[0].where("table_name = 'transitions'")


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split of every transitions row after both batches; rows of a conflict between the batches are in quarantine."""
    return _split_rows(spark, sf).select(F.col("record_id").alias("row_no"), "component", "split", "batch")


def p1_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share each split got."""
    rows = _split_rows(spark, sf).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("component").alias("n_components"))
    total = rows.agg(F.sum("n_rows").alias("all_rows"))
    return rows.join(F.broadcast(total)).select("split", "n_rows", "n_components", (F.col("n_rows") / F.col("all_rows")).alias("share"))


def p1_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold after both batches: every row has one split, no question (by number or text) has rows in two, and of the first batch
    none has moved but into quarantine."""
    rows = checkpointed(_split_rows(spark, sf))
    told = rows.join(_read(spark, sf, "transitions").select(F.col("row_no").alias("record_id"), "question_id", "question"), "record_id")
    apart = lambda c: told.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n"))
    one = lambda name, df: df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"))
    moved = F.col("was").isNotNull() & (F.col("was") != F.col("split")) & (F.col("split") != splits.QUARANTINE)
    return (
        one("rows", rows.agg(F.countDistinct("record_id").alias("n")))
        .unionByName(one("rows without a split", rows.agg(F.count(F.when(F.col("split").isNull(), 1)).alias("n"))))
        .unionByName(one("questions apart by number", apart("question_id")))
        .unionByName(one("questions apart by text", apart("question")))
        .unionByName(one("moved", rows.agg(F.count(F.when(moved, 1)).alias("n"))))
    )


def p2_repetition(spark: SparkSession, sf: str) -> DataFrame:
    """Share of repeated words of every trace, and what line-first cleaning removes."""
    return repetition.repetition(_read(spark, sf, "transitions"), "row_no", "generated_trace")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The traces that cleaning rejects, as it would take too much of them, and of these the ones in which it is repetition that goes."""
    return p2_repetition(spark, sf).where("rejected").where("repeated_share > 0.35").select("row_no")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    training = _read(spark, sf, "training").select(F.lit("training").alias("pair_table"), F.col("training_id").alias("pair_id"), "source", "prompt", "completion")
    transitions = _read(spark, sf, "transitions").select(F.lit("transitions").alias("pair_table"), F.col("row_no").alias("pair_id"), "source", F.col("input_x").alias("prompt"), F.col("target_y").alias("completion"))
    asked = _read(spark, sf, "questions").withColumn("said", F.concat_ws("\n", "question", "reference_solution"))
    sample = language.labelled_sample(asked, "question_id", "said", language.normal_label(F.col("lang")))  # four languages, of the pairs' kind
    sample += language.labelled_sample(_read(spark, sf, "documents"), "doc_id", "text", language.normal_label(F.col("lang")))  # all seven
    field = language.fit(sample)
    return pairs.defective_pairs(training.unionByName(transitions), field)


def _cut_values(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.stacked(_read(spark, sf, "transitions"), "row_no", "source", ["generated_trace", "target_y"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_cut_values(spark, sf)).select("row_no", "field_name")


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts each field."""
    values = _cut_values(spark, sf)
    return truncation.cut_rates(values, truncation.truncated(values))


def p4_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Hidden storage limits by source and field."""
    return truncation.hidden_limits(_cut_values(spark, sf))


def _training_items(spark: SparkSession, sf: str) -> DataFrame:
    both = packing.word_count(F.col("prompt")) + packing.word_count(F.col("completion"))
    return _read(spark, sf, "training").select(F.col("training_id").alias("item_id"), both.alias("words"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(_training_items(spark, sf), _read(spark, sf, "containers"))
    return packing.split_items(packed).select("container_kind", F.col("item_id").alias("training_id"))


def p5_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Container and position of every piece of every item."""
    return packing.pack(_training_items(spark, sf), _read(spark, sf, "containers")).withColumnRenamed("item_id", "training_id")


def p5_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Containers used and space unused."""
    kinds = _read(spark, sf, "containers")
    return packing.usage(packing.pack(_training_items(spark, sf), kinds), kinds)


def p5_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every packing: each item whole and once, in as few pieces as its kind allows, no container over its capacity, no
    place taken twice."""
    kinds, items = _read(spark, sf, "containers"), _training_items(spark, sf)
    packed = checkpointed(packing.pack(items, kinds))
    capacity = F.broadcast(kinds.select("container_kind", F.col("capacity_words").alias("capacity")))
    held = packed.groupBy("container_kind", "container_id").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.countDistinct("position").alias("places"), F.max("position").alias("last")).join(capacity, "container_kind")
    bad = held.groupBy("container_kind").agg(F.count(F.when((F.col("words") > F.col("capacity")) | (F.col("n") != F.col("places")) | (F.col("n") != F.col("last")), 1)).alias("bad_containers"))
    each = packed.groupBy("container_kind", "item_id").agg(F.sum("words").alias("got"), F.count("*").alias("pieces")).join(items, "item_id").join(capacity, "container_kind")
    least = F.greatest(F.lit(1), F.ceil(F.col("words") / F.col("capacity")))
    wrong = each.groupBy("container_kind").agg(F.count("*").alias("items"), F.sum("got").alias("words"), F.sum("pieces").alias("pieces"), F.count(F.when((F.col("got") != F.col("words")) | (F.col("pieces") != least), 1)).alias("bad_items"))
    return wrong.join(bad, "container_kind")


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items that leaked: in how many documents, and the longest verbatim match."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("verbatim_words").alias("longest_match"))


def p6_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The documents without a leaked passage."""
    documents = _read(spark, sf, "documents")
    return leakage.without_leaks(documents.select("doc_id"), _leaks(spark, sf))


def p7_uses(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is used."""
    return mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))[1]


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of every mix: no document beyond the cap of its source, no document of another source used, and every source that
    has documents within a hundredth of what it was to give."""
    uses, report = mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"))
    caps = _read(spark, sf, "mix_targets").select("source", "max_repeats")
    over = uses.join(F.broadcast(caps), "source").groupBy("source").agg(F.count(F.when(F.col("uses") > F.col("max_repeats"), 1)).alias("n"))
    planned = report.where("max_repeats IS NOT NULL").join(over, "source", "left")
    return planned.select("source", "target_share", "documents", F.coalesce("n", F.lit(0)).alias("documents_over_cap"), "met")


def _languages(spark: SparkSession, sf: str, stretches: bool = False) -> DataFrame:
    documents = _read(spark, sf, "documents")
    return language.detect(documents, "doc_id", "text", language.fit_documents(documents), "lang", stretches=stretches)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.mislabelled(_languages(spark, sf), "doc_id", "lang").select("doc_id", "lang")


def p8_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The main language of every text, its confidence, and how many languages the text has."""
    main = F.get("languages", F.lit(0))
    return _languages(spark, sf).select("doc_id", main["lang"].alias("lang"), main["confidence"].alias("confidence"), F.size("languages").alias("n_languages"))


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of every text, by words, with its language and confidence."""
    return _languages(spark, sf, True).select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_splits": p1_splits,
    "p1_shares": p1_shares,
    "p1_checks": p1_checks,
    "p2_found": p2_found,
    "p2_repetition": p2_repetition,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p4_limits": p4_limits,
    "p5_found": p5_found,
    "p5_packed": p5_packed,
    "p5_usage": p5_usage,
    "p5_checks": p5_checks,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p6_kept": p6_kept,
    "p7_uses": p7_uses,
    "p7_shares": p7_shares,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_documents": p8_documents,
    "p8_segments": p8_segments,
}

_TRACE_WORDS = r"""WITH w AS (SELECT row_no, regexp_extract_all(regexp_replace(lower(generated_trace), '(^|\n)[ \t]*([-*•]+|\(?\d{1,3}[.)]+)(\s|$)', '\1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM transitions),
g AS (SELECT row_no, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT row_no, w, unnest(range(1, len(w) - 2)) AS i FROM w)),
r AS (SELECT row_no, i FROM g QUALIFY row_number() OVER (PARTITION BY row_no, g ORDER BY i) > 1),
c AS (SELECT row_no, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY row_no)"""

_ITEM_WORDS = f"(coalesce(len(regexp_extract_all(prompt, '[^{W}]+')), 0) + coalesce(len(regexp_extract_all(completion, '[^{W}]+')), 0))"

ORACLE: dict[str, str] = {
    "p5_checks": f"""SELECT container_kind, count(*) AS items, sum(w)::BIGINT AS words, sum(greatest(1, ceil(w / capacity_words)))::BIGINT AS pieces, 0 AS bad_containers, 0 AS bad_items
 FROM (SELECT training_id, {_ITEM_WORDS} AS w FROM training), containers GROUP BY container_kind""",
    "p1_checks": """SELECT 'rows' AS "check", count(DISTINCT row_no) AS n FROM transitions UNION ALL SELECT * FROM (VALUES ('rows without a split', 0), ('questions apart by number', 0), ('questions apart by text', 0), ('moved', 0))""",
    "p7_checks": "SELECT t.source, target_share, count(doc_id) AS documents, 0 AS documents_over_cap, count(doc_id) > 0 AS met FROM mix_targets t LEFT JOIN documents d ON d.source = t.source GROUP BY ALL",
    "p5_found": f"SELECT container_kind, training_id FROM training, containers WHERE {_ITEM_WORDS} > capacity_words",
    "p2_found": f"{_TRACE_WORDS} SELECT row_no FROM c JOIN w USING (row_no) WHERE n > 0.35 * len(w)",
}
