"""Train, validation and test splits that keep related records together.

Records carry keys; records that share a key, directly or through others, form a component. The component table is kept and grows by
what each batch adds: its keys, a name for each component that took on another name, and rows for the components that are new or changed.
A batch brings its keys to the components that have them, and only these and the new keys are linked: links hook components to their
smallest neighbour, pointer jumping flattens the trees, and the links between what remains go into the next round. A component with a
split keeps it. One that joins components of different splits is quarantined. New ones fill what the splits lack of their shares.

Keys are nodes, so copies and hot keys cost one node; the few keys and components that hold much of the rows are joined by broadcast.
Every round is written to the shared folder, and deleted there when the next one stands. Nothing that grows with the data is collected:
the driver sees the few components above a fixed share of all records, and totals of a fixed number of buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions.text import strip
from tracewright.llm.questions import question_keys
from tracewright.llm.truncation import INVISIBLE
from tracewright.operators.rows import spectrum_question
from tracewright.runtime import checkpointed, exists, forget, store

QUARANTINE = "quarantine"
BUCKETS, LARGE, HOT = 1024, 1 / 2000, 64


def _flattened(parents: DataFrame) -> DataFrame:
    """``node, root`` from ``node, parent``: pointers jump to their parent's parent until none moves."""
    current, written = parents, None
    while True:
        up = current.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = checkpointed(current.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("next"), "parent"))
        if written is not None:
            forget(written)
        if jumped.where("next <> parent").isEmpty():
            return jumped.select("node", F.col("parent").alias("root"))
        current, written = jumped.select("node", F.col("next").alias("parent")), jumped


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b BIGINT); a component is named by its smallest node."""
    whole = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = checkpointed(whole.select(F.col("a").alias("node")).union(whole.select("b")).distinct().select("node", F.col("node").alias("component")))
    edges = whole.where("a <> b")
    while not edges.isEmpty():
        hooked = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        roots = edges.select(F.col("a").alias("node")).distinct().join(hooked, "node", "left_anti").select("node", F.col("node").alias("parent"))
        tree = checkpointed(hooked.unionByName(roots))
        flat = checkpointed(_flattened(tree))
        left, right = flat.select(F.col("node").alias("a"), F.col("root").alias("x")), flat.select(F.col("node").alias("b"), F.col("root").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        next_labels = checkpointed(labels.join(flat.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        next_whole = checkpointed(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        forget(labels, whole, tree, flat)
        labels, whole, edges = next_labels, next_whole, next_whole
    return labels


def key_links(records: DataFrame) -> DataFrame:
    """A link from a record's first key to each of its keys, itself too."""
    return records.select(F.col("keys")[0].alias("a"), F.explode("keys").alias("b")).distinct()


def spread(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """``big`` joined with ``small``, which has each key once. Keys with more than 1/``HOT`` of the rows, at most ``HOT`` of them, are joined by
    broadcast, so no task gets all their rows; without such keys it is a plain join."""
    counts = big.groupBy(key).agg(F.count("*").alias("n"))
    least = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) / HOT
    hot = [r[0] for r in counts.where(F.col("n") > max(least, HOT)).select(key).collect()]
    if not hot:
        return big.join(small, key)
    return big.where(~F.col(key).isin(hot)).join(small, key).unionByName(big.where(F.col(key).isin(hot)).join(F.broadcast(small.where(F.col(key).isin(hot))), key))


@dataclass(frozen=True)
class Components:
    """The component table, or what a batch adds to it.

    ``nodes``: node, component as it was named when the node came. ``names``: component, its name since a later batch; an old name has one
    row. ``splits``: component, split, n records, batch: a row for each batch that changed it, of which the last has the split and all
    together the records."""

    nodes: DataFrame
    names: DataFrame
    splits: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Components:
        none = lambda ddl: spark.createDataFrame([], ddl)
        return Components(none("node bigint, component bigint"), none("component bigint, name bigint"), none("component bigint, split string, n bigint, batch bigint"))

    def plus(self, more: Components) -> Components:
        return Components(self.nodes.unionByName(more.nodes), self.names.unionByName(more.names), self.splits.unionByName(more.splits))

    def named(self) -> DataFrame:
        """``component, name``: the present name of every old one."""
        final = self.names.select(F.col("component").alias("node"), F.col("name").alias("parent"))
        ends = self.names.select(F.col("name").alias("node")).join(self.names.select(F.col("component").alias("node")), "node", "left_anti").distinct()
        return _flattened(final.unionByName(ends.select("node", F.col("node").alias("parent")))).select(F.col("node").alias("component"), F.col("root").alias("name"))

    def present(self, nodes: DataFrame | None = None) -> DataFrame:
        """``node, component`` under their present names, of all nodes or of ``nodes`` (node)."""
        some = self.nodes if nodes is None else self.nodes.join(nodes, "node")
        return some.join(self.named(), "component", "left").select("node", F.coalesce("name", "component").alias("component"))

    def states(self) -> DataFrame:
        """``component, split, n`` under present names; what was merged is in the component it went to."""
        last = self.splits.groupBy("component").agg(F.max_by("split", "batch").alias("split"), F.sum("n").alias("n"))
        return last.join(self.names.select("component"), "component", "left_anti")

    def table(self) -> DataFrame:
        """``node, component, split`` of every node."""
        return spread(self.present(), self.states().select("component", "split"), "component")


def assign_splits(state: DataFrame, held: dict[str, int], targets: dict[str, float]) -> DataFrame:
    """``component, split`` for the new components of ``state`` (component, n records): those without a split.

    ``held`` has the records that every split (and the quarantine) holds. Large components go, biggest first, where most is lacking; the
    others, in the order of a hash, fill what is still lacking one split after the other. A component larger than any split's share
    still stays whole."""
    fresh = state.withColumn("h", F.xxhash64("component"))
    coming = fresh.agg(F.sum("n").alias("n")).first()["n"] or 0
    total = sum(held.values()) - held.get(QUARANTINE, 0) + coming
    share = sum(targets.values()) or 1.0
    lacking = {s: t / share * total - held.get(s, 0) for s, t in targets.items()}
    least = max(1, int(total * LARGE))
    placed: list[tuple[int, str]] = []
    for r in sorted(fresh.where(F.col("n") > least).select("component", "n").collect(), key=lambda r: (-r["n"], r["component"])):
        best = max(lacking, key=lambda s: (lacking[s], s))
        lacking[best] -= r["n"]
        placed.append((r["component"], best))
    rest = fresh.where(F.col("n") <= least).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    before, starts = 0, []
    for r in sorted(rest.groupBy("bucket").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["bucket"]):
        starts.append((r["bucket"], before))
        before += r["n"]
    spark = state.sparkSession
    offsets = spark.createDataFrame(starts, "bucket bigint, start bigint")
    inside = Window.partitionBy("bucket").orderBy("h", "component").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    wanted = {s: max(0.0, x) for s, x in lacking.items()}
    scale = before / sum(wanted.values()) if sum(wanted.values()) else 0.0
    edge, names = 0.0, sorted(wanted)
    chosen = F.lit(names[-1])
    bounds = []
    for s in names:
        edge += wanted[s] * scale
        bounds.append((edge, s))
    for top, s in reversed(bounds[:-1]):
        chosen = F.when(F.col("place") + F.col("n") / 2 < top, s).otherwise(chosen)
    filled = rest.join(F.broadcast(offsets), "bucket").withColumn("place", place).select("component", chosen.alias("split"))
    return spark.createDataFrame(placed, "component bigint, split string").unionByName(filled)


def update(keys: DataFrame, targets: dict[str, float], stored: Components | None = None, batch: int = 1) -> tuple[DataFrame, Components]:
    """``node, component, split`` for every node of a batch of records, and what the batch adds to the stored table.

    ``keys`` has keys ARRAY<BIGINT>, not empty, and n, the record's weight in the shares (0 or 1). Of the stored table the batch reads the
    rows of its own keys and of the components they belong to; no stored row is linked or written again."""
    spark = keys.sparkSession
    stored = stored or Components.empty(spark)
    links = checkpointed(key_links(keys))
    nodes = links.select(F.col("b").alias("node")).distinct()
    known = checkpointed(stored.present(nodes))
    if known.isEmpty():
        labels = connected(links)
    else:
        root = known.select(F.col("node"), F.col("component").alias("root"))
        ends = links.join(root.toDF("a", "x"), "a", "left").join(root.toDF("b", "y"), "b", "left")
        merged = connected(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
        at = nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("key"))
        labels = checkpointed(at.join(merged.withColumnRenamed("node", "key"), "key").select("node", "component"))
    old = known.select(F.col("component").alias("name")).distinct().join(labels.select(F.col("node").alias("_n"), "component").join(known.select(F.col("node").alias("_n"), F.col("component").alias("name")), "_n").select("name", "component").distinct(), "name")
    old = checkpointed(old.join(stored.states().withColumnRenamed("component", "name"), "name"))
    weights = spread(keys.groupBy(F.col("keys")[0].alias("node")).agg(F.sum("n").alias("n")), labels, "node").groupBy("component").agg(F.sum("n").alias("n"))
    came = old.groupBy("component").agg(F.sort_array(F.collect_set("split")).alias("had"), F.sum("n").alias("n_old"))
    kept = F.when(F.size("had") == 1, F.col("had")[0]).when(F.size("had") > 1, F.lit(QUARANTINE))
    state = checkpointed(weights.join(came, "component", "left").select("component", "n", F.coalesce("n_old", F.lit(0)).alias("n_old"), kept.alias("kept")))
    held = {r["split"]: r["n"] for r in stored.splits.groupBy("component").agg(F.max_by("split", "batch").alias("split"), F.sum("n").alias("n")).join(stored.names.select("component"), "component", "left_anti").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    for r in old.groupBy("split").agg(F.sum("n").alias("n")).collect():
        held[r["split"]] = held.get(r["split"], 0) - r["n"]
    for r in state.where("kept IS NOT NULL").groupBy("kept").agg(F.sum(F.col("n") + F.col("n_old")).alias("n")).collect():
        held[r["kept"]] = held.get(r["kept"], 0) + r["n"]
    fresh = assign_splits(state.where("kept IS NULL").select("component", "n"), held, targets)
    splits = checkpointed(state.where("kept IS NOT NULL").select("component", F.col("kept").alias("split")).unionByName(fresh))
    moved = old.where("name <> component").select(F.col("name").alias("component"), F.col("component").alias("name")).distinct()
    # a component's row has what came in with the batch, and what came from components that it took in; its own records are in earlier rows
    own = old.where("name = component").select("component", F.col("n").alias("own"))
    rows = state.join(own, "component", "left").join(splits, "component").select("component", "split", (F.col("n") + F.col("n_old") - F.coalesce("own", F.lit(0))).alias("n"), F.lit(batch).cast("long").alias("batch"))
    added = Components(labels.join(known, "node", "left_anti").select("node", "component"), moved, rows)
    return checkpointed(spread(labels, splits, "component")), added


def split_records(records: DataFrame, targets: dict[str, float], stored: Components | None = None, counted: str | None = None, batch: int = 1) -> tuple[DataFrame, Components]:
    """Records with ``component`` and ``split``, and what they add to the component table.

    ``records`` has keys and any other columns; a record without keys must be given one of its own. ``counted`` names a boolean column:
    only records where it holds count towards the shares. Columns ``component`` and ``split`` of the records are replaced."""
    records = checkpointed(records.drop("component", "split", "_key"))
    weight = F.col(counted).cast("long") if counted else F.lit(1).cast("long")
    nodes, added = update(records.select("keys", weight.alias("n")), targets, stored, batch)
    return spread(records.withColumn("_key", F.col("keys")[0]), nodes.withColumnRenamed("node", "_key"), "_key").drop("_key"), added


PARTS = ("nodes", "names", "splits")


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """Whole versions in ``folder``, and whether each stands for all before it. ``splits`` is written last."""
    if not exists(spark, folder):
        return []
    files, where = store(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(where)]
    good = [n for n in names if n[:1] in "vw" and n[1:].isdigit() and exists(spark, f"{folder}/{n}/{PARTS[-1]}/_SUCCESS")]
    return sorted((int(n[1:]), n[0] == "w") for n in good)


def stored_components(spark: SparkSession, folder: str) -> Components | None:
    """The component table kept in ``folder``: its newest whole version and what came after; None where there is none yet."""
    versions = _versions(spark, folder)
    if not versions:
        return None
    since = max((v for v, whole in versions if whole), default=0)
    used = [f"{folder}/{'w' if whole else 'v'}{v}" for v, whole in versions if v > since or (v == since and whole)]
    return Components(*(spark.read.parquet(*[f"{u}/{part}" for u in used]) for part in PARTS))


def _write(table: Components, folder: str) -> None:
    for part in PARTS:
        getattr(table, part).write.mode("overwrite").parquet(f"{folder}/{part}")


def compact(spark: SparkSession, folder: str) -> None:
    """Write the kept table anew as one version, without old names; earlier versions stay for readers."""
    versions, table = _versions(spark, folder), stored_components(spark, folder)
    if table is None:
        return
    whole = Components(table.present(), table.names.limit(0), table.states().withColumn("batch", F.lit(versions[-1][0]).cast("long")))
    _write(whole, f"{folder}/w{versions[-1][0]}")


def split_into(records: DataFrame, targets: dict[str, float], folder: str, counted: str | None = None, compact_every: int = 16) -> DataFrame:
    """``split_records`` against the table kept in ``folder``, to which the batch adds a version; now and then it is written anew."""
    spark = records.sparkSession
    number = max((v for v, _ in _versions(spark, folder)), default=0) + 1
    split, added = split_records(records, targets, stored_components(spark, folder), counted, number)
    _write(added, f"{folder}/v{number}")
    if number % compact_every == 0:
        compact(spark, folder)
    return split


def _text_key(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), f"[\\s\\p{{Z}}{INVISIBLE}]+", "")
    return F.when(strip(text) != "", F.xxhash64(F.lit("text"), bare))


def question_records(questions: DataFrame, transitions: DataFrame) -> DataFrame:
    """Keys of both tables: ``table_name, record_id, keys``. A question's keys are its number, its assembled text and its forms; a
    transition's are its question's number and text. Rows with neither get a key of their own."""
    forms = question_keys(questions)
    number = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit("id"), F.col(c)))
    body = spectrum_question(F.col("context"), F.col("question"), F.col("choices"))
    asked = questions.select(F.lit("questions").alias("table_name"), F.col("question_id").alias("record_id"), F.array(number("question_id"), _text_key(F.when(F.col("question").isNotNull(), body))).alias("own"), F.col("question_id"))
    asked = asked.join(forms, "question_id", "left").select("table_name", "record_id", F.concat("own", F.coalesce("keys", F.array().cast("array<bigint>"))).alias("keys"))
    rows = transitions.select(F.lit("transitions").alias("table_name"), F.col("row_no").alias("record_id"), F.array(number("question_id"), _text_key(F.col("question"))).alias("keys"))
    every = asked.unionByName(rows).withColumn("keys", F.array_distinct(F.filter("keys", lambda k: k.isNotNull())))
    return every.withColumn("keys", F.when(F.size("keys") == 0, F.array(F.xxhash64("table_name", "record_id"))).otherwise(F.col("keys")))


def same_questions(questions: DataFrame) -> DataFrame:
    """``question_id_a < question_id_b``: all pairs of rows asking the same, through the component table."""
    member = question_groups(questions)
    a, b = member.withColumnRenamed("question_id", "question_id_a"), member.withColumnRenamed("question_id", "question_id_b")
    return a.join(b, "component").where("question_id_a < question_id_b").select("question_id_a", "question_id_b")


def question_groups(questions: DataFrame) -> DataFrame:
    """``component, question_id`` of every question that another row asks, too: pairs without being spelt out."""
    forms = checkpointed(question_keys(questions))
    nodes = connected(key_links(forms.select("keys")))
    member = spread(forms.select("question_id", F.col("keys")[0].alias("node")), nodes, "node").select("component", "question_id").distinct()
    return checkpointed(spread(member, member.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "component").drop("size"))
