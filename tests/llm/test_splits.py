"""Components against union-find, keys on rewritten questions, and splits that stay."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm import questions as Q
from tracewright.llm import splits as S

TARGETS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components_are_union_find(spark, shape):
    rng = random.Random(4)
    pairs = {"random": [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(180)], "path": [(i, i + 1) for i in rng.sample(range(120), 120)], "star": [(7, i) for i in range(60)] * 2}[shape]
    got = {r.node: r.component for r in S.connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == union_find(pairs)


def test_no_links(spark):
    assert S.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def records(spark, groups, start=0):
    return spark.createDataFrame([(start + i, keys, "x") for i, keys in enumerate(groups)], "record_id int, keys array<bigint>, split_note string")


def test_splits_stay_and_conflicts_are_quarantined(spark):
    first, table = S.split_records(records(spark, [[i] for i in range(400)]), TARGETS)
    before = {r.component: r.split for r in first.collect()}
    counts = {s: list(before.values()).count(s) for s in TARGETS}
    assert abs(counts["train"] - 320) <= 2 and abs(counts["test"] - 40) <= 2
    train = [c for c, s in before.items() if s == "train"]
    test = [c for c, s in before.items() if s == "test"]
    fresh = [[train[0], 1000], [train[1], train[2]], [train[3], test[0]], [2000, 2001], *[[3000 + i] for i in range(196)]]
    second, more = S.split_records(records(spark, fresh, 1000), TARGETS, table, batch=2)
    whole = table.plus(more)
    after = {r.node: r.split for r in whole.table().collect()}
    assert {r.node for r in more.nodes.collect()} == {1000, 2000, 2001, *range(3000, 3196)}  # no stored key is written again
    sizes = {r["split"]: r["n"] for r in whole.states().groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert sum(sizes.values()) == 600 and sizes[S.QUARANTINE] == 3 and abs(sizes["train"] - 0.8 * 597) <= 2 and abs(sizes["test"] - 0.1 * 597) <= 2
    assert after[1000] == after[train[0]] == "train" and after[train[1]] == after[train[2]] == "train"
    assert after[train[3]] == after[test[0]] == S.QUARANTINE
    assert after[2000] == after[2001] and all(after[c] == s for c, s in before.items() if c not in (train[3], test[0]))
    by_record = {r.record_id: r.split for r in second.collect()}
    assert len(by_record) == 200 and by_record[1002] == S.QUARANTINE


def test_table_is_kept(spark, tmp_path):
    folder = str(tmp_path / "components")
    assert S.stored_components(spark, folder) is None
    S.split_into(records(spark, [[i] for i in range(50)]), TARGETS, folder)
    before = {r.node: r.split for r in S.stored_components(spark, folder).table().collect()}
    S.split_into(records(spark, [[i, 100 + i] for i in range(50)]).withColumn("split", F.lit("clash")).withColumn("component", F.lit(1)), TARGETS, folder)
    after = {r.node: r.split for r in S.stored_components(spark, folder).table().collect()}
    assert len(after) == 100 and all(after[i] == after[100 + i] == before[i] for i in range(50))


def test_many_batches_are_one(spark, tmp_path):
    """Components after many small batches, with and without a table written anew between, are those of all records at once."""
    rng = random.Random(9)
    groups = [[rng.randrange(60), rng.randrange(60, 90)] for _ in range(50)]
    want = union_find([(a, b) for a, b in groups])
    folder = str(tmp_path / "c")
    for at in range(0, 50, 17):
        S.split_into(records(spark, groups[at : at + 17]), TARGETS, folder, compact_every=2)
    stored = S.stored_components(spark, folder)
    got = {r.node: r.component for r in stored.present().collect()}
    assert got == want
    assert stored.states().agg(F.sum("n")).first()[0] == 50 and stored.states().count() == len(set(want.values()))


def test_hot_component_and_repeated_rows(spark):
    rows = [[1]] * 300 + [[1, 2]] * 30 + [[i] for i in range(10, 680)]
    got, _ = S.split_records(records(spark, rows), TARGETS)
    splits = got.groupBy("split").count().collect()
    share = {r["split"]: r["count"] / 1000 for r in splits}
    assert got.count() == 1000 and abs(share["train"] - 0.8) < 0.01 and abs(share["test"] - 0.1) < 0.01
    assert got.where(F.array_contains("keys", 1)).select("split").distinct().count() == 1


def test_empty(spark):
    got, table = S.split_records(records(spark, [[1]]).limit(0), TARGETS)
    assert got.count() == 0 and table.table().count() == 0


BASE = "Last Tuesday the garden sold 862 brushes, and Gorim added 457 cards. Norra pays for 6 of these sets. How many cards are left at the end?"
SAME = [
    "norra pays for 6 of these sets. last tuesday the garden sold 862 brushes, and gorim added 457 cards. how many cards are left at the end?",
    "LAST TUESDAY THE GARDEN SOLD 862 BRUSHES AND GORIM ADDED 457 CARDS NORRA PAYS FOR 6 OF THESE SETS HOW MANY CARDS ARE LEFT AT THE END",
    "Please solve: This past Tuesday the garden sold 862 brushes, as well as Gorim added 457 cards. Norra pays for 6 of these sets. What number of cards remain at the end? Thanks!",
    "[exercise]  Last Tuesday the gardn sold 862\nbrushes, and Gorim aded 457 cards . Norra pays for 6 of these sets . How many cards are left at the end ??",
    "Last ​Tuesday the garden sold ８６２ brushes, and Gorim added 457 cards. Norra pays for 6 of theese sets. How many cards are left at the end?",
]
OTHER = [
    BASE.replace("862", "863"), BASE.replace("862", "457").replace("457 cards", "862 cards"), BASE.replace("Gorim", "Norra"), BASE.replace("brushes", "cards"),
    BASE.replace("How many cards", "How many brushes"), BASE.replace("are left at the end", "does each group get"),
]


def test_same_questions(spark):
    filler = [BASE, *OTHER] * 2
    texts = [BASE, *SAME, *OTHER]
    rows = [(i, t, "en", "c") for i, t in enumerate(texts)] + [(100 + i, f"{t} {i}", "en", "c") for i, t in enumerate(filler)] + [(900, None, "en", "c"), (901, "", None, "c"), (902, "?!", "en", "c"), (903, "?!", "en", "c")]
    df = spark.createDataFrame(rows, "question_id int, question string, lang string, component string")
    got = {(r.question_id_a, r.question_id_b) for r in S.same_questions(df).collect()}
    n = 1 + len(SAME)
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n)}


LONG = ["Marvo buys 31 plates.", "The workshop adds 208 candles.", "Emko takes away 17 of them.", "Norra pays for 6 sets.", "Gorim counts 94 cards.", "How many plates are left?"]


def test_many_sentences_without_points(spark):
    """Six sentences in three orders, one of them without points, and a look-alike that isn't: persons swapped."""
    swapped = [x.replace("Marvo", "#").replace("Emko", "Marvo").replace("#", "Emko") for x in LONG]
    bare = lambda parts: " ".join(parts).replace(".", "").replace("?", "").lower()
    texts = [" ".join(LONG), " ".join(LONG[::-1]), bare([LONG[3], LONG[0], LONG[5], LONG[1], LONG[4], LONG[2]]), " ".join(swapped), bare(swapped)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "question_id int, question string, lang string")
    got = {(r.question_id_a, r.question_id_b) for r in S.same_questions(df).collect()}
    assert got == {(0, 1), (0, 2), (1, 2), (3, 4)}


def test_more_readings_than_are_keyed(spark):
    """Five words that can each be read in two ways give 32 readings; the form still meets the plain one, and no other."""
    pairs = [("bake", "cake"), ("land", "sand"), ("book", "look"), ("ring", "king"), ("hill", "mill")]
    plain = [" ".join(p[k] for p in pairs) + " 12 7" for k in (0, 1)]
    filler = [f"{a} {b} {i} {i + 1}" for i in range(8) for a, b in pairs]
    odd = " ".join("x" + p[0][1:] for p in pairs) + " 12 7"
    texts = [plain[0], odd, odd.replace("12 7", "12 8"), *filler]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "question_id int, question string, lang string")
    assert Q.Form(odd, "en", Q.Speller({"en": {w: 9 for p in pairs for w in p}})).count == 32
    got = {(r.question_id_a, r.question_id_b) for r in S.same_questions(df).collect()}
    assert got == {(0, 1)}


def test_slips():
    assert all(Q.one_slip("garden", w) for w in ["gardn", "gardden", "gadren", "garten", "garden"])
    assert not any(Q.one_slip("garden", w) for w in ["grden s", "gadenr", "gar", "gardenss"])


def test_splits_keep_questions_together(spark, sf):
    from tracewright.llm.queries import p1_found, p1_splits

    t = spark.read.parquet(f"{sf}/transitions.parquet")
    rows = p1_splits(spark, sf)
    assert rows.count() == t.count()
    named = rows.join(t.select("row_no", "question_id", "question"), "row_no")
    assert named.where("question_id IS NOT NULL").groupBy("question_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert named.groupBy("question").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    pairs = p1_found(spark, sf)
    by_question = named.select("question_id", "split").distinct()
    a, b = by_question.toDF("question_id_a", "a"), by_question.toDF("question_id_b", "b")
    assert pairs.join(a, "question_id_a").join(b, "question_id_b").where("a <> b").count() == 0
