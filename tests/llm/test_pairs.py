"""Defects of pairs, and the alignment against plain dynamic programming."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm import language, pairs


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(80))] for _ in range(2))
        assert pairs.lcs(a, b) == plain_lcs(a, b)


@pytest.fixture(scope="module")
def field(spark, sf):
    asked = spark.read.parquet(f"{sf.rpartition('/')[0]}/sf0.1/questions.parquet").withColumn("said", F.concat_ws("\n", "question", "reference_solution"))
    return language.fit(language.labelled_sample(asked, "question_id", "said", language.normal_label(F.col("lang"))))


QUESTION = "A garden keeps 281 cards next to 219 towels. Gorim pays for 5 of these sets. How many times can Fenja fill the cart?"
PROMPT = f"Question:\nSome answers stop early.\n\n{QUESTION}\n\nOptions:\n(A) 500\n(B) 62\nThe sum is 500.\n\nContinue with the next useful reasoning step:"
GOOD = ["Dividing 500 by 5 leaves 100 whole groups.", "It is a sorry sight, yet 3 pieces are lost for good.", "Nobody can help with the missing 3, so they are dropped.", "The sum is 500.", "5 x 4 = 20.", "The remainder is 6, which cannot fill another cart."]
BAD = {
    None: "empty", "": "empty", " \t​": "empty", "N/A": "empty", "<empty>": "empty", "...": "empty", "{}": "empty", "[no answer]": "empty", "\xa0": "empty", "—": "empty",
    "Sorry, I can’t provide a next step here.": "refusal", "Unfortunately, I'm unable to comply. Please consult a teacher instead.": "refusal",
    "Leider darf ich diese Frage nicht beantworten.": "refusal", "Je suis désolé, mais je ne suis pas en mesure d’aider avec cela.": "refusal", "No me es posible continuar aquí.": "refusal",
    QUESTION: "copies_question", QUESTION.upper().replace(".", ""): "copies_question", "The question says: How many times can Fenja fill the cart?": "copies_question", "Gorim pays for 5 of these sets.": "copies_question",
    "Die Muscheln tragen 890 zur Summe bei.": "other_language", "Después de restar quedan todavía 827 piezas.": "other_language",
    "Dividing 500 by 5 leaves 100 who…": "truncated", "Dividing 500 by 5 leaves 100 who": "truncated",
}


def test_defects(spark, field):
    filler = [f"{x} {y}" for x in GOOD for y in GOOD] * 3
    rows = [("t", i, PROMPT, c) for i, c in enumerate(BAD)] + [("t", 1000 + i, PROMPT, c) for i, c in enumerate(GOOD + filler)] + [("u", 0, None, GOOD[0]), ("u", 1, "", None)]
    df = spark.createDataFrame(rows, "pair_table string, pair_id int, prompt string, completion string").withColumn("source", F.lit("s")).withColumn("defect", F.lit("clash"))
    got = {(r.pair_table, r.pair_id): r.defect for r in pairs.defective_pairs(df, field).collect()}
    assert got == {("t", i): d for i, d in enumerate(BAD.values())} | {("u", 1): "empty"}
    assert pairs.defective_pairs(df.limit(0), field).count() == 0


def aligned_anywhere(text):
    got = pairs.words(text)
    ts = [pairs.words(x) for x in pairs.REFUSALS]
    return any(plain_lcs(t, got[i : i + len(t) + 2]) >= 0.8 * len(t) for t in ts for i in range(len(got)))


def test_refusal_anywhere():
    steps = "Dividing 500 by 5 leaves 100 whole groups and the 3 that are left go to the next box. " * 4
    for text in ("No te puedo ayudar con esta petición.", "I am not going to answer.", "I have to refuse this request.", "Sorry, I can't\nhelp  with\n\nthis.", "I  must\ndecline  to solve this."):
        assert pairs.is_refusal(text) and pairs.is_refusal(steps + text) and pairs.is_refusal(steps + text + " " + steps), text
    assert not pairs.is_refusal(steps) and not any(map(pairs.is_refusal, GOOD))


def test_refusals_are_brute_force():
    rng = random.Random(4)
    vocabulary = [w for x in pairs.REFUSALS for w in pairs.words(x)]
    seen = set()
    for _ in range(1500):
        t = pairs.words(rng.choice(pairs.REFUSALS))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + t[i + 1 :], [*t[:i], "so", *t[i:]], [*t[:i], rng.choice(vocabulary), *t[i + 1 :]]]) or t
        text = " ".join([*rng.choices(["step", "sum", "i", "no", "ich"], k=rng.randrange(60)), *t, *rng.choices(["box", "je", "this"], k=rng.randrange(20))])
        want = aligned_anywhere(text)
        assert pairs.is_refusal(text) == want, text
        seen.add(want)
    assert seen == {True, False}


def test_question_of():
    assert pairs.question_of(PROMPT).endswith(QUESTION) and "sum is" not in pairs.question_of(PROMPT)
    assert pairs.question_of("Question:\nWhat is 2 + 3?\nFirst step.\nSecond step.") == "What is 2 + 3?"


def test_long_pair(spark, field):
    text = "One long step about the sum of the boxes. " * 4000
    df = spark.createDataFrame([("t", 1, text, text), ("t", 2, PROMPT, text)], "pair_table string, pair_id int, prompt string, completion string").withColumn("source", F.lit(None).cast("string"))
    assert {r.pair_id: r.defect for r in pairs.defective_pairs(df, field).collect()} == {1: "copies_question"}
